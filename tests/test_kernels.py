import numpy as np
import pytest

from tapeline.operators import kernels
from tapeline.plans import registry
from tests.test_operators import frame


def test_legs():
    assert [(x[0], x[1], x[4]) for x in kernels.legs(np.arange(100, 130.0))] == [(0, 29, "up")]
    v = np.concatenate([np.arange(120, 100.0, -1), np.arange(100, 121.0)])
    assert [x[4] for x in kernels.legs(v)][0] == "down" and kernels.legs(v)[-1][4] == "up"
    assert {x[4] for x in kernels.legs(np.full(20, 100.0))} == {"flat"} and kernels.legs(np.array([1.0])) == []


def test_density():
    grid, d = kernels.density(np.linspace(-80, 80, 11), np.linspace(5, 95, 11))
    assert (d >= 0).all() and float(((d[1:] + d[:-1]) / 2 * np.diff(grid)).sum()) == pytest.approx(1, abs=0.03) and d[0] < d.max() / 4 > d[-1]


def test_monotone_slopes():
    x = np.array([0.0, 1.0, 3.0, 4.0])
    assert kernels.monotone_slopes(x, 2 * x) == pytest.approx([2, 2, 2, 2])
    # harmonic mean 2 / (1/1 + 1/3) of equal widths; ends by the outer parabola, never below 0
    assert kernels.monotone_slopes(np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 4.0])) == pytest.approx([0, 1.5, 4])
    assert kernels.monotone_slopes(np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 0.0]))[1] == 0


def test_legs_of_odd_length_and_net_move():
    assert kernels.legs(np.array([100.0, 100.0, 100.0]))[-1][1] == 2
    assert [x[4] for x in kernels.legs(np.array([100.0, 100.05, 100.0, 100.05, 100.05]), tol_pct=5)] == ["flat"]


def test_registry(spark):
    x = frame(spark, range(1, 60))
    assert registry.run("analyze_swing_levels", x, k=99).count() == 0
    assert registry.run("analyze_daily_trend", x).first().trend == "bullish"
    assert registry.run("current_leg", x).count() >= 1
    for bad in (lambda: registry.run("nope", x), lambda: registry.run("analyze_daily_trend", x, z=1)):
        with pytest.raises(ValueError):
            bad()


def test_every_tool_runs(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 2, 15, 0)
    x = frame(spark, range(1, 60))
    closes = spark.createDataFrame([(s, t0 + dt.timedelta(days=k), 15.0 + k % 3) for s in ("VIX", "VIX3M", "SPY") for k in range(30)], "symbol string, t timestamp, c double")
    news = spark.createDataFrame([(k, "X", t0 + dt.timedelta(minutes=k)) for k in range(40)], "id long, symbol string, created_at timestamp")
    plans = spark.createDataFrame([(100.0, 98.0, 4.0, 2.0, 103.0, 104.0, 1.0, "long", 110.0)], "entry double, stop double, base_height double, atr double, resistance double, vwap double, deviation double, side string, target double")
    quotes = spark.createDataFrame([("X", t0, 9.0, 10.0), ("X", t0 + dt.timedelta(hours=1), 9.9, 10.0), ("Y", t0, 1.0, 0.5)], "symbol string, t timestamp, bp double, ap double")
    inputs = {"analyze_market": closes, "get_news": news, "get_quote": quotes, **dict.fromkeys(("breakout_trade_geometry", "vwap_reversion_geometry", "smart_money_trade_geometry"), plans)}
    inputs["get_analyst_targets"] = spark.createDataFrame([(f"f{k % 9}", dt.date(2024, 1, 1 + k), 10.0 + k, k) for k in range(20)], "firm string, date date, target double, id long")
    inputs["get_corporate_actions"] = spark.createDataFrame([("X", '{"splits": [{"ex_date": "2024-01-03", "rate": "2"}]}')], "symbol string, json string")
    inputs["get_put_call_walls"] = spark.createDataFrame([("X", 10.0, 5, 3, 0.2)], "symbol string, strike double, call_oi long, put_oi long, iv double")
    for name in registry.TOOLS:
        registry.run(name, inputs.get(name, x)).count()
    assert registry.run("get_news", news, as_of=dt.datetime(2024, 1, 2, 15, 20), n=99).agg({"id": "max"}).first()[0] == 19
    assert registry.run("get_news", news, n=99).count() == 30 and registry.run("get_news", news, n=-5).count() == 1
    assert {r.symbol: r.warnings for r in registry.run("get_quote", quotes).collect()} == {"X": "wide" if 0.1 / 9.95 * 100 > 1 else "", "Y": "crossed; stale"}
    assert [r.target for r in registry.run("get_analyst_targets", inputs["get_analyst_targets"], n=2).collect()] == [29.0, 28.0]
    assert registry.run("breakout_trade_geometry", plans).first().geometry.meets


def test_opening_range_that_is_not_covered(spark):
    import datetime as dt

    from tapeline.operators import levels

    def day(first, n, last=100.0):
        t = dt.datetime(2024, 7, 2, 13, 30) + dt.timedelta(minutes=first)  # 09:30 in New York in summer
        return spark.createDataFrame([("X", t + dt.timedelta(minutes=k), 100.0, 101.0, 99.0, last if k == n - 1 else 100.0, 10 if k < 15 else 30) for k in range(n)], "symbol string, t timestamp, o double, h double, l double, c double, v long")

    late = levels.opening_breakout(day(4, 60)).first()
    assert late.note == "bars do not reach back to the open" and late.high is None and late.status is None
    forming = levels.opening_breakout(day(0, 10)).first()
    assert (forming.note, forming.complete, forming.status, forming.n, forming.volume_ratio) == (None, False, "still forming", 10, None)
    above = levels.opening_breakout(day(0, 30, 102.0)).first()
    assert (above.complete, above.status, above.high, above.volume_ratio) == (True, "broken out above", 101.0, 3.0)
    assert levels.opening_breakout(day(0, 30)).first().status == "inside_range" and levels.opening_breakout(day(-30, 20)).count() == 0


def test_grounding_of_numbers(spark):
    from tapeline.operators import records

    rows = [(1, 1, "user", "price 1,234.50 and 40"), (1, 2, "assistant", "it is 1234.5, or 39.8, or 55"), (1, 3, "user", "55"), (1, 4, "assistant", "55 again, and 5"), (2, 1, "assistant", "100 alone"), (3, 1, "user", "77"), (4, 1, "assistant", None)]
    got = {r.conv_id: (r.n, r.grounded) for r in records.grounding(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {1: (4, 3), 2: (1, 0)}


def test_gap_filling_needs_a_sane_step(spark):
    import datetime as dt

    from tapeline.operators import bars

    t = dt.datetime(2024, 1, 2)
    rows = [("X", t, 1.0, 1.0, 1.0, 1.0, 1, 1.0), ("X", t + dt.timedelta(microseconds=1), 1.0, 1.0, 1.0, 1.0, 1, 1.0), ("X", t + dt.timedelta(hours=1), 1.0, 1.0, 1.0, 1.0, 1, 1.0)]
    with pytest.raises(Exception, match="too close together"):
        bars.fill_gaps(spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v long, vw double")).count()


def test_closing_row_completes_the_stream_rollup(spark, tmp_path):
    import datetime as dt

    from tapeline.operators import bars
    from tapeline.streaming import bars as stream

    t = dt.datetime(2024, 1, 1)
    rows = [(k, "XY"[k % 2], t + dt.timedelta(minutes=7 * (k // 2)), float(k * 37 % 11), 1 + k % 5) for k in range(60)]
    schema = "id long, symbol string, t timestamp, p double, s long"
    spark.createDataFrame([*rows, (99, "X", t + dt.timedelta(days=2), 1.0, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in stream.run_available(stream.rollup(src, 60), "closed", str(tmp_path / "c")).collect()}
    assert got == {tuple(r)[:-1] for r in bars.rollup(spark.createDataFrame(rows, schema), 60).collect()}
