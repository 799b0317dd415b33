"""Price and macro context, walls, expiries, news, candles, gate and target lines, with golden values."""

import datetime as dt

import pytest

from tapeline.operators import context as X
from tapeline.operators import options

DAY = dt.datetime(2024, 6, 30)


def closes(spark, symbol_values, step=1):
    """The last value is of the day before DAY, the others lie `step` days apart before it."""
    rows = [(s, DAY - dt.timedelta(days=1 + step * (len(v) - 1 - k)), c) for s, v in symbol_values.items() for k, c in enumerate(v)]
    return spark.createDataFrame(rows, "symbol string, t timestamp, c double")


def test_price_context(spark):
    c = closes(spark, {"A": [80.0, 50.0, 100.0, 110.0], "B": [1.0, None, 2.0], "C": [5.0], "D": [0.0, 3.0]}, step=20)
    got = {(r.symbol, r.days): (r.change_pct and round(r.change_pct, 6), r.low, r.high, r.last) for r in X.price_context(c, "2024-06-30").collect()}
    assert got == {
        ("A", 30): (10.0, 100.0, 110.0, 110.0), ("A", 90): (37.5, 50.0, 110.0, 110.0), ("A", 365): (37.5, 50.0, 110.0, 110.0),
        ("B", 90): (100.0, 1.0, 2.0, 2.0), ("B", 365): (100.0, 1.0, 2.0, 2.0),
        ("D", 30): (None, 0.0, 3.0, 3.0), ("D", 90): (None, 0.0, 3.0, 3.0), ("D", 365): (None, 0.0, 3.0, 3.0),
    }
    assert X.price_context(c.limit(0), "2024-06-30").count() == 0


@pytest.mark.parametrize("vix, vix3m, regime, term", [(35.0, 30.0, "fear/spike", "backwardation"), (30.0, 31.0, "elevated", "contango"), (20.0, 20.0, "moderate", "backwardation"), (15.0, None, "complacency", None), (None, 20.0, None, None)])
def test_macro_context(spark, vix, vix3m, regime, term):
    series = {"SPY": [100.0 + k for k in range(20)], **({"VIX": [1.0, vix]} if vix else {}), **({"VIX3M": [vix3m]} if vix3m else {})}
    [r] = X.macro_context(closes(spark, series), "VIX", "VIX3M", "SPY", "2024-06-30").collect()
    assert (r.vix, r.regime, r.term_structure, r.index_close) == (vix, regime, term, 119.0)
    assert r.vix3m == (vix3m if vix else None) and r.index_week_pct == pytest.approx(4 / 115 * 100) and r.index_month_pct == pytest.approx(19.0)


def test_macro_context_of_few_closes(spark):
    [r] = X.macro_context(closes(spark, {"SPY": [1.0] * 4}), "VIX", "VIX3M", "SPY", "2024-06-30").collect()
    assert all(v is None for v in r)
    [r] = X.macro_context(closes(spark, {"SPY": [2.0] * 19}), "VIX", "VIX3M", "SPY", "2024-06-30").collect()
    assert (r.index_week_pct, r.index_month_pct) == (0.0, None)


def test_walls_read(spark):
    rows = [("A", 90.0, 5, 50, 0.2), ("A", 100.0, 20, 20, 0.2), ("A", 110.0, 60, 5, 0.2), ("B", 110.0, 1, 9, 0.2), ("B", 90.0, 9, 1, 0.2), ("C", 100.0, 1, 1, 0.0)]
    chain = spark.createDataFrame(rows, "symbol string, strike double, call_oi long, put_oi long, iv double")
    history = spark.createDataFrame([("A", 1, 105.0, 95.0), ("A", 2, 1.0, 1.0), ("A", 3, 110.0, 90.0), ("B", 1, 1.0, 1.0), ("C", 1, 5.0, None), ("C", 2, 5.0, 4.0)], "symbol string, taken long, call_wall double, put_wall double")
    got = {r.symbol: r for r in X.wall_read(options.gamma_exposure(chain, 95.0), 95.0, history).collect()}
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.call_wall, a.put_wall, a.position, a.range_position_pct, a.call_wall_trend, a.put_wall_trend) == (110.0, 90.0, "inside", 25.0, "rising", "falling")
    assert (b.position, b.range_position_pct, b.call_wall_trend) == ("above", None, None)
    assert (c.position, c.range_position_pct, c.gamma_regime, c.call_wall_trend, c.put_wall_trend) == ("below", None, "dampening", "flat", None)
    near = X.wall_read(options.gamma_exposure(chain, 109.5), 109.5).where("symbol = 'A'").first()
    assert near.near_call_wall and not near.near_put_wall and near.call_wall_trend is None


def test_nearest_expiry(spark):
    day = lambda k: DAY.date() + dt.timedelta(days=k)
    rows = [("in", day(-1)), ("in", day(45)), ("in", day(0)), ("late", day(-3)), ("late", day(46)), ("late", day(90)), ("past", day(-9)), ("past", day(-2)), ("none", None)]
    got = {r.symbol: r.dte for r in X.nearest_expiry(spark.createDataFrame(rows, "symbol string, expiry date"), "2024-06-30").collect()}
    assert got == {"in": 0, "late": 46, "past": -9}


def test_chosen_and_labelled_news(spark):
    news = spark.createDataFrame([(1, "Up", "Big"), (2, "UP", "big"), (3, "down", "x"), (4, None, "y")], "id long, title string, text string")
    picks = spark.createDataFrame([(7, "uP", "bIg"), (8, "down", "z"), (9, None, "y")], "pick long, title string, text string")
    assert [(r.pick, r.id, r.title) for r in X.chosen_news(news, picks).collect()] == [(7, 2, "UP")]
    labels = spark.createDataFrame([(1, "bullish"), (9, "bearish"), (3, None)], "id long, impact string")
    assert {r.id: r.impact for r in X.labelled_news(news, labels).collect()} == {1: "bullish", 2: "unknown", 3: "unknown", 4: "unknown"}


def test_candle_bodies(spark):
    at = lambda k: DAY + dt.timedelta(minutes=k)
    bars = spark.createDataFrame([("A", at(0), 10.0, 20.0, 0.0, 12.0), ("A", at(5), 12.0, 14.0, 4.0, 6.0)], "symbol string, t timestamp, o double, h double, l double, c double")
    trades = spark.createDataFrame([("A", at(1), 1.0), ("A", at(4), 11.0), ("B", at(6), 1.0)], "symbol string, t timestamp, p double")
    first, second = X.candle_bodies(bars, trades).orderBy("t").collect()
    assert (first.rising, first.base, first.height, first.p20, first.p80, first.from_trades) == (True, 10.0, 2.0, 3.0, 9.0, True)
    assert (second.rising, second.base, second.height, second.p20, second.p80, second.from_trades) == (False, 6.0, 6.0, 6.0, 12.0, False)


def test_breakout_gate(spark):
    when = [dt.datetime(2024, 7, 1, 14, 0), dt.datetime(2024, 7, 1, 16, 30), dt.datetime(2024, 7, 2, 14, 0), dt.datetime(2024, 7, 1, 15, 30), dt.datetime(2024, 7, 6, 15, 0), None]
    moments = spark.createDataFrame([(k, t) for k, t in enumerate(when)], "id long, t timestamp")
    ranges = spark.createDataFrame([("A", "2024-07-01", 2.0), ("B", "2024-07-01", 3.0), ("A", "2024-07-02", None)], "symbol string, day string, high double")
    window, none = "window does not favour breakouts", "no symbol has an opening range"
    assert {r.id: r.refused for r in X.breakout_gate(moments, ranges).collect()} == {0: None, 1: window, 2: none, 3: None, 4: window, 5: window}


def test_target_steps(spark):
    rows = [("U", dt.date(2024, 1, 1), 90.0, 1), ("U", dt.date(2024, 3, 1), 110.0, 3), ("U", dt.date(2024, 3, 1), 100.0, 2), ("U", dt.date(2024, 9, 1), 120.0, 4), ("V", dt.date(2024, 2, 2), None, 5)]
    got = X.target_steps(spark.createDataFrame(rows, "firm string, date date, target double, id long"), "2024-02-01", "2024-06-30", 100.0).orderBy("firm", "step").collect()
    assert [(r.step, str(r.moment)[5:], r.target, round(r.pct, 6)) for r in got] == [(1, "02-01", 90.0, -10.0), (2, "03-01", 100.0, 0.0), (3, "03-01", 110.0, 10.0), (4, "06-30", 120.0, 20.0), (5, "06-30", 120.0, 20.0)]
    assert {r.firm for r in got} == {"U"}
