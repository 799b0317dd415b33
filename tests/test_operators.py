import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.functions.clock import session_window
from tapeline.operators import bars, folds, indicators, levels, options, records, rules, scoring, structure
from tapeline.sources import views
from tapeline.streaming import bars as stream


def frame(spark, closes, spread=0.5, v=1000):
    rows = [("X", dt.datetime(2024, 1, 2, 14, 30) + dt.timedelta(minutes=k), c, c + spread, c - spread, float(c), v) for k, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v long")


def last(df, c):
    return df.orderBy(F.desc("t")).first()[c]


def test_golden_indicators(spark):
    assert last(indicators.sma(frame(spark, range(1, 6)), 3), "sma") == 4.0
    assert last(indicators.rsi(frame(spark, range(1, 10)), 5), "rsi") == 100.0
    assert last(indicators.atr(frame(spark, [100] * 16, 1.0)), "atr") == 2.0
    assert last(indicators.obv(frame(spark, range(1, 9)), 5), "obv_trend") == "rising"
    assert last(indicators.adx(frame(spark, range(1, 41))), "adx") >= 25
    assert last(indicators.trend(frame(spark, [100 + k / 2 for k in range(70)])), "trend") == "bullish"


def test_short_and_empty(spark):
    x = frame(spark, [1, 2])
    assert last(indicators.sma(x, 3), "sma") is None
    for op in (indicators.rsi, indicators.adx, levels.volume_profile, levels.filled_gaps, indicators.vwap_bands):
        assert op(x.limit(0)).count() == 0


def candles(spark, ohlc):
    rows = [("X", dt.datetime(2024, 1, 2, 14, 30) + dt.timedelta(minutes=k), *map(float, x), 1000) for k, x in enumerate(ohlc)]
    return spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v long")


def test_zones(spark):
    flat = [(100, 101, 99, 100)] * 5
    # the sixth candle falls, the next one's high passes the swing high; the one after the look-ahead returns into the zone
    rise = [*flat, (100, 100.5, 98.00004, 99), (99, 104, 98.9, 103), (103, 105, 102, 104), (104, 106, 103, 105), (105, 105, 100, 101)]
    got = structure.order_blocks(candles(spark, rise)).collect()
    assert [(r.kind, r.bottom, r.top, r.mitigated) for r in got] == [("bullish", 98.0, 100.5, True)]
    assert structure.order_blocks(candles(spark, rise[:8])).count() == 0  # no full look-ahead behind it
    gaps = [(1, 2, 1, 2), (2, 4, 2, 4), (4, 6, 3.00004, 5), (5, 6, 4, 5), (5, 5, 2.5, 3)]
    assert [(r.kind, r.bottom, r.top, r.filled) for r in levels.filled_gaps(candles(spark, gaps)).collect()] == [("bullish", 2.0, 3.0, True)]
    steps = [(10 * k, 10 * k + 1, 10 * k, 10 * k + 1) for k in range(1, 15)]
    assert levels.filled_gaps(candles(spark, steps)).count() == 6
    for close, zone, inside in ((104.4, "discount", False), (105, "equilibrium", False), (105.6, "premium", False), (103, "discount", True)):
        r = levels.premium_discount(candles(spark, [(100, 110, 100, 100), (100, 110, 100, close)])).first()
        assert (r.zone, r.in_retracement) == (zone, inside)
    assert levels.premium_discount(candles(spark, [(1, 1, 1, 1)])).first().zone is None
    assert structure.momentum(frame(spark, [1, 2, 3])).first().pattern == "not enough bars"
    assert structure.momentum(frame(spark, [1, 2, 3, 4])).first().pattern == "higher highs and lows"


def test_ties_follow_the_id(spark):
    t = dt.datetime(2024, 1, 2)
    d = spark.createDataFrame([("X", t, float(p), 1, k) for k, p in ((3, 30), (1, 10), (2, 20))], "symbol string, t timestamp, p double, s long, id long")
    assert [(r.o, r.c) for r in bars.rollup(d, 60).collect()] == [(10.0, 30.0)]


def test_pivots(spark):
    rows = [("X", dt.datetime(2024, 1, k), 0.0, 110.0, 100.0, 105.0, 1) for k in (1, 2)]
    d = spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v long")
    assert {r.level: r.price for r in levels.floor_pivots(d).collect()} == {"P": 105, "R1": 110, "S1": 100, "R2": 115, "S2": 95, "R3": 120, "S3": 90}


def test_gap_fill(spark):
    d = frame(spark, [101, 102, 103, 104, 105])
    assert [(r.c, r.v, r.synthetic) for r in bars.fill_gaps(d.where("c not in (103, 104)").withColumn("vw", F.col("c"))).orderBy("t").collect()] == [(101, 1000, False), (102, 1000, False), (102, 0, True), (102, 0, True), (105, 1000, False)]


def test_chain_sides(spark):
    a = spark.createDataFrame([("X", 95.0, 50.0, 0.3), ("X", 100.0, float("nan"), 0.3)], "symbol string, strike double, oi double, iv double")
    b = spark.createDataFrame([("X", 95.0, 700.0, 0.3), ("X", 105.0, 30.0, 0.3)], "symbol string, strike double, oi double, iv double")
    assert [(r.strike, r.call_oi, r.put_oi) for r in options.join_sides(a, b).orderBy("strike").collect()] == [(95.0, 50.0, 700.0), (100.0, 0.0, 0.0), (105.0, 0.0, 30.0)]


def test_records(spark):
    js = '{"cash_dividends": [{"ex_date": "2024-07-20"}], "forward_splits": [{"process_date": "2024-07-15"}], "name_changes": [{"x": "1"}]}'
    got = records.corporate_actions(spark.createDataFrame([("X", js)], "symbol string, json string")).collect()
    assert [(r.type, str(r.date)) for r in got] == [("forward_split", "2024-07-15"), ("cash_dividend", "2024-07-20"), ("name_change", "None")]
    one = spark.createDataFrame([("aapl, msft;Aapl  tsla",)], "s string").select(records.symbols(F.col("s")).alias("x")).first().x
    assert one == ["AAPL", "MSFT", "TSLA"]
    q = spark.createDataFrame([("X", dt.datetime(2024, 1, 1), 101.0, 100.0), ("Y", dt.datetime(2024, 1, 1), 0.0, 100.0)], "symbol string, t timestamp, bp double, ap double")
    assert [r.warnings for r in records.quote_quality(q, F.lit("2024-01-01 01:00:00")).orderBy("symbol").collect()] == ["crossed; stale", "stale"]


def test_clock(spark):
    times = {"2024-01-02 14:30:00": "opening_window", "2024-07-02 13:29:59": "outside_regular_hours", "2024-01-02 17:10:00": "midday_dead_zone", "2024-01-02 20:59:00": "power_hour", "2024-01-02 16:30:00": "other_session_hours", "2024-01-06 15:00:00": "outside_regular_hours"}
    d = spark.createDataFrame([(k,) for k in times], "s string").withColumn("t", F.to_timestamp("s"))
    assert {r.s: r.w for r in d.select("s", session_window(F.col("t")).alias("w")).collect()} == times


def test_folds(spark):
    o = [("a", 1, "X", "buy", 100.0, 10.0), ("a", 2, "X", "sell", 500.0, 11.0), ("a", 3, "X", "sell", 1.0, 11.0)]
    got = folds.paper_fills(spark.createDataFrame(o, "account string, seq long, symbol string, action string, quantity double, price double")).orderBy("seq").collect()
    assert [r.status for r in got] == ["filled", "filled", "rejected"] and got[0].filled == pytest.approx(99.885) and got[1].position_after == 0
    p = spark.createDataFrame([("X", 1, 5), ("X", 4, 9), ("X", 9, 9), ("X", 20, 1)], "symbol string, i int, v int")
    assert sorted(r.i for r in folds.suppress_neighbours(p).collect()) == [4, 20]
    v = spark.createDataFrame([("X", k, n) for k, n in enumerate([1, 5, 10, 5, 1])], "symbol string, bin int, v long")
    assert [(r.low_bin, r.high_bin) for r in folds.value_area(v).collect()] == [(1, 3)]


def test_fallback_and_rules(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, x string")
    assert sorted((r.k, r.x) for r in views.latest_by_rank(a, b, keys=["k"]).collect()) == [(1, "a"), (2, "b")]
    runs = rules.held(frame(spark, [1, 5, 6, 1, 7]), F.col("c") > 4).orderBy("start").collect()
    assert [r.n for r in runs] == [2, 1]


def test_streaming_twins(spark, tmp_path):
    rows = [(k, "XY"[k % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k), 100.0 + (k * 37 % 11), 1 + k % 5) for k in range(120)]
    d = spark.createDataFrame(rows + rows[:5], "id long, symbol string, t timestamp, p double, s long")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = {(r.symbol, r.t): (r.o, r.h, r.l, r.c, r.v) for r in stream.run_available(stream.rollup(src, 60), "rolled", str(tmp_path / "c1")).collect()}
    want = {(r.symbol, r.t): (r.o, r.h, r.l, r.c, r.v) for r in bars.rollup(spark.createDataFrame(rows, d.schema), 60).collect()}
    assert len(got) >= len(want) - 4 and all(want[k] == v for k, v in got.items())
    stops = stream.run_available(stream.trailing_stop(src.select("symbol", "t", "p")), "stops", str(tmp_path / "c2")).collect()
    assert stops and all(r.p <= r.high * 0.95 for r in stops)


def test_gap_fill_keeps_short_and_odd_bars(spark):
    d = frame(spark, range(101, 108)).withColumn("vw", F.col("c"))
    assert bars.fill_gaps(d.where("c in (101, 105)")).where("synthetic").count() == 0
    odd = d.where("c in (101, 103, 106)")  # step 2 minutes: 105 is filled, 106 is off the grid
    assert [(r.c, r.synthetic) for r in bars.fill_gaps(odd).orderBy("t").collect()] == [(101, False), (103, False), (103, True), (106, False)]


def test_first_hit_clears_the_set(spark):
    rows = frame(spark, [1, 2, 3, 4]).select("symbol", "t", "c")
    alerts = spark.createDataFrame([("b", "X", "c", "above", 2.0, 1), ("a", "X", "c", "above", 2.0, 1), ("z", "X", "c", "above", 4.0, 2)], "alert_id string, symbol string, field string, condition string, threshold double, owner int")
    assert [(r.alert_id, r.value) for r in rules.fire(rows, alerts).collect()] == [("a", 2.0)]
    assert sorted(r.alert_id for r in rules.fire(rows, alerts, ("owner",)).collect()) == ["a", "z"]
    assert rules.fire(rows.limit(0), alerts).count() == 0


def test_consolidation_touches_and_coil(spark):
    base = candles(spark, [(100, 110, 90, 100)] * 20 + [(100, 101, 99, 100)] * 10)
    got = structure.consolidation(base).first()
    assert (got.base, got.contraction_pct, got.volume, got.touches_high, got.well_tested, got.coiling) == (2.0, 90.0, "flat", 10, True, True)
    assert structure.consolidation(base.limit(14)).count() == 0


def test_trade_geometries(spark):
    one, c = spark.range(1), lambda *x: [F.lit(float(k)) if k is not None else F.lit(None).cast("double") for k in x]
    g = one.select(scoring.breakout_geometry(*c(100, 98, 4, 2, 103)).alias("g")).first().g
    assert (g.target2_base, g.ratio1_base, g.ratio2_base, g.ratio1_atr, g.best, g.meets, g.ratio_at_resistance, g.room) == (108.0, 2.0, 4.0, 1.0, 4.0, True, 1.5, False)
    g = one.select(scoring.breakout_geometry(*c(100, 98, None, 0, 99)).alias("g")).first().g
    assert (g.best, g.meets, g.room) == (None, False, True)
    assert one.select(scoring.breakout_geometry(*c(100, 101, 4, 2, 103)).alias("g")).first().g is None
    g = one.select(scoring.reversion_geometry(*c(96, 100, 2), F.lit("Long")).alias("g")).first().g
    assert (g.stop, g.target, g.ratio, g.meets) == (94.0, 100.0, 2.0, True)
    assert one.select(scoring.reversion_geometry(*c(96, 100, 2), F.lit("short")).alias("g")).first().g is None
    g = one.select(scoring.block_geometry(*c(100, 99, 102)).alias("g")).first().g
    assert (g.ratio, g.meets) == (2.0, False)
