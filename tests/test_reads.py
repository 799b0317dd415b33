"""Golden values of the composite reads, nearest joins and stateful rules, and plain versions of the sequential ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import folds, joins, reads, rules
from tapeline.plans import registry
from tests.test_operators import frame

START = dt.datetime(2024, 1, 2, 14, 30)
BARS = "symbol string, t timestamp, o double, h double, l double, c double, v long"


def bars(spark, rows, step=1, symbol="X"):
    return spark.createDataFrame([(symbol, START + dt.timedelta(minutes=k * step), *map(float, x[:4]), int(x[4]) if len(x) > 4 else 1000) for k, x in enumerate(rows)], BARS)


def plain_sweep(rows, swing=3, recent=5):
    n, out = len(rows), None
    inside = range(swing, n - swing)
    lows = [(k, rows[k][2]) for k in inside if rows[k][2] == min(r[2] for r in rows[k - swing : k + swing + 1])]
    highs = [(k, rows[k][1]) for k in inside if rows[k][1] == max(r[1] for r in rows[k - swing : k + swing + 1])]
    for j in range(max(swing, n - recent), n) if n >= 2 * swing + 2 else ():
        _, h, low, c = rows[j][:4]
        under = next((p for k, p in lows if k < j and low < p < c), None)
        over = next((p for k, p in highs if k < j and c < p < h), None)
        if under is not None:
            out = ("bullish", round(under, 4), n - 1 - j)
        elif out is None and over is not None:
            out = ("bearish", round(over, 4), n - 1 - j)
    return out


def test_sweeps_match_a_plain_version(spark):
    rng, cases, rows = random.Random(5), {}, []
    for s in range(40):
        c = [100 + rng.randint(-6, 6) / 2 for _ in range(rng.choice([5, 8, 12, 30]))]
        cases[f"S{s}"] = [(x, x + rng.randint(1, 6) / 4, x - rng.randint(1, 6) / 4, x) for x in c]
        rows += [(f"S{s}", START + dt.timedelta(minutes=k), *x, 1) for k, x in enumerate(cases[f"S{s}"])]
    got = {r.symbol: (r.type, r.level, r.bars_ago) for r in reads.liquidity_sweeps(spark.createDataFrame(rows, BARS)).collect()}
    assert got == {s: w for s, x in cases.items() if (w := plain_sweep(x))} and {w[0] for w in got.values()} == {"bullish", "bearish"}


def test_swing_clusters_of_a_double_top(spark):
    c = [100, 101, 102, 103, 105, 103, 102, 101, 100, 101, 102, 103, 105, 103, 102, 101, 100]
    got = reads.swing_clusters(bars(spark, [(x, x, x - 0.5, x) for x in c])).collect()
    assert (got[0].level, got[0].touches, got[0].type) == (105.0, 2, "resistance")
    assert reads.swing_clusters(bars(spark, [(1, 1, 1, 1)] * 3)).count() == 0
    flat = reads.swing_clusters(bars(spark, [(9, 9, 9, 9)] * 9)).collect()
    assert [(x.level, x.touches) for x in flat] == [(9.0, 6)]


def regime(spark, vix=(), index=(), sister=()):
    rows = [(s, START + dt.timedelta(days=k), float(x)) for s, xs in (("V", vix), ("M", sister), ("I", index)) for k, x in enumerate(xs)]
    return reads.market_regime(spark.createDataFrame(rows, "symbol string, t timestamp, c double"), "V", "M", "I").collect()


def test_market_regime(spark):
    (x,) = regime(spark, [13.0], range(300, 560))
    assert (x.risk_environment, x.vix_label, x.risk_score, x.ma_cross) == ("risk-on", "low (calm)", 4, "golden")
    (x,) = regime(spark, [20, 20, 20, 20, 20, 40], [100] * 5 + [75], [30.0])
    assert (x.risk_environment, x.risk_score, x.term_structure, round(x.vix_change_pct, 6)) == ("risk-off", -8, "backwardation", 100.0)
    (x,) = regime(spark, [], [100, 100, 100, 100, 100, 85])
    assert round(x.drawdown_pct, 9) == -15.0 and x.vix_label is None and x.risk_score == -1
    assert regime(spark, [], [5.0]) == [] and regime(spark) == []


def test_session_state(spark):
    x = bars(spark, [(10, 12, 9, 11), (11, 15, 10, 14)], step=720)
    (got,) = reads.todays_range(x.where("false"), x).collect()
    assert (got.o, got.h, got.l, got.from_daily) == (11.0, 15.0, 10.0, False)
    day = x.where("h = 15").withColumns({"o": F.lit(8.0), "t": F.to_timestamp(F.to_date("t"))})
    assert reads.todays_range(day, x).first().o == 8.0
    assert reads.session_bars(x).count() == 1 and reads.regular_session(x).count() == 1
    m = reads.momentum_pct(frame(spark, range(100, 131)), 10).first()
    assert (m.base, m.c) == (120.0, 130.0)
    assert reads.momentum_pct(frame(spark, [100, 110]), 10).first().momentum_pct == pytest.approx(10)


def test_rejection(spark):
    rows = [(10, 10.2, 8, 10.1), (10, 12, 9.9, 9.95), (10, 10, 10, 10), (8, 12, 8, 12)]
    got = bars(spark, rows).orderBy("t").select(reads.rejection(*map(F.col, "ohlc"))).collect()
    assert [x[0] for x in got] == ["bullish_rejection", "bearish_rejection", None, None]


def test_session_spikes(spark):
    rows = [(100, 100, 100, 100, 100)] * 60
    rows[2] = (100, 100, 100, 100, 9000)  # within the warm-up
    for k, v in ((30, 900), (33, 500), (50, 400)):
        rows[k] = (100, 100, 100, 100, v)
    for k in range(25):
        rows[k] = (90, 90, 90, 90, rows[k][4])
    for k in range(25, 30):
        rows[k] = (99, 99, 99, 99, 100)
    got = reads.session_spikes(bars(spark, rows)).orderBy("t").collect()
    assert [(x.v, x.type, x.rel_vol) for x in got] == [(900, "supply", 9.0), (400, "unsure", 4.0)]
    assert reads.session_spikes(bars(spark, rows[:24])).count() == 0


def test_suppression_by_keys(spark):
    x = spark.createDataFrame([("X", d, i, v) for d in "ab" for i, v in ((1, 5), (4, 9), (8, 9), (20, 1))], "symbol string, day string, i int, v long")
    assert sorted((r.day, r.i) for r in folds.suppress_neighbours(x, 5, ["symbol", "day"]).collect()) == [(d, i) for d in "ab" for i in (4, 20)]


def test_standing_targets(spark):
    x = spark.createDataFrame([("Morgan Stanley Co", "2024-01-01", 110.0, 1), ("MORGAN STANLEY", "2024-02-01", 120.0, 2), ("Other", "2024-03-01", 9.0, 3), (None, "2024-03-01", 9.0, 4)], "firm string, date string, target double, id long")
    assert [tuple(r) for r in reads.standing_targets(x, ["morgan stanley", "UBS"], 100).collect()] == [("morgan stanley", "2024-02-01", 120.0, 20.0)]


def test_nearest(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    a = spark.createDataFrame([("X", at(m)) for m in (-5, 1, 5, 7, 30)] + [("Y", at(0))], "k string, at timestamp")
    b = spark.createDataFrame([("X", at(0), 1), ("X", at(10), 2)], "k string, t timestamp, x int")
    got = {(r.k, r.at): r.x for r in joins.nearest(a, b, "k", "at", "t", ["x"]).collect()}
    assert got == {("X", at(-5)): 1, ("X", at(1)): 1, ("X", at(5)): 1, ("X", at(7)): 2, ("X", at(30)): 2, ("Y", at(0)): None}


def test_price_alert_within_a_minute(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    x = spark.createDataFrame([("X", at(0), 9.0), ("X", at(30), 5.0), ("X", at(90), 5.0)], "symbol string, t timestamp, p double")
    assert [r.met for r in rules.price_alert(x, "above", 9).orderBy("t").collect()] == [True, True, False]
    assert [r.met for r in rules.price_alert(x, "below", 5).orderBy("t").collect()] == [False, True, True]


def test_held_and_latched(spark):
    x = frame(spark, [1, 5, 5, 5, 1, 5, 5, 1])
    (got,) = rules.held_for(x, F.col("c") >= 5, 120).collect()
    assert (got.start, got.fired_at) == (START + dt.timedelta(minutes=1), START + dt.timedelta(minutes=3))
    (got,) = rules.latched(x, F.col("c") >= 5, ["symbol"]).collect()
    assert got.t == START + dt.timedelta(minutes=1)


def test_setup(spark):
    """A falling candle before an impulse is demand; a return into it with a long lower wick is a setup."""
    days = [(100, 101, 99.5, 100.5)] * 8 + [(101, 101.5, 98.5, 99)] + [(99 + 3 * k, 103 + 3 * k, 98.6 + 3 * k, 102 + 3 * k) for k in range(1, 7)] + [(118, 121, 99, 100)]
    last = [(100, 100.3, 99.9, 100.1)] * 11 + [(100, 100.1, 98.9, 100.05)]
    (x,) = reads.smart_money_setup(bars(spark, days, 1440), bars(spark, last)).collect()
    assert (x.demand.top, x.demand.bottom, x.price_in_block) == (101.5, 98.5, True) and "rejection_candle" in x.confirmations
    assert x.stop == pytest.approx(98.2) and x.meets and x.signal == ("no_setup" if x.regime == "bearish" else "long_setup")
    assert reads.smart_money_setup(bars(spark, days[:7], 1440), bars(spark, last)).count() == 0
    assert reads.smart_money_setup(bars(spark, days[:9], 1440), bars(spark, last)).first().signal == "no_setup"


def test_registered_reads(spark):
    x = frame(spark, [100, 101, 102, 103, 102, 101, 100, 101, 102, 103, 104, 105])
    assert registry.run("cluster_swing_levels", x).count() == 2 and registry.run("momentum_pct", x, minutes=500).first().base == 100
    assert registry.run("analyze_liquidity", x).count() == 0 and registry.run("analyze_volume_profile_2", x).count() == 0
