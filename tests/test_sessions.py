"""Session levels, sliced joins, profit potential, mixtures, reports and rule sets, with golden values."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import joins, mixture, reports, rules, rulesets, session_levels

OPEN = dt.datetime(2024, 1, 3, 14, 30)  # 09:30 in New York


def session(spark, closes, volumes, day=OPEN):
    rows = [("X", day + dt.timedelta(minutes=k), c, c, c, c, v) for k, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v long")


def test_levels_of_a_session(spark):
    closes = [100.0 + 0.05 * (k % 5) for k in range(60)]
    volumes = [100] * 60
    closes[0], closes[1] = 90.0, 114.0  # the session's range: 24 bins of 1.0
    for k, v in ((20, 2000), (40, 1000)):
        volumes[k] = v
    closes[20], closes[40] = 110.0, 105.0
    for k in (50, 52, 54, 56):  # built up without a spike
        closes[k], volumes[k] = 95.2, 250
    volumes[54] = 260
    bars = session(spark, closes, volumes)
    get = lambda news: {(r.type, r.price): r for r in session_levels.session_levels(bars, news).collect()}
    plain = get(None)
    kinds = {k[0] for k in plain}
    assert kinds == {"supply", "scattered"} and not any(r.stale or r.news_driven for r in plain.values())
    assert plain[("scattered", 95.5)].t == OPEN + dt.timedelta(minutes=54) and plain[("scattered", 95.5)].v == 1010
    assert ("scattered", 100.5) in plain  # the bin most bars are in
    news = spark.createDataFrame([("X", OPEN + dt.timedelta(minutes=55)), ("Y", OPEN + dt.timedelta(minutes=20))], "symbol string, created_at timestamp")
    cut = get(news)
    assert cut[("supply", 105.0)].news_driven and not cut[("supply", 105.0)].stale  # exactly 15 minutes
    assert cut[("supply", 110.0)].stale and not cut[("scattered", 95.5)].stale
    assert session_levels.session_levels(bars.limit(0)).count() == 0
    assert session_levels.session_levels(bars.limit(24)).count() == 0


def test_a_spike_owns_its_bin(spark):
    closes, volumes = [100.4] * 60, [100] * 60
    closes[0], closes[1], volumes[30] = 90.0, 114.0, 1000
    got = session_levels.session_levels(session(spark, closes, volumes)).collect()
    assert [r.type for r in got] == ["unsure"]  # the volume around the spike's price is no level of its own


def _fold(prices):
    """Extremes in order of arrival, step by step."""
    out = None
    for p in prices:
        if out is None:
            out = [p, p, p, p]
            continue
        if p < out[0]:
            out[0] = out[2] = p
        else:
            out[2] = max(out[2], p)
        if p > out[1]:
            out[1], out[3] = p, out[0]
    return out


@pytest.mark.parametrize("seconds", [60, 700, 86_400])
def test_potential_is_the_plain_fold(spark, seconds):
    rng, rows = random.Random(seconds), []
    for s in "XYZ":
        for k in range(60):
            low = rng.choice([None, 0.0, -1.0, *map(float, range(1, 9))])
            rows.append((s, OPEN + dt.timedelta(seconds=97 * k), low, rng.choice([float(low or 0) + 1, None])))
    got = session_levels.potential(spark.createDataFrame(rows, "symbol string, t timestamp, l double, h double"), seconds).collect()
    assert len(got) == 3
    for r in got:
        want = _fold([p for s, _, low, h in rows for p in (low, h) if s == r.symbol and p is not None and p > 0])
        assert [r.min, r.max, r.max_after_min, r.min_before_max] == want
        assert r.max_profit_pct == pytest.approx(max(want[2] / want[0], want[1] / want[3]) * 100 - 100)
    best = session_levels.profit_efficiency(spark.createDataFrame([("B", 4.0), ("A", 4.0), ("C", 1.0)], "symbol string, max_profit_pct double"), 2.0).first()
    assert (best.best_symbol, best.profit_efficiency) == ("A", 0.5)
    assert session_levels.profit_efficiency(spark.createDataFrame([("B", 0.0)], "symbol string, max_profit_pct double"), 2.0).first().profit_efficiency is None


def test_low_comes_before_high_within_a_bar(spark):
    one = spark.createDataFrame([("X", OPEN, 10.0, 12.0)], "symbol string, t timestamp, l double, h double")
    assert session_levels.potential(one).first().max_profit_pct == pytest.approx(20.0)


@pytest.mark.parametrize("seconds", [1, 50, 86_400])
def test_joins_in_slices_equal_plain_ones(spark, seconds):
    rng = random.Random(4)
    at = lambda k: OPEN + dt.timedelta(seconds=k)
    right = [(s, at(k), k) for s in ("X", None) for k in sorted(rng.sample(range(100, 400), 25))]
    left = [(i, s, t) for i, (s, t) in enumerate([(rng.choice(["X", "Y", None]), at(rng.randrange(500))) for _ in range(80)] + [("X", None), (None, None), ("X", right[3][1])])]
    a = spark.createDataFrame(left, "i int, symbol string, at timestamp")
    b = spark.createDataFrame(right, "symbol string, t timestamp, k int")
    back = {r.i: r.k for r in joins.asof_backward(a, b, "symbol", "at", "t", ["k"], seconds=seconds).collect()}
    clip = {r.i: r.k for r in joins.asof_backward(a, b, "symbol", "at", "t", ["k"], clip=True, seconds=seconds).collect()}
    near = {r.i: r.k for r in joins.nearest(a, b, "symbol", "at", "t", ["k"], seconds=seconds).collect()}
    for i, s, t in left:
        own = sorted((x, k) for y, x, k in right if y == s)
        before = [k for x, k in own if t is not None and x <= t]
        assert back[i] == (before[-1] if before else None)
        assert clip[i] == (before[-1] if before else own[0][1] if own else None)
        if t is not None:
            assert near[i] == (min(own, key=lambda o: (abs(o[0] - t), o[0]))[1] if own else None)
    number = {(r.symbol, r.k): r.pos for r in joins.numbered(b, "symbol", "t", seconds=seconds).collect()}
    assert number == {(s, k): 1 + sum(y == s and q < k for y, _, q in right) for s, _, k in right}


def test_bars_with_holes_hold_trades_up_to_the_next(spark):
    at = lambda k: OPEN + dt.timedelta(seconds=k)
    bars = spark.createDataFrame([("X", at(0)), ("X", at(60)), ("X", at(240)), ("Y", at(0))], "symbol string, t timestamp")
    points = [("X", at(k), k) for k in (-1, 0, 59, 60, 239, 240, 419, 420)] + [("Y", at(59), 1), ("Y", at(60), 2), ("Z", at(0), 3)]
    got = joins.in_gaps(spark.createDataFrame(points, "symbol string, t timestamp, k int"), bars, seconds=100).collect()
    assert {(r.symbol, r.k): r.bar_t for r in got} == {("X", 0): at(0), ("X", 59): at(0), ("X", 60): at(60), ("X", 239): at(60), ("X", 240): at(240), ("X", 419): at(240), ("Y", 1): at(0)}


def test_market_beside_an_entry(spark):
    at = lambda k: OPEN + dt.timedelta(minutes=k)
    market = spark.createDataFrame([(at(k), c) for k, c in enumerate([100.0, 110.0, 99.0, 0.0, 50.0, 60.0])], "t timestamp, c double")
    windows = [(1, at(0), at(2), 9), (2, at(2), at(2), 2), (3, None, at(2), 4), (4, at(50), at(60), 100), (5, at(0), at(1), 1), (6, at(9), at(9), 1), (7, None, None, 3)]
    w = spark.createDataFrame(windows, "id int, first_t timestamp, last_t timestamp, n int")
    got = {r.id: (r.market_pct and round(r.market_pct, 6), r.same_time) for r in joins.market_return(w, market, seconds=60).collect()}
    assert got == {1: (-1.0, True), 2: (20.0, False), 3: (round((60 / 99 - 1) * 100, 6), False), 4: (-40.0, False), 5: (10.0, True), 6: (None, False), 7: (None, False)}
    assert [r.market_pct for r in joins.market_return(w, market.limit(0)).collect()] == [None] * 7


def test_price_alerts_over_slices(spark):
    rng = random.Random(6)
    rows = [(rng.choice("XY"), OPEN + dt.timedelta(seconds=rng.randrange(600)), float(rng.randrange(100)), k) for k in range(300)]
    d = spark.createDataFrame(rows, "symbol string, t timestamp, p double, k int")
    got = {r.k: r.met for r in rules.price_alert(d, "above", 97.0, 30, slice_seconds=45).collect()}
    assert got == {k: any(s2 == s and 0 <= (t - t2).total_seconds() <= 30 and p2 >= 97 for s2, t2, p2, _ in rows) for s, t, _, k in rows}


def test_mixtures_are_recovered(spark):
    x = np.arange(0, 100, 0.5)
    normal = 0.3 * np.exp(-0.5 * ((x - 20) / 4) ** 2) / 4 + 0.7 * np.exp(-0.5 * ((x - 65) / 7) ** 2) / 7
    cauchy = 0.5 / (2 * (1 + ((x - 30) / 2) ** 2)) + 0.5 / (3 * (1 + ((x - 70) / 3) ** 2))
    rows = [(s, float(c), float(v)) for s, h in (("n", normal), ("m", normal * 7), ("c", cauchy)) for c, v in zip(x, h)] + [("flat", 1.0, 5.0), ("none", 1.0, 0.0), ("none", 2.0, None)]
    h = spark.createDataFrame(rows, "symbol string, centre double, v double")
    got = {(r.symbol, r.component): r for r in mixture.fit_mixture(h, 2).collect()}
    for s in "nm":
        assert [round(got[(s, k)].location) for k in (0, 1)] == [20, 65] and got[(s, 0)].weight == pytest.approx(0.3, abs=0.01)
        assert [got[(s, k)].scale for k in (0, 1)] == pytest.approx([4, 7], abs=0.1)
    assert not {s for s, _ in got} & {"flat", "none"}
    c = {r.component: r for r in mixture.fit_mixture(h.where("symbol = 'c'"), 2, "cauchy").collect()}
    assert [c[k].location for k in (0, 1)] == pytest.approx([30, 70], abs=0.3) and [c[k].scale for k in (0, 1)] == pytest.approx([2, 3], rel=0.15)
    for kind in mixture.KINDS:
        for seed in range(5):
            trace = mixture.fit_once(x, cauchy + normal, 3, kind, seed, 1e-9)[3]
            assert all(b >= a - 1e-9 * abs(a) for a, b in zip(trace, trace[1:])) and len(trace) > 2
    with pytest.raises(ValueError):
        mixture.fit_mixture(h, 2, "uniform")


def _sessions(spark):
    day = dt.datetime(2024, 1, 2, 9)
    none = (0, 0, 0, 0, 0, 0, 0)
    rows = [
        (day, "live", 3000.0, (4, 0.5, 0.1, ["7", "9"]), (4, 1), (10, 2, 5, 1), (6, 2, 1, 1, 0, 1, 3, 1.0), [("momentum", "up", True, 2, 2.0), ("reversion", "flat", False, 0, None)]),
        (day + dt.timedelta(hours=2), "sim", 700.04, (1, 1.0, 1.0, ["8", "7", None]), (0, 0), (0, 0, 0, 0), (4, 0, 0, 0, 0, 0, 1, None), [("momentum", "down", False, None, -1.0), ("momentum", "up", None, 1, None)]),
        (day + dt.timedelta(days=1), "live", 100.0, None, (1, 1), (1, 0, 0, 0), (*none, 3.0), []),
        (day + dt.timedelta(days=2), "live", 9000.0, None, (0, 0), (0, 0, 0, 0), (*none, None), None),
    ]
    return spark.createDataFrame(rows, reports.SESSION)


def test_day_reports(spark):
    got = {str(r.day): r for r in reports.day_reports(_sessions(spark)).collect()}
    r = got["2024-01-02"]
    assert (r.sessions, r.total_runtime_sec, r.grounding.scored_cycles, r.grounding.mean_score, r.grounding.min_score, r.grounding.ungrounded) == (2, 3700.0, 5, pytest.approx(0.6), 0.1, ["7", "8", "9"])
    assert r.tactics_validation.asDict() == {"attempts": 4, "rejections": 1, "rejection_rate": 0.25}
    assert (r.tools.error_rate, r.tools.quote_warning_rate, r.decision_quality.active_rate, r.decision_quality.mean_session_return_pct) == (0.2, 0.2, 0.4, 1.0)
    m = r.strategies["momentum"]
    assert (m.activations, m.effective, m.alert_only, m.effectiveness, m.mean_return_pct, m.regimes) == (3, 1, 1, pytest.approx(1 / 3), 0.5, ["up", "down"])
    assert r.strategies["reversion"].mean_return_pct is None and [s.mode for s in r.session_index] == ["live", "sim"]
    other = got["2024-01-04"]
    assert other.grounding is None and other.strategies == {} and other.tools.error_rate is None and other.decision_quality.active_rate is None


def test_a_day_is_reported_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    spark.createDataFrame([], "day date").write.parquet(path)
    for k, days in enumerate((["2024-01-02", "2024-01-04"], [])):  # the third day has run too short
        due = reports.due_reports(_sessions(spark), spark.read.parquet(path)).select("day")
        rows = [str(r.day) for r in due.orderBy("day").collect()]
        assert rows == days, k
        due.write.mode("append").parquet(path)


def test_rule_sets(spark):
    ok = {"field": "last_price", "condition": "below", "value": 180}
    sets = {
        "good": [{"action": "buy", "quantity": "10", "conditions": [ok, {"field": "vix", "condition": "below", "value": "20.5", "hold_sec": 30}], "note": "dip"}, {"action": "sell", "quantity_pct": 50.0, "conditions": [{**ok, "field": "day_volume", "value": 1e6}], "trail": False}],
        "empty": [], "object": {"action": "buy"}, "element": [3], "action": [{"action": "hold", "quantity": 1, "conditions": [ok]}], "both": [{"action": "buy", "quantity": 1, "quantity_pct": 1, "conditions": [ok]}],
        "neither": [{"action": "buy", "conditions": [ok]}], "text": [{"action": "buy", "quantity": "many", "conditions": [ok]}], "zero": [{"action": "buy", "quantity": 0, "conditions": [ok]}], "over": [{"action": "sell", "quantity_pct": 101, "conditions": [ok]}],
        "bare": [{"action": "buy", "quantity": 1, "conditions": []}], "field": [{"action": "buy", "quantity": 1, "conditions": [ok, {**ok, "field": "mood"}]}], "side": [{"action": "buy", "quantity": 1, "conditions": [{**ok, "condition": "at"}]}],
        "value": [{"action": "buy", "quantity": 1, "conditions": [{**ok, "value": None}]}], "hold": [{"action": "buy", "quantity": 1, "conditions": [{**ok, "hold_sec": 601}]}], "trail": [{"action": "buy", "quantity": 1, "conditions": [ok], "trail": "true"}],
        "second": [{"action": "buy", "quantity": 1, "conditions": [ok], "trail": 1}, 5],
    }
    rows = [(k, "X", json.dumps(v)) for k, v in sets.items()] + [("broken", "X", "[{"), ("null", "X", None)]
    d = spark.createDataFrame(rows, "set_id string, symbol string, actions string")
    valid = rulesets.validated(d)
    got = {r.set_id: r for r in valid.collect()}
    assert {k: r.error for k, r in got.items()} == {
        "good": None, "empty": "actions must be a non-empty array", "object": "actions must be a non-empty array", "broken": "actions must be a non-empty array", "null": "actions must be a non-empty array",
        "element": "actions[0]: must be an object", "action": "actions[0]: action must be buy or sell", "both": "actions[0]: exactly one of quantity and quantity_pct must be set",
        "neither": "actions[0]: exactly one of quantity and quantity_pct must be set", "text": "actions[0]: quantity is no number", "zero": "actions[0]: quantity must be above 0", "over": "actions[0]: quantity_pct must be in (0, 100]",
        "bare": "actions[0]: conditions must be a non-empty array", "field": "actions[0].conditions[1]: field is unknown", "side": "actions[0].conditions[0]: condition must be above or below",
        "value": "actions[0].conditions[0]: value must be a number", "hold": "actions[0].conditions[0]: hold_sec must be between 0 and 600", "trail": "actions[0]: trail must be a boolean", "second": "actions[0]: trail must be a boolean",
    }
    first, second = got["good"].actions
    assert (first.quantity, first.quantity_pct, first.trail, first.note) == (10.0, None, True, "dip") and [(c.field, c.value, c.hold_sec) for c in first.conditions] == [("last_price", 180.0, 0.0), ("vix", 20.5, 30.0)]
    assert (second.quantity_pct, second.trail) == (50.0, False)
    assert sorted((r.set_id, r.error) for r in rulesets.errors(d).where("set_id = 'second'").collect()) == [("second", "must be an object"), ("second", "trail must be a boolean")]
    assert [tuple(r) for r in rulesets.price_levels(valid).collect()] == [("good", "X", "buy", "buy 10sh", "last_price", "below", 180.0)]
    assert [r.text for r in rulesets.summaries(valid).orderBy("i").collect()] == ["buy 10 sh X when last_price below 180 and vix below 20.5 held 30s (dip)", "sell 50% of position X when day_volume below 1000000.0"]
    assert rulesets.validated(d.limit(0)).count() == 0
