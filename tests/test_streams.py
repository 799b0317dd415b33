"""Stateful stream operators against their batch twins: shuffled input, many batches, restarts."""

import datetime as dt
import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeline.operators import rules
from tapeline.streaming import state

T0 = dt.datetime(2024, 3, 8, 14, 30)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    state.use_rocksdb(spark)


def feed(spark, path, batches, schema):
    """One Parquet file per batch, in order of their times."""
    for rows in batches:
        k = len(os.listdir(path)) if os.path.isdir(path) else 0
        tmp = f"{path}-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
        os.makedirs(path, exist_ok=True)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.rename(f"{tmp}/{part}", f"{path}/{k:04d}.parquet")
        os.utime(f"{path}/{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(stream, out, checkpoint, mode="append"):
    """Everything available now, to files that stay over restarts."""
    def write(batch, k):
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(checkpoint)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(str(out)).drop("batch")


def shuffled(rows, late, seed=5):
    """Rows in an order in which none is later than `late` behind the newest before it."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: (r[0] + dt.timedelta(seconds=rng.random() * late.total_seconds()), rng.random()))


def chunks(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


SCHEMA = "t timestamp, symbol string, id long, p double, v long"


def prices():
    rng, rows = random.Random(11), []
    for k in range(150):
        # several rows share a time, over two days
        t = T0 + dt.timedelta(seconds=40 * (k // 2)) + (dt.timedelta(days=1) if k >= 90 else dt.timedelta())
        rows.append((t, "XY"[rng.random() < 0.4], k, rng.choice([1.0, 2.0, 3.0, None]), rng.randrange(100)))
    closing = [(T0 + dt.timedelta(days=9), s, 10_000, 0.0, 0) for s in "XY"]
    return rows, closing


def check(spark, tmp_path, make, want, late="10 minutes"):
    """Feed half, stop, feed the rest, restart: the rows are those of the batch twin, each once."""
    rows, closing = prices()
    order = shuffled(rows, dt.timedelta(minutes=9))
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    parts = chunks(order, 4)
    feed(spark, path, parts[:2], SCHEMA)
    drain(make(stream_of(spark, path, SCHEMA)), out, cp)
    feed(spark, path, [*parts[2:], closing], SCHEMA)
    got = drain(make(stream_of(spark, path, SCHEMA)), out, cp)
    expected = want(spark.createDataFrame(rows + closing, SCHEMA))
    # what only the closing rows could release is not out yet
    cut = F.col(got.columns[-1] if "fired_at" in got.columns else "t") < F.lit(T0 + dt.timedelta(days=8))
    key = lambda r: repr(r)
    got, expected = (sorted([tuple(r) for r in d.where(cut).select(got.columns).collect()], key=key) for d in (got, expected))
    assert got == expected and got


def test_held_for_stream(spark, tmp_path):
    check(spark, tmp_path, lambda s: state.held_for(s, F.col("p") >= 2, 60), lambda d: rules.held_for(d, F.col("p") >= 2, 60).select("symbol", "start", "fired_at"))


def test_latched_stream(spark, tmp_path):
    day = lambda d: d.withColumn("day", F.to_date("t"))
    check(
        spark, tmp_path, lambda s: state.latched(day(s), F.col("p") > 2, ["symbol", "day"], ["id", "p"]),
        lambda d: rules.latched(day(d), F.col("p") > 2, ["symbol", "day"]).select("symbol", "day", "t", "id", "p"),
    )


def test_day_volume_stream_with_seed(spark, tmp_path):
    seeds = spark.createDataFrame([("X", "2024-03-08", 1000), ("Y", "2024-03-07", 5000)], "symbol string, day string, v long")
    check(spark, tmp_path, lambda s: state.day_volume(s, seeds), lambda d: state.day_volume_batch(d, seeds))
    rows, _ = prices()
    done = state.day_volume_batch(spark.createDataFrame(rows, SCHEMA), seeds).orderBy("t").collect()
    first = {s: next(r for r in done if r.symbol == s) for s in "XY"}
    assert first["X"].day_volume == 1000 + first["X"].v and first["Y"].day_volume == first["Y"].v
    second = next(r for r in done if r.symbol == "X" and r.t.day == 9)
    assert second.day_volume == second.v


def one_batch(spark, tmp_path, make, n):
    """What a stream gives for n rows of a symbol in its first batch, and those rows."""
    rows = [(T0 + dt.timedelta(seconds=k // 2), "X", k, float(k % 4), 1) for k in range(n)]
    closing = [(T0 + dt.timedelta(days=9), "X", 10**6, 0.0, 0)]
    path, out, cp = (str(tmp_path / f"{x}{n}") for x in ("in", "out", "cp"))
    feed(spark, path, [rows + closing], SCHEMA)
    return drain(make(stream_of(spark, path, SCHEMA)), out, cp), spark.createDataFrame(rows, SCHEMA)


def test_first_batch_over_many_blocks_and_slots(spark, tmp_path, monkeypatch):
    # blocks of 700 rows: slots of an hour hold several, and results leave in several
    monkeypatch.setattr(state, "BLOCK_ROWS", 700)
    got, rows = one_batch(spark, tmp_path, state.day_volume, 20_000)
    want = state.day_volume_batch(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_held_runs_over_blocks_and_slots_of_one_batch(spark, tmp_path, monkeypatch):
    # runs of an hour and a half, broken by one row, cross slots and blocks
    monkeypatch.setattr(state, "BLOCK_ROWS", 700)
    broken = lambda d: F.col("id") % 10_800 != 0
    got, rows = one_batch(spark, tmp_path, lambda s: state.held_for(s, broken(s), 900), 40_000)
    want = rules.held_for(rows, broken(rows), 900).select("symbol", "start", "fired_at")
    got = sorted(map(tuple, got.where(F.col("start") < F.lit(T0 + dt.timedelta(days=8))).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 4


class FakeHandle:
    """State in memory that notes how large the values are."""

    def __init__(self):
        self.maps, self.values, self.timers, self.most = {}, {}, set(), 0

    def getMapState(self, name, *_):
        return FakeMap(self, self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return FakeValue(self.values.setdefault(name, []))

    def registerTimer(self, ms):
        self.timers.add(ms)


class FakeMap:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value
        self.handle.most = max(self.handle.most, len(value[0]) if isinstance(value[0], bytes) else 0)

    def removeKey(self, key):
        del self.held[key]


class FakeValue:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held[:] = [value]

    def clear(self):
        self.held.clear()


class Times:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def test_waiting_rows_leave_slot_by_slot(monkeypatch):
    """Ten times the rows take no larger state values and no larger frames; order and sums are whole, late rows that the fold has passed are dropped."""
    from pyspark.sql import types as T

    monkeypatch.setattr(state, "BLOCK_ROWS", 5000)
    made = T._parse_datatype_string("symbol string, us long, n long")
    fold = lambda s, r: ((s[0] + 1,), [(r["_us"], s[0])])
    peaks = []
    for hours in (24, 240):
        handle, p = FakeHandle(), state.InOrder(fold, lambda r: (0,), T._parse_datatype_string("n long"), made)
        p.init(handle)
        us = [k * 3_600_000_000 // 1000 for k in range(1000 * hours)]
        random.Random(1).shuffle(us)
        blocks = [state._packed(pa.table({"_us": us[k : k + 5000], "_id": us[k : k + 5000]})) for k in range(0, len(us), 5000)]
        p.handleInputRows(("X",), iter([pd.DataFrame({"packed": blocks})]), None)
        half, out, frames = hours * 1_800_000_000, [], []
        for passed in (half, 10**15):
            for frame in p.handleExpiredTimer(("X",), Times(passed), None):
                frames.append(max(len(x) for x in frame["packed"]))
                out += [r for x in frame["packed"] for r in state._unpacked(x).to_pylist()]
            assert [r["us"] for r in out] == sorted(u for u in us if u <= passed)
            p.handleInputRows(("X",), iter([pd.DataFrame({"packed": [state._packed(pa.table({"_us": [half - 1], "_id": [0]}))]})]), None)
        assert [r["n"] for r in out] == list(range(len(us))) and not any(handle.maps.values())
        peaks.append((handle.most, max(frames)))
    assert all(b < 2 * a for a, b in zip(*peaks)), peaks


def test_rows_at_the_watermark_are_released(spark, tmp_path):
    rows = [(T0, "X", 0, 3.0, 1), (T0 + dt.timedelta(minutes=10), "Y", 1, 0.0, 1)]
    for name, make in (("l", lambda s: state.latched(s, F.col("p") > 2, ["symbol"], ["id"])), ("d", state.day_volume)):
        path = str(tmp_path / f"in{name}")
        feed(spark, path, [rows], SCHEMA)
        got = drain(make(stream_of(spark, path, SCHEMA)), str(tmp_path / f"out{name}"), str(tmp_path / f"cp{name}")).collect()
        assert [(r.symbol, r.t) for r in got] == [("X", T0)], name


def test_latch_keeps_one_row():
    """A key's state is its best row so far, whatever the number of rows."""
    from pyspark.sql import types as T

    handle = FakeHandle()
    p = state.First(T._parse_datatype_string("_us long, _id long, p double"), T._parse_datatype_string("symbol string, t long, p double"))
    p.init(handle)
    rows = [Row(_us=u, _id=k, p=float(k)) for k, u in enumerate([None, *random.Random(3).sample(range(5_000, 10**6), 3000), 4_000, 4_000])]
    for k in range(0, len(rows), 500):
        assert list(p.handleInputRows(("X",), iter(rows[k : k + 500]), None)) == []
    assert handle.values["best"] == [(4_000, 3001, 3001.0)] and not handle.maps
    assert list(p.handleExpiredTimer(("X",), Times(3_000), None)) == []
    assert [tuple(r) for r in p.handleExpiredTimer(("X",), Times(4_000), None)] == [("X", 4_000, 3001.0)]
    assert list(p.handleExpiredTimer(("X",), Times(9_000), None)) == [] and not handle.values["best"]


BAR = "symbol string, t timestamp, o double, h double, l double, c double, v long, arrival long"


def test_buffer_stream(spark, tmp_path):
    rng, rows = random.Random(2), []
    minute = lambda k: T0 + dt.timedelta(minutes=k)
    for k in range(80):
        if k % 7:  # holes
            rows.append(("X", minute(k), 1.0, 2.0, 0.5, float(k), k))
        if k % 9 == 8:  # a back-fill repeats bars with other values and closes holes, within its reach
            rows += [("X", minute(j), 9.0, 9.0, 9.0, 9.0, 9) for j in range(max(0, k - 12), k) if rng.random() < 0.8]
    rows += [("X", minute(-60 * 17), 1.0, 1.0, 1.0, 1.0, 1), ("Y", minute(3), 1.0, 1.0, 1.0, 1.0, 1), ("Y", None, 1.0, 1.0, 1.0, 1.0, 1)]
    rows.insert(10, ("X", minute(-60 * 15), 5.0, 5.0, 5.0, 5.0, 5))  # late, but not too late: held until others push it out
    rows = [(*r, k) for k, r in enumerate(rows)]
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    parts = chunks([*rows[:20][::-1], *rows[20:]], 5)  # within a batch any order
    feed(spark, path, parts[:3], BAR)
    drain(state.buffer(stream_of(spark, path, BAR), most=30), out, cp, "update")
    feed(spark, path, parts[3:], BAR)
    got = drain(state.buffer(stream_of(spark, path, BAR), most=30), out, cp, "update").collect()
    held = {}
    for r in got:
        held[tuple(r)[:-1]] = held.get(tuple(r)[:-1], 0) + (1 if r.held else -1)
    assert set(held.values()) <= {0, 1} and 0 in held.values()
    want = {tuple(r) for r in state.buffer_batch(spark.createDataFrame(rows, BAR), most=30).collect()}
    assert {b for b, n in held.items() if n} == want and len(want) == 31
    assert any(b[2] == 9.0 for b in want) and any(b[2] == 1.0 for b in want)


def test_one_stream_of_all_messages(spark, tmp_path, monkeypatch):
    from tapeline.streaming import ingest

    bar = lambda s, k, c: {"T": "b", "S": s, "t": f"2024-01-03T14:{30 + k}:00Z", "o": 1, "h": 2, "l": 0.5, "c": c, "v": 10}
    texts = [
        json.dumps([{"T": "success", "msg": "authenticated"}, bar("X", 0, 1.5), bar("Q", 0, 9.9)]),
        json.dumps([{"T": "t", "S": "x", "t": "2024-01-03T14:30:01.5Z", "p": 3.25, "s": 7, "i": 11, "c": ["@", "I"]}, {"T": "q", "S": "X", "t": "2024-01-03T14:30:02Z", "bp": 0, "bs": 1, "ap": 3.5, "as": 2}]),
        "not json", "", None, json.dumps({"T": "n", "id": 5, "headline": "h", "created_at": "2024-01-03T14:31:00Z", "symbols": ["Y", "x", "X", "Q"]}),
        json.dumps([bar("Y", 1, 2.5), {"T": "error", "code": 406, "msg": "limit"}, {"T": "b", "S": "Y", "t": "soon"}, {"T": "t", "S": "Y", "t": "2024-01-03T14:31:00Z"}]),
        json.dumps([bar("X", 2, 3.5)]),
    ]
    schema, path, out, cp = "value string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    watched = spark.createDataFrame([("X",), ("y",)], "symbol string")
    feed(spark, path, [[(t,)] for t in texts[:5]], schema)
    ingest.start(stream_of(spark, path, schema), watched, out, cp).awaitTermination()
    feed(spark, path, [[(t,)] for t in texts[5:]], schema)
    # the first try of a batch fails between its tables; the next run writes the whole batch again
    plain, left = ingest.branches, [1]

    def failing(found, known):
        made = plain(found, known)
        return {**made, "quotes": made["quotes"].select(F.raise_error(F.lit("lost")))} if left and found.count() and left.pop() else made

    monkeypatch.setattr(ingest, "branches", failing)
    with pytest.raises(Exception, match="lost|FAILED|RAISE"):
        made = ingest.start(stream_of(spark, path, schema), watched, out, cp)
        made.awaitTermination()
        raise RuntimeError("lost: no quote in the batch, so nothing failed") if not left else made.exception()
    monkeypatch.undo()
    ingest.start(stream_of(spark, path, schema), watched, out, cp).awaitTermination()
    got = {k: spark.read.parquet(f"{out}/{k}").drop("batch") for k in ingest.KINDS}
    assert sorted((r.symbol, r.t.minute, r.c) for r in got["bars"].collect()) == [("X", 30, 1.5), ("X", 32, 3.5), ("Y", 31, 2.5)]
    assert [(r.symbol, r.p, r.id) for r in got["trades"].collect()] == [("X", 3.25, 11)]
    assert [(r.symbol, r.bid, r.ask) for r in got["quotes"].collect()] == [("X", None, 3.5)]
    assert sorted((r.id, r.symbol) for r in got["news"].collect()) == [(5, "X"), (5, "Y")]
    assert sorted((r.kind, r.code) for r in got["status"].collect()) == [("error", 406), ("success", None)]
