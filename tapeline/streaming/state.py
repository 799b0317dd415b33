"""Stateful stream operators: rows in order of their times, bounded buffers, seeded sums, timers.

Each has a batch twin that gives the same rows. A stream may be shuffled and cut into any batches
as long as rows are no later than the watermark: rows wait in map state until the watermark has
passed them, an event-time timer then releases them in order of (t, id), and a fold takes them
one by one with the key's value state. Folds see a key's rows exactly as a window ordered by
(t, id) does. Waiting rows are bounded by the watermark's delay, the folds' state by a tuple.
A first batch over a whole table waits in the state store as a whole, a worker holds one slot of it.

Streams need the RocksDB state store (`use_rocksdb`), which keeps state on disk and in the
checkpoint, so a lost executor or a restart goes on from the last batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tapeline.functions.clock import ny_date

#: Bars that a buffer holds for a symbol, and how far behind its newest bar one may arrive.
BUFFER_BARS, BUFFER_HOURS = 420, 16
#: Width of the slots in which rows wait, in microseconds, and rows that a worker packs, keeps or gives out at a time.
SLOT_US, BLOCK_ROWS = 3_600_000_000, 50_000

Fold = Callable[[tuple, Row], tuple[tuple, list[tuple]]]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timer(micros: int) -> int:
    """The timer that fires once the watermark stands at a time or behind it; a timer fires when the watermark is above it."""
    return -(-micros // 1000) - 1


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _runs(values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order that brings equal values together, rising and stable, and the bounds of each value's run in it."""
    order = np.argsort(values, kind="stable")
    ends = np.r_[0, np.flatnonzero(np.diff(values[order])) + 1, len(values)]
    return order, list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def _gathered(tables: Iterator[pa.Table], most: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """The rows of tables in tables of about `most` rows."""
    held: list[pa.Table] = []
    n = 0
    for x in tables:
        held.append(x)
        n += x.num_rows
        if n >= most:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.concat_tables(held).combine_chunks()


def _codes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row, equal where the keys are."""
    code = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        x = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(x.dictionary) + x.indices.to_numpy(), return_inverse=True)[1]
    return code


def _pack(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one key: the keys, the newest time in the block and its rows without the keys."""
    for rows in _gathered(pa.Table.from_batches([b]) for b in batches):
        order, runs = _runs(_codes(rows, keys))
        dealt = rows.take(order)
        blocks = [dealt.slice(a, b - a) for a, b in runs]
        columns = [dealt.column(k).take([a for a, _ in runs]).combine_chunks() for k in keys]
        columns += [pa.array([pc.max(x.column("_us")).as_py() for x in blocks], pa.int64()), pa.array([_packed(x.drop_columns(keys)) for x in blocks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "last_us", "packed"])


class InOrder(StatefulProcessor):
    """Feeds a key's rows to a fold in order of (_us, _id) once the watermark has passed them.

    Rows come, wait and leave in Arrow blocks. They wait by slots of time, and slots are released
    one after the other, so a worker holds a few blocks or one slot of a key, never all its rows.
    """

    def __init__(self, fold: Fold, start: Callable[[Row], tuple], state: T.StructType, out: T.StructType):
        self.fold, self.start, self.state_schema, self.out = fold, start, state, out

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "slot long", "n int")
        self.passed = handle.getValueState("passed", "us long")
        self.value = handle.getValueState("value", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = self.passed.get()[0] if self.passed.exists() else None
        for new in _gathered(_unpacked(x) for frame in rows for x in frame["packed"]):
            # a block may hold rows that are later than the watermark beside others; those that the fold has passed are dropped
            new = new if passed is None else new.filter(pc.greater(new.column("_us"), passed))
            if new.num_rows:
                self._keep(new)
                self._wake(pc.min(new.column("_us")).as_py())
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(s for (s,) in self.parts.keys())
        due = [s for s in slots if s * SLOT_US <= passed]
        if not due:
            return
        value = tuple(self.value.get()) if self.value.exists() else None
        out: list[tuple] = []
        for slot in due:
            rows = self._take(slot)
            ready = int(np.searchsorted(rows.column("_us").to_numpy(), passed, side="right"))
            shape = Row(*rows.column_names)
            for k in range(0, ready, BLOCK_ROWS):
                for r in zip(*(c.to_pylist() for c in rows.slice(k, min(BLOCK_ROWS, ready - k)).columns)):
                    row = shape(*r)
                    value, made = self.fold(self.start(row) if value is None else value, row)
                    out += made
                    if len(out) >= BLOCK_ROWS:
                        yield self._made(key, out)
                        out = []
            if ready < rows.num_rows:
                self._keep(rows.slice(ready))
                self._wake(rows.column("_us")[ready].as_py())
        if len(due) < len(slots):
            self._wake(slots[len(due)] * SLOT_US)
        self.passed.update((passed,))
        if value is not None:
            self.value.update(value)
        if out:
            yield self._made(key, out)

    def _keep(self, rows: pa.Table) -> None:
        order, runs = _runs(rows.column("_us").to_numpy() // SLOT_US)
        rows = rows.take(order).combine_chunks()
        for a, b in runs:
            slot = rows.column("_us")[a].as_py() // SLOT_US
            n = (self.parts.getValue((slot,)) or (0,))[0]
            self.waiting.updateValue((slot, n), (_packed(rows.slice(a, b - a)),))
            self.parts.updateValue((slot,), (n + 1,))

    def _take(self, slot: int) -> pa.Table:
        """The rows of a slot in order; the slot is empty afterwards."""
        parts = range(self.parts.getValue((slot,))[0])
        rows = pa.concat_tables([_unpacked(self.waiting.getValue((slot, k))[0]) for k in parts])
        for k in parts:
            self.waiting.removeKey((slot, k))
        self.parts.removeKey((slot,))
        return rows.take(pc.sort_indices(rows, [("_us", "ascending"), ("_id", "ascending")], null_placement="at_start")).combine_chunks()

    def _made(self, key: tuple, made: list[tuple]) -> pd.DataFrame:
        columns = [*([k] * len(made) for k in key), *zip(*made)]
        rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(self.out))], names=self.out.names)
        return pd.DataFrame({"packed": [_packed(rows)]})

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(_timer(micros))


def in_order(rows: DataFrame, keys: list[str], columns: list[str], late: str, fold: Fold, start: Callable[[Row], tuple], state: str, out: str) -> DataFrame:
    """Run a fold over a stream of (t, id, keys, columns); out names the columns it yields behind the keys, times as microseconds.

    start: the state that a key begins with, from its first row. Rows without a time are left out.
    """
    fed = rows.select(F.unix_micros(F.col("t").cast("timestamp")).alias("_us"), F.col("id").alias("_id"), *keys, *columns).where("_us is not null")
    named = [fed.schema[c] for c in keys]
    made = T.StructType(named + T._parse_datatype_string(out).fields)
    blocks = fed.mapInArrow(lambda batches: _pack(batches, keys), T.StructType(named + T._parse_datatype_string("last_us long, packed binary").fields))
    timed = blocks.select(F.timestamp_micros("last_us").alias("t"), *keys, "packed").withWatermark("t", late)
    done = timed.groupBy(*keys).transformWithStateInPandas(InOrder(fold, start, T._parse_datatype_string(state), made), "packed binary", "Append", "EventTime")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("packed"):
                yield from _unpacked(block.as_py()).to_batches()

    return done.mapInArrow(unpack, made)


def held_for(rows: DataFrame, condition: Column, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream twin of rules.held_for on (symbol, t, id, ...): (symbol, start, fired_at), once a run.

    Rows of equal time are taken in order of id. A null condition does not hold and ends the run.
    """
    least = seconds * 1_000_000

    def fold(state: tuple, r: Row) -> tuple[tuple, list[tuple]]:
        start, fired = state
        if not r["_ok"]:
            return (None, False), []
        start = r["_us"] if start is None else start
        if not fired and r["_us"] - start >= least:
            return (start, True), [(start, r["_us"])]
        return (start, fired), []

    fed = rows.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    out = in_order(fed, ["symbol"], ["_ok"], late, fold, lambda r: (None, False), "start long, fired boolean", "start long, fired_at long")
    return out.select("symbol", F.timestamp_micros("start").alias("start"), F.timestamp_micros("fired_at").alias("fired_at"))


def _firsts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each block and key the first row by (_us, _id) that is `_ok`, nulls beside the keys if there is none, and the newest time of all its rows."""
    for rows in _gathered(pa.Table.from_batches([b]) for b in batches):
        rows = rows.append_column("_code", pa.array(_codes(rows, keys))).append_column("_not", pc.invert(rows.column("_ok")))
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("_code", "_not", "_us", "_id")], null_placement="at_start"))
        at = np.flatnonzero(np.diff(rows.column("_code").to_numpy(), prepend=-1))
        last = pa.array(np.maximum.reduceat(rows.column("_us").to_numpy(), at))
        heads = rows.take(at).drop_columns(["_code", "_not"])
        columns = [x if c in keys else pc.if_else(heads.column("_ok"), x, pa.scalar(None, x.type)) for c, x in zip(heads.column_names, heads.columns) if c != "_ok"]
        names = [c for c in heads.column_names if c != "_ok"]
        yield from pa.Table.from_arrays([*columns, last], names=[*names, "last_us"]).combine_chunks().to_batches()


class First(StatefulProcessor):
    """A key's first row by (_us, _id), once the watermark has passed it; no other row is kept."""

    def __init__(self, row: T.StructType, out: T.StructType):
        self.row, self.out = row, out

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.row)
        self.fired = handle.getValueState("fired", "fired boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at = self.row.names
        new = min((r for r in rows if r["_us"] is not None), key=self._order, default=None)
        if new is None or self.fired.exists():
            return iter([])
        if not self.best.exists() or self._order(new) < self._order(Row(*at)(*self.best.get())):
            self.best.update(tuple(new[c] for c in at))
            self.handle.registerTimer(_timer(new["_us"]))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        best = None if self.fired.exists() else tuple(self.best.get())
        if best is None or best[0] > timerValues.getCurrentWatermarkInMs() * 1000:
            return iter([])
        self.fired.update((True,))
        self.best.clear()
        return iter([Row(*self.out.names)(*key, best[0], *best[2:])])

    @staticmethod
    def _order(r: Row) -> tuple:
        return r["_us"], r["_id"] is not None, r["_id"]


def latched(rows: DataFrame, condition: Column, keys: list[str], take: list[str], late: str = "10 minutes") -> DataFrame:
    """Stream twin of rules.latched on (t, id, ...): keys, t and the columns `take` of the first row of each key, by (t, id), on which the condition holds."""
    fed = rows.withColumn("_ok", F.coalesce(condition, F.lit(False))).select(F.unix_micros(F.col("t").cast("timestamp")).alias("_us"), F.col("id").alias("_id"), "_ok", *keys, *[c for c in take if c not in keys]).where("_us is not null")
    firsts = fed.mapInArrow(lambda batches: _firsts(batches, keys), T.StructType([f for f in fed.schema.fields if f.name != "_ok"] + [T.StructField("last_us", T.LongType())]))
    met = firsts.withColumn("t", F.timestamp_micros("last_us")).drop("last_us").withWatermark("t", late)
    fields = ["_us", "_id", *take]
    out = T.StructType([met.schema[c] for c in keys] + [T.StructField("t", T.LongType())] + [met.schema[c] for c in take])
    done = met.groupBy(*keys).transformWithState(First(T.StructType([met.schema[c] for c in fields]), out), out, "Append", "EventTime")
    return done.withColumn("t", F.timestamp_micros("t"))


def day_volume(bars: DataFrame, seeds: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """(symbol, t, v, day_volume): each bar with its session's volume so far; a new New York date starts at 0.

    bars: a stream of (symbol, t, id, v). seeds (symbol, day, v): volume of a session before the
    first bar, as today's daily bar has it; a seed of another day than the first bar's counts for
    nothing. One seed a symbol.
    """

    def fold(state: tuple, r: Row) -> tuple[tuple, list[tuple]]:
        day, total = state
        total = (total if day == r["_day"] else 0) + (r["v"] or 0)
        return (r["_day"], total), [(r["_us"], r["v"], total)]

    fed = bars.withColumn("_day", ny_date(F.col("t").cast("timestamp")).cast("string")).withColumn("v", F.col("v").cast("long"))
    if seeds is None:
        fed = fed.withColumn("_seed_day", F.lit(None).cast("string")).withColumn("_seed", F.lit(0).cast("long"))
    else:
        first = seeds.select("symbol", F.col("day").cast("string").alias("_seed_day"), F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("_seed")).dropDuplicates(["symbol"])
        fed = fed.join(first, "symbol", "left")
    out = in_order(fed, ["symbol"], ["_day", "v", "_seed_day", "_seed"], late, fold, lambda r: (r["_seed_day"], r["_seed"]), "day string, total long", "t long, v long, day_volume long")
    return out.withColumn("t", F.timestamp_micros("t"))


def day_volume_batch(bars: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Batch twin of day_volume."""
    d = bars.withColumn("_day", ny_date(F.col("t").cast("timestamp")))
    so_far = F.sum(F.coalesce(F.col("v").cast("long"), F.lit(0))).over(W.partitionBy("symbol", "_day").orderBy("t", "id"))
    first = F.lit(0)
    if seeds is not None:
        # a seed belongs to the symbol's first session and to no other
        d = d.withColumn("_first", F.min("_day").over(W.partitionBy("symbol")))
        d = d.join(seeds.select("symbol", F.col("day").cast("date").alias("_first"), F.col("v").cast("long").alias("_seed")), ["symbol", "_first"], "left")
        first = F.when(F.col("_day") == F.col("_first"), F.coalesce("_seed", F.lit(0))).otherwise(0)
    return d.select("symbol", "t", F.col("v").cast("long").alias("v"), (so_far + first).alias("day_volume"))


class Buffer(StatefulProcessor):
    """The newest bars of a symbol by time, each time as it first arrived."""

    def __init__(self, bar: T.StructType, most: int, back: int):
        self.bar, self.most, self.back = bar, most, back

    def init(self, handle: Any) -> None:
        self.held = handle.getListState("held", self.bar)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = {r[0]: tuple(r) for r in self.held.get()}
        held, newest = dict(before), max(before, default=None)
        for r in sorted((tuple(r[c] for c in self.bar.names) for r in rows), key=lambda r: r[1]):
            newest = r[0] if newest is None else max(newest, r[0])
            if r[0] >= newest - self.back and r[0] not in held:
                held[r[0]] = r
        kept = dict(sorted(held.items())[-self.most :])
        self.held.put(list(kept.values()))
        added = [(r, True) for t, r in kept.items() if t not in before]
        gone = [(r, False) for t, r in before.items() if t not in kept]
        shape = Row("symbol", *self.bar.names, "held")
        return iter([shape(*key, *r, flag) for r, flag in added + gone])


def buffer(bars: DataFrame, most: int = BUFFER_BARS, hours: int = BUFFER_HOURS) -> DataFrame:
    """Changes to every symbol's buffer, as (symbol, t, o, h, l, c, v, held): a bar comes in with held true and goes out with held false.

    bars: a stream of (symbol, t, o, h, l, c, v, arrival), live and back-filled bars alike. Of bars
    of one time the first to arrive stays, so a back-fill fills holes and never replaces a live
    bar. A bar more than `hours` behind the newest that has arrived for its symbol is too late.
    The buffer holds the `most` newest times; a batch reports what it changes in all. Rows of one
    batch are taken in order of `arrival`, so how arrivals are cut into batches doesn't matter.
    """
    fed = bars.select("symbol", F.unix_micros(F.col("t").cast("timestamp")).alias("_us"), F.col("arrival").cast("long").alias("arrival"), "o", "h", "l", "c", "v").where("_us is not null")
    bar = T.StructType(fed.schema.fields[1:])
    out = T.StructType([*fed.schema.fields, T.StructField("held", T.BooleanType())])
    done = fed.groupBy("symbol").transformWithState(Buffer(bar, most, hours * 3_600_000_000), out, "Update", "None")
    return done.select("symbol", F.timestamp_micros("_us").alias("t"), "o", "h", "l", "c", "v", "held")


def buffer_batch(bars: DataFrame, most: int = BUFFER_BARS, hours: int = BUFFER_HOURS) -> DataFrame:
    """Batch twin of buffer: what each symbol's buffer holds after all arrivals, as (symbol, t, o, h, l, c, v)."""
    us = F.unix_micros(F.col("t").cast("timestamp"))
    arrived = W.partitionBy("symbol").orderBy("arrival")
    d = bars.withColumn("_us", us).where("_us is not null").withColumn("_late", F.col("_us") < F.max("_us").over(arrived.rowsBetween(W.unboundedPreceding, 0)) - hours * 3_600_000_000)
    first = d.where("not _late").groupBy("symbol", "_us").agg(F.min_by(F.struct("t", "o", "h", "l", "c", "v"), "arrival").alias("b"))
    newest = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("_us")))
    return first.withColumn("_n", newest).where(F.col("_n") <= most).select("symbol", "b.*")
