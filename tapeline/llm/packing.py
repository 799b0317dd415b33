"""Packing of documents into sequences whose token mixture is controlled.

Every source is a queue of documents, cut into packets of at most one sequence. Deficit
round-robin serves them: in each window a source's credit grows by its share of the window's
tokens, it sends packets as long as its credit covers them, and keeps what is left (the deficit)
for the next window. The packets sent, one behind the other, are cut into sequences, so only the
last sequence is padded, and up to any window a source is at most one packet behind its share.

Deficits are not passed from window to window but computed: while a queue has packets, what it
has sent by window r is the longest run of packets within r times its quantum, whatever was sent
when. So a packet that ends at token e of its queue goes in window ceil(e / quantum), and three
running totals, none of them in one task, replace the rounds: of tokens within a queue (over the
files of the encoded corpus), and of packets and of buckets of windows within the stream.

Where the shares asked for differ from the corpus, queues run dry at different times. The others
then share the windows in proportion: the credit given up to a virtual time v is the sum of
min(tokens, share * v) over the queues, which gives the window of v.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.llm import common
from tapeline.llm.simple8b import encoder

SEQUENCE = 2048
#: Windows, and in turn buckets of windows, whose running total one task takes.
BUCKET = 1024
LEVELS = 3


def encode(docs: DataFrame, path: str, end_id: int | None = 1) -> DataFrame:
    """Written table (shard, row, doc_id, source, at, n_tokens, ids): each document's ids once, and the tokens of its source before it in its shard.

    ids are little-endian and 16 bits wide where the vocabulary allows, else 32 (column `wide`).
    A shard is what one task wrote; shard and row name a document even where doc_id is null or repeated.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, row = encoder(path), TaskContext.get().partitionId(), 0
        wide = e.tokenizer.get_vocab_size() > 1 << 16 or (end_id or 0) >= 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        tail = np.array([] if end_id is None else [end_id], kind)
        before: dict[str | None, int] = {}
        for batch in common.slices(batches, "text"):
            ids = [np.concatenate([e.encode(t).astype(kind), tail]) for t in batch.column("text").to_pylist()]
            at = []
            for source, x in zip(batch.column("source").to_pylist(), ids):
                at.append(before.get(source, 0))
                before[source] = at[-1] + len(x)
            n = batch.num_rows
            columns = [
                pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("source"), pa.array(at, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(n, wide)),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "row", "doc_id", "source", "at", "n_tokens", "ids", "wide"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return common.materialize(rows.mapInArrow(run, "shard int, row long, doc_id long, source string, at long, n_tokens long, ids binary, wide boolean"))


def running_totals(rows: DataFrame, key: str, value: str, level: int = 0) -> DataFrame:
    """(key, before): per distinct whole-number key the sum of `value` over all smaller keys, in buckets of BUCKET keys on LEVELS levels; the topmost is one task's."""
    keys = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias("_n")).withColumn("_up", F.floor(F.col("_key") / BUCKET) if level < LEVELS else F.lit(0))
    smaller = W.partitionBy("_up").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    done = keys.withColumn("before", F.coalesce(F.sum("_n").over(smaller), F.lit(0)))
    if level < LEVELS:
        above = running_totals(keys, "_up", "_n", level + 1).withColumnRenamed("before", "_above")
        done = done.join(above, "_up").withColumn("before", F.col("before") + F.col("_above"))
    return done.select(F.col("_key").alias(key), "before")


def _shares(encoded: DataFrame, mixture: dict[str, float] | None) -> tuple[Column, list[tuple[int, float]]]:
    """The virtual time at which a source's credit reaches the tokens `end` (from the columns source, total and end), and (tokens, share) of every queue that is named and of the others together."""
    mixture = mixture or {}
    if any(w <= 0 for w in mixture.values()):
        raise ValueError("shares must be above 0")
    every = encoded.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    named = {r["source"]: r["n"] for r in encoded.where(F.col("source").isin(list(mixture))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if mixture else {}
    rest = every - sum(named.values())
    given = sum(mixture[s] for s in named)
    if rest and given >= 1:
        raise ValueError("the shares leave nothing to the sources that are not named")
    scale = 1.0 if rest else 1 / (given or 1)  # shares of sources that have documents, if no others do
    queues = [(n, mixture[s] * scale) for s, n in named.items()] + ([(rest, 1 - given)] if rest else [])
    time = F.col("end").cast("double") * F.lit(float(rest)) / F.col("total") / F.lit(1 - given if rest else 1.0)
    for s in named:
        time = F.when(F.col("source") == s, F.col("end") / F.lit(mixture[s] * scale)).otherwise(time)
    return time, queues


def schedule(encoded: DataFrame, mixture: dict[str, float] | None = None, size: int = SEQUENCE, window: int = SEQUENCE) -> DataFrame:
    """Written table (shard, row, source, first, length, window, stream): every packet with the window it is sent in and the tokens sent before it.

    encoded: rows of `encode`. Within a window the sources follow in order of their names, none first.
    """
    time, queues = _shares(encoded, mixture)
    per_shard = encoded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = per_shard.select("source", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("source")).alias("total"))
    bases = bases.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "base", "total")
    rows = encoded.select("shard", "row", "source", "at", "n_tokens").where("n_tokens > 0")
    rows = rows.join(bases, (rows.shard == bases._shard) & rows.source.eqNullSafe(bases._source))
    packets = rows.select("*", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {size}L)")).alias("_k")).select(
        "shard", "row", "source", "total", (F.col("_k") * size).alias("first"), F.least(F.lit(size), F.col("n_tokens") - F.col("_k") * size).alias("length"), (F.col("base") + F.col("at")).alias("_at")
    )
    packets = packets.withColumn("end", F.col("_at") + F.col("first") + F.col("length"))
    credit = sum((F.least(F.lit(float(n)), time * w) for n, w in queues), F.lit(0.0))
    packets = packets.select("shard", "row", "source", "first", "length", "end", F.ceil(credit / window).alias("window"))
    packets = common.materialize(packets.withColumn("_bucket", F.floor(F.col("window") / BUCKET)))
    sent = W.partitionBy("_bucket").orderBy("window", "source", "end").rowsBetween(W.unboundedPreceding, -1)
    inside = packets.withColumn("_inside", F.coalesce(F.sum("length").over(sent), F.lit(0)))
    done = inside.join(running_totals(packets, "_bucket", "length"), "_bucket")
    return done.select("shard", "row", "source", "first", "length", "window", (F.col("before") + F.col("_inside")).alias("stream"))


def pack(docs: DataFrame, path: str, end_id: int | None = 1, mixture: dict[str, float] | None = None, size: int = SEQUENCE, window: int = SEQUENCE) -> DataFrame:
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, window, ids): every token of every document in one piece of one sequence of at most `size` tokens.

    mixture: shares of sources in each window of `window` tokens; sources that it does not name
    share the rest in proportion to their tokens, and without it all do, so that no queue runs dry
    before the last window. start counts the document's ids before the piece; ids are
    little-endian unsigned 32-bit. Null texts count as empty and consist of end_id alone, or of
    nothing and give no piece where that is None. Rows without a source are one queue; rows with a
    null or repeated doc_id are documents of their own. Other columns are ignored; an empty table
    gives no rows.
    """
    encoded = encode(docs, path, end_id)
    plan = schedule(encoded, mixture, size, window).groupBy("shard", "row").agg(F.sort_array(F.collect_list(F.struct("first", "length", "stream", "window"))).alias("packets"))
    rows = plan.join(encoded.select("shard", "row", "doc_id", "source", "n_tokens", "ids", "wide"), ["shard", "row"]).drop("shard", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "ids"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
        for batch in common.slices(batches, "ids"):
            out = []
            for doc_id, source, n, data, wide, packets in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "ids", "wide", "packets")]):
                ids = memoryview(data if wide else np.frombuffer(data, "<u2").astype("<u4").tobytes())
                for p in packets:
                    a, end, stream = p["first"], p["first"] + p["length"], p["stream"]
                    while a < end:
                        z = min(end, a + size - stream % size)
                        out.append((doc_id, source, a, z - a, n, stream // size, stream % size, p["window"], bytes(ids[4 * a : 4 * z])))
                        stream += z - a
                        a = z
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    schema = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, window long, ids binary"
    return rows.mapInArrow(cut, schema)
