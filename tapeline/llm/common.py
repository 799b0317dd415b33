"""Helpers that the operators of this subpackage share: tables, scratch tables, components and meetings of groups."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


#: Characters of text, and rows, that a worker takes apart at a time.
SLICE_CHARS, SLICE_ROWS = 2_000_000, 500


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts of a column pass SLICE_CHARS (a longer text stands alone), so what a worker holds beside them is bounded."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        first = done = 0
        for k in range(batch.num_rows):
            if k > first and (ends[k] - done > SLICE_CHARS or k - first >= SLICE_ROWS):
                yield batch.slice(first, k - first)
                first, done = k, ends[k - 1]
        if batch.num_rows:
            yield batch.slice(first)


#: Words in either of two generations, and the bytes of the longest word that is kept at all: together they bound a memory's bytes.
KEPT_WORDS, KEPT_LENGTH = 100_000, 64


class Memory(dict):
    """What a worker remembers of recent words: `make` gives the value of a word that is not remembered.

    When the younger of two generations is full it becomes the older one, whose words come back as
    they are met. Long words are made anew each time, so an entry is some hundred bytes at most.
    """

    def __init__(self, most: int = KEPT_WORDS):
        self.older: dict = {}
        self.most = most

    def make(self, word):
        raise NotImplementedError

    def forget(self) -> None:
        """Let both generations go, and what Arrow holds unused: workers live on for other stages."""
        self.older = {}
        self.clear()
        pa.default_memory_pool().release_unused()

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > KEPT_LENGTH:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of text that an Arrow batch may hold; a value of the user's own that is smaller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 500 or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, "500")


#: Tasks that the rows of one hot key are dealt over.
SALTS = 64


def salt(by: str):
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts_used():
    """Which salts a key has rows in, as a mask of SALTS bits."""
    return F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask")


def per_salt(facts: DataFrame) -> DataFrame:
    """A row of facts for each salt of its mask and no others, so a hot key is split and a small one costs no more."""
    return facts.withColumn("_salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), x -> shiftright(_mask, x) & 1L = 1L)"))).drop("_mask")


def with_facts(rows: DataFrame, keys: list[str], by: str, facts: list, having: str = "true") -> DataFrame:
    """rows with aggregates over their keys, for keys that satisfy `having`; rows of a key are dealt over SALTS tasks by `by`.

    rows is read twice: give a written table.
    """
    salted = rows.withColumn("_salt", salt(by))
    per_key = salted.groupBy(*keys).agg(*facts, salts_used()).where(having)
    return salted.join(per_salt(per_key), [*keys, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of edges (a, b), as (node, component): component is the smallest node reachable.

    Alternating large-star and small-star contraction; each round is written to the shared
    folder and only one flag reaches the driver. Self-links and nulls are ignored. A hub's
    links are dealt over many tasks (with_facts).
    """
    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    low = [F.min("v").alias("low")]
    while not _is_star_forest(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(with_facts(both, ["u"], "v", low).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())
        small = with_facts(large, ["u"], "v", low)
        down = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = materialize(down.union(small.where("v = low").select("u", "v")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_star_forest(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    return not per_node.agg(F.max(bad).alias("bad")).first()["bad"]


def meetings(rows: DataFrame, keys: list[str], guest: str, home: str, weight: str, limit: float) -> DataFrame:
    """Let every guest of a key meet every row of that key that is at home there, in blocks of about `limit` weight.

    rows: keys, id, the flags `guest` and `home` (a row may be both), further columns. Returns
    rows with i, j and side: a guest has side 0 and comes to block i with all j, a row at home
    has side 1 and comes to block j with all i. A key costs a guest as many copies as it has
    home blocks, and a row at home as many as it has guest blocks. rows is read twice.
    """
    blocks = lambda flag: F.ceil(F.sum(F.when(F.col(flag), F.col(weight))) / F.lit(float(limit))).cast("int")
    facts = [blocks(guest).alias("ni"), blocks(home).alias("nj"), F.min("id").alias("low"), F.max("id").alias("high")]
    dealt = with_facts(rows, keys, "id", facts, "ni > 0 and nj > 0 and low <> high")
    i, j = (F.pmod(F.xxhash64("id", F.lit(k)), F.col(n)).cast("int") for k, n in ((1, "ni"), (2, "nj")))
    a = dealt.where(guest).withColumn("i", i).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).withColumn("side", F.lit(0))
    b = dealt.where(home).withColumn("j", j).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("side", F.lit(1))
    return a.unionByName(b).drop("ni", "nj", "low", "high")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys with the bounds of the runs, from batches sorted by the keys; a run may span batches."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        last = batch is None
        if not last:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
        if held is None:
            return
        new = np.zeros(held.num_rows - 1, bool)
        for k in keys:
            x = held.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), *([held.num_rows] if last else [])]
        if bounds[-1]:
            yield held.slice(0, bounds[-1]).combine_chunks(), bounds
            held = held.slice(bounds[-1])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Contiguous rows of equal integer keys, one table at a time, from batches sorted by the keys."""
    for table, bounds in whole_runs(batches, keys):
        names = [table.column(k).to_numpy() for k in keys]
        for a, b in zip(bounds, bounds[1:]):
            yield tuple(int(x[a]) for x in names), table.slice(a, b - a)


class Forest:
    """Union-find over 0..n-1 with the smallest index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
