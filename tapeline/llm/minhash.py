"""Near-duplicate documents by min-max hashing.

Every document is the set of its distinct five-word shingles. Each of 60 hash functions is
evaluated once per shingle and gives two signature values, the minimum and the maximum, so
120 values cost 60 evaluations. Bands of the values find candidates: 20 of 6 at the threshold
0.85, 24 of 5 at 0.8; a minimum and a maximum of the same function never share a band.

Plan: identical sets collapse first, so groups of copies cost one row each. Members of a band's
bucket never expand to pairs, and texts or full sets never travel to more than one partner:

1. Every document meets the smallest member of its buckets, on full sets.
2. In buckets that still hold several components, those outside the largest meet the others by
   16-bit signatures in blocks and name their LEADS likeliest partners, which are confirmed on
   full sets.
3. Members of what is still open, if any, meet in blocks of full sets, pair by pair.

The components of the confirmed links are the result.

Words are held as 64-bit hashes while they run; an equal hash of different shingles within
one document pair has probability below 2**-40 for sets of a million shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

SHINGLE = 5
PERMUTATIONS = 60
#: Chance to miss a pair at the threshold, at most.
MISS = 1e-4
#: Signatures on either side of a block, and shingles where full sets meet.
BLOCK = 4096
BLOCK_SHINGLES = 500_000
#: Likeliest partners that a document outside the largest component of a bucket names, before what is then open is compared in full.
LEADS = 4

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_POS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(common.Memory):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_words = _WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; words are what stands between ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n >= SHINGLE:
        h = sum(h[i : n - SHINGLE + 1 + i] * _POS[i] for i in range(SHINGLE))
    elif n:
        h = np.array([(h * _POS[:n]).sum() + np.uint64(n)], np.uint64)
    return np.unique(_mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 120): the minima and then the maxima of each non-empty set; a row of zeros for an empty one."""
    out = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint64)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[k] for k in full])
        at = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        for p in range(PERMUTATIONS):
            t = x * _MUL[p] + _ADD[p]
            out[full, p] = np.minimum.reduceat(t, at)
            out[full, PERMUTATIONS + p] = np.maximum.reduceat(t, at)
    return out


def band_rows(num: int, den: int) -> int:
    """Values per band: as many, up to 6, as miss a pair at the threshold with chance MISS at most."""
    fit = [r for r in (6, 5, 4, 3, 2) if (1 - (num / den) ** r) ** (2 * PERMUTATIONS / r) <= MISS]
    return fit[0] if fit else 1


def bands(sig: np.ndarray, rows: int = 6) -> np.ndarray:
    """(documents, 120 / rows) band keys as signed 64-bit integers; each key holds its band's number."""
    per = sig.reshape(len(sig), 2 * PERMUTATIONS // rows, rows)
    key = (_mix(per) * _BAND[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(per.shape[1], dtype=np.uint64)
    return _mix(key).view(np.int64)


_PROFILE = "id long, n_shingles long, digest binary, bands array<long>"


def _profile(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        keys = bands(signatures(sets), rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, max(1, keys.shape[1]), dtype=np.int32), keys.reshape(-1)),
            ],
            names=["id", "n_shingles", "digest", "bands"],
        )
    _words.forget()


def _write_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, shingles, sig): the sorted set and the low 16 bits of its signature."""
    for batch in common.slices(batches, "text"):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        sig = signatures(sets).astype("<u2")
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
            names=["id", "n", "shingles", "sig"],
        )
    _words.forget()


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, for sorted sets without repeats."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def least_equal(num: int, den: int, margin: float | None) -> float:
    """Equal signature values below which a pair is not looked at: the threshold less `margin` standard deviations; None looks at all."""
    j, n = num / den, 2 * PERMUTATIONS
    return 0.0 if margin is None else (j - margin * (j * (1 - j) / n) ** 0.5) * n


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link on full sets. The set of b travels once a pair, that of a once for up to SALTS groups of its pairs."""
    dealt = pairs.withColumn("part", common.salt("b"))
    sets = sets.select("id", "shingles")
    heads = dealt.select("a", "part").distinct().join(sets, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rest = dealt.join(sets, F.col("b") == F.col("id")).select("a", "part", "b", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "shingles"))):
                x = np.frombuffer(s, "<u8")
                if (a, part) != now:
                    now, held = (a, part), []
                if b is None:
                    held.append(x)
                elif any(links(x, y, num, den) for y in held):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = heads.union(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return met.mapInArrow(check, "a long, b long")


def _crossing(part: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each guest: its row, and the rows at home of other components whose signatures agree in at least `least` values, with that number."""
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(part.num_rows, -1)
    side, comp = part.column("side").to_numpy(), part.column("comp").to_numpy()
    home = np.flatnonzero(side == 1)
    at_home, comps = sig[home], comp[home]
    for g in np.flatnonzero(side == 0).tolist():
        other = np.flatnonzero(comps != comp[g])
        same = (at_home[other] == sig[g]).sum(axis=1)
        near = same >= least
        if near.any():
            yield g, home[other[near]], same[near]


def _leads(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each guest up to LEADS pairs to confirm, with those at home of other components that are likeliest to link."""
    for _, part in common.runs(batches, ["key", "i", "j"]):
        ids = part.column("id").to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for g, there, same in _crossing(part, least):
            top = there[np.argsort(-same, kind="stable")[:LEADS]]
            out.append(np.stack([np.minimum(ids[top], ids[g]), np.maximum(ids[top], ids[g])], axis=1))
        pairs = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _open_members(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(key, id, guest, home) of rows that have a pair to confirm across components."""
    for (key, _, _), part in common.runs(batches, ["key", "i", "j"]):
        guests, homes = set(), set()
        ids = part.column("id").to_numpy()
        for g, there, _ in _crossing(part, least):
            guests.add(int(ids[g]))
            homes.update(ids[there].tolist())
        every = sorted(guests | homes)
        cols = [pa.array([key] * len(every), pa.int64()), pa.array(every, pa.int64()), pa.array([x in guests for x in every], pa.bool_()), pa.array([x in homes for x in every], pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "guest", "home"])


def _exact(batches: Iterator[pa.RecordBatch], least: float, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Confirm every pair across components in a block on full sets, and return a spanning forest of those that link."""
    for _, part in common.runs(batches, ["key", "i", "j"]):
        comp, ids, sets = part.column("comp").to_numpy(), part.column("id").to_numpy(), [np.frombuffer(s, "<u8") for s in part.column("shingles").to_pylist()]
        number = {c: k for k, c in enumerate(np.unique(comp).tolist())}
        forest, out = common.Forest(len(number)), []
        for g, there, same in _crossing(part, least):
            for k in there[np.argsort(-same, kind="stable")].tolist():
                x, y = number[comp[g]], number[comp[k]]
                if forest.find(x) != forest.find(y) and links(sets[g], sets[k], num, den):
                    forest.join(x, y)
                    out.append((int(ids[g]), int(ids[k])))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, id, comp, guest, home) of buckets that hold several components: all are at home, those outside the largest component are guests."""
    placed = common.materialize(buckets.select("key", "id").join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
    dealt = placed.withColumn("_salt", common.salt("id"))
    per_key = dealt.groupBy("key", "comp").agg(F.count("*").alias("n"), common.salts_used()).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.bit_or("_mask").alias("_mask"))
    several = dealt.join(common.per_salt(per_key.where("comps > 1").select("key", "main", "_mask")), ["key", "_salt"])
    return several.select("key", "id", "comp", (F.col("comp") != F.col("main")).alias("guest"), F.lit(True).alias("home"))


def _met(rows: DataFrame, weight: str, limit: float) -> DataFrame:
    met = common.meetings(rows, ["key"], "guest", "home", weight, limit)
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, margin: float | None = 5.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept).

    component_id is the smallest id reachable over links with den * intersection >= num * union.
    Null or blank texts have an empty set and are alone. Rows with equal ids are one node; a row
    without an id is not linked and has no component. kept: the id is the component's. Other
    columns of docs are ignored, whatever their names; an empty table gives an empty result.

    Pairs that share a band are confirmed on full sets, except those whose signatures agree in
    fewer values than the threshold less `margin` standard deviations (five: 3e-7 of the pairs
    at the threshold); None confirms them all.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, least = band_rows(num, den), least_equal(num, den, margin)
    profile = common.materialize(texts.mapInArrow(lambda batches: _profile(batches, rows), _PROFILE))
    filled = profile.where("digest is not null and id is not null")
    nodes = common.with_facts(filled, ["digest"], "id", [F.min("id").alias("rep")]).select("id", "n_shingles", "rep", F.expr("if(id = rep, bands, null)").alias("bands"))
    empty = profile.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("rep"), F.lit(None).cast("array<long>").alias("bands"))
    nodes = common.materialize(nodes.union(empty))
    keys = common.materialize(nodes.where("bands is not null").select(F.explode("bands").alias("key"), "id").distinct())
    buckets = common.materialize(common.with_facts(keys, ["key"], "id", [F.min("id").alias("low"), F.max("id").alias("high")], "low <> high").drop("high"))
    heads = common.materialize(buckets.groupBy("id").agg(F.min("low").alias("head")))
    sets = common.materialize(texts.join(heads.select("id"), "id", "left_semi").mapInArrow(_write_sets, "id long, n long, shingles binary, sig binary"))
    several = nodes.where("id is not null").groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("id")
    same_id = nodes.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # first every document with the smallest member of its buckets, then the likeliest partners across components that still share a bucket, then what is open
    links = common.materialize(confirm(heads.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")), sets, num, den).union(same_id))
    parts = common.materialize(common.connected_components(links))
    mixed = common.materialize(_mixed(buckets, parts))
    if not mixed.isEmpty():
        signed = mixed.withColumn("one", F.lit(1)).join(sets.select("id", "sig"), "id")
        leads = _met(signed, "one", BLOCK).mapInArrow(lambda batches: _leads(batches, least), "a long, b long").distinct()
        more = common.materialize(confirm(leads, sets, num, den))
        links = links.union(more)
        parts = common.materialize(common.connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
        mixed = common.materialize(_mixed(mixed, parts))
    if not mixed.isEmpty():
        signed = mixed.withColumn("one", F.lit(1)).join(sets.select("id", "sig"), "id")
        members = _met(signed, "one", BLOCK).mapInArrow(lambda batches: _open_members(batches, least), "key long, id long, guest boolean, home boolean")
        members = members.groupBy("key", "id").agg(F.max("guest").alias("guest"), F.max("home").alias("home"))
        members = common.materialize(members.join(mixed.select("key", "id", "comp"), ["key", "id"]).join(sets.select("id", "n"), "id"))
        met = common.meetings(members, ["key"], "guest", "home", "n", BLOCK_SHINGLES).join(sets.select("id", "sig", "shingles"), "id")
        met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
        more = met.mapInArrow(lambda batches: _exact(batches, least, num, den), "a long, b long")
        parts = common.connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return nodes.join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rep"), F.lit(False)).alias("kept"),
    )
