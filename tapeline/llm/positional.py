"""Benchmark decontamination with a distributed positional inverted index.

The index is stored once and serves any number of test sets. One pass over the training texts
writes every token's posting: a row per (term, shard) with the term's positions in that shard,
a shard being a range of documents of some million words, so a frequent term is
split over many rows. Rows are laid out by (term, shard). A term is the 64-bit hash of its word.

A search reads the postings of the test terms only. It counts them, takes each window's rarest
term, drops windows with a term that never occurs, and sends the other postings to their shards,
where offset-adjusted lists are intersected from the rarest term on. Windows go with the tasks
in parts of bounded size (PART_WINDOWS); each part reads its own terms' rows of the index again,
never the texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm import common

WINDOW = 13
#: Words after which a shard is closed.
SHARD_WORDS = 1_000_000
#: Windows that are sent with the tasks at once.
PART_WINDOWS = 200_000

#: Bytes that end a word become spaces, A-Z become a-z, digits, letters and all bytes from 0x80 stay.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class _Terms(common.Memory):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) - (1 << 63)


#: Words that a worker remembers in either generation.
KEPT_WORDS = 400_000
_terms = _Terms(KEPT_WORDS)


def terms(text: str | None) -> np.ndarray:
    """The words of a text as term numbers."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    return np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 in bytes of seven bits, low ones first, all but a number's last with the high bit set; and where each ends."""
    size = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = values[some] >> 7 * k & 127 | (size[some] > k + 1) << 7
    return out, ends


def _unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _pack, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.r_[0, ends][:-1]
    values = (data[starts] & 127).astype(np.int64)
    for k in range(1, 5):
        some = np.flatnonzero(ends - starts > k)
        values[some] |= (data[starts[some] + k] & 127).astype(np.int64) << 7 * k
    return values, ends


def _lists(positions: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all rows one after the other, and where each row's end."""
    offsets = np.frombuffer(positions.buffers()[1], np.int32)[positions.offset : positions.offset + len(positions) + 1].astype(np.int64)
    gaps, ends = _unpack(np.frombuffer(positions.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    bounds = np.searchsorted(ends, offsets - offsets[0], side="right")
    at = np.cumsum(gaps)
    before = np.r_[0, at][bounds[:-1]]
    return at - np.repeat(before, np.diff(bounds)), bounds[1:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Document ids and words of one shard after the other."""
    ids, texts, size = [], [], 0
    for batch in common.slices(batches, "text"):
        ids.append(batch.column("doc_id"))
        texts += [terms(t) for t in batch.column("text").to_pylist()]
        size += sum(len(x) for x in texts[-batch.num_rows :])
        if size >= SHARD_WORDS:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def _write_index(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    _terms.most = kept
    shard = TaskContext.get().partitionId() << 32
    names = ["kind", "shard", "term", "n", "positions", "doc_ids", "n_words"]
    for ids, texts in _shards(batches):
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = _starts(sizes)
        term = np.concatenate(texts)
        at = np.arange(len(term), dtype=np.int64) + np.repeat(np.arange(len(texts)), sizes)  # one free place between documents
        order = np.argsort(term, kind="stable")
        term, at = term[order], at[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[first, len(term)]
        k = len(first)
        gaps = np.diff(at, prepend=0)
        gaps[first] = at[first]
        packed, stops = _pack(gaps)
        offsets = np.r_[0, stops][ends].astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        no_lists = [pa.nulls(k, pa.list_(ids.type)), pa.nulls(k, pa.list_(pa.int32()))]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(sizes, pa.int32()))]
        one = [pa.array([0], pa.int32()), pa.array([shard]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *listed]
        yield pa.RecordBatch.from_arrays(one, names=names)
        assert not len(texts) or starts[-1] + sizes[-1] < 1 << 32
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(np.full(k, shard)), pa.array(term[first]), pa.array(np.diff(ends).astype(np.int32)), postings, *no_lists], names=names)
        shard += 1
    _terms.forget()


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each document of a shard begins."""
    return np.cumsum(sizes + 1) - (sizes + 1)


def build_index(docs: DataFrame, path: str | None = None, kept: int = KEPT_WORDS) -> DataFrame:
    """Write the index of docs (doc_id, text) to path, or to the shared folder, and return it.

    Rows of kind 1: (term, shard, n, positions), the positions being places in the shard, each as
    its distance from the one before, in bytes of seven bits (_pack). Rows of kind 0: a shard's doc_ids and n_words. Null and empty texts have
    no words; rows with equal ids or none stay apart; other columns are ignored. kept: words that a
    worker remembers in either generation; fewer take less memory and more time.
    """
    common.small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    fields = [("kind", T.IntegerType()), ("shard", T.LongType()), ("term", T.LongType()), ("n", T.IntegerType()), ("positions", T.BinaryType()), ("doc_ids", T.ArrayType(id_type)), ("n_words", T.ArrayType(T.IntegerType()))]
    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: _write_index(batches, kept), T.StructType([T.StructField(*f) for f in fields]))
    ranges = F.shiftright("term", 56)  # terms are hashes, so their ranges are even; a frequent term's shards are dealt further
    rows = rows.repartition(ranges, F.pmod(F.xxhash64("shard"), F.lit(64))).sortWithinPartitions("kind", "term", "shard")
    if path is None:
        return common.materialize(rows)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def documents(index: DataFrame) -> DataFrame:
    """(shard, k, doc_id, n_words) of every indexed row."""
    listed = index.where("kind = 0").select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("k", "d"))
    return listed.select("shard", "k", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))


def windows_of(tests: DataFrame, size: int) -> DataFrame:
    """Distinct windows (window, terms, items) of tests (item_id, text); items with a null id or text or without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                x = terms(text)
                if len(x):
                    n = min(size, len(x))
                    rows = np.lib.stride_tricks.sliding_window_view(x, n)
                    names = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in rows]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, n), pa.int32()), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists, pa.array([item] * len(rows), pa.string())], names=["window", "terms", "item_id"])

    tests = tests.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    cut_up = tests.mapInArrow(cut, "window long, terms array<long>, item_id string")
    return cut_up.groupBy("window").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item_id")).alias("items"))


_FOUND = "shard long, k int, first array<int>, last array<int>, sets array<long>"


def _phrases(lists: dict[int, np.ndarray], place: np.ndarray, by_anchor: dict) -> Iterator[tuple[int, int, int]]:
    """(first, last, set) of each occurrence of a window, in places of the shard; place: the term number at each place."""
    for term in lists.keys() & by_anchor.keys():
        for order, group in by_anchor[term]:
            at = lists[term] - order[0][0]
            at = at[(at >= 0) & (at + len(order) <= len(place))]
            for offset, t in order[1:]:
                if not len(at):
                    break
                at = at[place[at + offset] == t]
            for s in at.tolist():
                yield s, s + len(order) - 1, group


def _near(lists: dict[int, np.ndarray], bounds: np.ndarray, by_anchor: dict, slop: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, set) of the shortest stretch (the earliest of equal ones) around each occurrence of a window's rarest
    term that holds all terms of the window, as often as it does, within its size plus slop places of one document."""
    for term in lists.keys() & by_anchor.keys():
        for order, group in by_anchor[term]:
            need, reach = Counter(t for _, t in order), len(order) + slop
            if not need.keys() <= lists.keys():
                continue
            for at in lists[term].tolist():
                doc = np.searchsorted(bounds, at, side="right")
                low, high = max(at - reach + 1, bounds[doc - 1]), min(at + reach - 1, bounds[doc] - 2 if doc < len(bounds) else at + reach - 1)
                events = sorted((p, t) for t in need for x in [lists[t]] for p in x[np.searchsorted(x, low) : np.searchsorted(x, high, side="right")].tolist())
                have: Counter = Counter()
                lack, left, best = len(need), 0, None
                for p, t in events:
                    have[t] += 1
                    lack -= have[t] == need[t]
                    while not lack:
                        q, u = events[left]
                        if q <= at <= p and p - q < reach and (best is None or p - q < best[1] - best[0]):
                            best = (q, p)
                        have[u] -= 1
                        lack += have[u] == need[u] - 1
                        left += 1
                if best:
                    yield *best, group


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _search_part(index: DataFrame, windows: list, slop: int | None) -> DataFrame:
    """Matches of one bounded part of the windows: (shard, k, first, last, sets), one row per document with any."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(int(t),) for t in {t for w, _ in windows for t in w}], "term long")
    postings = index.where("kind = 1").select("shard", "term", "n", "positions").join(F.broadcast(wanted), "term")  # bounded by PART_WINDOWS
    counts = {r.term: r.n for r in postings.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    by_anchor = defaultdict(list)
    alive: set[int] = set()
    for w, group in windows:
        if all(t in counts for t in w):
            order = sorted(enumerate(w), key=lambda x: (counts[x[1]], x[1], x[0]))
            by_anchor[order[0][1]].append((order, group))
            alive.update(w)
    sent = spark.sparkContext.broadcast((dict(by_anchor), sorted(alive)))  # bounded by PART_WINDOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_anchor, known = sent.value
        number = np.array(known, np.int64)
        numbered = {int(np.searchsorted(number, t)): [([(o, int(np.searchsorted(number, x))) for o, x in order], g) for order, g in found] for t, found in by_anchor.items()}
        for (shard,), part in common.runs(batches, ["shard"]):
            sizes = np.concatenate([np.array(x, np.int64) for x in part.column("n_words").to_pylist() if x is not None])
            part = part.filter(pc.is_valid(part.column("term")))
            if not part.num_rows:
                continue
            held = np.searchsorted(number, part.column("term").to_numpy())
            if not numbered.keys() & set(held.tolist()):
                continue
            at, ends = _lists(pa.concat_arrays(part.column("positions").chunks))
            lists = dict(zip(held.tolist(), np.split(at, ends[:-1])))
            starts = _starts(sizes)
            if slop is None:
                place = np.full(int(starts[-1] + sizes[-1]), -1, np.int32)
                place[at] = np.repeat(held, np.diff(ends, prepend=0))
                found = _phrases(lists, place, numbered)
            else:
                found = _near(lists, starts, numbered, slop)
            spans, sets = defaultdict(set), defaultdict(set)
            for first, last, group in found:
                k = int(np.searchsorted(starts, first, side="right")) - 1
                spans[k].add((first - int(starts[k]), last - int(starts[k])))
                sets[k].add(group)
            rows = sorted(spans)
            merged = [_merged(list(spans[k])) for k in rows]
            cols = [[shard] * len(rows), rows, *([[s[e] for s in m] for m in merged] for e in (0, 1)), [sorted(sets[k]) for k in rows]]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shard", "k", "first", "last", "sets"])

    kept = postings.join(F.broadcast(spark.createDataFrame([(int(t),) for t in alive], "term long")), "term")
    rows = kept.select("shard", "term", "positions", F.lit(None).cast("array<int>").alias("n_words"))
    rows = rows.union(index.where("kind = 0").select("shard", F.lit(None).cast("long"), F.lit(None).cast("binary"), "n_words"))
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _FOUND)


def search(index: DataFrame, tests: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(shard, k, spans, items) of every document with a match, by its place in the index.

    slop None: exact windows of `size` words, of all words where an item has fewer. Else the
    words of a window in any order within its size plus slop words, each as often as in it.
    spans: maximal runs (first, last) of words inside matches; items: the item ids, sorted.
    """
    windows = windows_of(tests, size).withColumn("group", F.xxhash64("items"))
    windows = common.materialize(windows)
    parts = -(-windows.count() // PART_WINDOWS)
    found = index.sparkSession.createDataFrame([], _FOUND)
    for p in range(parts):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p).select("terms", "group").collect()
        found = found.union(_search_part(index, [(tuple(r.terms), r.group) for r in some], slop))
    found = common.materialize(found)
    groups = windows.select(F.col("group"), "items").dropDuplicates(["group"])
    items = found.select("shard", "k", F.explode("sets").alias("group")).distinct().join(groups, "group")
    items = items.groupBy("shard", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = found.groupBy("shard", "k").agg(F.flatten(F.collect_list(F.arrays_zip("first", "last"))).alias("spans"))
    return spans.join(items, ["shard", "k"])


def decontaminate(docs: DataFrame, tests: DataFrame, kept: int = KEPT_WORDS) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    n_hit: words inside an occurrence of any window; n_items: items with occurring windows;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null or empty texts have no words; items
    with a null id or text or without words have no windows; repeated ids keep a row each, and
    other columns are ignored. Empty tables give an empty result, or no hits.
    """
    index = build_index(docs, kept=kept)
    found = search(index, tests).withColumn("n_hit", F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.first, s.last)))))"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return documents(index).join(found, ["shard", "k"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
