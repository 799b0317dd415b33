"""Simple-8b word-aligned coding of integers, and token files made of it.

A 64-bit word holds a selector in its top four bits and 60 bits of values of equal width.
Selector 0 is the escape: the next word is one raw 64-bit value that needs more than 60 bits.
Values are coded in frames of FRAME; the offsets of the frames' first words are kept, so that a
frame is found and decoded by itself, with one array operation per selector.

Token files are Parquet with one row per block of consecutive documents: shard, block, ids
before the block in its shard, document ids, tokens per document, frame offsets and coded
words. Shards follow each other in doc_id order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

FRAME = 4096
#: A block is closed when it has so many ids.
BLOCK_IDS = 65_536
#: (values, bits) of selectors 1 to 14; fixed values of the code.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_LIMITS = np.array([1 << b for _, b in LAYOUT], np.uint64)
_NARROWER = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


#: Frames that are coded with one set of array operations.
_TOGETHER = 16


def _pack_frames(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each frame, and the words; no word reaches over the end of its frame."""
    n = len(v)
    best = np.zeros(n, np.uint8)  # the escape, until a selector fits
    wide = _NARROWER[v] if v.max(initial=0) < len(_NARROWER) else np.searchsorted(_LIMITS, v, side="right").astype(np.uint8)  # selectors too narrow for each value
    narrow = np.cumsum(np.bincount(wide, minlength=len(LAYOUT) + 1))
    place = np.arange(n)
    room = np.minimum(FRAME - place % FRAME, n - place)
    for s in range(len(LAYOUT), 0, -1):
        count = LAYOUT[s - 1][0]
        if count <= n and narrow[s - 1] >= count:  # else no run of so many values can fit
            over = np.zeros(n + 1, np.int32)
            np.cumsum(wide >= s, out=over[1:])
            np.putmask(best[: n - count + 1], (over[count:] == over[: n - count + 1]) & (room[: n - count + 1] >= count), s)
    step = np.array([1] + [c for c, _ in LAYOUT])
    after, at, starts = (place + step[best]).tolist(), 0, []
    while at < n:
        starts.append(at)
        at = after[at]
    starts_a = np.array(starts, np.int64)
    sel = best[starts_a]
    size = 1 + (sel == 0)
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        which = sel == s
        here = starts_a[which]
        if s == 0:
            out[first[which] + 1] = v[here]
            continue
        count, bits = LAYOUT[s - 1]
        word = np.full(len(here), s << 60, np.uint64)
        for k in range(count):
            word |= v[here + k] << np.uint64(k * bits)
        out[first[which]] = word
    per_frame = np.bincount(starts_a // FRAME, weights=size).astype(np.int64)
    return per_frame, out


def pack(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Frame offsets (in words, one more than frames) and the little-endian words of unsigned values."""
    v = np.asarray(values, np.uint64)
    parts = [_pack_frames(v[k : k + FRAME * _TOGETHER]) for k in range(0, len(v), FRAME * _TOGETHER)]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([p[0] for p in parts]))] if parts else [[0]]).astype(np.int32)
    return offsets, (np.concatenate([p[1] for p in parts]) if parts else v[:0]).astype("<u8").tobytes()


def _unpack_frames(w: np.ndarray) -> np.ndarray:
    """The values of whole frames that follow each other."""
    sel = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    if (sel == 0).any():  # a raw word may look like an escape: follow them in order
        k = 0
        for k0 in np.flatnonzero(sel == 0).tolist():
            if k0 >= k:
                raw[k0 + 1] = True
                k = k0 + 2
        sel[raw] = 15
    count = np.array([0] + [c for c, _ in LAYOUT] + [1])[sel]
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        here = sel == s
        if s == 15:
            out[at[here]] = w[here]
        elif s:
            c, bits = LAYOUT[s - 1]
            k = np.arange(c)
            out[at[here][:, None] + k] = (w[here][:, None] >> (k.astype(np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    return out


def unpack(offsets: np.ndarray, data: bytes) -> np.ndarray:
    w = np.frombuffer(data, "<u8")
    ends = [*range(0, len(offsets) - 1, _TOGETHER), len(offsets) - 1]
    frames = [_unpack_frames(w[offsets[a] : offsets[b]]) for a, b in zip(ends, ends[1:])]
    return np.concatenate(frames) if frames else np.zeros(0, np.uint64)


#: A run of Latin letters that normalization only lower-cases, and a run of ASCII punctuation that no contraction can begin in.
_PLAIN = re.compile(r"([a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: An ASCII capital before a character that may be a combining mark (UTF-8 lead bytes of all blocks that have such): composed first, it is lower-cased in another way.
_MARKED = re.compile(rb"[A-Z](?:[\xcc\xcd\xd2\xd6-\xdf\xe0\xe1\xea\xf0-\xf4]|\xe2[\x83\xb3\xb5\xb7]|\xe3[\x80\x82]|\xef[\xac\xb8])")


#: Words that a worker keeps in either generation.
KEPT_WORDS = 400_000


class Encoder(common.Memory):
    """Chunk between ASCII white space to ids by the tokenizers library, which cuts words at any white space.

    The library's normalizer composes characters (NFC) and then lower-cases. ASCII letters are
    lower-cased beforehand here where no mark follows a capital, so that composing can't see the
    difference; texts where one does, and texts that may hold a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tapeline.llm.bpe import byte_symbols

        super().__init__(KEPT_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def make(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if chunk.isalpha():  # ASCII letters alone, lower-cased already
            return b"".join([self.ids[t.id] for t in self.model.tokenize(text)])
        m = _PLAIN.fullmatch(text)
        if m is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if m[2]:
            return self[m[1].encode()] + self[m[2].encode()]
        word = text if text.isascii() else text.lower().encode().decode("latin-1").translate(self.symbols)
        return b"".join([self.ids[t.id] for t in self.model.tokenize(word)])

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        raw = text.encode("utf-8")
        data = raw.lower()
        if any(m in data for m in self.marks) or _MARKED.search(raw):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, data.split())), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_FILE = "shard int, block int, before long, doc_ids array<long>, lengths array<int>, offsets array<int>, words binary"


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 1, to: str | None = None) -> DataFrame:
    """Encode whole texts, add end_id to each, and write token files in ascending doc_id order; returns them as a DataFrame.

    The files go to the shared folder `to`, which must not exist yet, and stay there; without it, to
    the scratch folder, until the application ends.
    Null texts count as empty. Rows with equal ids follow each other in order of their texts,
    rows without an id come first. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard = encoder(path), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        block = before = 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(held)
            offsets, words = pack(values)
            row = ([shard], [block], [before], [ids], [[len(x) for x in held]], [offsets], [words])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in _FILE.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.concatenate([e.encode(text), tail])
                held.append(x)
                ids.append(doc_id)
                size += len(x)
                if size >= BLOCK_IDS:
                    yield close()
                    held, ids, block, before, size = [], [], block + 1, before + size, 0
        if held:
            yield close()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(write, _FILE)
    if to is None:
        return common.materialize(files)
    files.write.parquet(to)
    return spark.read.schema(files.schema).parquet(to)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of token files: start counts the ids of all documents before, ids are little-endian unsigned 32-bit."""
    totals = {r.shard: r.n for r in files.groupBy("shard").agg(F.max(F.col("before") + F.expr("aggregate(lengths, 0L, (s, x) -> s + x)")).alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                values = unpack(np.asarray(row["offsets"].as_py()), row["words"].as_py()).astype("<u4")
                lengths = np.array(row["lengths"].as_py(), np.int64)
                end = np.cumsum(lengths)
                first = base[row["shard"].as_py()] + row["before"].as_py()
                parts = [values[a:b].tobytes() for a, b in zip(end - lengths, end)]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(first + end - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
