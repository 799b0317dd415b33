"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is a list of parts beside a list with the rank of each part's join with its right
neighbour. The lowest rank is searched by a scan, the boundary there is deleted, and only the
two neighbouring ranks are refreshed. Words beyond SHORT parts go through a heap with the same
order (rank, then position), so a very long word costs n log n.

Each Python worker loads the vocabulary once and keeps the ids of recent words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm import common

SHORT = 64
#: Words that a worker keeps in either generation.
KEPT_WORDS = 100_000
_NONE = 1 << 30
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself where printable in Latin-1, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(common.Memory):
    """Word to ids (little-endian unsigned 32-bit), filled as words come."""

    def __init__(self, path: str):
        super().__init__(KEPT_WORDS)
        spec = json.load(open(path, encoding="utf-8"))
        vocab, symbol = spec["model"]["vocab"], byte_symbols()
        byte_of = {c: b for b, c in symbol.items()}
        self.first = [vocab[symbol[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], k)
            self.joined.append(vocab[a + b])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *special.values()])
        self.pieces: list[bytes] = [b""] * (top + 1)
        for t, k in vocab.items():
            self.pieces[k] = bytes(byte_of[c] for c in t)
        for t, k in special.items():
            self.pieces[k] = t.encode()
        self.special = {t: k.to_bytes(4, "little") for t, k in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(_PATTERN).findall

    def make(self, word: str) -> bytes:
        parts = [self.first[b] for b in word.encode("utf-8", "surrogatepass")]
        ids = self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts)
        return np.array(ids, "<u4").tobytes()

    def merge(self, parts: list[int]) -> list[int]:
        get, joined = self.rank.get, self.joined
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        ranks.append(_NONE)
        while (low := min(ranks)) != _NONE:
            k = ranks.index(low)
            parts[k] = new = joined[low]
            del parts[k + 1], ranks[k]
            ranks[k] = get(new << 20 | parts[k + 1], _NONE) if k + 1 < len(parts) else _NONE
            if k:
                ranks[k - 1] = get(parts[k - 1] << 20 | new, _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.rank.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := get(parts[k] << 20 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] != a or nxt < 0 or parts[nxt] != b:
                continue
            parts[k], parts[nxt] = self.joined[r], -1
            after[k] = end = after[nxt]
            if end >= 0:
                before[end] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (q := get(parts[x] << 20 | parts[after[x]])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[after[x]]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.words(text)))
        return b"".join(self.special.get(part) or b"".join(map(self.__getitem__, self.words(part))) for part in self.cut.split(text) if part)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers; null is as empty.

    One row per row of docs, repeated ones included, in no set order; texts of any length are
    encoded whole; other columns are ignored; an empty table gives an empty result. decoded: add
    what the ids decode to, as `decode` does, in the same worker.
    """
    common.small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *[("decoded", pa.string())] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in common.slices(batches, "text"):
            ids = [e.encode(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(0), [len(x) // 4 for x in ids], ids, *[map(e.decode, ids)] * decoded]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add `decoded` to a DataFrame with a column `ids`; invalid UTF-8 becomes U+FFFD, null ids become null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [None if x is None else e.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
