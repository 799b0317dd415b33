"""Fill-in-middle transformation by a byte automaton.

One table, built from the unit and the sentinels, drives the scan: a state says how many UTF-8
continuation bytes are due, whether the byte before was white space, and how much of a sentinel
has been read. A transition emits START where a unit begins and SENTINEL where one ends. After
`horizon` bytes the state no longer depends on where the automaton stood before (the table is
checked for it), so all bytes of a segment take their transitions together, each from `horizon`
bytes back; segments overlap by that much. The scan counts its emissions per block. The second
pass finds the block of a cut by the counts and the byte inside it.

Bytes are never decoded, so texts of any length cost one byte of emissions per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many are transformed, and so many of those suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("chars", "words", "lines")
#: Emissions of a transition.
START, SENTINEL = 1, 2
#: Bytes that a scan runs at a time, and bytes that a count covers.
SEGMENT, BLOCK = 1 << 16, 1 << 12
#: Stands between texts and is no byte of UTF-8: every state goes back to the first.
BREAK = 0xFF
_WHITE = (9, 10, 11, 12, 13, 32)


class Automaton:
    """Transitions and emissions over bytes for a unit and sentinels."""

    def __init__(self, unit: str = "chars", sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        if len(set(marks)) != 3 or not all(marks) or any(m[0] in m2[1:] for m in marks for m2 in marks):
            raise ValueError("three different sentinels are needed, whose first bytes stand nowhere else in them")
        prefixes = sorted({m[:k] for m in marks for k in range(len(m))}, key=lambda p: (len(p), p))
        states = [(due, fresh, p) for p in prefixes for fresh in (True, False) for due in range(4)]
        states.sort(key=lambda s: s != (0, True, b""))  # the first state stands before a text
        number = {s: k for k, s in enumerate(states)}
        self.next = np.zeros((len(states), 256), np.uint8 if len(states) <= 256 else np.uint16)
        self.emit = np.zeros((len(states), 256), np.uint8)
        for s, k in number.items():
            for b in range(256):
                to, out = self._step(*s, b, unit, marks, prefixes)
                self.next[k, b], self.emit[k, b] = number[to], out
        self.horizon = self._horizon(max(map(len, marks)) + 4)

    @staticmethod
    def _step(due: int, fresh: bool, read: bytes, b: int, unit: str, marks: list[bytes], prefixes: list[bytes]) -> tuple[tuple, int]:
        if b == BREAK:
            return (0, True, b""), 0
        tail = read + bytes([b])
        out = SENTINEL if tail in marks else 0
        while tail not in prefixes:
            tail = tail[1:]
        inside = b & 0xC0 == 0x80 and due > 0
        then = due - 1 if inside else 1 if b & 0xE0 == 0xC0 else 2 if b & 0xF0 == 0xE0 else 3 if b & 0xF8 == 0xF0 else 0
        white = b in _WHITE if unit == "words" else b == 10 if unit == "lines" else True
        # a word begins where white space ends, a line after a line feed, a character at any byte that continues none
        begins = fresh and not (unit == "words" and white) if unit != "chars" else not inside
        return (then, white, tail), out | (START if begins else 0)

    def _horizon(self, most: int) -> int:
        """Bytes after which all states have become one, whatever the bytes are."""
        n = len(self.next)
        apart = {(a, b) for a in range(n) for b in range(a)}
        for k in range(1, most + 1):
            apart = {(max(x, y), min(x, y)) for a, b in apart for x, y in set(zip(self.next[a].tolist(), self.next[b].tolist())) if x != y}
            if not apart:
                return k
        raise ValueError("the automaton does not forget its past")

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The emission of every byte; the scan begins in the first state."""
        out, back = np.empty(len(data), np.uint8), self.horizon
        flat, emit, wide = self.next.ravel(), self.emit.ravel(), np.int32
        padded = np.concatenate([np.full(back, BREAK, np.uint8), data])
        for a in range(0, len(data), SEGMENT):
            z = min(a + SEGMENT, len(data))
            state = np.zeros(z - a, self.next.dtype)
            for k in range(back):
                state = flat.take((state.astype(wide) << 8) | padded[a + k : z + k])
            out[a:z] = emit.take((state.astype(wide) << 8) | data[a:z])
        return out


@lru_cache(maxsize=4)
def automaton(unit: str, sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(unit, sentinels)


class Emissions:
    """Counted emissions of a scan over texts that lie one after the other, each behind a BREAK byte."""

    def __init__(self, data: np.ndarray, machine: Automaton):
        self.out = machine.scan(data)
        blocks = np.arange(0, max(len(data), 1), BLOCK)
        self.counts = {}
        for kind in (START, SENTINEL):
            per_block = np.add.reduceat((self.out & kind) != 0, blocks, dtype=np.int64) if len(data) else np.zeros(1, np.int64)
            self.counts[kind] = np.concatenate([[0], np.cumsum(per_block)])

    def before(self, kind: int, at: int) -> int:
        """Emissions of a kind before a byte."""
        b = at // BLOCK
        return int(self.counts[kind][b]) + int(np.count_nonzero(self.out[b * BLOCK : at] & kind))

    def place(self, kind: int, k: int) -> int:
        """The byte of emission number k of a kind, counted from 0."""
        b = int(np.searchsorted(self.counts[kind], k, side="right")) - 1
        return b * BLOCK + int(np.flatnonzero(self.out[b * BLOCK : (b + 1) * BLOCK] & kind)[k - int(self.counts[kind][b])])


def _joined(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The texts of a column behind a BREAK byte each, and where they end."""
    texts = column.cast(pa.large_binary()).to_pylist()
    parts = [bytes([BREAK]) + (t or b"") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]).tolist()


def transform(docs: DataFrame, seed: int = 1, unit: str = "chars", sentinels: tuple[str, ...] = SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, output, prefix_units, middle_units): texts cut into prefix, middle and suffix at unit bounds and put in the order of their form.

    n counts the units of the whole text: code points (a byte that neither begins nor continues
    one counts by itself), words (each with the white space after it; white space at the start
    belongs to the first cut) or lines. The forms: `plain` (the text as it is), `psm` (prefix,
    suffix, middle) and `spm` (suffix, prefix, middle), each part behind its sentinel. Cuts and
    form follow from sha256 of seed, colon and doc_id, so repeated rows are cut by the same hash
    and a lost task gives the same rows again. A text that holds a sentinel stays plain, as do
    empty and null ones; rows without an id take the hash of an empty id. Other columns are
    ignored; an empty table gives no rows.
    """
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *draws)
    common.small_batches(docs.sparkSession)
    first, second, third = (s.encode() for s in sentinels)
    automaton(unit, tuple(sentinels))  # wrong arguments fail here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, tuple(sentinels))
        for batch in common.slices(batches, "text"):
            data, ends = _joined(batch.column("text"))
            e, raw = Emissions(data, machine), memoryview(data)
            made, start, units, marks = [], 0, 0, 0
            for end, h1, h2, h3, h4 in zip(ends, *[batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]):
                begin, u0, m0 = start + 1, units, marks
                units, marks, start = e.before(START, end), e.before(SENTINEL, end), end
                n = units - u0
                if end == begin or marks > m0 or h3 % 100 >= rate:
                    made.append((n, "plain", bytes(raw[begin:end]), None, None))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                cut = [begin if k == 0 else end if k == n else e.place(START, u0 + k) for k in (low, high)]
                prefix, middle, suffix = raw[begin : cut[0]], raw[cut[0] : cut[1]], raw[cut[1] : end]
                if h4 % 100 < suffix_first:
                    made.append((n, "spm", b"".join((second, suffix, first, prefix, third, middle)), low, high - low))
                else:
                    made.append((n, "psm", b"".join((first, prefix, second, suffix, third, middle)), low, high - low))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            n, form, output, p, m = (pa.array(x, t) for x, t in zip(zip(*made), kinds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, output.view(pa.string()), p, m], names=["doc_id", "n", "form", "output", "prefix_units", "middle_units"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, output string, prefix_units long, middle_units long")


def restore(done: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Add `restored`: the text rebuilt from `output` and `form` alone. Null outputs give null."""
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring(c, F.length(before(c, mark)) + len(mark) + 1, F.length(c))
    first, second, third = sentinels
    c = F.col("output")
    psm, spm = after(c, first), after(c, second)
    text = (
        F.when(F.col("form") == "psm", F.concat(before(psm, second), after(psm, third), before(after(psm, second), third)))
        .when(F.col("form") == "spm", F.concat(before(after(spm, first), third), after(spm, third), before(spm, first)))
        .otherwise(c)
    )
    return done.withColumn("restored", text)

