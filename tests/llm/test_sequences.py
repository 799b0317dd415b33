"""Fill-in-middle, packing and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tapeline.llm import fim, packing, whiten

TEXTS = ["", None, "a", "héllo wörld 日本語 \U0001f600‍x", "x <P> y", "<<P", "P>", "<S", "< <S< <M", "line one\nline two\n\nlast", "  two  words ", "é" * 5000 + "日" * 5000]


def _step_by_step(machine, data):
    state, out = 0, []
    for b in data:
        out.append(int(machine.emit[state, b]))
        state = int(machine.next[state, b])
    return out


@pytest.mark.parametrize("unit", fim.UNITS)
def test_scan_equals_single_steps(unit, monkeypatch):
    monkeypatch.setattr(fim, "SEGMENT", 37)
    machine, rng = fim.Automaton(unit), random.Random(3)
    for _ in range(60):
        data = [rng.choice([60, 80, 83, 77, 62, 0x80, 0xA4, 0xC3, 0xE3, 0xF0, 0xFF, 32, 10, 97]) for _ in range(rng.randrange(150))]
        assert machine.scan(np.array(data, np.uint8)).tolist() == _step_by_step(machine, data)


@pytest.mark.parametrize("unit,pieces", [("chars", list), ("words", lambda t: __import__("re").findall(r"\S+\s*", t)), ("lines", lambda t: t.splitlines(keepends=True))])
def test_units_and_places(unit, pieces):
    machine = fim.Automaton(unit)
    for t in TEXTS:
        data = np.frombuffer(b"\xff" + (t or "").encode(), np.uint8)
        e = fim.Emissions(data, machine)
        want = pieces(t or "")
        assert e.before(fim.START, len(data)) == len(want)
        at = len(data) - len("".join(want).encode())  # white space before the first word belongs to no unit
        for k, piece in list(enumerate(want))[:2000]:
            assert e.place(fim.START, k) == at
            at += len(piece.encode())


def test_sentinels_must_tell_parts_apart():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Automaton("chars", bad)
    with pytest.raises(ValueError):
        fim.Automaton("bytes")


def _plain_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in fim.SENTINELS) or h3 % 100 >= 90:
        return (n, "plain", t, None, None)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return (n, "spm", f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}", a, z - a)
    return (n, "psm", f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}", a, z - a)


def test_fill_in_middle(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS * 8)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = fim.restore(fim.transform(docs)).collect()
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, r.n, r.form, r.output, r.prefix_units, r.middle_units) for r in got], key=key) == sorted([(i, *_plain_fim(i, t)) for i, t, _ in rows], key=key)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in got) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
    for unit in ("words", "lines"):
        back = fim.restore(fim.transform(docs, seed=7, unit=unit, rate=100, suffix_first=50)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in back) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)


def _rounds(queues, shares, window):
    """Deficit round-robin step by step with exact numbers: (source, index of the packet, round) in the order of sending."""
    left, sent, deficit, out, r = {s: list(p) for s, p in queues.items()}, dict.fromkeys(queues, 0), dict.fromkeys(queues, Fraction(0)), [], 0
    while any(left.values()):
        r += 1
        for s in sorted(left):
            deficit[s] += shares[s] * window
            while left[s] and left[s][0] <= deficit[s]:
                deficit[s] -= left[s][0]
                out.append((s, sent[s], r))
                sent[s] += 1
                left[s].pop(0)
    return out


def test_schedule_is_deficit_round_robin(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    rng, rows = random.Random(8), []
    at = {}
    for shard in range(5):
        at = {}
        for row in range(60):
            source = rng.choice("aaaab") if rng.random() < 0.7 else f"s{rng.randrange(4)}"
            n = rng.choice([1, 3, 17, 40, 130])
            rows.append((shard, row, source, at.get(source, 0), n))
            at[source] = at.get(source, 0) + n
    total = sum(r[4] for r in rows)
    queues, names = {}, {}
    for shard, row, source, _, n in sorted(rows):
        for k in range(0, n, 32):
            queues.setdefault(source, []).append(min(32, n - k))
            names.setdefault(source, []).append((shard, row, k))
    shares = {s: Fraction(sum(p), total) for s, p in queues.items()}
    encoded = spark.createDataFrame(rows, "shard int, row long, source string, at long, n_tokens long")
    got = packing.schedule(encoded, size=32, window=64).orderBy("stream").collect()
    want = _rounds(queues, shares, 64)
    assert [(r.shard, r.row, r["first"]) for r in got] == [names[s][k] for s, k, _ in want]
    assert [r.window for r in got] == [r for _, _, r in want]
    assert [r.stream for r in got] == np.cumsum([0, *[r.length for r in got][:-1]]).tolist()
    sent = dict.fromkeys(queues, 0)
    for k, r in enumerate(got):  # at the end of every window a source is less than a packet behind its share
        sent[r.source] += r.length
        if k + 1 == len(got) or got[k + 1].window != r.window:
            assert all(0 <= min(float(shares[s]) * 64 * r.window, sum(queues[s])) - sent[s] + 1e-6 < 32 + 1e-6 for s in queues)


def test_given_mixture(spark):
    rows = [(0, k, s, 100 * (k // 2), 100) for k, s in enumerate(["a", "b"] * 50)] + [(1, k, None, 10 * k, 10) for k in range(100)]
    encoded = spark.createDataFrame(rows, "shard int, row long, source string, at long, n_tokens long")
    got = packing.schedule(encoded, {"a": 0.6, "b": 0.2, "absent": 0.9}, size=50, window=1000).orderBy("stream").collect()
    assert sum(r.length for r in got) == 11_000
    for window in (1, 4, 5):  # until the rows without a source run dry after 5 windows
        sent = {s: sum(r.length for r in got if r.source == s and r.window <= window) for s in ("a", "b", None)}
        for s, share in (("a", 0.6), ("b", 0.2), (None, 0.2)):
            assert 0 <= round(share * window * 1000 - sent[s], 6) < 50
    assert max(r.window for r in got) == 11
    for bad in ({"a": 0.6, "b": 0.4}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.schedule(encoded, bad)


def test_pack(spark):
    rng = random.Random(5)
    words = ["the", "Über", "日本", "fox", "jumps", "'s", "<|endoftext|>"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 900, 4000]))), rng.choice(["a", "a", "b", None]), k) for k in range(120)]
    rows += [(7, "again", "a", 1), (7, "again", "a", 1), (None, "no id", None, None), (500, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").repartition(3)
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) is not None and len(r.ids) == 4 * r.length and r.start + r.length <= r.doc_tokens
    for k, rs in by_sequence.items():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *[r.length for r in rs][:-1]]).tolist()
        assert sum(r.length for r in rs) == 2048 or k == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = sorted((repr(i), np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t, _, _ in rows)
    pieces, ids = {}, []
    for r in sorted(got, key=lambda r: r.start):
        pieces.setdefault((r.doc_id, r.start), []).append(r)
    assert sorted((repr(i), t) for i, t in _rebuilt(got)) == want
    assert packing.pack(docs.limit(0), path).count() == 0
    alone = packing.pack(docs.where("doc_id = 500"), path, end_id=None)
    assert alone.count() == 0


def _rebuilt(pieces):
    """(doc_id, ids) of every document; those with a repeated id are short and in one piece."""
    whole = {}
    for r in sorted(pieces, key=lambda r: r.start):
        if r.length == r.doc_tokens:
            yield r.doc_id, bytes(r.ids)
        else:
            whole.setdefault(r.doc_id, []).append(bytes(r.ids))
    for doc_id, parts in whole.items():
        yield doc_id, b"".join(parts)


def _vectors(rng, n, dims):
    return (rng.normal(size=(n, dims)) @ np.diag(np.linspace(0.2, 3, dims))).astype(np.float32)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    e = _vectors(rng, 300, 20)
    e[200:] = e[0]  # a hot vector: counted once
    rows = [(k, v.tolist(), "x") for k, v in enumerate(e)]
    rows += [(900, None, "x"), (901, [None, *e[1].tolist()[1:]], "x"), (902, [math.inf, *e[1].tolist()[1:]], "x"), (903, [math.nan] * 20, "x"), (904, [1.0, 2.0], "x"), (905, [], "x"), (None, e[3].tolist(), None)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string"), 16).toPandas()
    x = np.floor(64 * e.astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, w = np.linalg.eigh(c.T @ c / n)
    values, w = values[::-1], w[:, ::-1]
    assert len(got) == 301 * 16 and (got.n == n).all() and got.vec_id.isna().sum() == 16
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    first = got[got.vec_id < 300]
    y = first.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - s / n) @ w[:, :16] / np.sqrt(values[:16])
    assert np.abs(y * np.sign((y * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(first.groupby("component").explained.first().to_numpy() / (values[:16] / values.sum()) - 1).max() < 1e-12
    exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    assert [int(v) for v in first.groupby("vec_id").deviation.first()] == exact


def test_whitening_of_few_dimensions_and_none(spark):
    flat = [(k, [float(k), 2.0 * k, 5.0]) for k in range(10)]
    rows = whiten.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-9
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten.whiten(same).count() == 0 and whiten.whiten(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        whiten.whiten(same, 0)


def test_exact_deviations_beyond_longs():
    x = np.array([[2**53, -(2**53)], [0, 5]], np.int64)
    sums = [2**53, 5 - 2**53]
    centred = whiten._centred(x, 2**12, [v * 2**11 for v in sums])
    want = [[2**12 * int(v) - 2**11 * s for v, s in zip(row, sums)] for row in x.tolist()]
    assert centred.tolist() == want
    assert [int(v) for v in whiten._deviations(centred)] == [sum(v * v for v in row) for row in want]
