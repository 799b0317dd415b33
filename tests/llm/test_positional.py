import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeline.llm import common, positional

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_a_worker_forgets_both_generations_of_words():
    words = positional._Terms(2)
    found = [words[w] for w in (b"a", b"b", b"c", b"a")]
    assert found[0] == found[3] and words.older
    words.forget()
    assert not words and not words.older


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, size=13):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for item, t in items:
            q = WORD.findall(low(t))
            for k in range(max(1, len(q) - size + 1) if q else 0):
                win = q[k : k + size]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (10, "Short item"), (2, "the the the"), (3, None), (4, "..."), (5, LONG.upper()), (6, "solo")]
DOCS = [
    (1, "x " * 5 + LONG + " y"), (2, " ".join(f"w{k}" for k in range(12))), (3, "A short, ITEM! and the the the the the"),
    (4, None), (5, ""), (6, "?!"), (7, "x " * 700 + "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (7, "solo"), (8, "été SOLO-solo " * 30), (None, "short item"),
]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


@pytest.mark.parametrize("windows, chars", [(positional.PART_WINDOWS, common.SLICE_CHARS), (20, 60)])
def test_matches_brute_force(spark, monkeypatch, windows, chars):
    monkeypatch.setattr(positional, "PART_WINDOWS", windows)
    monkeypatch.setattr(common, "SLICE_CHARS", chars)
    monkeypatch.setattr(positional, "SHARD_WORDS", chars)
    docs = spark.createDataFrame([(*d, "a", 1) for d in DOCS], "doc_id long, text string, item_id string, row long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(positional.decontaminate(docs.drop("row"), items)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert positional.decontaminate(docs.limit(0), items).count() == 0
    assert rows(positional.decontaminate(docs, items.limit(0))) == brute(DOCS, [])


def test_stored_index_serves_two_test_sets(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = positional.build_index(docs, str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    assert again.where("kind = 1").agg({"n": "sum"}).first()[0] == sum(len(WORD.findall(low(t))) for _, t in DOCS)
    for items in (ITEMS[:1], [("z", "y"), ("q", "été solo")]):
        tests = spark.createDataFrame(items, "item_id string, text string")
        got = positional.search(again, tests).join(positional.documents(index), ["shard", "k"]).collect()
        want = {(d, n, h) for d, n, h, *_ in brute(DOCS, items) if h}
        assert {(r.doc_id, r.n_words, sum(s.last - s.first + 1 for s in r.spans)) for r in got} == want


def test_packed_positions_come_back():
    rng = np.random.default_rng(3)
    edges = [(1 << k) + d for k in (7, 14, 21, 28, 32) for d in (-1, 0, 1)]
    for values in ([], [0], [127, 128], edges, rng.integers(0, 1 << 33, 5000).tolist()):
        packed, ends = positional._pack(np.array(values, np.int64))
        back, again = positional._unpack(packed)
        assert back.tolist() == values and again.tolist() == ends.tolist()


def near(words, item, slop):
    need, reach = Counter(item), len(item) + slop
    return any(not need - Counter(words[k : k + reach]) for k in range(len(words)))


def test_proximity_matches_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices("abcdef", k=rng.randrange(1, 14)))) for k in range(150)] + [(200, "x9 a b c x9 x9 x9 x9 x9 x9 x9 c a x9"), (201, "a x1 x2 x3 x4 x5 x6 x7 x8 b r x9 b"), (202, None)]
    items = [("1", "a b c"), ("2", "f f e"), ("3", "r b a"), ("4", "d"), ("5", "a a b b")]
    index = positional.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for slop in (0, 2, 8):
        found = positional.search(index, spark.createDataFrame(items, "item_id string, text string"), slop=slop).join(positional.documents(index), ["shard", "k"])
        got = {(r.doc_id, i) for r in found.collect() for i in r.items}
        assert got == {(d, i) for d, t in docs for i, q in items if near((t or "").split(), q.split(), slop)}
