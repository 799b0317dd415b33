import random

import numpy as np
import pytest

from tapeline.llm import common, lattice, minhash


def components(n, pairs):
    f = common.Forest(n)
    for a, b in pairs:
        f.join(a, b)
    return [f.find(k) for k in range(n)]


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    want = components(200, pairs)
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == {k: want[k] for p in pairs if p[0] != p[1] for k in p}
    assert common.connected_components(df.limit(0)).count() == 0


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)] * 3
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"r{rng.randrange(999)}" for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    return [*texts, None, "", "  ", "one two", "One  Two", "one two three", "word " * 5000, "word " * 7]


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block * 100)
    texts = corpus()
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(len(sets), pairs)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, component string, id long")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    for k in got:
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), want[k], want[k] == k)


def brute(texts):
    sets = [shingles(t) for t in texts]
    near = lambda a, b: sets[a] and 20 * min(len(sets[a]), len(sets[b])) >= 17 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    return components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if near(a, b)])


@pytest.mark.parametrize("leads", [0, minhash.LEADS])
def test_links_over_a_hub_and_near_the_threshold(spark, monkeypatch, leads):
    """Copies that link only over a hub that is not the smallest, chains, and 300 planted pairs just above and below 0.85."""
    monkeypatch.setattr(minhash, "LEADS", leads)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(0, 195, 5), 3):
            w[at] = word()
        texts.append(" ".join(w))
    texts.insert(30, " ".join(base))
    chain = [word() for _ in range(150)]
    for k in range(12):
        texts.append(" ".join(chain[5 * k : 5 * k + 90]))
    for k in range(300):
        w = [word() for _ in range(104)]
        texts += [" ".join(w), " ".join(w[: 104 - (7 + k % 3)] + [word() for _ in range(7 + k % 3)])]
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sum(want[k] != k for k in range(73, len(texts))) >= 100


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (2, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 1, None, False), (4, 1, 4, True), (4, 1, 4, True), (2, 0, 2, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    doubled = np.rint(2 * p).astype(int)
    assert ((doubled % 2).sum(axis=1) % 8 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p - v) ** 2).sum(axis=1) >= d - 1e-9).all() for v in lattice.SHORTEST) and d.max() <= 1 + 1e-9


def test_lattice_recall_and_pruning():
    """Of 20,000 random vectors of one label less than 5 % of the pairs meet; planted links from 0.93 on meet, at least 0.95 of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    own, near = lattice.cells(x, np.zeros(len(x), np.int64))
    looks = np.concatenate([own.ravel(), near.ravel()])
    keys, counts = np.unique(own, return_counts=True)
    at = np.searchsorted(keys, looks).clip(max=len(keys) - 1)
    assert np.where(keys[at] == looks, counts[at], 0).sum() - own.size < 0.05 * len(x) ** 2 / 2
    for cosine, least in ((0.93, 0.98), (0.95, 0.99), (0.99, 0.999)):
        a, z = x[:4000], x[4000:8000]
        z = z - (z * a).sum(axis=1)[:, None] * a
        b = cosine * a + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z, axis=1)[:, None]
        own_b, near_b = lattice.cells(b, np.zeros(len(b), np.int64))
        met = (own[:4000] == own_b).any(axis=1)
        for t in range(lattice.TABLES):
            part = slice(t * lattice.PROBES, (t + 1) * lattice.PROBES)
            met |= (near[:4000, part] == own_b[:, t, None]).any(axis=1) | (near_b[:, part] == own[:4000, t, None]).any(axis=1)
        assert met.mean() >= least


@pytest.mark.parametrize("block", [lattice.BLOCK, 40])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    x = [base[k % 30] + rng.normal(size=64) * s for k, s in enumerate(rng.uniform(0, 0.3, 200))]
    x[7] = x[5]
    rows = [(k, [float(v) for v in y], k % 30 % 3) for k, y in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, rows[0][1], None), (905, [], 1), (906, rows[0][1][:8], 0)]
    unit = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    same = np.array([r[2] for r in rows])
    link = (unit @ unit.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(link, False)
    want = components(200, np.argwhere(link).tolist())
    df = spark.createDataFrame([(*r, "c") for r in rows + bad], "vec_id long, embedding array<double>, label int, copies string")
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    assert len(got) == 207
    assert all((got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True) for r in bad)
    found = sum(got[k].n_links for k in range(200))
    assert 0.97 * link.sum() <= found <= link.sum()
    assert sum(got[k].component_id == want[k] for k in range(200)) >= 195
    assert lattice.near_duplicates(df.limit(0)).count() == 0
