"""Near-duplicate embeddings by E8 lattice hashing.

Each of 8 tables projects a unit vector to two orthonormal 8-dimensional blocks and decodes
each block to its nearest point of the E8 lattice; the two points name the vector's cell.
Besides its own cell a vector looks into the 8 neighbouring cells that are nearest to it (one
block moved by one of the lattice's 240 shortest vectors). At the threshold of 0.93 a pair
meets in one table with probability 0.48 and in one of eight with 0.994; closer pairs more.
Random pairs of the same label meet with probability 2e-4, so few others are compared.

Plan: equal vectors collapse first. A cell with a vector at home and another that looks in is a
meeting, in blocks of bounded size, where a matrix product verifies the cosines of guests and
those at home in double precision; nothing is compared outside a cell. A pair counts only in
the first cell where it meets. A block returns per vector the number of links and one spanning
link, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common

TABLES = 8
PARTS = 2
PROBES = 8
SCALE = 1.5
#: Vectors per block.
BLOCK = 1024
#: Runs up to this size are looked at for any link first.
SMALL = 64


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    k = np.abs(d[odd]).argmax(axis=1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(axis=1)[:, None] <= ((x - b) ** 2).sum(axis=1)[:, None], a, b)


@lru_cache(maxsize=8)
def _bases(dim: int) -> list[np.ndarray]:
    rng = np.random.default_rng(81 + dim)
    width = 8 * PARTS
    wide = max(dim, width)
    return [np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim, :width] * SCALE * (wide / 8) ** 0.5 for _ in range(TABLES)]


def cells(x: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, TABLES) and neighbouring cells (n, TABLES * PROBES) of unit rows, as signed 64-bit keys."""
    n = len(x)
    rng = np.random.default_rng(5)
    coef = rng.integers(1, 2**62, (PARTS, 8), dtype=np.int64) * 2 + 1
    own, near = [], []
    for t, basis in enumerate(_bases(x.shape[1])):
        y = (x @ basis).reshape(n * PARTS, 8)
        p = nearest_e8(y)
        doubled = np.rint(2 * p).astype(np.int64).reshape(n, PARTS, 8)
        key = (doubled * coef).sum(axis=(1, 2)) + salt * np.int64(0x9E3779B97F4A7C1) + t
        gain = ((y - p) @ SHORTEST.T).reshape(n, -1)
        top = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        move = np.rint(2 * SHORTEST).astype(np.int64)[top % 240]
        own.append(key)
        near.append(key[:, None] + (move * coef[top // 240]).sum(axis=2))
    return np.stack(own, axis=1), np.concatenate(near, axis=1)


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the row numbers of the usable vectors and their unit rows in double precision."""
    by_dim: dict[int, tuple[list, list]] = {}
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            norm = np.sqrt((x * x).sum())
            if np.isfinite(norm) and norm > 0:
                at, rows = by_dim.setdefault(len(v), ([], []))
                at.append(k)
                rows.append(x / norm)
    return {d: (np.array(at), np.stack(rows)) for d, (at, rows) in by_dim.items()}


_HASHED = "id long, unit binary, label string, digest binary, salt long"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision, a digest of label and vector, and a number that sets labels and dimensions apart; null where nothing can link."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        units: list[bytes | None] = [None] * len(labels)
        digests: list[bytes | None] = [None] * len(labels)
        salts = [0] * len(labels)
        for dim, (at, x) in _units(batch.column("embedding")).items():
            for r, k in enumerate(at.tolist()):
                if labels[k] is not None:
                    units[k] = x[r].tobytes()
                    digests[k] = xxhash.xxh3_128_digest(f"{labels[k]} {dim} ".encode() + units[k])
                    salts[k] = (xxhash.xxh3_64_intdigest(str(labels[k]).encode()) ^ dim) & (2**62 - 1)
        cols = [batch.column("id"), pa.array(units, pa.binary()), batch.column("label"), pa.array(digests, pa.binary()), pa.array(salts, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "unit", "label", "digest", "salt"])


def _by_dim(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and their unit vectors, for each dimension."""
    sizes = pc.binary_length(column).to_numpy()
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out.append((at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1)))
    return out


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that each vector is at home in and looks into."""
    for batch in batches:
        ids, salts = batch.column("id").to_numpy(), batch.column("salt").to_numpy()
        for at, x in _by_dim(batch.column("unit")):
            own, near = cells(x, salts[at])
            tables = np.arange(TABLES, dtype=np.int32)
            for keys, numbers, home in ((own, tables, True), (near, tables.repeat(PROBES), False)):
                cols = [keys.ravel(), np.tile(numbers, len(at)), ids[at].repeat(keys.shape[1]), np.full(keys.size, home)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "number", "id", "home"])


def _met_before(own: np.ndarray, near: np.ndarray, g: np.ndarray, h: np.ndarray, number: int, key: int) -> np.ndarray:
    """Of pairs of rows (g, h), which meet in an earlier table, or in this one in a cell that comes before `key`."""
    out = np.zeros(len(g), bool)
    near = near.reshape(len(near), TABLES, PROBES)
    for t in range(number + 1):
        rest = np.flatnonzero(~out)
        own_g, own_h = own[g[rest], t], own[h[rest], t]
        same = own_g == own_h
        at_h, at_g = (near[g[rest], t] == own_h[:, None]).any(axis=1), (near[h[rest], t] == own_g[:, None]).any(axis=1)
        out[rest] = same | at_h | at_g if t < number else ~same & ((at_h & (own_h < key)) | (at_g & (own_g < key)))
    return out


def _any_link(ids: np.ndarray, x: np.ndarray, threshold: float) -> bool:
    return bool(((x @ x.T >= threshold) & (ids[:, None] != ids[None, :])).any())


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per vector of a block the links found there, each counted where its pair meets first, and the smallest id it reaches over them.

    A guest that is at home too meets those at home from both sides, and counts its own links only.
    """
    for table, bounds in common.whole_runs(batches, ["key", "number", "i", "j"]):
        keys, numbers, every_id, sides, at_homes, all_copies, all_salts = (table.column(c).to_numpy() for c in ("key", "number", "id", "side", "home", "copies", "salt"))
        out: list[list] = [[], [], []]
        dims = _by_dim(table.column("unit"))
        for rows, vectors in dims:
            edges = bounds if len(dims) == 1 else np.searchsorted(rows, bounds).tolist()
            linked = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > SMALL or b - a > 1 and _any_link(every_id[rows[a:b]], vectors[a:b], threshold)]
            if not linked:
                continue
            need = np.concatenate([np.arange(a, b) for a, b in linked])
            place = np.searchsorted(need, [a for a, _ in linked]).tolist()
            own, near = cells(vectors[need], all_salts[rows[need]])
            for (a, b), at in zip(linked, place):
                here, x, seen = rows[a:b], vectors[a:b], (own[at : at + b - a], near[at : at + b - a])
                ids, side, copies, at_home, salts = every_id[here], sides[here], all_copies[here], at_homes[here], all_salts[here]
                guests, homes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                names, node = np.unique(ids, return_inverse=True)
                n, forest = np.zeros(len(names), np.int64), common.Forest(len(names))
                for first in range(0, len(guests), 256):
                    some = guests[first : first + 256]
                    g, h = np.nonzero(x[some] @ x[homes].T >= threshold)
                    g, h = some[g], homes[h]
                    real = (ids[g] != ids[h]) & (salts[g] == salts[h])
                    g, h = g[real], h[real]
                    new = ~_met_before(*seen, g, h, int(numbers[here[0]]), int(keys[here[0]]))
                    g, h = g[new], h[new]
                    np.add.at(n, node[g], copies[h])
                    one_way = ~at_home[g]
                    np.add.at(n, node[h[one_way]], copies[g[one_way]])
                    root = np.array([forest.find(k) for k in range(len(names))])
                    for p, q in np.unique(np.stack([root[node[g]], root[node[h]]], axis=1), axis=0).tolist():
                        forest.join(p, q)
                found = np.array([forest.find(k) for k in range(len(names))])
                keep = n > 0
                for col, more in zip(out, (names, n, names[found])):
                    col.extend(more[keep].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "n", "root"])


_LOOK = "key long, number int, id long, home boolean"


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: (vec_id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null and their cosine is at least the
    threshold. Null, empty or zero vectors and those with null or non-finite components link
    with nothing, nor do vectors of different lengths. A row without an id links with nothing
    and has no component; different vectors of one id are one node whose links are summed. Other columns are
    ignored; an empty table gives an empty result.
    """
    common.small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    hashed = common.materialize(rows.mapInArrow(_hash, _HASHED))
    usable = common.with_facts(hashed.where("digest is not null and id is not null"), ["digest"], "id", [F.min("id").alias("rep"), F.count("*").alias("copies")])
    nodes = common.materialize(usable.select("id", "digest", "rep", "copies").union(hashed.where("digest is null or id is null").select("id", "digest", F.lit(None).cast("long"), F.lit(None).cast("long"))))
    firsts = common.materialize(usable.where("id = rep").dropDuplicates(["id", "digest"]).select("id", "unit", "salt", "copies"))
    looks = common.materialize(firsts.mapInArrow(_look, _LOOK))
    met = common.meetings(looks.withColumns({"guest": F.lit(True), "one": F.lit(1)}), ["key", "number"], "guest", "home", "one", BLOCK)
    met = met.join(firsts, "id").repartition("key", "number", "i", "j").sortWithinPartitions("key", "number", "i", "j", "id")
    found = common.materialize(met.mapInArrow(lambda batches: _verify(batches, threshold), "id long, n long, root long"))
    parts = common.connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    nodes = nodes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return nodes.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
