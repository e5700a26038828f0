"""Pivot codes and collision-counted near-duplicates of embeddings against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import pivots, projections
from evalspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- 11 ---------------------------------------------------------------------

def codes(rows, parts, entries, rounds):
    """(codes, errors, codebooks) of integer vectors in order, every part against every entry."""
    v = np.array(rows, np.int64).reshape(len(rows), parts, -1)
    books = v[:entries].copy()

    def nearest():
        d = ((v[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        index, _ = nearest()
        for j in range(parts):
            for e in range(len(books)):
                if (index[:, j] == e).any():
                    books[e, j] = v[index[:, j] == e, j].sum(axis=0) // (index[:, j] == e).sum()
    index, dist = nearest()
    return index.tolist(), dist.sum(axis=1).tolist(), books.transpose(1, 0, 2)


def test_pivot_query_against_all_entries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    index, errors, books = codes([[math.floor(256 * x) for x in r.embedding] for r in rows], 16, 64, 2)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = Counter()
    for r, e in zip(rows, errors):
        labels[r.label] += e
    got = {r.vec_id: r for r in QUERIES["op11_pivot_codes"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, i, e in zip(rows, index, errors):
        g = got[r.vec_id]
        assert (g.code, g.error, g.label_error, g.codebooks_sha256) == ("".join(f"{x:02x}" for x in i), e, labels[r.label], digest)


def test_pivot_nearest_is_exact_and_prunes():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 5), (4, 3), (4, 4000), (8, 1 << 27)):
        parts, entries = rng.integers(-spread, spread, (300, width)), rng.integers(-spread, spread, (64, width))
        entries[7] = entries[3]  # ties go to the lower index
        piv = pivots.choose_pivots(entries, 4)
        index, best, evaluated = pivots.nearest(parts, pivots.distances(parts, piv).astype(np.float32).astype(float), entries, pivots.distances(entries, piv))
        d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert evaluated < d.size
    assert evaluated < 0.8 * d.size


def test_pivot_defined_cases(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    vecs = [[rng.choice([-0.5, 0.25, 1.0, 3.99, -7.0]) for _ in range(8)] for _ in range(30)]
    good = [(i, v, "x", i % 3) for i, v in enumerate(vecs)] + [(4, vecs[9], "y", 1), (4, vecs[9], "y", 1), (None, vecs[2], "z", 0), (-5, [0.0] * 8, None, None)]
    bad = [(50, None, "n", 0), (51, [1.0] * 7 + [None], "n", 0), (52, [nan] + [1.0] * 7, "n", 0), (53, [-inf] + [1.0] * 7, "n", 0),
           (54, [], "n", 0), (55, [1.0] * 4, "n", 0), (56, [1.0] * 7, "n", 0), (57, [2.0 ** 21] + [1.0] * 7, "n", 0)]
    kind = "vec_id long, embedding array<float>, code string, error int"
    df = spark.createDataFrame(good + bad, kind)
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * x) for x in r[1]]))
    index, errors, books = codes([[math.floor(256 * x) for x in r[1]] for r in order], 4, 10, 2)
    out, got_books = pivots.compress(df, parts=4, entries=10)
    assert out.columns == ["vec_id", "code", "error", "__code", "__error"]
    assert (got_books == books).all()
    assert sorted((str(r.vec_id), str(r.code), list(r["__code"]), r["__error"]) for r in out.collect()) == sorted(
        (str(r[0]), str(r[2]), i, e) for r, i, e in zip(order, index, errors))
    few, books = pivots.compress(df.where("vec_id < 3 AND vec_id >= 0"), parts=4, entries=64)
    assert few.count() == 3 and books.shape == (4, 3, 2) and few.where("__error <> 0").count() == 0
    for nothing in (df.limit(0), df.where("vec_id IN (50, 52, 54)")):
        none, books = pivots.compress(nothing, parts=4)
        assert none.count() == 0 and books.size == 0 and none.columns == out.columns


# --- 13 ---------------------------------------------------------------------

def links(vectors, cosine):
    """Links of every vector and the smallest index that it reaches (None: unusable)."""
    n, parent, out = len(vectors), list(range(len(vectors))), [0] * len(vectors)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    u = [np.array(v, float) / np.abs(v).max() if k else None for v, k in zip(vectors, ok)]  # huge and tiny vectors, too
    u = [x if x is None else x / np.linalg.norm(x) for x in u]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                out[i], out[j] = out[i] + 1, out[j] + 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return out, [find(i) for i in range(n)]


def turned(rng, v, cosine):
    """A vector at the given cosine to ``v``."""
    w = rng.normal(size=len(v))
    v = v / np.linalg.norm(v)
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


def groups(rng, dim=24):
    """Lone vectors, pairs about the threshold, a tight group, a wide one and a chain."""
    out = [rng.normal(size=dim) for _ in range(150)]
    out += [turned(rng, v, c) for v, c in zip(out[:60], np.linspace(0.85, 0.99, 60))]
    out += [turned(rng, out[0], 0.992) for _ in range(120)] + [turned(rng, out[1], 0.95) for _ in range(60)]
    chain = [out[2]]
    for _ in range(20):
        chain.append(turned(rng, chain[-1], 0.93))
    return [(v * rng.uniform(0.1, 9)).tolist() for v in out + chain[1:]] + [out[5].tolist(), out[5].tolist()]


@pytest.mark.parametrize("room", [4096, 40])  # one run, and many signs with runs in chunks
def test_projection_links(spark, room):
    vectors = groups(np.random.default_rng(room))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    want, reach = links(vectors, 0.9)
    got = {r.vec_id: r for r in projections.near_duplicates(df, room=room).collect()}
    assert all(got[i].n_links <= n for i, n in enumerate(want))
    assert sum(got[i].n_links for i in got) >= 0.97 * sum(want)
    right = sum(got[i].component_id == c for i, c in enumerate(reach))
    assert right >= 0.97 * len(reach)
    assert all(got[got[i].component_id].component_id == got[i].component_id for i in got)
    near = projections.near_duplicates(df, room=room, recall=0.99999).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in near} == {i: (n, c) for i, (n, c) in enumerate(zip(want, reach))}


def test_projection_calibration():
    rng = np.random.default_rng(8)
    plan = projections.calibrate(100_000, 0.9, recall=0.9, room=500)
    dim, caught = 32, 0
    d = projections.directions(dim, plan.orders * (plan.signs + 1), 1).reshape(plan.orders, plan.signs + 1, dim)
    for _ in range(2000):
        v = rng.normal(size=dim)
        a, b = d @ (v / np.linalg.norm(v)), d @ turned(rng, v, 0.9)
        hits = ((a[:, 1:] > 0) == (b[:, 1:] > 0)).all(axis=1) & (np.abs(a[:, 0] - b[:, 0]) <= plan.window)
        caught += hits.sum() >= plan.least
    assert 0.88 <= caught / 2000 <= 0.96  # the directions are one draw


def test_projection_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [3.0, 3.0]), (2, [2.0, 4.0]), (None, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 2.0, 0.0]), (10, [1e300, 2e300]), (11, [-1.0, -2.0]), (None, None), (12, [1e-300, 2e-300]), (13, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "c", 5) for i, v in rows], "vec_id long, embedding array<double>, u string, n_links int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in projections.near_duplicates(df).collect())
    want, _ = links([v for _, v in rows], 0.9)
    groups_of = {**{i: 1 for i in (1, 2, 10, 12, 13)}, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 11: 11}
    expect = sorted((str(i), n, 1 if i is None and v else groups_of.get(i)) for (i, v), n in zip(rows, want))
    assert got == expect
    assert projections.near_duplicates(df.limit(0)).count() == 0
    alone = projections.near_duplicates(df.where("vec_id IN (3, 5)")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in alone) == [(3, 0, 3), (5, 0, 5)]


def test_projection_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    want, reach = links([r.embedding for r in rows], 0.9)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op13_embedding_dedup"](spark, SF).collect()}
    assert got == {r.vec_id: (n, rows[c].vec_id, c == i) for i, (r, n, c) in enumerate(zip(rows, want, reach))}
