import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, topk

SCHEMA = "vec_id long, embedding array<double>, score int, rank int, q int"


def table(spark, n=400, dims=16, seed=3, odd=True):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dims).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(130)]  # a hot vector
    if odd:
        rows += [(5000, None), (5001, [1.0, None] + [0.0] * 14), (5002, [math.inf] * 16), (5003, [math.nan] * 16), (5010, [0.0] * 16), (None, rows[1][1]), (7, rows[7][1]), (5020, rows[3][1][:5])]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(6), rows


def usable(rows):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[i] = v + [0.0] * (16 - len(v))
    return seen


def test_exact_top_k(spark):
    df, rows = table(spark)
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in usable(rows).items()}
    want = []
    for q in sorted(vectors):
        if q % 10 == 0:
            ranked = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    for lists in (1, 2, 3):
        got = topk.exact_top_k(df, F.col("id") % 10 == 0, 5, lists=lists).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_few_candidates_and_large_components(spark):
    t = spark.createDataFrame([(0, [1e12, 2.0]), (1, [3e12, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in topk.exact_top_k(t, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 2**63 - 1), (0, 2, 256 * 256 * (10**12 + 2))]
    assert topk.exact_top_k(t.limit(0), F.col("id") == 0, 5).count() == 0
    assert topk.exact_top_k(t, F.col("id") == 77, 5).count() == 0


def test_neighbours(spark):
    df, rows = table(spark)
    vectors = {i: np.array(v) for i, v in usable(rows).items() if any(v)}
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert i != q and abs(s - float(vectors[q] @ vectors[i])) < 1e-12
        true = sorted(((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:20]
        worst = -true[-1][0]
        hit += sum(s >= worst - 1e-12 for _, _, s in found)
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize(("kind", "most"), [("clustered", 0.1), ("isotropic", 0.45)])
def test_narrow_windows_find_the_neighbours(spark, kind, most):
    """Windows that hold a small part of the table, on clustered and on isotropic vectors of different lengths."""
    rng = np.random.default_rng(5)
    n, dims = 12000, 10
    points = rng.normal(0, 1, (n, dims))
    if kind == "clustered":
        points = 3 * rng.normal(0, 1, (300, dims))[rng.integers(0, 300, n)] + 0.3 * points
    points *= rng.uniform(0.9, 1.1, (n, 1)) / np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, p.tolist(), i, i, "x") for i, p in enumerate(points)], "vec_id long, embedding array<double>, place int, curve int, code string").repartition(4)
    stats = {}
    got = {}
    for r in ann.nearest(df, F.col("id") % 40 == 0, 10, stats=stats, least_window=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert stats["share"] < most
    products = points[::40] @ points.T
    products[np.arange(len(products)), np.arange(0, n, 40)] = -np.inf
    true = np.argsort(-products, axis=1)[:, :10]
    assert all(len(x) == 10 for x in got.values())
    assert np.mean([len(got[40 * i] & set(t.tolist())) / 10 for i, t in enumerate(true)]) >= 0.9


@pytest.mark.parametrize("kind", ["tight", "offset"])
def test_neighbours_that_short_codes_cannot_tell(spark, kind):
    """Clusters of near copies, larger than the shortlist, and vectors that differ little from their mean."""
    rng = np.random.default_rng(11)
    n, dims = 3000, 24
    noise = rng.normal(0, 1, (n, dims))
    points = rng.normal(0, 1, (25, dims))[rng.integers(0, 25, n)] + 0.01 * noise if kind == "tight" else 5 + 0.2 * noise
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    products = points[::20] @ points.T
    products[np.arange(len(products)), np.arange(0, n, 20)] = -np.inf
    true = np.argsort(-products, axis=1)[:, :20]
    assert np.mean([len(got[20 * i] & set(t.tolist())) / 20 for i, t in enumerate(true)]) >= 0.9


@pytest.mark.parametrize("bits", ann.CODE_BITS)
def test_codes_of_all_lengths(bits):
    v = np.random.default_rng(1).normal(0, 1, (50, 7))
    codes = ann.codes_of(v, bits)
    assert {len(c) for c in codes} == {ann.code_bytes(7, bits)}
    assert np.abs(ann.decoded(codes, 7, bits) - v).max() <= np.abs(v).max() / 2 ** min(bits, 20) + 1e-6 + (bits == 4) / 13 * np.abs(v).max()


def test_codes():
    rng = np.random.default_rng(1)
    for width in (1, 7, 64):
        v = rng.normal(0, 1, (50, width))
        back = ann.decoded(ann.codes_of(v), width)
        assert np.abs(back - v).max() <= np.abs(v).max() / 13 + 1e-6


def test_hilbert_keys_are_a_curve():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(2 ** (n * bits)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_no_vectors(spark):
    t = spark.createDataFrame([(0, [0.0, 0.0]), (1, None)], "vec_id long, embedding array<double>")
    assert ann.nearest(t, F.col("id") == 0, 3).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(one, F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
