"""Top-k search against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import covertree


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scores = sorted(((-int(v @ vectors[q]), i) for i, v in vectors.items() if i != q), key=lambda x: x)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize(("seed", "block_rows"), [(0, 60), (1, 10_000)])
def test_equals_all_scores(spark, seed, block_rows):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 500)] + rng.normal(scale=0.2, size=(500, 8))
    x[100:140] = x[100]  # a third of a cell is one vector: ties
    rows = [(i, x[i].tolist(), 1, "r") for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string").repartition(4)
    got = covertree.top_k(df, F.col("id") % 50 == 0, block_rows=block_rows).collect()
    whole = {i: np.floor(256 * x[i]).astype(np.int64) for i in range(500)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute(whole, range(0, 500, 50), 5)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in covertree.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 7, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 7, 0)]
    assert covertree.top_k(df.where("vec_id > 99"), F.col("id") % 50 == 0).count() == 0


def test_walks_of_two_trees_equal_all_scores():
    """Clusters, in which most pairs are left out, and rows that lie equally far apart, in which none are."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 3)) * 4000
    near = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 3)) * 20).astype(np.int64)
    far = rng.normal(size=(3000, 64))
    far = np.floor(256 * far / np.linalg.norm(far, axis=1)[:, None]).astype(np.int64)
    for x, pruned in ((near, True), (far, False)):
        seen = {}
        ids = rng.permutation(len(x)) + 5
        at = np.flatnonzero(ids % 50 == 0)
        got = covertree.search(ids[at], x[at], ids, x, 5, np.full(len(at), -(1 << 62)), seen)
        scores = x[at] @ x.T
        want = {(int(ids[i]), int(ids[j]), int(scores[n, j])) for n, i in enumerate(at) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-scores[n, j], ids[j]))[:5]}
        assert set(got) == want and len(got) == len(want)
        assert (seen["multiplied"] < 0.5 * seen["all"]) == pruned


def test_one_large_group_and_repeated_ids(spark):
    """A third of all rows are one vector; some ids are there twice."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (600, 4))
    x[200:400] = x[200]
    rows = [(i, [float(v) / 256 for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame([*rows, *rows[:20]], "vec_id long, embedding array<double>").repartition(3)
    got = covertree.top_k(df, F.col("id") % 50 == 0, block_rows=64).collect()
    twice = np.r_[np.arange(600), np.arange(20)]
    for q in range(0, 600, 50):
        want = sorted((-int(x[q] @ x[i]), int(i)) for i in twice if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_cover_trees_cover(spark):
    rng = np.random.default_rng(5)
    tree = covertree.CoverTree(rng.integers(-100, 100, (700, 3)))
    assert len(tree.centre) > 3
    for centre, radius, members, children in zip(tree.centre, tree.radius, tree.members, tree.children, strict=True):
        assert (np.sqrt(((tree.rows[members] - centre) ** 2).sum(axis=1)) <= radius + 1e-9).all()
        if children:
            assert sorted(np.concatenate([tree.members[c] for c in children]).tolist()) == sorted(members.tolist())
