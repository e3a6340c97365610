"""Top-k search against comparing everything, with many shards and blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from newsloom.llm import topk


def exact(rows, k, every):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q, x in good:
        if q % every == 0:
            scored = sorted({(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q})[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))


def check(spark, rows, k=5, every=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS vector", "1 AS score", "0 AS shard")
    got = [tuple(r) for r in topk.top_k(df, k, every).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(exact(rows, k, every))


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 8))
    return [(int(i), (middle[i % 6] + rng.normal(scale=0.3, size=8)).astype(np.float32).tolist()) for i in range(n)]


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "LEAF", 16)
    check(spark, vectors(1200))


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    check(spark, [(i, [0.5, 0.25, float(i % 3)]) for i in range(600)], every=25)


def test_odd_rows(spark):
    rows = vectors(120, 3) + [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (50, vectors(120, 3)[50][1])]
    check(spark, rows)
    check(spark, [(50, [1.0, 2.0])])
    check(spark, [(50, [1.0, 2.0]), (51, [-1.0, 2.0]), (100, [0.0, 0.0])])
    check(spark, [])


def test_the_tree_leaves_parts_out():
    rng = np.random.default_rng(1)
    points = np.floor(256 * np.concatenate([rng.normal(loc=c, scale=0.05, size=(400, 6)) for c in (-3, 0, 3)]))
    tree = topk.BallTree(points, 32)
    visited = []
    original = tree.points
    class Watched:  # noqa: E306
        def __getitem__(self, s):
            visited.append(s.stop - s.start)
            return original[s]
    tree.points = Watched()
    best, found = topk.search(tree, np.arange(len(points)), points[-1:], np.array([-1]), np.array([-np.inf]), 5)
    scores = points @ points[-1]
    assert best[0].tolist() == sorted(scores, reverse=True)[:5] and sum(visited) < len(points) / 2


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="different lengths|cannot reshape"):
        check(spark, [(50, [1.0, 2.0]), (51, [1.0])])


def test_large_components(spark, monkeypatch):
    """Sums beyond 2**53 are exact, sums beyond 64 bits an error."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "LEAF", 16)
    rng = np.random.default_rng(7)
    check(spark, [(i, (rng.normal(size=6) * 1e6).astype(np.float32).tolist()) for i in range(300)], every=10)
    check(spark, [(i, [1.5e6 + (i % 2), 1e6, -2e6]) for i in range(250)], every=25)
    with pytest.raises(Exception, match="64 bits"):
        check(spark, [(50, [1e9, 1e9]), (51, [1e9, 1e9])])
