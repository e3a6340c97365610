"""Pairs by metric partitioning against all pairs: borders, dense cells, copies a row sends, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from newsloom.operators import pivot_pairs as op
from newsloom.operators.vectors import pairwise_similar


def frame(spark, rows):
    data = [(i, f"s{i % 3}", None if row is None else [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "article_id long, src string, embedding array<float>").repartition(4)


def clusters(n, dim, spread, seed=1, centers=25):
    pick = np.random.default_rng(seed)
    out = pick.standard_normal((centers, dim))[pick.integers(0, centers, n)] + pick.standard_normal((n, dim)) * spread
    return out / np.linalg.norm(out, axis=1)[:, None]


def pairs(df):
    return sorted((r.article_1, r.source_1, r.article_2, r.source_2, round(r.similarity, 6)) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9, 0.97])
@pytest.mark.parametrize("number", [2, 30])
def test_equals_all_pairs(spark, threshold, number):
    df = frame(spark, clusters(700, 16, 0.35))
    got = pairs(op.pairwise_similar_pivots(df, threshold, pivots=number, tile_rows=100))
    assert got == pairs(pairwise_similar(df, threshold)) and got


def test_odd_rows_and_copies(spark):
    base = clusters(300, 8, 0.3, seed=4)
    rows = [*base, *[base[0]] * 150, None, np.zeros(8), -base[1]]
    df = frame(spark, rows)
    got = pairs(op.pairwise_similar_pivots(df, 0.9, pivots=9, tile_rows=50))
    assert got == pairs(pairwise_similar(df, 0.9))
    assert op.pairwise_similar_pivots(df.where("false"), 0.9, pivots=9).collect() == []
    assert pairs(op.pairwise_similar_pivots(df.limit(20), -0.5, pivots=3)) == pairs(pairwise_similar(df.limit(20), -0.5))


def test_rows_send_few_copies(spark):
    """Far clusters: a row stays near its border, and borders are seldom near."""
    rows = clusters(20_000, 32, 0.12, seed=7, centers=60)
    cells = op.Cells(op.spread_out(rows[::10], 100), 0.95)
    _, row, _ = cells.of(rows)
    assert len(row) / len(rows) < 2


def test_many_rows_take_the_cells(spark):
    """At 8 000 rows with the number of pivots left open: the same pairs, and not the way of tiles."""
    df = frame(spark, clusters(8000, 32, 0.1, seed=9, centers=80))
    found = op.pairwise_similar_pivots(df, 0.97, tile_rows=128)
    assert "cell" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == pairwise_similar(df, 0.97).count() > 0
