"""The stored graph index: recall at its default parameters, copies, upserts, deletions, shards read and written."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import vector_graph as graph
from newsloom.session import new_path


def vectors(n, dim, seed=1, copies=0):
    pick = np.random.default_rng(seed)
    centers = pick.standard_normal((40, dim))
    out = centers[pick.integers(0, 40, n)] + pick.standard_normal((n, dim)) * 0.8
    out[:copies] = out[0]
    return out / np.linalg.norm(out, axis=1)[:, None]


def frame(spark, rows, first=0):
    data = [(first + i, f"u/{first + i}", i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "article_id long, url string, publish_date long, embedding array<float>").repartition(4)


def recall(found, asked, stored, ids, k):
    best = np.argsort(-(asked @ stored.T), axis=1, kind="stable")[:, :k]
    hits = sum(len({ids[j] for j in best[q]} & {r.article_id for r in found if r.query_id == q}) for q in range(len(asked)))
    return hits / best.size


@pytest.fixture(scope="module")
def stored(spark):
    rows = vectors(12_000, 48)
    path = new_path(spark, "test-graph")
    graph.write_graph(frame(spark, rows), path, shard_rows=4096)
    return rows, path


def test_recall_at_the_default_parameters(spark, stored):
    rows, path = stored
    asked = vectors(60, 48, seed=2)
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, embedding array<float>")
    found = graph.query_graph(spark, path, queries, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan
    hits = found.collect()
    assert recall(hits, asked, rows.astype(np.float32), range(len(rows)), 10) >= 0.9
    for r in hits[:50]:
        assert abs(r.score - asked[r.query_id] @ rows[r.article_id]) < 1e-5 and r.url == f"u/{r.article_id}"
    assert {r.rank for r in hits} == set(range(1, 11))


def test_many_queries_meet_the_shards_in_a_co_group(spark, stored, monkeypatch):
    rows, path = stored
    asked = vectors(30, 48, seed=3)
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, embedding array<float>")
    few = {(r.query_id, r.article_id) for r in graph.query_graph(spark, path, queries, 5).collect()}
    monkeypatch.setattr(graph, "bounded_vectors", lambda *_: None)
    assert {(r.query_id, r.article_id) for r in graph.query_graph(spark, path, queries, 5).collect()} == few


def test_links_are_navigable(spark, stored):
    """Every article is reached from every top row, levels are sparse, and no row has too many neighbours."""
    _, path = stored
    for shard in range(3):
        rows = sorted(graph.read_graph(spark, path).where(F.col("shard") == shard).collect(), key=lambda r: r.node)
        assert [r.node for r in rows] == list(range(len(rows))) and {r.size for r in rows} == {len(rows)}
        assert all(len(r.neighbours) == r.level + 1 and len(r.neighbours[0]) <= 64 and all(len(x) <= 32 for x in r.neighbours[1:]) for r in rows)
        seen, queue = {0}, [0]
        while queue:
            for x in rows[queue.pop()].neighbours[0]:
                if x not in seen:
                    seen.add(x)
                    queue.append(x)
        assert len(seen) >= 0.999 * len(rows)
        assert 0 < sum(r.level > 0 for r in rows) < len(rows) / 16


def test_upsert_touches_only_its_shards_and_keeps_recall(spark):
    rows = vectors(6000, 32, seed=5)
    path = new_path(spark, "test-graph")
    graph.write_graph(frame(spark, rows[:5000]), path, shard_rows=500)
    before = {r.f: r.t for r in graph.read_graph(spark, path).select(F.input_file_name().alias("f"), F.col("shard").alias("t")).distinct().collect()}
    one = frame(spark, rows[5000:5001], 5000)
    assert graph.upsert_graph(one, path) == 1
    after = {r.f for r in graph.read_graph(spark, path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(before.keys() - after) <= 1
    graph.upsert_graph(frame(spark, rows[5000:], 5000), path, spark.createDataFrame([(f"u/{i}",) for i in range(0, 4000, 2)] + [("nowhere",), (None,)], "url string"))
    alive = np.array([i for i in range(6000) if i >= 4000 or i % 2])
    assert sorted(r.article_id for r in graph.graph_rows(spark, path).collect()) == alive.tolist()
    asked = vectors(50, 32, seed=6)
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, embedding array<float>")
    assert recall(graph.query_graph(spark, path, queries, 10).collect(), asked, rows[alive], alive, 10) >= 0.9
    # A replaced vector is found under its new place only.
    graph.upsert_graph(frame(spark, -rows[4001:4002], 4001), path)
    far = spark.createDataFrame([(0, [float(-x) for x in rows[4001]])], "query_id long, embedding array<float>")
    assert graph.query_graph(spark, path, far, 1).first().article_id == 4001
    assert graph.graph_rows(spark, path).where("url = 'u/4001'").count() == 1


def test_copies_of_one_vector(spark):
    """A third of all rows are one vector: they stay reachable, and so does the rest."""
    rows = vectors(3000, 24, seed=8, copies=1000)
    path = new_path(spark, "test-graph")
    graph.write_graph(frame(spark, rows), path)
    asked = np.concatenate([rows[:1], rows[1000:1060]])
    queries = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, embedding array<float>")
    found = graph.query_graph(spark, path, queries, 20).collect()
    assert all(r.article_id < 1000 for r in found if r.query_id == 0) and sum(r.query_id == 0 for r in found) == 20
    assert sum(r.rank == 1 and r.article_id == 999 + r.query_id for r in found) >= 57


def test_odd_rows(spark):
    path = new_path(spark, "test-graph")
    schema = "article_id long, url string, publish_date long, embedding array<float>"
    odd = [(1, "a", 1, [1.0, 0.0]), (2, "a", 2, [0.0, 1.0]), (3, None, 1, [1.0, 0.0]), (4, "b", None, None), (None, "c", None, [0.0, 0.0]), (6, "d", 1, [1.0, 1.0])]
    graph.write_graph(spark.createDataFrame(odd, schema), path)
    assert sorted(r.url for r in graph.graph_rows(spark, path).collect()) == ["a", "c", "d"]
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.url) for r in graph.query_graph(spark, path, queries, 1).collect()] == [(1, "a")]
    assert graph.query_graph(spark, path, queries.where("false"), 1).collect() == []
    graph.upsert_graph(spark.createDataFrame([], schema), path, spark.createDataFrame([("a",), ("c",), ("d",)], "url string"))
    assert graph.graph_rows(spark, path).collect() == []
    graph.upsert_graph(spark.createDataFrame(odd, schema), path)
    assert sorted(r.url for r in graph.graph_rows(spark, path).collect()) == ["a", "c", "d"]
