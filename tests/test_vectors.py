from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import embedding, tiles, trends, vectors
from newsloom.operators.tiles import tile_self_join
from newsloom.plans.fixtures import article_vectors


def frame(spark, matrix, **columns):
    rows = [(i, *[c[i] for c in columns.values()], [float(x) for x in v]) for i, v in enumerate(matrix)]
    kinds = ", ".join(f"{name} {'string' if isinstance(c[0], str) else 'int'}" for name, c in columns.items())
    return spark.createDataFrame(rows, f"article_id bigint, {kinds + ', ' if kinds else ''}embedding array<float>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).standard_normal((300, 16)).astype(np.float32)


def unit(m):
    m = np.asarray(m, dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def as_rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("broadcast_rows, tile_rows", [(4096, 2048), (0, 64)])
def test_knn_is_exact(spark, cloud, broadcast_rows, tile_rows):
    df = frame(spark, cloud)
    q = df.where("article_id < 40").withColumnRenamed("article_id", "query_id")
    got = vectors.knn_topk(q, df, 5, broadcast_rows=broadcast_rows, tile_rows=tile_rows)
    scores = unit(cloud[:40]) @ unit(cloud).T
    want = [(i, int(j), r + 1) for i in range(40) for r, j in enumerate(np.argsort(-scores[i], kind="stable")[:5])]
    assert as_rows(got, "query_id", "article_id", "rank") == sorted(want)


def test_ties_go_to_the_smaller_id_and_null_vectors_are_left_out(spark):
    df = spark.createDataFrame(
        [(5, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0]), (1, None), (3, [0.0, 0.0])], "article_id bigint, embedding array<float>"
    )
    q = spark.createDataFrame([(0, [3.0, 0.0])], "query_id bigint, embedding array<float>")
    for size in (4096, 0):
        got = vectors.knn_topk(q, df, 3, broadcast_rows=size)
        assert [r.article_id for r in got.orderBy("rank").collect()] == [2, 5, 3]


@pytest.mark.parametrize("tile_rows", [2048, 40])
def test_pairs_are_exact(spark, cloud, tile_rows):
    src = [f"s{i % 3}" for i in range(300)]
    got = vectors.pairwise_similar(frame(spark, cloud, src=src), 0.6, tile_rows=tile_rows)
    s = unit(cloud) @ unit(cloud).T
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] > 0.6 and src[i] != src[j]]
    assert len(want) > 5
    assert as_rows(got, "article_1", "article_2") == want


def test_pairs_of_one_category(spark, cloud):
    df = frame(spark, cloud[:60], src=[f"s{i % 2}" for i in range(60)]).withColumn(
        "categories", F.when(F.col("article_id") < 30, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    )
    whole = set(as_rows(vectors.pairwise_similar(df, 0.3), "article_1", "article_2"))
    part = set(as_rows(vectors.pairwise_similar(df, 0.3, "a"), "article_1", "article_2"))
    assert part == {p for p in whole if max(p) < 30} and part


def test_lsh_pairs_are_a_subset_without_repeats_and_mostly_found(spark, cloud):
    rng = np.random.default_rng(5)
    near = cloud + rng.standard_normal(cloud.shape).astype(np.float32) * 0.15
    df = frame(spark, np.concatenate([cloud, near]), src=["a"] * 300 + ["b"] * 300)
    exact = set(as_rows(vectors.pairwise_similar(df, 0.9), "article_1", "article_2"))
    found = as_rows(vectors.pairwise_similar_lsh(df, 0.9, bands=12, bits=6), "article_1", "article_2")
    assert len(found) == len(set(found)) and set(found) <= exact
    assert len(found) >= 0.95 * len(exact) >= 200


def test_lsh_with_a_hot_bucket_keeps_every_pair(spark, cloud):
    """A third of the articles are copies: their bucket is cut into tiles, and nothing is lost."""
    copies = np.tile(cloud[:1], (100, 1))
    df = frame(spark, np.concatenate([copies, cloud[1:201]]), src=[f"s{i % 2}" for i in range(300)])
    got = vectors.pairwise_similar_lsh(df, 0.99, bands=4, bits=6, tile_rows=32)
    assert as_rows(got, "article_1", "article_2") == [(i, j) for i in range(100) for j in range(i + 1, 100) if (i - j) % 2]


def test_lsh_neighbours_recall(spark, sf_dir):
    v = article_vectors(spark, sf_dir)
    q = v.where("label = 3").select(F.col("article_id").alias("query_id"), "embedding")
    exact = set(as_rows(vectors.knn_topk(q, v, 3), "query_id", "article_id"))
    near = vectors.knn_lsh(q, v.select("article_id", "embedding"), 3, bands=24, bits=4, probes=2)
    found = set(as_rows(near, "query_id", "article_id"))
    assert len(found & exact) >= 0.9 * len(exact)


def test_tiles_meet_exactly_once(spark):
    import pyarrow as pa

    df = spark.range(101).select("id", (F.col("id") % 2).alias("r"))

    def emit(a, b, diagonal):
        left, right = (t.column("id").to_pylist() if t.num_columns else [] for t in (a, b))
        pairs = [(x, y) for n, x in enumerate(left) for y in (right[n + 1:] if diagonal else right)]
        return pa.table({"x": pa.array([min(p) for p in pairs], pa.int64()), "y": pa.array([max(p) for p in pairs], pa.int64())})

    got = as_rows(tile_self_join(df, "r", "id", emit, "x bigint, y bigint", 10), "x", "y")
    assert got == [(x, y) for x in range(101) for y in range(x + 1, 101) if (x - y) % 2 == 0]


def test_related_articles_settle_urls_before_the_cut(spark):
    rows = [("q", [1.0, 0.0]), ("q/index.html", [1.0, 0.0])]
    rows += [(f"a{s}", [1.0, 0.1]) for s in ("", "/index.html")] + [(f"b{s}", [1.0, 0.2]) for s in ("", "/index.html")]
    rows += [("c", [1.0, 0.3]), ("d", [0.0, 1.0])]
    v = spark.createDataFrame(rows, "url string, embedding array<float>")
    articles = v.select("url", F.lit(0.5).alias("similarity_score"))
    for size in (4096, 0):
        got = vectors.related_articles(v, articles, ["q"], 3, broadcast_rows=size).orderBy("rank").collect()
        assert [r.url for r in got] == ["a", "b", "c"]
        assert got[0].similarity_score == pytest.approx(1 / np.sqrt(1.01))


def test_related_recent(spark):
    rows = [(i, [1.0, i / 10], f"2024-01-{20 - i if i < 5 else i + 10:02d}") for i in range(9)]
    v = spark.createDataFrame(rows, "article_id bigint, embedding array<float>, d string").withColumn("publish_ts", F.col("d").cast("timestamp"))
    got = vectors.related_recent(v, [0], 2, extra=3).orderBy("place").collect()
    assert [r.article_id for r in got] == [1, 2]
    near = vectors.related_recent(v, [0], 2, extra=3, by_date=False).orderBy("place").collect()
    assert [r.article_id for r in near] == [1, 2]


def test_threshold_is_inclusive_or_not(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "article_id bigint, embedding array<float>")
    t = spark.createDataFrame([(1, "x", [3.0, 4.0])], "trend_id int, query string, embedding array<float>")
    for size in (4096, 0):
        incl = {r.article_id: (r.trend, r.similarity_score) for r in trends.trend_assign(a, t, 0.6, True, broadcast_rows=size).collect()}
        assert incl[1] == ("x", pytest.approx(0.6)) and incl[2][0] == "x" and incl[3] == (None, None)
        excl = {r.article_id: r.trend for r in trends.trend_assign(a, t, 0.8, False, broadcast_rows=size).collect()}
        assert excl == {1: None, 2: None, 3: None}


def test_no_trends(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0])], "article_id bigint, embedding array<float>")
    t = spark.createDataFrame([], "trend_id int, query string, embedding array<float>")
    row = trends.trend_assign(a, t).first()
    assert (row.trend, row.similarity_score) == (None, None)


@pytest.mark.parametrize(
    "labels, scores, want",
    [
        (["a", "a", "b"], [0.6, 0.6, 0.9], "a"),
        (["a", "b", "b"], [0.9, 0.6, 0.6], "b"),
        (["a", "b", "c"], [0.6, 0.9, 0.7], "b"),
        (["a", "b", "c"], [0.9, 0.9, 0.7], "a"),
        ([None, None, "c"], [0.4, 0.4, 0.7], "c"),
        ([None, "b", "a"], [0.4, 0.7, 0.7], "b"),
        ([None, None, None], [0.1, 0.1, 0.1], None),
    ],
)
def test_ensemble_vote(spark, labels, scores, want):
    vote = trends.ensemble_vote([F.lit(x).cast("string") for x in labels], [F.lit(x) for x in scores])
    assert spark.range(1).select(vote).first()[0] == want


def test_ensemble_gate(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], [0.0, 1.0])], "article_id int, m1 array<float>, m2 array<float>, m3 array<float>")
    t = spark.createDataFrame([(1, "x", [1.0, 0.0], [1.0, 0.0], [1.0, 0.0])], "trend_id int, query string, m1 array<float>, m2 array<float>, m3 array<float>")
    row = trends.ensemble_trend(a, t, ["m1", "m2", "m3"]).first()
    assert (row.ensemble_score, row.ensemble_trend) == (pytest.approx(0.6), "x")
    row = trends.ensemble_trend(a, t, ["m1", "m2", "m3"], weights=[0.1, 0.1, 0.8]).first()
    assert (row.ensemble_score, row.ensemble_trend) == (pytest.approx(0.2), None)


def test_embeddings_place_equal_texts_together(spark):
    df = spark.createDataFrame([(1, "cats and dogs"), (2, "Cats, dogs and"), (3, "stock market news today")], "id int, text string")
    e = {r.id: np.array(r.embedding) for r in embedding.text_embed_hash(df, ["text"], 64).collect()}
    assert e[1] @ e[2] == pytest.approx(1.0) and e[1] @ e[3] < 0.9


def test_articles_that_are_in_no_table(spark):
    def embed(df):
        return embedding.text_embed_hash(df, ["content"], 32)

    t = embed(spark.createDataFrame([(1, "cats", "cats"), (2, "stocks", "stocks")], "trend_id int, query string, content string"))
    t = t.withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
    got = trends.analyze_articles(spark, [{"url": "u", "content": "cats"}, {"content": "stocks stocks"}], t, embed, 0.9)
    assert [(r.url, r.trend) for r in got.orderBy("article_id").collect()] == [("u", "cats"), (None, "stocks")]


def test_model_hook_runs_on_batches(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a", "bcd"), ("", None)], "title string, content string")
    assert [r.embedding for r in embedding.embed(df, ["title", "content"], load).collect()] == [[5.0, 1.0], [0.0, 1.0]]


def test_one_answer_for_every_number_of_trends(spark):
    """NULL vectors on both sides, articles without id and with the id of another one: both ways agree row by row."""
    a = spark.createDataFrame(
        [(1, "p", [1.0, 0.0]), (None, "q", [0.0, 1.0]), (None, "r", [0.6, 0.8]), (7, "s", [0.0, 2.0]), (7, "t", [1.0, 0.1]), (8, "u", None)],
        "article_id bigint, name string, embedding array<float>",
    )
    t = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "none", None), (3, "y", [0.0, 1.0]), (4, "z", [0.0, 3.0])], "trend_id int, query string, embedding array<float>")
    got = [
        sorted((r.name, r.trend, None if r.similarity_score is None else round(r.similarity_score, 6)) for r in trends.trend_assign(a, t, 0.5, **sizes).collect())
        for sizes in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "tile_rows": 1})
    ]
    assert got[0] == got[1] == got[2]
    assert got[0] == [("p", "x", 1.0), ("q", "y", 1.0), ("r", "y", 0.8), ("s", "y", 1.0), ("t", "x", 0.995037), ("u", None, None)]


def test_a_row_travels_to_few_tiles(spark):
    """Copies of a row follow the rows a task can hold, not the size of a small tile."""
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 2).alias("r"))
    assert tiles._with_tiles(rows, None, "id", 10)[1] == tiles.MOST_TILES
    assert {r._n for r in tiles._with_tiles(rows, "r", "id", 10)[1].collect()} == {tiles.REGION_TILES}
    assert tiles._with_tiles(rows, None, "id", 1000)[1] == 4


def test_a_large_tile_is_compared_in_blocks(monkeypatch):
    found = np.random.default_rng(4).standard_normal((50, 4))
    t = pa.table({"vector": pa.array(found.tolist()), "src": pa.array([f"s{i % 3}" for i in range(50)])})
    for diagonal in (True, False):
        whole = [np.concatenate(c) for c in zip(*vectors._pairs_above(0.2, t, t, diagonal))]
        with monkeypatch.context() as small:
            small.setattr(vectors, "BLOCK_SCORES", 350)
            blocks = list(vectors._pairs_above(0.2, t, t, diagonal))
        assert len(blocks) == 8 and len(whole[0]) > 50
        assert set(zip(*whole[:2])) == set(zip(*[np.concatenate(c) for c in zip(*blocks)][:2]))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_meet_in_packed_blocks(spark, cloud):
    """Blocks of rows meet by number, neither row by row nor in a cross join."""
    df = frame(spark, cloud, src=[f"s{i % 3}" for i in range(300)])
    for pairs in (vectors.pairwise_similar(df, 0.6, tile_rows=40), vectors.pairwise_similar_lsh(df, 0.6, bands=24, bits=2, tile_rows=40)):
        assert "FlatMapCoGroupsInArrow" not in _plan(pairs) and "Join LeftOuter, ((_i" in _plan(pairs)
    assert tiles.tile_count(615_000, 2048, tiles.BLOCK_ROWS) == 10 and tiles.tile_count(615_000, 2048) == 76


def test_pairs_near_the_threshold_are_those_of_double_precision(spark):
    # Cosines with the first vector go past 0.6 in steps that single precision cannot tell apart.
    angle = np.arccos(0.6) + (np.arange(200) - 100) * 1e-10
    matrix = np.concatenate([[[1.0, 0.0]], np.stack([np.cos(angle), np.sin(angle)], axis=1)])
    rows = [(i, "a" if i == 0 else "b", [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "article_id bigint, src string, embedding array<double>")
    got = as_rows(vectors.pairwise_similar(df, 0.6), "article_1", "article_2")
    assert abs(len(got) - 100) <= 1 and got == [(0, i) for i in range(1, len(got) + 1)]


def test_crowded_buckets_and_regions_give_the_same_pairs(spark, cloud, monkeypatch):
    rows = [(i % 280, f"s{i % 3}", None if i % 50 == 0 else [0.0] * 16 if i % 50 == 1 else [float(x) for x in v]) for i, v in enumerate(cloud)]
    df = spark.createDataFrame(rows, "article_id bigint, src string, embedding array<float>")
    found = []
    for crowded in (0.0, float("inf")):
        monkeypatch.setattr(vectors, "CROWDED", crowded)
        pairs = vectors.pairwise_similar_lsh(df, 0.5, bands=6, bits=3, tile_rows=64)
        assert ("FlatMapCoGroupsInArrow" in _plan(pairs)) == (crowded > 0)
        found.append(as_rows(pairs, "article_1", "source_1", "article_2", "source_2", "similarity"))
    exact = as_rows(vectors.pairwise_similar(df, 0.5), "article_1", "source_1", "article_2", "source_2", "similarity")
    assert found[0] == found[1] and set(found[0]) <= set(exact) and 20 < len(found[0]) < len(exact)


def test_recall_of_pairs_finds_either_side_once(spark, sf_dir):
    from newsloom.plans.catalog import QUERIES, load

    if "pairwise_similar_lsh" not in QUERIES:
        load()
    checked = QUERIES["pairwise_similar_lsh"](spark, sf_dir)
    assert _plan(checked).count("MapInArrow") == 2
    assert [tuple(r) for r in checked.collect()] == [(0, True)]
