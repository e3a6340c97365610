"""Vectors, similarity and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import pivot_pairs as pivots
from newsloom.operators import trends as trend_ops
from newsloom.operators import vector_graph as graph
from newsloom.operators import vectors as op
from newsloom.operators.embedding import text_embed_hash as embed_hash
from newsloom.plans.catalog import query
from newsloom.plans.fixtures import (
    ARTICLES,
    MODELS,
    TRENDS,
    VECTORS,
    article_vectors,
    articles,
    table,
    trends,
    vector_articles,
    with_models,
)
from newsloom.session import new_path

COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
TREND_SCORES = f"""s AS (SELECT a.*, t.trend_id, t.query, {COS.format('a.embedding', 't.embedding')} AS score FROM article_vectors a, trends t),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, trend_id) AS rn FROM s)"""


def _score(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


@query(f"""WITH {VECTORS}, {TRENDS} SELECT a.article_id, a.label, round({COS.format('a.embedding', 't.embedding')}, 4) AS score
FROM article_vectors a JOIN trends t ON t.trend_id = a.label""")
def cosine_pairs(spark, sf):
    """Every article against the trend of its own label."""
    t = trends(spark, sf).select(F.col("trend_id").alias("label"), F.col("embedding").alias("center"))
    pairs = article_vectors(spark, sf).join(t, "label")
    return op.cosine_pairs(pairs, "embedding", "center").select("article_id", "label", _score("score"))


@query(f"""WITH {VECTORS}, {TRENDS}, {TREND_SCORES}, k AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, article_id) AS rank FROM s)
SELECT query AS query_id, article_id, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 10""")
def knn_topk(spark, sf):
    """The ten articles nearest to every trend."""
    found = op.knn_topk(trends(spark, sf), article_vectors(spark, sf), 10, query_id="query")
    return found.select("query_id", "article_id", "rank", _score("score"))


KNN_ALL = f"""WITH {VECTORS}, s AS (SELECT a.article_id AS query_id, b.article_id, {COS.format('a.embedding', 'b.embedding')} AS score
  FROM article_vectors a, article_vectors b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS rank FROM s)
SELECT query_id, article_id, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 4"""


@query(KNN_ALL)
def knn_all_tiled(spark, sf):
    """Neighbours of every article: too many queries to send to every task, so tile by tile."""
    v = article_vectors(spark, sf)
    found = op.knn_topk(v, v, 4, query_id="article_id", broadcast_rows=0, tile_rows=128)
    return found.select("query_id", "article_id", "rank", _score("score"))


def _recall(found, exact, keys):
    """One row: hits whose cosine is not the exact one, and whether nine tenths of the exact hits were found."""
    both = exact.withColumn("_e", F.lit(1)).join(found.withColumn("_f", F.lit(1)), keys, "left")
    odd = found.agg(F.count_if(F.abs(F.col("score") - F.col("cosine")) > 1e-6).alias("false_hits"))
    seen = both.agg((F.count("_f") >= 0.9 * F.count("_e")).alias("recalled"))
    return seen.select(odd.scalar().alias("false_hits"), "recalled")


@query("SELECT 0::BIGINT AS false_hits, true AS recalled")
def knn_lsh(spark, sf):
    """Approximate neighbours of every trend from hash buckets against the exact ones: true cosines, recall of at least 0.9."""
    asked = trends(spark, sf).select(F.col("query").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    corpus = article_vectors(spark, sf).select("article_id", "embedding")
    found = op.knn_lsh(asked, corpus, 10, bands=24, bits=5, probes=3).select("query_id", "article_id", "score")
    pairs = found.join(asked, "query_id").join(corpus.withColumnRenamed("embedding", "center"), "article_id")
    checked = op.cosine_pairs(pairs, "embedding", "center", "cosine").select("query_id", "article_id", "score", "cosine")
    exact = op.knn_topk(asked, corpus, 10).select("query_id", "article_id")
    return _recall(checked, exact, ["query_id", "article_id"])


def _with_urls(spark, sf):
    v = article_vectors(spark, sf)
    return v.select("article_id", F.concat(F.lit("v/"), F.col("article_id").cast("string")).alias("url"), F.col("article_id").alias("publish_date"), F.col("embedding").cast("array<float>").alias("embedding"))


@query("SELECT 0::BIGINT AS false_hits, true AS recalled")
def vector_graph(spark, sf):
    """A stored graph index at its default parameters against the exact neighbours of every trend: true cosines, recall of at least 0.9."""
    path = new_path(spark, "vector-graph")
    graph.write_graph(_with_urls(spark, sf), path)
    asked = trends(spark, sf).select(F.col("query").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    corpus = article_vectors(spark, sf).select("article_id", "embedding")
    found = graph.query_graph(spark, path, asked, 10).select("query_id", "article_id", "score")
    pairs = found.join(asked, "query_id").join(corpus.withColumnRenamed("embedding", "center"), "article_id")
    checked = op.cosine_pairs(pairs, "embedding", "center", "cosine").select("query_id", "article_id", "score", "cosine")
    exact = op.knn_topk(asked, corpus, 10).select("query_id", "article_id")
    return _recall(checked, exact, ["query_id", "article_id"])


@query(f"""WITH {VECTORS}, stored AS (SELECT article_id, embedding FROM article_vectors WHERE article_id % 3 <> 0),
batch AS (SELECT article_id, list_reverse(embedding) AS embedding FROM article_vectors WHERE article_id % 4 = 0),
now AS (SELECT * FROM batch UNION ALL SELECT * FROM stored WHERE article_id NOT IN (SELECT article_id FROM batch) AND article_id % 5 <> 0)
SELECT article_id, concat('v/', article_id) AS url, round(embedding[1]::DOUBLE, 4) AS first, round(embedding[-1]::DOUBLE, 4) AS last FROM now""")
def vector_graph_upsert(spark, sf):
    """What a stored graph holds after some vectors were replaced, some added and some removed by url."""
    path = new_path(spark, "vector-graph")
    v = _with_urls(spark, sf)
    graph.write_graph(v.where("article_id % 3 <> 0"), path, shard_rows=128)
    gone = v.where("article_id % 5 = 0").select("url")
    graph.upsert_graph(v.where("article_id % 4 = 0").withColumn("embedding", F.reverse("embedding")), path, gone)
    ends = [F.round(F.element_at("embedding", i).cast("double"), 4).alias(n) for i, n in ((1, "first"), (-1, "last"))]
    return graph.graph_rows(spark, path).select("article_id", "url", *ends)


PAIRS = f"""WITH {VECTORS}, p AS (SELECT a.article_id AS article_1, a.src AS source_1, b.article_id AS article_2, b.src AS source_2,
  {COS.format('a.embedding', 'b.embedding')} AS similarity FROM article_vectors a JOIN article_vectors b ON a.article_id < b.article_id AND a.src <> b.src)
SELECT article_1, source_1, article_2, source_2, round(similarity, 4) AS similarity FROM p WHERE similarity > 0.4"""


@query(PAIRS)
def pairwise_similar(spark, sf):
    return op.pairwise_similar(article_vectors(spark, sf), 0.4).withColumn("similarity", F.round("similarity", 4))


@query(PAIRS)
def pairwise_similar_pivots(spark, sf):
    """The same pairs from cells around pivots and the rows that visit them."""
    found = pivots.pairwise_similar_pivots(article_vectors(spark, sf), 0.4, pivots=12, tile_rows=128)
    return found.withColumn("similarity", F.round("similarity", 4))


@query("SELECT 0::BIGINT AS false_hits, true AS recalled")
def pairwise_similar_lsh(spark, sf):
    """Pairs found through hash buckets against the exact ones: true cosines, recall of at least 0.9."""
    v = article_vectors(spark, sf)
    found = op.pairwise_similar_lsh(v, 0.4, bands=24, bits=4).select("article_1", "article_2", F.col("similarity").alias("score"))
    exact = op.pairwise_similar(v, 0.4).select("article_1", "article_2", F.col("similarity").alias("cosine"))
    # The pairs outgrow the articles with their square, so either side is found once and they meet in one join.
    both = found.join(exact, ["article_1", "article_2"], "full")
    odd = F.abs(F.col("score") - F.coalesce("cosine", F.lit(-1.0))) > 1e-6
    seen = F.count_if(F.col("score").isNotNull() & F.col("cosine").isNotNull())
    return both.agg(F.count_if(odd).alias("false_hits"), (seen >= 0.9 * F.count("cosine")).alias("recalled"))


@query(f"""WITH {ARTICLES}, v AS (SELECT a.*, e.embedding, [a.main_category, a.src] AS categories FROM articles a JOIN embeddings e ON e.vec_id = a.article_id),
p AS (SELECT a.article_id AS article_1, a.src AS source_1, a.title AS title_1, array_to_string(a.categories, ',') AS categories,
  b.article_id AS article_2, b.src AS source_2, b.title AS title_2, {COS.format('a.embedding', 'b.embedding')} AS similarity
  FROM v a JOIN v b ON a.article_id < b.article_id AND a.src <> b.src AND a.main_category = 'Science' AND b.main_category = 'Science')
SELECT * REPLACE (round(similarity, 4) AS similarity) FROM p WHERE similarity > 0.3""")
def pairwise_in_category(spark, sf):
    """Similar articles of one category, with titles."""
    v = vector_articles(spark, sf).withColumn("categories", F.array("main_category", "src"))
    pairs = op.pairwise_similar(v, 0.3, "Science", tile_rows=64)
    return op.describe_pairs(pairs, v).withColumns(
        {"categories": F.array_join("categories", ","), "similarity": F.round("similarity", 4)}
    )


@query(f"""WITH {VECTORS}, {TRENDS}, {TREND_SCORES}
SELECT article_id, CASE WHEN score >= 0.5 THEN query END AS trend, round(score, 4) AS similarity_score FROM r WHERE rn = 1""")
def trend_assign(spark, sf):
    scored = trend_ops.trend_assign(article_vectors(spark, sf), trends(spark, sf), 0.5)
    return scored.select("article_id", "trend", _score("similarity_score"))


@query(f"""WITH {VECTORS}, {TRENDS}, {TREND_SCORES}
SELECT article_id, CASE WHEN score > 0.5 THEN query END AS trend, round(score, 4) AS similarity_score FROM r WHERE rn = 1""")
def trend_assign_tiled(spark, sf):
    """The same without sending the trends to every task, as for a huge list of trends."""
    scored = trend_ops.trend_assign(article_vectors(spark, sf), trends(spark, sf), 0.5, inclusive=False, broadcast_rows=0, tile_rows=128)
    return scored.select("article_id", "trend", _score("similarity_score"))


_LETTERS = "etaoinshr"
_COUNTED = "[" + ", ".join(f"(length(text) - length(replace(text, '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"


@query(f"""WITH {ARTICLES}, a AS (SELECT article_id, {_COUNTED.replace('text', "coalesce(content, '')")} AS embedding FROM articles),
t AS (SELECT item_id AS trend_id, concat('item_', item_id) AS query, {_COUNTED} AS embedding FROM benchmark),
c AS (SELECT a.article_id, t.trend_id, t.query, {COS.format('a.embedding', 't.embedding')} AS raw FROM a, t),
s AS (SELECT *, CASE WHEN isnan(raw) THEN 0 ELSE raw END AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, trend_id) AS rn FROM s)
SELECT article_id, CASE WHEN score >= 0.98 THEN query END AS trend, round(score, 4) AS similarity_score FROM r WHERE rn = 1""")
def analyze_articles(spark, sf):
    """All articles embedded on the way (counts of letters) and assigned to the benchmark texts as trends."""

    def embed(df):
        text = F.coalesce("content", F.lit(""))
        return df.withColumn("embedding", F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS]))

    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("trend_id"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("query"), F.col("text").alias("content"))
    rows = articles(spark, sf).select("article_id", "url", "title", "content")
    found = trend_ops.analyze_articles(spark, rows, embed(items).drop("content"), embed, 0.98)
    return found.select("article_id", "trend", _score("similarity_score"))


_SLICES = {m: f"[{start}:{start + n - 1}]" for m, (start, n) in MODELS.items()}
_MODEL_SCORES = ", ".join(
    f"{COS.format(f'a.embedding{part}', f't.embedding{part}')} AS {m}" for m, part in _SLICES.items()
)
ENSEMBLE = f"""WITH {VECTORS}, {TRENDS}, s AS (SELECT a.article_id, t.trend_id, t.query, {_MODEL_SCORES} FROM article_vectors a, trends t),
b AS (SELECT article_id, max(model_a) AS sa, max(model_b) AS sb, max(model_c) AS sc,
  first(query ORDER BY round(model_a, 9) DESC, trend_id) AS qa, first(query ORDER BY round(model_b, 9) DESC, trend_id) AS qb,
  first(query ORDER BY round(model_c, 9) DESC, trend_id) AS qc FROM s GROUP BY article_id),
l AS (SELECT *, CASE WHEN sa > 0.5 THEN qa END AS la, CASE WHEN sb > 0.5 THEN qb END AS lb, CASE WHEN sc > 0.5 THEN qc END AS lc,
  sa * 0.25 + sb * 0.35 + sc * 0.40 AS total FROM b),
v AS (SELECT *, CASE WHEN la = lb OR la = lc THEN la WHEN lb = lc THEN lb
  WHEN la IS NOT NULL AND sa >= coalesce(CASE WHEN lb IS NOT NULL THEN sb END, -2) AND sa >= coalesce(CASE WHEN lc IS NOT NULL THEN sc END, -2) THEN la
  WHEN lb IS NOT NULL AND sb >= coalesce(CASE WHEN lc IS NOT NULL THEN sc END, -2) THEN lb ELSE lc END AS vote FROM l)"""


@query(f"{ENSEMBLE} SELECT article_id, round(total, 4) AS ensemble_score, CASE WHEN total > 0.5 THEN vote END AS ensemble_trend FROM v")
def ensemble_trend(spark, sf):
    a, t = with_models(article_vectors(spark, sf)), with_models(trends(spark, sf))
    return trend_ops.ensemble_trend(a, t, list(MODELS)).select("article_id", _score("ensemble_score"), "ensemble_trend")


@query(f"{ENSEMBLE} SELECT count(*) AS articles, count(CASE WHEN total > 0.5 THEN vote END) AS with_trend FROM v")
def trend_summary(spark, sf):
    a, t = with_models(article_vectors(spark, sf)), with_models(trends(spark, sf))
    return trend_ops.trend_summary(trend_ops.ensemble_trend(a, t, list(MODELS)))


@query(f"""WITH {ARTICLES}, t AS (SELECT article_id, CASE main_category WHEN 'Sports' THEN NULL WHEN 'Other' THEN '' ELSE main_category END AS c, similarity_score FROM articles)
SELECT article_id, '' AS categories, CASE WHEN coalesce(c, '') = '' THEN 'General' ELSE c END AS main_category, similarity_score,
  sha256(concat(article_id, '|2024-02-01 00:00:00')) AS trending_id, '2024-02-01' AS analyzed FROM t""")
def trending_rows(spark, sf):
    """Rows of the trending table with their defaults."""
    category = F.when(F.col("main_category") == "Other", F.lit("")).when(F.col("main_category") != "Sports", F.col("main_category"))
    a = articles(spark, sf).withColumns({"main_category": category, "categories": F.lit(None).cast("array<string>")})
    return trend_ops.trending_rows(a, "2024-02-01 00:00:00").select(
        "article_id", F.array_join("categories", ",").alias("categories"), "main_category", "similarity_score", "trending_id",
        F.date_format("analyzed_date", "yyyy-MM-dd").alias("analyzed"),
    )


def _linked(spark, sf):
    """Articles with vectors; those of the Science desk link to an index.html page."""
    url = F.when(F.col("main_category") == "Science", F.concat("url", F.lit("/index.html"))).otherwise(F.col("url"))
    return vector_articles(spark, sf).withColumn("url", url)


LINKED = f"""{ARTICLES}, linked AS (SELECT a.* REPLACE (CASE a.main_category WHEN 'Science' THEN a.url || '/index.html' ELSE a.url END AS url), e.embedding
  FROM articles a JOIN embeddings e ON e.vec_id = a.article_id),
both_urls AS (SELECT article_id, title, url, embedding FROM linked UNION ALL
  SELECT article_id, title, CASE WHEN ends_with(url, '/index.html') THEN left(url, length(url) - 11) ELSE url || '/index.html' END, embedding FROM linked),
keyed AS (SELECT *, CASE WHEN ends_with(url, '/index.html') THEN left(url, length(url) - 11) ELSE url END AS norm FROM both_urls)"""


def _both_urls(spark, sf):
    """Every article under its url and under the other spelling of it."""
    linked = _linked(spark, sf).select("article_id", "title", "url", "embedding")
    other = F.when(F.endswith("url", F.lit("/index.html")), F.regexp_replace("url", "/index.html$", "")).otherwise(
        F.concat("url", F.lit("/index.html"))
    )
    return linked.unionByName(linked.withColumn("url", other))


ASKED = ["https://src0.example.com/fr/0", "https://src1.example.com/en/1", "https://src2.example.com/en/2"]


@query(f"""WITH {LINKED}, q AS (SELECT * FROM keyed WHERE url IN ('{"', '".join(ASKED)}')),
s AS (SELECT q.url AS asked_url, k.url, k.norm, k.article_id, {COS.format('q.embedding', 'k.embedding')} AS score FROM q JOIN keyed k ON k.norm <> q.norm),
b AS (SELECT *, row_number() OVER (PARTITION BY asked_url, norm ORDER BY round(score, 9) DESC, url) AS rn FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY asked_url ORDER BY round(score, 9) DESC, url) AS rank FROM b WHERE rn = 1)
SELECT asked_url, url, article_id, rank::INT AS rank, round(score, 4) AS similarity_score FROM k WHERE rank <= 5""")
def related_articles(spark, sf):
    """Related articles of given urls when many articles are stored under two urls."""
    stored = _both_urls(spark, sf)
    found = op.related_articles(stored.select("url", "embedding"), stored.select("url", "article_id"), ASKED, 5)
    return found.select("asked_url", "url", "article_id", "rank", _score("similarity_score"))


@query(f"""WITH {ARTICLES}, v AS (SELECT a.article_id, a.publish_ts, e.embedding FROM articles a JOIN embeddings e ON e.vec_id = a.article_id),
s AS (SELECT q.article_id AS query_id, v.article_id, v.publish_ts, {COS.format('q.embedding', 'v.embedding')} AS score FROM v q, v WHERE q.article_id IN (1, 7)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS rank FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY publish_ts DESC, rank) AS place FROM k WHERE rank <= 10 AND article_id <> query_id)
SELECT query_id, article_id, place::INT AS place, round(score, 4) AS score FROM p WHERE place <= 5""")
def related_recent(spark, sf):
    v = vector_articles(spark, sf).select("article_id", "embedding", "publish_ts")
    return op.related_recent(v, [1, 7], 5).select("query_id", "article_id", "place", _score("score"))


@query("""SELECT url, vec_id AS article_id, array_to_string([round(x, 4) FOR x IN embedding::DOUBLE[]], ',') AS embedding
FROM (SELECT vec_id, concat('v/', vec_id) AS url, embedding FROM embeddings) WHERE url = 'v/17' LIMIT 1""")
def vector_by_url(spark, sf):
    from newsloom.operators.serving import lookup

    v = article_vectors(spark, sf).withColumn("url", F.concat(F.lit("v/"), F.col("article_id").cast("string")))
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string"))
    return lookup(v, "url", ["v/17"]).limit(1).select("url", "article_id", F.array_join(rounded, ",").alias("embedding"))


@query(r"""SELECT doc_id, 256::INT AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""")
def text_embed_hash(spark, sf):
    """Hashed TF-IDF vectors of all documents: their size, and length 1 unless there is no word."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = embed_hash(d, ["text"], 256)
    size = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(size), 4).alias("norm"))
