"""The news tables, derived from the given tables; every row of them is used."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import lead_sentences

# Event type -> category of the article; the last one stands for "no category known".
CATEGORY_OF_EVENT = {"view": "Politics", "click": "Science", "signup": "Sports", "purchase": "Technology"}
MODELS = {"model_a": (1, 16), "model_b": (17, 24), "model_c": (41, 24)}


# Tables of long texts, where the work per row outweighs a shuffle of a small file.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. A text table of fewer files than the cluster has cores is dealt out by its key; a big one is not."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, TEXT_TABLES[name]) if name in TEXT_TABLES and len(df.inputFiles()) < cores else df


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document, dated and scored by the event with its number."""
    category = F.lit("Other")
    for event, name in CATEGORY_OF_EVENT.items():
        category = F.when(F.col("event_type") == event, F.lit(name)).otherwise(category)
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    return d.join(e, d.doc_id == e.event_id).select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("src"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("language"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("content"),
        category.alias("main_category"),
        F.col("value").alias("similarity_score"),
        F.col("ts").alias("publish_ts"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ingest_ts"),
    )


ARTICLES = """articles AS (
  SELECT d.doc_id AS article_id, d.source AS src,
         concat('https://', d.source, '.example.com/', d.lang, '/', d.doc_id) AS url,
         d.lang AS language, split_part(d.text, '.', 1) AS title, d.text AS content,
         CASE e.event_type WHEN 'view' THEN 'Politics' WHEN 'click' THEN 'Science' WHEN 'signup' THEN 'Sports'
              WHEN 'purchase' THEN 'Technology' ELSE 'Other' END AS main_category,
         e.value AS similarity_score, e.ts AS publish_ts, e.ts + INTERVAL 1 HOUR AS ingest_ts
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


def recrawled(spark: SparkSession, sf: str) -> DataFrame:
    """All articles, and the English ones once more as crawled a day later."""
    a = articles(spark, sf).select(
        "article_id", "src", "url", "title", "main_category", "similarity_score", "publish_ts", "language", "content", "ingest_ts"
    )
    again = a.join(articles(spark, sf).where("language = 'en'").select("article_id"), "article_id", "left_semi")
    return a.unionByName(
        again.withColumns(
            {
                "title": F.concat("title", F.lit(" (updated)")),
                "similarity_score": F.col("similarity_score") + 1,
                "publish_ts": F.col("publish_ts") + F.expr("INTERVAL 1 DAY"),
            }
        )
    )


RECRAWLED = ARTICLES + """, recrawled AS (
  SELECT article_id, src, url, title, main_category, similarity_score, publish_ts, language, content, ingest_ts FROM articles
  UNION ALL
  SELECT article_id, src, url, concat(title, ' (updated)'), main_category, similarity_score + 1,
         publish_ts + INTERVAL 1 DAY, language, content, ingest_ts FROM articles WHERE language = 'en')"""


def raw_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as a crawler leaves them: sentinels, blanks, dates as text in many formats."""
    t = F.col("publish_ts")
    formats = {
        "Politics": F.date_format(t, "yyyy-MM-dd HH:mm:ss"),
        "Science": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        "Sports": F.date_format(t, "dd/MM/yyyy HH:mm"),
        "Technology": F.concat(F.lit("Updated  "), F.date_format(t, "h:mm a 'EDT', EEE MMMM dd, yyyy")),
    }
    text = F.when(F.col("language") == "es", F.lit("No publish date")).otherwise(F.lit("some day soon"))
    for name, value in formats.items():
        text = F.when(F.col("main_category") == name, value).otherwise(text)
    title = (
        F.when(F.col("src") == "src3", F.lit("No title"))
        .when(F.col("src") == "src5", F.lit("   "))
        .when(F.col("src") == "src7", F.lit(None).cast("string"))
        .otherwise(F.col("title"))
    )
    return articles(spark, sf).withColumns({"title": title, "publish_date": text})


RAW = ARTICLES + """, raw AS (
  SELECT * REPLACE (CASE src WHEN 'src3' THEN 'No title' WHEN 'src5' THEN '   ' WHEN 'src7' THEN NULL ELSE title END AS title),
    CASE main_category WHEN 'Politics' THEN strftime(publish_ts, '%Y-%m-%d %H:%M:%S')
         WHEN 'Science' THEN strftime(publish_ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
         WHEN 'Sports' THEN strftime(publish_ts, '%d/%m/%Y %H:%M')
         WHEN 'Technology' THEN strftime(publish_ts, 'Updated  %-I:%M %p EDT, %a %B %d, %Y')
         WHEN 'Other' THEN CASE WHEN language = 'es' THEN 'No publish date' ELSE 'some day soon' END END AS publish_date,
    CASE main_category WHEN 'Politics' THEN date_trunc('second', publish_ts)
         WHEN 'Science' THEN date_trunc('second', publish_ts) - INTERVAL 2 HOUR
         WHEN 'Sports' THEN date_trunc('minute', publish_ts)
         WHEN 'Technology' THEN date_trunc('minute', publish_ts) + INTERVAL 4 HOUR END AS read_ts
  FROM articles)"""


def article_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as article vectors; the label names the source."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("article_id"),
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("src"),
        "label",
        "embedding",
    )


VECTORS = """article_vectors AS (
  SELECT vec_id AS article_id, concat('src', label) AS src, label, embedding FROM embeddings)"""


def trends(spark: SparkSession, sf: str) -> DataFrame:
    """One trend query per label: the mean of all its vectors, aggregated on the executors."""
    e = table(spark, sf, "embeddings").withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    return e.groupBy("label").agg(Summarizer.mean(F.col("_v")).alias("_m")).select(
        F.col("label").alias("trend_id"),
        F.concat(F.lit("trend_"), F.col("label").cast("string")).alias("query"),
        vector_to_array("_m").alias("embedding"),
    )


TRENDS = """components AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
trends AS (
  SELECT label AS trend_id, concat('trend_', label) AS query, list(x ORDER BY i) AS embedding
  FROM components GROUP BY label)"""


def with_models(df: DataFrame) -> DataFrame:
    """Three slices of the vector stand for the vectors of three models."""
    return df.withColumns({m: F.slice("embedding", start, n) for m, (start, n) in MODELS.items()})


def vector_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that have a vector."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    return articles(spark, sf).join(v, "article_id")


def search_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All articles with a three-sentence summary, to search in."""
    return articles(spark, sf).select(
        F.col("article_id").alias("doc_id"), "title", lead_sentences("content", 3).alias("summary"), "content", "publish_ts"
    )


# Sentences of a text as DuckDB sees them: mark the breaks, split, drop blank pieces.
WS = r"[\s\p{Z}\x{0B}\x{85}]"


def sql_sentences(text: str) -> str:
    return (
        f"[s FOR s IN string_split(regexp_replace({text}, '([.!?]){WS}+', '\\1␞', 'g'), '␞') "
        f"IF regexp_replace(s, '{WS}', '', 'g') <> '']"
    )


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


DOCS = (
    ARTICLES
    + f""", docs AS (
  SELECT article_id AS doc_id, title,
         array_to_string([{sql_strip('s')} FOR s IN ({sql_sentences('content')})[1:3]], ' ') AS summary,
         content, publish_ts FROM articles)"""
)
