"""Trend queries and their assignment to articles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.vectors import RANK_DIGITS, unit_rows
from newsloom.operators.vectors import BLOCK_SCORES, BROADCAST_ROWS, bounded_vectors, knn_topk
from newsloom.schema import MODEL_WEIGHTS, RELATED_QUERIES


def active_top_keywords(df: DataFrame, n: int = 10, order: str = "position") -> DataFrame:
    """The first n active trending searches in feed order."""
    return df.where("active").orderBy(order).limit(n).select("query")


def related_queries_flatten(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per rising and top query of a related-queries payload (JSON)."""
    parsed = F.from_json(payload, RELATED_QUERIES)
    empty = F.array().cast("array<struct<query:string,value:string,extracted_value:int,link:string,serpapi_link:string>>")

    def tagged(kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"_p.{kind}"), empty), lambda q: F.struct(F.lit(kind).alias("kind"), q.alias("q"))
        )

    return (
        df.withColumn("_p", parsed)
        .select(*keep, F.explode(F.concat(tagged("rising"), tagged("top"))).alias("_e"))
        .select(*keep, "_e.kind", "_e.q.*")
    )


def _best_match(queries: list[pa.Array], units: list[np.ndarray]):
    """An Arrow UDF over one vector column per model: array of (query of the best trend, cosine).

    ``queries`` and ``units`` hold the trends that have a vector of the model.
    """

    @F.arrow_udf("array<struct<query:string,score:double>>")
    def match(*vectors: pa.Array) -> pa.Array:
        n = len(vectors[0])
        best = np.zeros((n, len(units)), np.int64)
        score = np.full((n, len(units)), np.nan)
        shift = np.cumsum([0, *map(len, units)])
        for m, (unit, column) in enumerate(zip(units, vectors)):
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            step = max(1, BLOCK_SCORES // max(1, len(unit)))
            for start in range(0, len(valid) if len(unit) else 0, step):
                there = valid[start : start + step]
                cosine = unit_rows(column.take(pa.array(there))) @ unit.T
                top = np.argmax(np.round(cosine, RANK_DIGITS), axis=1)
                best[there, m] = shift[m] + top
                score[there, m] = cosine[np.arange(len(there)), top]
        missing = np.isnan(score).ravel()
        entries = pa.StructArray.from_arrays(
            [pa.concat_arrays(queries).take(pa.array(best.ravel(), mask=missing)), pa.array(score.ravel(), mask=missing)],
            names=["query", "score"],
        )
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(units)), entries)

    return match


def best_trends(
    articles: DataFrame, trends: DataFrame, models: Sequence[str], broadcast_rows: int = BROADCAST_ROWS, **sizes: int
) -> DataFrame:
    """Add query_<n> and score_<n>: the most similar trend under every embedding model.

    ``trends``: trend_id, query and one vector column per model, named as in ``articles``.
    Ties go to the smaller trend_id. A trend without a vector is left out, an article without
    one has no trend. Up to ``broadcast_rows`` trends go to every task and each batch of
    articles is one matrix product; beyond that the distinct vectors of the articles meet the
    trends tile by tile and the result comes back by the vector, so articles without id or
    with the id of another one get their own result either way.
    """
    small = bounded_vectors(trends, ["trend_id", "query", *models], broadcast_rows)
    if small is not None:
        there = [small.filter(pc.is_valid(small.column(m))) for m in models]
        queries = [pa.concat_arrays([pa.array([], pa.string()), *t.column("query").cast(pa.string()).chunks]) for t in there]
        match = _best_match(queries, [unit_rows(t.column(m)) if t.num_rows else np.zeros((0, 1)) for t, m in zip(there, models)])
        out = articles.withColumn("_m", match(*[F.col(m) for m in models]))
        found = {f"query_{n}": F.col("_m")[n]["query"] for n in range(len(models))}
        found |= {f"score_{n}": F.col("_m")[n]["score"] for n in range(len(models))}
        return out.withColumns(found).drop("_m")
    out = articles
    for n, model in enumerate(models):
        name = F.sha2(F.col(model).cast("string"), 256)
        vectors = articles.where(F.col(model).isNotNull()).select(name.alias("_v"), F.col(model).alias(model)).dropDuplicates(["_v"])
        top = knn_topk(vectors, trends, 1, "_v", "trend_id", model, broadcast_rows=broadcast_rows, **sizes)
        top = top.select(F.col("query_id").alias("_v"), F.col("article_id").alias("trend_id"), F.col("score").alias(f"score_{n}"))
        named = top.join(trends.select("trend_id", F.col("query").alias(f"query_{n}")), "trend_id").drop("trend_id")
        out = out.withColumn("_v", name).join(named, "_v", "left").drop("_v")
    return out


def trend_assign(
    articles: DataFrame, trends: DataFrame, threshold: float = 0.5, inclusive: bool = True, vector: str = "embedding",
    **sizes: int,
) -> DataFrame:
    """Add similarity_score (best cosine) and trend (its query, if the score reaches the threshold)."""
    scored = best_trends(articles.drop("similarity_score", "trend"), trends, [vector], **sizes)
    enough = F.col("score_0") >= threshold if inclusive else F.col("score_0") > threshold
    return scored.withColumn("trend", F.when(enough, F.col("query_0"))).withColumnRenamed(
        "score_0", "similarity_score"
    ).drop("query_0")


def analyze_articles(
    spark: SparkSession, articles: Sequence[dict] | DataFrame, trends: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = 0.5
) -> DataFrame:
    """Trend assignment for articles that have no embedding yet: a list of dicts (url, title, content) or a table of them with article_id.

    ``embed`` adds the embedding column; it has to be the one the trends were embedded with.
    """
    if not isinstance(articles, DataFrame):
        rows = [(n, a.get("url"), a.get("title"), a.get("content")) for n, a in enumerate(articles)]
        articles = spark.createDataFrame(rows, "article_id bigint, url string, title string, content string")
    return trend_assign(embed(articles), trends, threshold).drop("embedding")


def ensemble_vote(labels: Sequence[Column], scores: Sequence[Column]) -> Column:
    """The label two of the models agree on, else the label of the most certain model, else NULL."""
    agreed = F.coalesce(
        *[
            F.when(labels[i] == labels[j], labels[i])
            for i in range(len(labels))
            for j in range(i + 1, len(labels))
        ]
    )
    ranked = F.array(
        *[
            F.when(label.isNotNull(), F.struct(score.alias("score"), F.lit(-n).alias("order"), label.alias("label")))
            for n, (label, score) in enumerate(zip(labels, scores))
        ]
    )
    return F.coalesce(agreed, F.array_max(F.filter(ranked, lambda x: x.isNotNull()))["label"])


def ensemble_trend(
    articles: DataFrame,
    trends: DataFrame,
    models: Sequence[str],
    weights: Sequence[float] = MODEL_WEIGHTS,
    threshold: float = 0.5,
    **sizes: int,
) -> DataFrame:
    """Add ensemble_score (weighted best cosines) and ensemble_trend (the vote, if the score is above)."""
    scored = best_trends(articles, trends, models, **sizes)
    scores = [F.coalesce(F.col(f"score_{n}"), F.lit(0.0)) for n in range(len(models))]
    labels = [F.when(s > threshold, F.col(f"query_{n}")) for n, s in enumerate(scores)]
    total = scores[0] * F.lit(weights[0])
    for s, w in zip(scores[1:], weights[1:]):
        total = total + s * F.lit(w)
    return scored.withColumn("ensemble_score", total).withColumn(
        "ensemble_trend", F.when(F.col("ensemble_score") > threshold, ensemble_vote(labels, scores))
    )


def trend_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("articles"), F.count("ensemble_trend").alias("with_trend"))


def trending_rows(scored: DataFrame, analyzed: str | Column) -> DataFrame:
    """Rows of the trending table: defaults filled, one analysis time, a repeatable id per article and time."""
    ts = F.lit(analyzed).cast("timestamp") if isinstance(analyzed, str) else analyzed
    category = F.col("main_category")
    return scored.withColumns(
        {
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
            "main_category": F.when(category.isNull() | (category == ""), F.lit("General")).otherwise(category),
            "similarity_score": F.col("similarity_score").cast("double"),
            "analyzed_date": ts,
            "trending_id": F.sha2(F.concat_ws("|", F.col("article_id").cast("string"), ts.cast("string")), 256),
        }
    )
