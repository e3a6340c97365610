"""Serving queries: pages, filters, lookups, counts, front page."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schema import CATEGORIES, FRONT_PAGE_CATEGORIES

MAX_PAGE_SIZE = 50


def check_page(page: int, size: int, max_size: int | None = MAX_PAGE_SIZE) -> None:
    if not isinstance(page, int) or page < 1:
        raise ValueError("page starts at 1")
    if not isinstance(size, int) or size < 1 or (max_size is not None and size > max_size):
        raise ValueError(f"page size is between 1 and {max_size}")


def check_category(category: str, known: Sequence[str] = CATEGORIES) -> None:
    if category not in known:
        raise ValueError(f"unknown category {category!r}")


def check_score(score: float) -> None:
    if score < 0:
        raise ValueError("score starts at 0")


def request_fault(page: Column, size: Column, category: Column, score: Column, max_size: int = MAX_PAGE_SIZE, known: Sequence[str] = CATEGORIES) -> Column:
    """What is wrong with a request, as a column over many of them: the first of 'page', 'size', 'category', 'score', or NULL.

    The rules of ``check_page``, ``check_category`` and ``check_score``; a missing category or score is not asked for.
    """
    return (
        F.when(F.coalesce(page < 1, F.lit(True)), "page")
        .when(F.coalesce((size < 1) | (size > max_size), F.lit(True)), "size")
        .when(category.isNotNull() & ~category.isin(list(known)), "category")
        .when(score.isNotNull() & (score < 0), "score")
    )


def _page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page and the total count. Only page * size rows per task are kept for the sort."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", total)


def _newest(date: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(date), F.asc(key)]


def articles_page(
    df: DataFrame, page: int = 1, size: int = 10, start=None, end=None, category: str | None = None,
    contains: str | None = None, date: str = "publish_ts", key: str = "article_id", max_size: int | None = MAX_PAGE_SIZE,
) -> DataFrame:
    """Newest first; filters on date range (inclusive), category and a word of the title are optional."""
    check_page(page, size, max_size)
    kind = df.schema[date].dataType
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast(kind))
    if category is not None:
        df = df.where(F.col("main_category") == category)
    if contains:
        df = df.where(F.contains(F.lower("title"), F.lit(contains.lower())))
    return _page(df, _newest(date, key), page, size)


def trending_page(
    df: DataFrame, page: int = 1, size: int = 10, min_score: float = 0.0, category: str | None = None,
    date: str = "publish_ts", key: str = "article_id", max_size: int | None = MAX_PAGE_SIZE,
) -> DataFrame:
    """Most similar first, then newest, from a minimum score on."""
    check_page(page, size, max_size)
    check_score(min_score)
    df = df.where(F.col("similarity_score") >= min_score)
    if category is not None:
        df = df.where(F.col("main_category") == category)
    return _page(df, [F.desc_nulls_last("similarity_score"), *_newest(date, key)], page, size)


def articles_between(df: DataFrame, start, end, on: str = "uploaded_date") -> DataFrame:
    """Rows with start <= column <= end. Sort the result where it is shown, newest first."""
    kind = df.schema[on].dataType
    return df.where(F.col(on).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def recent_articles(
    df: DataFrame, now, hours: int = 24, limit: int = 100, from_time=None, date: str = "publish_ts", key: str = "article_id"
) -> DataFrame:
    """At most ``limit`` newest articles since ``from_time``, or of the last ``hours``."""
    kind = df.schema[date].dataType
    since = F.lit(from_time).cast(kind) if from_time is not None else F.lit(now).cast(kind) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(date) >= since).orderBy(*_newest(date, key)).limit(limit)


def latest_n(df: DataFrame, n: int, date: str = "publish_ts", key: str = "article_id") -> DataFrame:
    return df.orderBy(*_newest(date, key)).limit(n)


def lookup(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Point lookups; the list becomes a pushed-down filter."""
    return df.where(F.col(column).isin(list(values)))


def lookup_by_urls(df: DataFrame, urls: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given urls: a list in memory or a table with a url column of any size."""
    if isinstance(urls, DataFrame):
        return df.join(urls.select("url"), "url", "left_semi")
    return lookup(df, "url", urls)


def category_counts(df: DataFrame) -> DataFrame:
    """Articles per category; NULL and empty count as "Uncategorized"."""
    name = F.when(F.coalesce("main_category", F.lit("")) == "", F.lit("Uncategorized")).otherwise(F.col("main_category"))
    return df.groupBy(name.alias("main_category")).agg(F.count("*").alias("n"))


def distinct_category_sets(df: DataFrame, column: str = "categories") -> DataFrame:
    return df.select(F.array_sort(column).alias(column)).distinct()


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def category_top_picks(
    df: DataFrame, categories: Sequence[str] = tuple(FRONT_PAGE_CATEGORIES), k: int = 1,
    date: str = "publish_ts", key: str = "article_id",
) -> DataFrame:
    """The k best articles of each listed category, in list order; a category without one gives a row of NULLs."""
    spark = df.sparkSession
    listed = pa.table({"category_ord": pa.array(range(len(categories)), pa.int32()), "category": pa.array(categories, pa.string())})
    dim = spark.createDataFrame(listed)
    order = [F.desc_nulls_last("similarity_score"), *_newest(date, key)]
    ranked = (
        df.where(F.col("main_category").isin(list(categories)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("main_category").orderBy(*order)))
        .where(F.col("rank") <= k)
    )
    return dim.join(ranked, F.col("category") == F.col("main_category"), "left").drop("main_category")


def serving_projection(df: DataFrame) -> DataFrame:
    """The article a client sees: no content, defaults filled, category "Other" shown as "Social"."""
    category = F.when(F.coalesce("main_category", F.lit("")) == "", F.lit("General")).otherwise(F.col("main_category"))
    return df.select(
        "article_id",
        "url",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        category.alias("main_category"),
        F.when(category == "Other", F.lit("Social")).otherwise(category).alias("shown_category"),
        F.when(F.coalesce("title", F.lit("")) == "", F.lit("No title available")).otherwise(F.col("title")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "similarity_score",
        F.date_format("publish_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("publish_date"),
    )

