"""Table maintenance: deduplication, anti-joins, upserts, migration, crawl frontier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.schema import GOLD_COLUMNS
from newsloom.sources.articles import union_all


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    The rank filter is pushed below the shuffle, so each task sends at most one row per
    key and a key that holds a large share of the rows stays cheap.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``order`` columns per key, NULL last; ``tie`` columns ascending decide ties."""
    by = [F.desc_nulls_last(c) for c in order] + [F.asc_nulls_last(c) for c in tie]
    return first_per_key(df, keys, by)


def dedup_stored(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """``dedup_latest`` of rows whose keys seldom repeat: looked at alone first, so unique ones do not shuffle their texts.

    ``stored`` holds the keys of ``df`` at less cost than ``df`` itself.
    """
    repeated = duplicate_groups((df if stored is None else stored).select(*keys), *keys)
    return dedup_latest(df, keys, order, tie) if repeated.limit(1).count() else df


def dedup_best(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    return first_per_key(df, [key], [F.desc_nulls_last(score), F.asc(tie)])


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``existing``; only its key columns are read."""
    return df.join(existing.select(*keys), list(keys), "left_anti")


def new_stored_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new_rows`` of stored tables: the keys alone tell first whether all rows are new or none is; only else the rows are shuffled."""
    known = df.select(*keys).join(existing.select(*keys), list(keys), "left_semi").count()
    if not known:
        return df
    return new_rows(df, existing, keys) if known < df.count() else df.limit(0)


def delete_by_keys(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(keys_df.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], mode: str = "upsert") -> DataFrame:
    """Merged content of a table; ``source`` has to be unique on the keys.

    ``upsert``: source rows replace target rows with the same key.
    ``insert_new``: target rows win.
    """
    if mode == "upsert":
        return union_all(delete_by_keys(target, source, keys), source)
    if mode == "insert_new":
        return union_all(target, new_rows(source, target, keys))
    raise ValueError(f"unknown mode {mode!r}")


def upsert_stamped(
    target: DataFrame, source: DataFrame, keys: Sequence[str], stamp: str | Column, batch_id: str
) -> DataFrame:
    """Upsert with one upload time and one batch id for the whole batch."""
    ts = F.lit(stamp).cast("timestamp") if isinstance(stamp, str) else stamp
    return upsert(target, source.withColumns({"uploaded_date": ts, "batch_id": F.lit(batch_id)}), keys)


def column_backfill(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a column where it is NULL or empty from an update table that is unique on the key."""
    new = updates.select(key, F.col(column).alias("_new"))
    empty = F.col(column).isNull() | (F.col(column) == "")
    return (
        target.join(new, key, "left")
        .withColumn(column, F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column)))
        .drop("_new")
    )


def migrate_missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Articles not yet in the trending table, with the defaults of a fresh row."""
    have = set(source.columns)
    body = [F.col(c) for c in ("content", "title") if c in have] or [F.lit("No content")]
    return new_rows(source, target, ["article_id"]).select(
        "article_id",
        "url",
        (F.col("image_url") if "image_url" in have else F.lit(None).cast("string")).alias("image_url"),
        (F.coalesce("categories", F.array().cast("array<string>")) if "categories" in have else F.array().cast("array<string>")).alias("categories"),
        (F.coalesce("main_category", F.lit("General")) if "main_category" in have else F.lit("General")).alias("main_category"),
        "title",
        (F.col("summary") if "summary" in have else F.lit(None).cast("string")).alias("summary"),
        F.lit(0.0).alias("similarity_score"),
        *([F.col("publish_ts")] if "publish_ts" in have else []),
        body[0].alias("content"),
    )


def migration_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts of source rows, inserted and skipped, in one pass."""
    known = target.select("article_id").distinct().withColumn("_known", F.lit(True))
    return source.select("article_id").join(known, "article_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known")).alias("skipped"),
    )


def gold_build(df: DataFrame, upload_date: str) -> DataFrame:
    """The gold projection: one row per (url, src), dates without time."""
    latest = dedup_stored(df, ["url", "src"], ["publish_ts", "ingest_time"], ["title"])
    return latest.withColumn("publish_date", F.to_date("publish_ts")).withColumn(
        "upload_date", F.lit(upload_date).cast("date")
    ).select(*GOLD_COLUMNS)


def crawl_frontier(entries: DataFrame, seen: DataFrame, first: str = "top_stories") -> DataFrame:
    """Feed entries not crawled yet, one per url; feeds named like ``first`` go first, then feed order."""
    todo = new_rows(entries.where(F.col("url").isNotNull() & (F.col("url") != "")), seen, ["url"])
    priority = F.when(F.col("category").contains(first), 0).otherwise(1)
    return first_per_key(todo, ["url"], [priority, F.col("category"), F.col("entry_id")])


def batch_assign(df: DataFrame, size: int, key: str, digits: int = 4) -> DataFrame:
    """Add a dense row_index and the batch_id of batches of ``size`` rows; ``key`` has to be unique.

    No global sort: rows are numbered inside buckets of a hash of the key, and the
    counts of the (at most 16**digits) buckets give every bucket its offset.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn("row_index", F.col("_offset") + F.col("_inside"))
        .withColumn("batch_id", F.floor(F.col("row_index") / size))
        .drop("_bucket", "_inside", "_offset")
    )
