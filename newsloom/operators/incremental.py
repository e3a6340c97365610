"""Incremental loading: high-watermark, batch bounds, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import localize
from newsloom.sources.sinks import table_exists

EPOCH = "1970-01-01 00:00:00"


def read_watermark(spark: SparkSession, path: str, job: str) -> str:
    """The last ingest time a job has loaded (as text), or the epoch."""
    if not table_exists(spark, path):
        return EPOCH
    last = (
        spark.read.parquet(path).where(F.col("id") == job)
        .agg(F.date_format(F.max("last_ingest_time"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    )
    return last or EPOCH


def advance_watermark(spark: SparkSession, path: str, job: str, last: str) -> None:
    """Append one row after every write of the batch has succeeded; the greatest value counts."""
    row = spark.createDataFrame([(job, last)], "id string, last_ingest_time string")
    row.withColumn("last_ingest_time", F.col("last_ingest_time").cast("timestamp")).coalesce(1).write.mode(
        "append"
    ).parquet(path)


def loaded_runs(spark: SparkSession, path: str, job: str) -> list[str]:
    """The run folders a job has loaded: one short text a run, a few a day."""
    if not table_exists(spark, path):
        return []
    return [r[0] for r in spark.read.schema("id string, run string").parquet(path).where(F.col("id") == job).select("run").distinct().collect()]


def mark_loaded(spark: SparkSession, path: str, job: str, runs: list[str]) -> None:
    """Append the runs a batch has loaded, after its write has succeeded."""
    spark.createDataFrame([(job, run) for run in runs], "id string, run string").coalesce(1).write.mode("append").parquet(path)


def incremental_load(df: DataFrame, last: str | Column, ts: str = "ingest_time") -> DataFrame:
    """Rows ingested after the watermark; a literal, so that it reaches the scan as a pushed filter."""
    bound = F.lit(last).cast(df.schema[ts].dataType) if isinstance(last, str) else last
    return df.where(F.col(ts) > bound)


def batch_bounds(df: DataFrame, ts: str = "ingest_time") -> DataFrame:
    return df.agg(
        F.min(ts).alias("min_ingest_time"), F.max(ts).alias("max_ingest_time"), F.count("*").alias("processed_rows")
    )


def batch_notification(
    df: DataFrame, table: str, date: str, hours: list[int], upload_stamp: str, zone: str, ts: str = "ingest_time"
) -> DataFrame:
    """One row holding the update message of a batch as JSON; no row for an empty batch."""
    bounds = batch_bounds(df, ts).where("processed_rows > 0")
    details = F.struct(
        F.col("processed_rows"), F.lit(table).alias("table"), F.lit(date).alias("date"),
        F.array(*[F.lit(h) for h in hours]).alias("hours"),
    )
    span = F.struct(localize(F.col("min_ingest_time").cast("timestamp"), zone).alias("from"), F.lit(upload_stamp).alias("to"))
    message = F.to_json(
        F.struct(
            F.lit("general").alias("update_type"), F.lit(upload_stamp).alias("timestamp"),
            details.alias("details"), span.alias("time_range"),
        )
    )
    return bounds.select(message.alias("message"))
