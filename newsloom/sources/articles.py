"""Readers: article JSON, import CSV, slots of a partitioned table, feeds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import col
from newsloom.schema import AUDIO_BYTES_PER_SECOND, RAW_ARTICLE


def read_articles_json(spark: SparkSession, path: str, schema: T.StructType = RAW_ARTICLE) -> DataFrame:
    """Files holding JSON arrays of articles; damaged records carry their text in ``_corrupt``."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def stored_schema(spark: SparkSession, path: str, default: T.StructType = RAW_ARTICLE) -> T.StructType:
    """The schema of an existing table, else the default."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return default
    return spark.read.parquet(path).schema


def read_articles_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str], defaults: Mapping[str, str]
) -> DataFrame:
    """CSV with a header; ``columns`` maps file column -> our column, in file order; blanks get defaults."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return raw.select(
        *[
            F.coalesce(F.col(f"`{old}`"), F.lit(defaults[new])).alias(new) if new in defaults else F.col(f"`{old}`").alias(new)
            for old, new in columns.items()
        ]
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """A database table in parallel key ranges; rows outside the bounds fall into the outer ranges."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]), numPartitions=str(partitions), **options,
        )
        .load()
    )


def crawled_urls(spark: SparkSession, path: str) -> DataFrame:
    """The distinct urls of stored crawl files (JSON objects or arrays of them)."""
    found = spark.read.schema("url string").option("multiLine", True).json(path)
    return found.where("url IS NOT NULL").distinct()


def slot_scan(
    df: DataFrame, date: str, hours: Iterable[int], date_col: str = "ingest_date", hour_col: str = "ingest_hour"
) -> DataFrame:
    """Rows of a date and a list of hours: one filter on the partition columns, so other folders are not read."""
    wanted = [f"{h:02d}" for h in hours]
    return df.where((F.col(date_col) == date) & F.col(hour_col).isin(wanted))


def hours_scan(
    df: DataFrame, wanted: Iterable[tuple[str, int]], date_col: str = "ingest_date", hour_col: str = "ingest_hour"
) -> DataFrame:
    """Rows of (date, hour) folders, which may lie on several dates; also a pure partition filter."""
    by_date: dict[str, list[str]] = {}
    for date, hour in wanted:
        by_date.setdefault(date, []).append(f"{hour:02d}")
    keep = F.lit(False)
    for date, hours in by_date.items():
        keep = keep | ((F.col(date_col) == date) & F.col(hour_col).isin(hours))
    return df.where(keep)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing in a frame is NULL there."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def feed_entries(df: DataFrame, xml: str = "xml", category: str = "category") -> DataFrame:
    """One row per item of a stored RSS 2.0 feed: category, link, title and publish date."""
    schema = "channel struct<item:array<struct<link:string,title:string,pubDate:string>>>"
    item = F.explode("_feed.channel.item")
    return (
        df.withColumn("_feed", F.from_xml(F.col(xml), schema))
        .select(F.col(category).alias("category"), item.alias("_item"))
        .select(
            "category",
            F.trim("_item.link").alias("url"),
            F.trim("_item.title").alias("title"),
            F.trim("_item.pubDate").alias("publish_date"),
        )
    )


def audio_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Length in seconds of audio files, estimated from their size; the bytes are not read."""
    return spark.read.format("binaryFile").load(path).select("path", duration_from_size("length").alias("seconds"))


def duration_from_size(c: str | Column) -> Column:
    return F.floor(col(c) / F.lit(AUDIO_BYTES_PER_SECOND)).cast("bigint")
