"""Pages of a large table by rank: stored in its order, with the number of rows before each file.

The table is range-sorted once and written as one file for each part; a small table says how many rows each part has
and how many come before it. Page n is then a few row numbers of one or two parts, and the total is a
number that is already there, however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.serving import MAX_PAGE_SIZE, check_page

PART_ROWS = 100_000


def write_ranked(df: DataFrame, path: str, order: Sequence[Column], part_rows: int = PART_ROWS) -> None:
    """Store the rows in an order under a new path; the order ends in a unique key, so no value of it is hot."""
    parts = max(1, -(-df.count() // part_rows))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # The writer sorts by folder; each task has one, so its order stays.
    placed.write.partitionBy("_part").parquet(f"{path}/rows")
    spark = df.sparkSession
    sizes = spark.read.parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def ranked_page(spark: SparkSession, path: str, page: int = 1, size: int = 10, max_size: int | None = MAX_PAGE_SIZE) -> DataFrame:
    """A page of the stored order with the total number of rows; only the parts that hold it are read."""
    check_page(page, size, max_size)
    parts = spark.read.parquet(f"{path}/parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    lo, hi = (page - 1) * size, page * size
    here = parts.where((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).collect()  # one or two rows, unless parts are smaller than pages
    rows = spark.read.parquet(f"{path}/rows")
    columns = [c for c in rows.columns if c != "_part"]
    at = F.lit(None).cast("long")
    for r in here:
        at = F.when(F.col("_part") == r["_part"], F.col("_metadata.row_index") + r["before"]).otherwise(at)
    rows = rows.where(F.col("_part").isin([r["_part"] for r in here])).withColumn("_at", at)
    return rows.where((F.col("_at") >= lo) & (F.col("_at") < hi)).orderBy("_at").select(*columns, F.lit(total).cast("long").alias("total"))
