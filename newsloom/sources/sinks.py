"""Sinks: partitioned appends, JSON batches, error side output, and merging into a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.tables import upsert
from newsloom.schema import ARTICLE_KEY
from newsloom.session import new_path
from newsloom.sources.key_index import file_names, files_to_open, index_files, indexed_files


def with_ingest_columns(df: DataFrame, ingest_ts: str | Column) -> DataFrame:
    """Add ingest_time and the partition columns ingest_date, ingest_hour."""
    ts = F.lit(ingest_ts).cast("timestamp") if isinstance(ingest_ts, str) else ingest_ts
    return df.withColumns(
        {
            "ingest_time": ts,
            "ingest_date": F.date_format(ts, "yyyy-MM-dd"),
            "ingest_hour": F.date_format(ts, "HH"),
        }
    )


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], max_records: int = 5000, mode: str = "append", gather: bool = True
) -> None:
    """Append to a partitioned parquet table with files of at most ``max_records`` rows.

    With mode "overwrite" the folders that get rows are replaced, all others stay. Rows are gathered by folder first, so a folder gets few files; the rebalance lets
    adaptive execution split a folder that gets most of the rows over many tasks. Rows that all go to one folder need no ``gather``.
    """
    gathered = df.hint("rebalance", *by) if gather else df
    writer = gathered.write.partitionBy(*by).option("maxRecordsPerFile", max_records)
    writer.option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def write_json_batches(df: DataFrame, path: str, max_records: int = 500, by: Sequence[str] = ()) -> None:
    """Append JSON lines in files of at most ``max_records`` rows; rows are gathered by folder first."""
    gathered = df.hint("rebalance", *by) if by else df
    gathered.write.partitionBy(*by).option("maxRecordsPerFile", max_records).mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.csv(path, header=True, mode="overwrite", escape='"')


def split_corrupt(df: DataFrame, c: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(all rows without the raw text, damaged rows with it)."""
    return df.drop(c), df.where(F.col(c).isNotNull())


def write_clustered(
    df: DataFrame, path: str, by: str, cluster: str, spread_by: Sequence[str] = ARTICLE_KEY, mode: str = "append"
) -> None:
    """Partition folders by ``by``, rows sorted by ``cluster`` so that file statistics skip.

    The range ends with a hash of the row key, so that one huge (by, cluster) value is
    spread over several tasks.
    """
    ranged = df.withColumn("_salt", F.xxhash64(*spread_by))
    (
        ranged.repartitionByRange(by, cluster, "_salt")
        .sortWithinPartitions(by, cluster)
        .drop("_salt")
        .write.partitionBy(by)
        .mode(mode)
        .parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _folder(by: Sequence[str]) -> Column:
    """The folder of a row as one text; a filter on it is evaluated on folder names, not on rows."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in by])


def read_like(spark: SparkSession, path: str, by: Sequence[str], source: DataFrame, merge_schema: bool = False) -> DataFrame:
    """A stored table with the folder columns typed as in ``source`` ("03" must not come back as 3)."""
    reader = spark.read.option("mergeSchema", merge_schema)
    fields = [source.schema[f.name] if f.name in by else f for f in reader.parquet(path).schema.fields]
    return reader.schema(T.StructType(fields)).parquet(path)


def merge_into(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], by: Sequence[str], mode: str = "upsert",
    max_records: int = 10000, merge_schema: bool = False, stored: bool = False, gather: bool = True,
) -> None:
    """Merge ``source`` (unique on ``keys``) into a table partitioned by ``by``.

    Only folders that hold a matched row are read and rewritten; their names are all that comes
    to the driver. Rows for other folders are added to these. The new content is written aside first, so the
    table is never read while it is being replaced and a lost executor cannot lose rows. ``stored`` says that
    ``source`` is a stored table already, which stays; ``gather`` is that of ``write_partitioned``.
    ``merge_schema`` is needed only when files of the table differ in their columns: it reads
    every file footer. The keys of each file are kept in a Bloom filter beside the table
    (``key_index``), so of a table that is merged into again and again a small batch opens only the
    files that may hold its keys.
    """
    if not table_exists(spark, path):
        write_partitioned(source, path, by, max_records, gather=gather)
        index_files(spark, path, read_like(spark, path, by, source), keys)
        return
    aside = None if stored else write_aside(source, "merge-source")
    source = source if aside is None else aside
    target = read_like(spark, path, by, source, merge_schema)
    # The stored keys meet the batch in a semi-join: a small batch is broadcast, a larger one
    # filters them by its runtime filter, so they are not all shuffled.
    opened = files_to_open(spark, path, target, source, keys)
    # Spark prunes the list of files by this filter, so no other file is opened.
    known = target.where(F.col("_metadata.file_path").isin(opened)).select(*keys, *by).join(source.select(*keys), list(keys), "left_semi")
    if mode == "insert_new":
        # The files that are read are listed before, so those that are added here are not among them.
        # Keys alone tell whether all rows are new or none is; else the rows meet the known keys.
        matched = known.select(*keys).distinct().count()
        if matched < source.count():
            fresh = source.join(known.select(*keys), list(keys), "left_anti") if matched else source
            write_partitioned(fresh, path, by, max_records, gather=gather)
        _index_new(spark, path, by, source, keys)
        if aside is not None:
            remove_aside(aside)
        return
    if mode != "upsert":
        raise ValueError(f"unknown mode {mode!r}")
    folders = known.select(*by).distinct()
    touched = {row["_name"]: row for row in folders.withColumn("_name", _folder(by)).collect()}
    here = _folder(by).isin(list(touched))
    merged = write_aside(upsert(target.where(here), source, keys).where(here), "merge-rows") if touched else None
    write_partitioned(source.where(~here), path, by, max_records, gather=gather)
    # A folder whose rows all moved elsewhere gets no new file, so it is dropped below.
    left: set[str] = set()
    if merged is not None:
        write_partitioned(merged, path, by, max_records, "overwrite")
        left = {row[0] for row in merged.select(_folder(by)).distinct().collect()}
        remove_aside(merged)
    _index_new(spark, path, by, source, keys)
    if aside is not None:
        remove_aside(aside)
    for name, row in touched.items():
        if name not in left:
            naming = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
            parts = [naming.getPartitionPathString(c, None if row[c] is None else str(row[c])) for c in by]
            p = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _index_new(spark: SparkSession, path: str, by: Sequence[str], source: DataFrame, keys: Sequence[str]) -> None:
    """Filters for the files a merge has written, and for those of whoever wrote without."""
    target = read_like(spark, path, by, source)
    known = {r.file for r in indexed_files(spark, path).select("file").collect()}
    fresh = sorted(file_names(target) - known)
    if fresh:
        index_files(spark, path, target.where(F.col("_metadata.file_path").isin(fresh)), keys)


def remove_aside(df: DataFrame) -> None:
    """Delete the files of a table written aside that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_aside(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own in the shared folder, packed tightly."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
