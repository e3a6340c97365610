"""A Bloom filter of the keys for each file of a stored table, so that a small batch opens only the files that may hold its keys.

The filters are rows of a table in the folder ``_key_index`` of the stored table, which readers of the table
pass over. A file without a filter is always opened, so whoever writes past the index costs time, not rows; a filter of a file that
is gone is not asked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, n long, bits binary"
#: Bits a key and bits set for it: about one file in 2000 is opened in vain.
BITS, PROBES = 16, 8
#: A batch of more keys than this opens every file.
MOST_KEYS = 200_000


def _positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of so many bits."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(17) | h << np.uint64(47)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(size)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(64, len(hashes) * BITS + 7 & ~7)
    bits = np.zeros(size, bool)
    bits[_positions(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the hashes may be in the filter."""
    known = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return bool(known[_positions(hashes, len(known))].all(axis=1).any())


def _hash(df: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    """``h`` of each row's keys, as values of the stored types."""
    return df.select(F.xxhash64(*[F.col(k).cast(like.schema[k].dataType) for k in keys]).alias("h"))


def index_files(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Add the filters of the files that ``rows`` (a scan of files of the table) reads."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.unique(table.column("h").to_numpy())
        return pa.table({"file": [key[0].as_py()], "n": [len(hashes)], "bits": [filter_of(hashes)]}, pa.schema([("file", pa.string()), ("n", pa.int64()), ("bits", pa.binary())]))

    hashed = rows.select(F.col("_metadata.file_path").alias("file"), F.xxhash64(*keys).alias("h"))
    hashed.groupBy("file").applyInArrow(build, SCHEMA).write.mode("append").parquet(f"{path}/_key_index")


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    from newsloom.sources.sinks import table_exists

    return spark.read.schema(SCHEMA).parquet(f"{path}/_key_index") if table_exists(spark, f"{path}/_key_index") else spark.createDataFrame([], SCHEMA)


def file_names(target: DataFrame) -> set[str]:
    """The files of a scan as the column ``_metadata.file_path`` names them (no empty host in front of the path)."""
    return {name.replace(":///", ":/", 1) for name in target.inputFiles()}


def files_to_open(spark: SparkSession, path: str, target: DataFrame, source: DataFrame, keys: Sequence[str]) -> list[str]:
    """The files of ``target`` (a scan of the table) that may hold a key of ``source``: names only come to the driver."""
    files = file_names(target)
    few = _hash(source, keys, target).distinct().limit(MOST_KEYS + 1).toArrow().column("h").to_numpy()
    if len(few) > MOST_KEYS:
        return sorted(files)

    def ask(batches):
        for batch in batches:
            hit = [may_hold(bits, few) if len(few) else False for bits in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(hit, pa.bool_())], ["file", "hit"])

    answers = indexed_files(spark, path).select("file", "bits").mapInArrow(ask, "file string, hit boolean").collect()
    spared = {r.file for r in answers if not r.hit}
    return sorted(files - spared)
