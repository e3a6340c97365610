"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import new_path

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: The setting by which Spark deletes the shuffle files of a query when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same rows, stored in the shared folder: lineage ends here and nothing is computed twice.

    The shuffle files go as soon as the rows are stored; otherwise they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before or "false")
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a stored intermediate table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Bits of a filter for each of its keys (one foreign key in so many passes it), and the most bits of a filter (64 MB).
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 29
#: Fixed value: the bits of one value of ``bitmap_construct_agg``.
BITMAP = 1 << 15


def marked(rows: DataFrame, key: Column, keys: DataFrame, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``, false where ``key`` is certainly none of ``keys`` (a table of one column).

    The keys are hashed into bitmaps, a few bytes a key, that go to every task. So a join of long rows with few keys
    need not shuffle all of the rows; the rows marked true still have to be joined.
    """
    size = min(MOST_FILTER_BITS, max(1, -(-FILTER_BITS * keys.count() // BITMAP)) * BITMAP)

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(size)) + 1  # numbered from 1, as the bitmap functions do

    bits = keys.select(place(F.col(keys.columns[0])).alias("_v")).withColumn("_bucket", F.bitmap_bucket_number("_v"))
    bits = bits.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_v")).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col("_bucket"), "left")
    return met.select(*[rows[f"`{c}`"] for c in rows.columns], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(mark))


def worker_memo(name: str) -> dict:
    """A dict that lives as long as the Python worker, for read-only models and memo tables."""
    holder = sys.modules.setdefault("_newsloom_worker_memo", types.ModuleType("_newsloom_worker_memo"))
    return holder.__dict__.setdefault("tables", {}).setdefault(name, {})


def flat(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    """One Arrow array of the given type."""
    column = column.cast(kind)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)
    return column


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of the texts in it; a null is an empty text."""
    array = flat(column, pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def in_pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece have about ``most`` bytes; a single text stays whole."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(column))[1])
        start = 0
        while start < batch.num_rows:
            total = np.cumsum(sizes[start:])
            n = max(1, int(np.searchsorted(total, most, "right")))
            yield batch.slice(start, n)
            start += n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class RollingHash:
    """64-bit hashes of any byte range of an array, from prefix sums of a polynomial over random byte codes."""

    def __init__(self, raw: np.ndarray, seed: int = 11):
        codes = random_words(256, seed)[raw]
        n = len(raw)
        self._inverse = powers(INVERSE, n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(BASE, n), out=self._sums[1:])

    def ranges(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start])


def as_table(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs; whatever else the table has cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
