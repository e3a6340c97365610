"""Resampling of documents towards a target distribution by importance weights of hashed n-grams.

Features are counted twice, over all documents and over the target texts, in a fixed number of
buckets; the logarithm of the ratio of the two distributions is a bucket's gain. A document's
weight is the mean gain of its features; noise of the Gumbel kind, drawn from its id, makes the
documents with the highest scores a sample without replacement.

Inside a task everything is Arrow kernels and arrays: lower case, splitting at a pattern,
flattening and dictionary encoding give one array of word numbers; shifted against itself it gives
the n-grams; only distinct ones are hashed; gains are taken by bucket and summed by document. A task
sends one row for each bucket to the counts, whatever it has read. Ranks come from a range sort of
small rows and the sizes of its partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import flat, in_pieces, text_bytes, written

# What stands between words, the number of buckets, and the seed of the noise.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED = 10_000, 2024


class Ngrams:
    """The n-grams (1 to ``longest`` words) of a batch of texts as buckets, each with its text's row."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, longest: int, buckets: int):
        raw, at = text_bytes(texts)
        # A fresh array from the bytes: the kernels are not reliable on slices.
        whole = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw)))
        rows = pc.split_pattern_regex(pc.ascii_lower(whole), BETWEEN)
        words, owner = flat(pc.list_flatten(rows), pa.large_string()), pc.list_parent_indices(rows).to_numpy()
        real = pc.not_equal(pc.binary_length(words), 0)  # a separator at either end leaves an empty part
        coded = words.filter(real).dictionary_encode()
        owner = owner[real.to_numpy(zero_copy_only=False)]
        first = coded.indices.to_numpy().astype(np.int64)
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        self.words = np.bincount(owner, minlength=len(rows))
        crc = np.array([zlib.crc32(w) for w in names], np.int64) if names else np.zeros(0, np.int64)
        self.rows, self.buckets = [owner], [(crc % buckets)[first]]
        gram, grams = first, names
        for n in range(2, longest + 1):
            # A gram of n words: the one of n - 1 words and the word behind it, of the same text.
            inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
            pair = np.full(len(first), -1, np.int64)
            pair[inside] = gram[inside] * len(names) + first[inside + n - 1]
            distinct, again = np.unique(pair[inside], return_inverse=True)
            grams = [grams[p // len(names)] + b" " + names[p % len(names)] for p in distinct.tolist()]
            crc = np.array([zlib.crc32(g) for g in grams], np.int64) if grams else np.zeros(0, np.int64)
            gram = np.full(len(first), -1, np.int64)
            gram[inside] = again
            self.rows.append(owner[inside])
            self.buckets.append((crc % buckets)[again])
        self.owner, self.bucket = np.concatenate(self.rows), np.concatenate(self.buckets)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has any. NULL and empty texts have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in in_pieces(batches, "text"):
            total += np.bincount(Ngrams(piece.column("text"), longest, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """For each bucket 1000 times the logarithm of how much likelier it is in the target, floored, with add-one smoothing.

    The counts that come to the driver are two numbers a bucket, however large the tables are.
    """
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, docs), (t, target)):
        for row in bucket_counts(texts, longest, buckets).collect():
            counts[row.bucket] = row.n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((t[i] + 1.0) * all_s / ((s[i] + 1.0) * all_t))) for i in range(buckets)]


def weighted(docs: DataFrame, gains: list[int], longest: int = 1, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``carry`` of every row, its ``n_words``, ``n_features`` and ``weight`` (the floored mean gain; 0 without features)."""
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = rows.select(*names).schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.array(gains, np.int64)
        for piece in in_pieces(batches, "text"):
            grams = Ngrams(piece.column("text"), longest, len(by_bucket))
            order = np.argsort(grams.owner, kind="stable")
            sizes = np.bincount(grams.owner, minlength=piece.num_rows)
            some = np.flatnonzero(sizes)
            total = np.zeros(piece.num_rows, np.int64)
            if len(some):
                total[some] = np.add.reduceat(by_bucket[grams.bucket[order]], (np.cumsum(sizes) - sizes)[some])
            made = [pa.array(x, pa.int64()) for x in (grams.words, sizes, total // np.maximum(sizes, 1))]
            yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + made, [*names, "n_words", "n_features", "weight"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_words", "n_features", "weight")


def noise(id_col: str, seed: int = SEED):
    """Gumbel noise (times 1000, floored) that depends on the id and the seed only."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; those with a rank are drawn.

    ``floor(percent * N / 100)`` of the N documents with at least ``least_words`` words are drawn,
    those with the highest scores; ties go to the smaller id, a NULL id comes last. Rows that agree
    in all of it (repeated rows) follow each other in any order. NULL and empty texts have no
    features and weight 0; an empty target or an empty table gives rows all the same. Columns beside
    the id and the text play no part. The counts of the buckets are the only thing that passes through
    the driver.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = weighted(corpus, bucket_gains(corpus, target, longest, buckets), longest).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = written(scored.withColumn("able", F.col("n_words") >= least_words), "resample-scored")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Where a stored row lies settles the order of equal rows, so that no key is hot.
    place = (F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line"))
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("file"), F.col("line")]
    ordered = scored.where("able").select("*", *place).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(np.arange(at + 1, at + batch.num_rows + 1), pa.int64()))
            at += batch.num_rows

    columns = ["doc_id", "n_features", "weight", "score", "part"]
    numbered = ordered.select(*columns).mapInArrow(number, ordered.select(*columns).schema.add("at", "long"))
    numbered = written(numbered, "resample-ranked")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.floor(F.sum("n").over(whole) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("at")
    ranked = numbered.join(offsets, "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    rest = scored.where("NOT able").withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out))
