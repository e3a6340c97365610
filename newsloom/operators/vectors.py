"""Similarity over embedding vectors: nearest neighbours, related articles, similar pairs, LSH."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import normalize_url
from newsloom.functions.vectors import RANK_DIGITS, band_signature, cosine, probe_signatures, unit_rows
from newsloom.operators.tables import first_per_key
from newsloom.operators.tiles import TILE_ROWS, block_self_join, tile_join, tile_self_join
from newsloom.session import new_path

# A table of vectors with at most this many rows and bytes may be sent to every task. Which way is
# taken changes the plan only: both give the same rows.
BROADCAST_ROWS = 4096
BROADCAST_BYTES = 32 << 20
#: Entries of a score matrix that a task holds at a time.
BLOCK_SCORES = 1 << 22
#: Pairs whose cosines are taken at a time.
PAIR_ROWS = 1 << 15
#: From this share of all pairs on that the buckets of an LSH search compare, counted for each band, all pairs are compared once.
CROWDED = 0.5


def block_rows(others: int) -> int:
    """Rows that are compared with so many others at a time."""
    return max(1, BLOCK_SCORES // max(1, others))


def bounded_vectors(df: DataFrame, columns: Sequence[str], limit: int = BROADCAST_ROWS) -> pa.Table | None:
    """The table as Arrow, ordered by its first column, if it has at most ``limit`` rows and few bytes; else None.

    One job that brings at most ``limit`` + 1 rows to the driver.
    """
    rows = df.select(*columns).limit(limit + 1).toArrow()
    return rows.sort_by(columns[0]) if rows.num_rows <= limit and rows.nbytes <= BROADCAST_BYTES else None


def vector_rows(df: DataFrame, vector: str = "embedding", date: str = "publish_ts") -> DataFrame:
    """Rows of the vector table: a repeatable id, url, vector, publish time in epoch seconds. Merge them on url."""
    return df.select(
        F.xxhash64("url").alias("article_id"), "url", F.col(vector).cast("array<float>").alias("embedding"),
        F.unix_timestamp(F.col(date).cast("timestamp")).alias("publish_date"),
    )


def cosine_pairs(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Cosine of two vector columns of the same row."""
    return pairs.withColumn(out, cosine(a, b))


def _best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray | None, k: int) -> np.ndarray:
    """Positions of the k best entries: greater score, then smaller id; with keys, one per key."""
    look = k
    while True:
        near = np.arange(len(scores))
        if look < len(scores):
            border = np.round(np.partition(scores, len(scores) - look)[len(scores) - look], RANK_DIGITS)
            near = np.flatnonzero(np.round(scores, RANK_DIGITS) >= border)
        order = near[np.lexsort((ids[near], -np.round(scores[near], RANK_DIGITS)))]
        if keys is None:
            return order[:k]
        _, first = np.unique(keys[order], return_index=True)
        if len(first) >= k or len(near) == len(scores):
            return order[np.sort(first)[:k]]
        look *= 4


class _TopK:
    """The running k best (id, key, score) of every query."""

    def __init__(self, k: int, keyed: bool):
        self.k, self.keyed, self.rows = k, keyed, {}

    def add(self, query, scores, ids, keys) -> None:
        keep = _best(scores, ids, keys, self.k)
        scores, ids, keys = scores[keep], ids[keep], keys[keep] if self.keyed else None
        if query in self.rows:
            s, i, key = self.rows[query]
            scores, ids = np.concatenate([s, scores]), np.concatenate([i, ids])
            keys = np.concatenate([key, keys]) if self.keyed else None
            keep = _best(scores, ids, keys, self.k)
            scores, ids, keys = scores[keep], ids[keep], keys[keep] if self.keyed else None
        self.rows[query] = (scores, ids, keys)

    def batches(self, schema: pa.Schema) -> list[pa.RecordBatch]:
        out = []
        for query, (scores, ids, keys) in self.rows.items():
            columns = [pa.array([query] * len(ids)), pa.array(ids), pa.array(scores, pa.float64())]
            if self.keyed:
                columns.append(pa.array(keys))
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema))
        return out


def _top_schema(queries: DataFrame, corpus: DataFrame, keyed: bool) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType().add("query_id", queries.schema["query_id"].dataType).add(
        "article_id", corpus.schema["article_id"].dataType
    ).add("score", DoubleType())
    if keyed:
        schema = schema.add("key", corpus.schema["key"].dataType)
    return schema, to_arrow_schema(schema)


def _numpy(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    broadcast_rows: int = BROADCAST_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Candidates that hold the exact k best of every query.

    ``queries``: query_id, vector and optionally key; ``corpus``: article_id, vector and
    optionally key. With keys, an entry with the key of the query is left out and only the
    best entry of every key counts.

    Up to ``broadcast_rows`` queries go to every task, which sends on the k best of its
    partition. More queries meet the corpus tile by tile.
    """
    keyed = "key" in corpus.columns
    schema, arrow = _top_schema(queries, corpus, keyed)
    cols = ["vector", "key"] if keyed else ["vector"]
    queries = queries.select("query_id", *cols).where("vector IS NOT NULL")
    corpus = corpus.select("article_id", *cols).where("vector IS NOT NULL")

    def compare(top: _TopK, names: list, own: list | None, unit: np.ndarray, block) -> None:
        ids = _numpy(block.column("article_id"))
        keys = _numpy(block.column("key")) if keyed else None
        scores = unit @ unit_rows(block.column("vector")).T
        for n, (name, row) in enumerate(zip(names, scores)):
            if not keyed:
                top.add(name, row, ids, None)
                continue
            other = np.flatnonzero(keys != own[n])
            if len(other):
                top.add(name, row[other], ids[other], keys[other])

    small = bounded_vectors(queries, ["query_id", *cols], broadcast_rows)
    if small is not None:
        names, unit = small.column("query_id").to_pylist(), unit_rows(small.column("vector"))
        own = small.column("key").to_pylist() if keyed else None

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = _TopK(k, keyed)
            step = block_rows(len(names))
            for batch in batches:
                for start in range(0, batch.num_rows if names else 0, step):
                    compare(top, names, own, unit, batch.slice(start, step))
            yield from top.batches(arrow)

        return corpus.mapInArrow(scan, schema)

    def emit(a: pa.Table, b: pa.Table) -> pa.Table:
        top = _TopK(k, keyed)
        if a.num_rows and b.num_rows:
            own = a.column("key").to_pylist() if keyed else None
            names, unit, step = a.column("query_id").to_pylist(), unit_rows(a.column("vector")), block_rows(b.num_rows)
            for start in range(0, len(names), step):
                part = slice(start, start + step)
                compare(top, names[part], own[part] if keyed else None, unit[part], b)
        return pa.Table.from_batches(top.batches(arrow), schema=arrow)

    return tile_join(queries, corpus, None, "query_id", "article_id", emit, schema, tile_rows)


def rank_top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query_id; the rank filter also runs before the shuffle."""
    order = [F.round("score", RANK_DIGITS).desc(), F.asc("article_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    article_id: str = "article_id",
    vector: str = "embedding",
    **sizes: int,
) -> DataFrame:
    """Exact k nearest articles of every query by cosine: query_id, article_id, score, rank."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    found = corpus.select(F.col(article_id).alias("article_id"), F.col(vector).alias("vector"))
    return rank_top(nearest(asked, found, k, **sizes), k)


def related_articles(vectors: DataFrame, articles: DataFrame, urls: Sequence[str], k: int = 5, **sizes: int) -> DataFrame:
    """The k articles most similar to every asked url, one per normalised url, never the asked one.

    ``vectors``: url, embedding; ``articles``: one row per url. The similarity replaces the
    stored score. Distinct urls are settled before the cut at k, so no over-fetch is needed.
    """
    keyed = vectors.select("url", F.col("embedding").alias("vector"), normalize_url("url").alias("key"))
    asked = keyed.where(F.col("url").isin(list(urls))).withColumnRenamed("url", "query_id")
    hits = nearest(asked, keyed.withColumnRenamed("url", "article_id"), k, **sizes)
    order = [F.round("score", RANK_DIGITS).desc(), F.asc("article_id")]
    top = rank_top(first_per_key(hits, ["query_id", "key"], order), k)
    hit = top.select(F.col("query_id").alias("asked_url"), F.col("article_id").alias("url"), "score", "rank")
    return hit.join(articles.drop("similarity_score"), "url").withColumnRenamed("score", "similarity_score")


def related_recent(
    vectors: DataFrame, ids: Sequence, k: int = 5, extra: int = 5, by_date: bool = True, **sizes: int
) -> DataFrame:
    """The k + extra nearest of every asked article, without itself; the k most recent of them.

    ``vectors``: article_id, embedding, publish_ts.
    """
    asked = vectors.where(F.col("article_id").isin(list(ids))).select(F.col("article_id").alias("query_id"), "embedding")
    near = knn_topk(asked, vectors, k + extra, **sizes).where("article_id <> query_id")
    dated = near.join(vectors.select("article_id", "publish_ts"), "article_id")
    order = [F.desc_nulls_last("publish_ts")] if by_date else []
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "rank"))
    return dated.withColumn("place", place).where(F.col("place") <= k)


def _pairs_above(threshold: float, a: pa.Table, b: pa.Table, diagonal: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs with a cosine above the threshold and different sources, and their scores, block by block.

    Products in single precision leave out what is below the threshold by more than their error; the cosines of the rest are of double precision.
    """
    one, two = unit_rows(a.column("vector")), unit_rows(b.column("vector"))
    src_a, src_b, step = _numpy(a.column("src")), _numpy(b.column("src")), block_rows(len(two))
    # Products of unit vectors differ by at most about half a unit of the last place for each factor, product and sum.
    least = threshold - (one.shape[1] + 8) * float(np.finfo(np.float32).eps)
    rough_one, rough_two = one.astype(np.float32), two.astype(np.float32).T
    for start in range(0, len(one), step):
        hit = rough_one[start : start + step] @ rough_two > np.float32(least)
        if diagonal:
            hit = np.triu(hit, start + 1)
        left, right = np.nonzero(hit)
        differ = src_a[left + start] != src_b[right]
        left, right = left[differ] + start, right[differ]
        scores = np.empty(len(left))
        for at in range(0, len(left), PAIR_ROWS):
            part = slice(at, at + PAIR_ROWS)
            scores[part] = np.einsum("ij,ij->i", one[left[part]], two[right[part]])
        above = scores > threshold
        yield left[above], right[above], scores[above]


def _no_pairs(a: pa.Table, b: pa.Table) -> pa.Table:
    none = (a if a.num_columns else b).slice(0, 0)
    return _pair_table(none, none, *(np.zeros(0, int),) * 2, np.zeros(0))


def _pair_table(a: pa.Table, b: pa.Table, left, right, scores) -> pa.Table:
    """The smaller id of a pair comes first."""
    ids = [_numpy(a.column("article_id"))[left], _numpy(b.column("article_id"))[right]]
    src = [_numpy(a.column("src"))[left], _numpy(b.column("src"))[right]]
    swap = ids[0] > ids[1]
    return pa.table(
        {
            "article_1": pa.array(np.where(swap, ids[1], ids[0])),
            "source_1": pa.array(np.where(swap, src[1], src[0]), pa.string()),
            "article_2": pa.array(np.where(swap, ids[0], ids[1])),
            "source_2": pa.array(np.where(swap, src[0], src[1]), pa.string()),
            "similarity": pa.array(scores, pa.float64()),
        }
    )


def _pair_schema(df: DataFrame) -> str:
    kind = df.schema["article_id"].dataType.simpleString()
    return f"article_1 {kind}, source_1 string, article_2 {kind}, source_2 string, similarity double"


def pairwise_similar(
    df: DataFrame, threshold: float = 0.7, category: str | None = None, vector: str = "embedding",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Exactly the pairs of articles of different sources with a cosine above the threshold.

    ``df``: article_id, src, the vector and, with a category to look in, categories.
    """
    if category is not None:
        df = df.where(F.array_contains("categories", category))
    lean = df.select("article_id", "src", F.col(vector).alias("vector")).where("vector IS NOT NULL")

    def emit(a: pa.Table, b: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        for found in _pairs_above(threshold, a, b, diagonal):
            yield _pair_table(a, b, *found)

    return block_self_join(lean, emit, _pair_schema(df), tile_rows)


def describe_pairs(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the titles of both articles and the categories of the first."""
    one = articles.select(F.col("article_id").alias("article_1"), F.col("title").alias("title_1"), "categories")
    two = articles.select(F.col("article_id").alias("article_2"), F.col("title").alias("title_2"))
    return pairs.join(one, "article_1").join(two, "article_2")


def _signed(df: DataFrame, bands: int, bits: int, vector: str, seed: int, tile_rows: int) -> tuple[DataFrame, int]:
    """The rows with a vector and their signature, stored, and the number of regions."""
    path = new_path(df.sparkSession, "lsh")
    df.where(F.col(vector).isNotNull()).withColumn("codes", band_signature(vector, bands, bits, seed)).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored, max(1, -(-stored.count() * bands // tile_rows))


def lsh_index(
    df: DataFrame, bands: int, bits: int, vector: str = "embedding", seed: int = 7, tile_rows: int = TILE_ROWS
) -> tuple[DataFrame, int]:
    """One row per article and band with its bucket, and the number of regions buckets are hashed into.

    Signatures are written to the shared folder once, one row per article, and expanded
    into bands when read, so the Python side does not run again for every use. The number
    of regions makes an average region about one tile.
    """
    stored, regions = _signed(df, bands, bits, vector, seed, tile_rows)
    return _in_bands(stored, regions), regions


def _in_bands(signed: DataFrame, regions: int) -> DataFrame:
    return signed.select("*", F.posexplode("codes").alias("band", "code")).withColumn("_r", _region(regions))


def _region(regions: int) -> Column:
    return F.pmod(F.xxhash64("band", "code"), F.lit(regions))


def pairwise_similar_lsh(
    df: DataFrame, threshold: float = 0.7, bands: int = 16, bits: int = 6, vector: str = "embedding",
    seed: int = 7, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Pairs like ``pairwise_similar`` that share a bucket in some band; each is checked exactly.

    Buckets are hashed into regions; a bucket that holds a large share of the articles
    makes its region large, which is then cut into more tiles. A pair found in several
    bands is sent on by the first of them only, so nothing has to be deduplicated.

    Few bits for many articles make crowded buckets: once the regions compare about as many pairs as there are, every
    row would travel once a band and tile to be compared with most others again and again. Then each pair of articles is compared once, and its signatures tell whether it shares a bucket.
    """
    lean = df.select("article_id", "src", F.col(vector).alias("vector"))
    signed, regions = _signed(lean, bands, bits, "vector", seed, tile_rows)
    # A code takes as few bytes as its bits need.
    small = next(kind for kind, most in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 64)) if bits <= most)
    signed = signed.withColumn("codes", F.col("codes").cast(f"array<{small}>"))
    entries = _in_bands(signed, regions).drop("code").withColumn("_entry", F.xxhash64("article_id", "band"))

    def codes(t: pa.Table) -> np.ndarray:
        return _numpy(t.column("codes").combine_chunks().flatten()).reshape(t.num_rows, -1)

    def meet(a: pa.Table, b: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        all_a, all_b = codes(a), codes(b)
        for left, right, scores in _pairs_above(threshold, a, b, diagonal):
            keep = (all_a[left] == all_b[right]).any(axis=1)
            yield _pair_table(a, b, left[keep], right[keep], scores[keep])

    def emit(a: pa.Table, b: pa.Table, diagonal: bool) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _no_pairs(a, b)
        all_a, all_b = codes(a), codes(b)
        in_a, in_b = _numpy(a.column("band")), _numpy(b.column("band"))
        kept = []
        for left, right, scores in _pairs_above(threshold, a, b, diagonal):
            there = in_a[left] == in_b[right]
            left, right, scores = left[there], right[there], scores[there]
            same = all_a[left] == all_b[right]
            keep = same.any(axis=1) & (in_a[left] == np.argmax(same, axis=1))
            kept.append(_pair_table(a, b, left[keep], right[keep], scores[keep]))
        return pa.concat_tables(kept)

    sizes = entries.groupBy("_r").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
    if (sizes.pairs or 0) >= CROWDED * ((sizes.n or 0) / bands) ** 2:
        return block_self_join(signed, meet, _pair_schema(df), tile_rows)
    return tile_self_join(entries, "_r", "_entry", emit, _pair_schema(df), tile_rows)


def knn_lsh(
    queries: DataFrame, corpus: DataFrame, k: int, bands: int = 16, bits: int = 6, probes: int = 2, seed: int = 7,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Approximate k nearest articles: those sharing a probed bucket, ranked by the exact cosine.

    ``queries``: query_id, embedding; ``corpus``: article_id, embedding. Every query also
    probes the buckets across its ``probes`` least certain hyperplanes per band.
    """
    lean = corpus.select("article_id", F.col("embedding").alias("vector"))
    index, regions = lsh_index(lean, bands, bits, "vector", seed, tile_rows)
    stored = index.drop("codes").withColumn("_entry", F.xxhash64("article_id", "band"))
    near = F.posexplode(probe_signatures("vector", bands, bits, probes, seed)).alias("band", "near")
    asked = (
        queries.select("query_id", F.col("embedding").alias("vector"))
        .where("vector IS NOT NULL")
        .select("query_id", "vector", near)
        .select("query_id", "vector", "band", F.explode("near").alias("code"))
        .withColumns({"_r": _region(regions), "_ask": F.xxhash64("query_id", "band", "code")})
    )
    schema, arrow = _top_schema(queries, corpus, False)

    def emit(a: pa.Table, b: pa.Table) -> pa.Table:
        top = _TopK(k, True)
        if a.num_rows and b.num_rows:
            ids, bucket_b = _numpy(b.column("article_id")), _numpy(b.column("band")) * (1 << bits) + _numpy(b.column("code"))
            bucket_a = _numpy(a.column("band")) * (1 << bits) + _numpy(a.column("code"))
            names, one, two = a.column("query_id").to_pylist(), unit_rows(a.column("vector")), unit_rows(b.column("vector"))
            step = block_rows(len(two))
            for start in range(0, len(one), step):
                part = slice(start, start + step)
                for name, bucket, row in zip(names[part], bucket_a[part], one[part] @ two.T):
                    at = np.flatnonzero(bucket_b == bucket)
                    if len(at):
                        top.add(name, row[at], ids[at], ids[at])
        top.keyed = False
        return pa.Table.from_batches(top.batches(arrow), schema=arrow)

    found = tile_join(asked, stored, "_r", "_ask", "_entry", emit, schema, tile_rows)
    best = found.groupBy("query_id", "article_id").agg(F.max("score").alias("score"))
    return rank_top(best, k)
