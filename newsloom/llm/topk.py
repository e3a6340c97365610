"""Exact top-k search by inner product with ball trees.

The vectors are dealt into shards by a hash of their id. A task builds a ball tree over one shard
(numpy, nodes hold centre and radius) and searches it for a block of queries, branch and bound:
nodes are visited in the order of their largest upper bound ``<q, centre> + |q| * radius``, and a
query goes into a node only if its bound reaches the query's current k-th score. That score is
shared: each query is first searched in one shard, its home, and starts every other shard with the
k-th score found there. A bound equal to the k-th score is still visited, because ties go to the
smaller id.

Scores are whole numbers: components are ``floor(scale * x)``, products are summed in doubles where those are
exact (sums below 2**53), else in 64-bit integers, and the bounds get a relative margin of 1e-9.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import flat, written

LEAF, SHARD_ROWS, BLOCK_ROWS = 256, 16_384, 1_024
#: Less than any score.
NONE = -(2**63 - 1)
HITS = T.StructType().add("query_id", "long").add("vec_id", "long").add("score", "long")


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, vector`` with whole-number components; vectors that are NULL or hold a NULL or non-finite number are left out."""
    x = F.col("vector")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(x.isNotNull() & ~odd).select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vector"))


class BallTree:
    """Nodes over rows of a matrix; the rows are reordered so that a node is a range."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        self.centres, self.radii = [], []
        self._grow(points, 0, len(points), leaf)
        self.points, self.width, self.largest = points[self.order], points.shape[1], float(np.abs(points).max(initial=1.0))
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _grow(self, points: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        rows = points[self.order[lo:hi]]
        centre = rows.mean(axis=0)
        away = np.linalg.norm(rows - centre, axis=1)
        here = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.centres.append(centre)
        self.radii.append(away.max())
        if hi - lo > leaf and away.max() > 0:
            # Split half and half along the line between two far points.
            a = rows[away.argmax()]
            b = rows[np.linalg.norm(rows - a, axis=1).argmax()]
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows @ (b - a), mid)]
            left = self._grow(points, lo, lo + mid, leaf)
            right = self._grow(points, lo + mid, hi, leaf)
            self.nodes[here] = (lo, hi, left, right)
        return here


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries x k) of the best rows of a tree, unfilled places have score NONE; ``floor`` is the shared k-th score.

    Products are summed in doubles if those are exact for the largest components, else in integers.
    """
    names = ids[tree.order]
    largest = tree.largest * np.abs(queries).max(initial=1.0) * max(1, tree.width)
    if largest >= 2**63:
        raise ValueError("a score would not fit into 64 bits")
    kind = np.float64 if largest < 2**53 else np.int64
    whole = queries.astype(kind, copy=False)
    best = np.full((len(queries), k), NONE, np.int64)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    length = np.linalg.norm(queries, axis=1)
    bounds = queries @ tree.centres.T + length[:, None] * tree.radii
    bounds += 1e-9 * (np.abs(bounds) + length[:, None] * (np.linalg.norm(tree.centres, axis=1) + tree.radii)) + 1e-6
    heap = [(-bounds[:, 0].max(), 0, np.arange(len(queries)))]
    while heap:
        _, node, active = heapq.heappop(heap)
        lo, hi, left, right = tree.nodes[node]
        limit = np.maximum(best[active, k - 1].astype(float), floor[active])
        active = active[bounds[active, node] >= limit]
        if not len(active):
            continue
        if left < 0:
            score = (whole[active] @ tree.points[lo:hi].astype(kind, copy=False).T).astype(np.int64)
            score[query_ids[active][:, None] == names[lo:hi]] = NONE
            score = np.concatenate([best[active], score], axis=1)
            label = np.concatenate([found[active], np.broadcast_to(names[lo:hi], (len(active), hi - lo))], axis=1)
            # The k best with ties to the smaller id: narrow down by score, then order what is left.
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            for row, q in enumerate(active):
                near = np.flatnonzero(score[row] >= least[row])
                top = near[np.lexsort((label[row, near], -score[row, near]))[:k]]
                best[q], found[q] = score[row, top], label[row, top]
            continue
        for child in (left, right):
            heapq.heappush(heap, (-bounds[active, child].max(), child, active))
    return best, found


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    array = flat(column, pa.large_list(pa.float64()))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _search_tables(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not points.num_rows or not queries.num_rows:
            return none
        matrix, wanted = _matrix(points.column("vector"), points.num_rows), _matrix(queries.column("vector"), queries.num_rows)
        if matrix.shape[1] != wanted.shape[1]:
            raise ValueError("vectors of different lengths")
        ids, query_ids = points.column("vec_id").to_numpy(zero_copy_only=False), queries.column("query_id").to_numpy(zero_copy_only=False)
        best, found = search(BallTree(matrix), ids, wanted, query_ids, queries.column("floor").to_numpy(zero_copy_only=False), k)
        row, place = np.nonzero(best > NONE)
        return pa.table({"query_id": query_ids[row], "vec_id": found[row, place], "score": best[row, place]})

    return run


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the k best other rows.

    The score is the inner product of ``floor(scale * x)``; ties go to the smaller id, ranks run
    from 1, with fewer than k others all are returned. Rows whose vector is NULL or holds a NULL or
    non-finite number take no part, nor do rows without id. An id that comes twice is one query and
    one candidate for each of its different vectors; a query is never its own candidate. Vectors
    of different lengths are an error, and so are components whose scores might not fit into 64 bits.
    """
    rows = whole_vectors(table, id_col, vector_col, scale).where("vec_id IS NOT NULL").distinct()
    rows = written(rows.select("*", F.xxhash64("vec_id").alias("code")), "vectors")
    n = rows.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-(n // every + 1) // BLOCK_ROWS))
    shard = F.pmod("code", F.lit(shards)).cast("int")
    points = rows.select("vec_id", "vector", shard.alias("shard"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    block = F.pmod(F.xxhash64("code", F.lit("block")), F.lit(blocks)).cast("int")
    asked = asked.select(F.col("vec_id").alias("query_id"), "vector", shard.alias("home"), block.alias("block"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    dealt = points.select("*", every_block)

    def hits(queries: DataFrame) -> DataFrame:
        # Fresh column identities, since both sides stem from one table.
        own, other = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (dealt, queries))
        pairs = own.groupBy("shard", "block").cogroup(other.groupBy("shard", "block"))
        return pairs.applyInArrow(_search_tables(k), HITS)

    start = asked.select("query_id", "vector", "block", F.col("home").alias("shard"), F.lit(float("-inf")).alias("floor"))
    if shards == 1:
        return _ranked(hits(start), k)
    first = written(hits(start), "topk-home")
    full = F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf")))
    floors = first.groupBy("query_id").agg(full.alias("floor"))
    known = asked.join(floors, "query_id", "left").select("query_id", "vector", "block", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    others = known.select("*", every_shard).where("shard <> home").drop("home")
    return _ranked(first.unionByName(hits(others)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows of each query and shard come in, so a query's rows are few."""
    best = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
