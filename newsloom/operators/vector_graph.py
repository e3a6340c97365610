"""A stored vector index: navigable small-world graphs, one for each shard, as Parquet rows.

Articles are dealt to shards by a hash of their url. A shard has at most about SHARD_ROWS articles
and is a folder of its own: a row for each article with its vector, its level and its neighbours on
each level (numbers of rows in the shard). A query batch is searched in every shard by a beam that
follows the graph, all queries in step; the shards' best are merged. An upsert or a deletion reads
and replaces the shards of its urls only.

Levels thin out by a factor of M, drawn from the url, so a rebuilt shard is the same one. On each
level the EF_BUILD nearest rows of a row are its candidates, of which M (2 * M on the lowest
level) become neighbours: those nearer to the row than to a neighbour chosen before, then the nearest of the
rest. Links run both ways.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.vectors import unit_rows
from newsloom.operators.tables import first_per_key
from newsloom.operators.vectors import bounded_vectors, rank_top
from newsloom.session import new_path
from newsloom.sources.sinks import delete_path

M, EF_BUILD, EF_SEARCH = 32, 300, 200
SHARD_ROWS = 8192
#: Queries of a block that go through a shard in step, rows a query expands at once, and rows linked at a time.
QUERY_BLOCK, EXPAND, BUILD_BLOCK = 256, 4, 128

ROW = "shard int, node int, size int, article_id long, url string, publish_date long, embedding array<float>, level int, neighbours array<array<int>>"
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("node", pa.int32()), ("size", pa.int32()), ("article_id", pa.int64()), ("url", pa.string()), ("publish_date", pa.int64()),
        ("embedding", pa.list_(pa.float32())), ("level", pa.int32()), ("neighbours", pa.list_(pa.list_(pa.int32()))),
    ]
)


def _chosen(vectors: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) the neighbours, as a mask: diverse ones first, then the nearest."""
    n, k = near.shape
    theirs = vectors[near]
    between = theirs @ theirs.transpose(0, 2, 1)
    there = near >= 0
    kept = np.zeros((n, k), bool)
    for c in range(k):
        closer = np.where(kept, between[:, c, :], -2.0).max(axis=1)
        kept[:, c] = there[:, c] & (score[:, c] > closer) & (kept.sum(axis=1) < most)
    spare = there & ~kept
    room = most - kept.sum(axis=1)
    return kept | (spare & (np.cumsum(spare, axis=1) <= room[:, None]))


class Graph:
    """The graph of one shard: unit vectors, levels, and for each level an array of neighbours (-1 where there is none)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.levels, self.links = vectors.astype(np.float32), levels, links

    @classmethod
    def built(cls, vectors: np.ndarray, levels: np.ndarray, m: int, ef: int) -> Graph:
        """A graph over all rows at once."""
        graph = cls(vectors, levels, [])
        for level in range(int(levels.max(initial=0)) + 1):
            graph.links.append(np.full((len(vectors), 2 * m if level == 0 else m), -1, np.int32))
            graph._link(level, np.flatnonzero(levels >= level), np.flatnonzero(levels >= level), ef)
        return graph

    def _link(self, level: int, rows: np.ndarray, among: np.ndarray, ef: int) -> None:
        """Give the rows neighbours among others on a level, and those the link back."""
        table = self.links[level]
        # Copies of one vector: a row is linked with the next two of them only, else they would be each other's only neighbours.
        _, kind, sizes = np.unique(self.vectors[among], axis=0, return_inverse=True, return_counts=True)
        turn = np.argsort(kind, kind="stable")
        number = np.empty(len(among), np.int64)
        number[turn] = np.arange(len(among)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        mine = np.searchsorted(among, rows)
        for at in range(0, len(rows), BUILD_BLOCK):
            some, place = rows[at : at + BUILD_BLOCK], mine[at : at + BUILD_BLOCK]
            score = self.vectors[some] @ self.vectors[among].T
            score[some[:, None] == among[None, :]] = -3.0
            if sizes.max() > 4:
                ahead = (number[None, :] - number[place][:, None]) % sizes[kind][None, :]
                score[(kind[place][:, None] == kind[None, :]) & (ahead > 2)] = -3.0
            k = min(ef, len(among))
            near = np.argpartition(-score, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
            score = np.take_along_axis(score, near, 1)
            near = np.where(score > -3.0, among[near], -1)
            self._put(table, some, near, score)
        source, target = np.repeat(rows, table.shape[1]), table[rows].ravel()
        source, target = source[target >= 0], target[target >= 0]
        back = ~(table[target] == source[:, None]).any(axis=1)
        owners = np.unique(target[back])
        theirs = table[owners]
        self._settle(table, np.concatenate([target[back], np.repeat(owners, table.shape[1])[theirs.ravel() >= 0]]), np.concatenate([source[back], theirs[theirs >= 0]]), ef)

    def _put(self, table: np.ndarray, rows: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        """Store the neighbours of the rows, chosen of candidates that stand nearest first."""
        keep = _chosen(self.vectors, near, score, table.shape[1])
        order = np.argsort(~keep, axis=1, kind="stable")[:, : table.shape[1]]
        table[rows] = -1
        table[rows[:, None], np.arange(order.shape[1])] = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(near, order, 1), -1)

    def _settle(self, table: np.ndarray, owner: np.ndarray, near: np.ndarray, ef: int) -> None:
        """Choose the neighbours of each owner anew, of the ef nearest of its candidates (pairs of owner and candidate)."""
        score = np.einsum("rd,rd->r", self.vectors[owner], self.vectors[near])
        turn = np.lexsort((near, -score, owner))
        owner, near, score = owner[turn], near[turn], score[turn]
        owners, start, counts = np.unique(owner, return_index=True, return_counts=True)
        place = np.arange(len(owner)) - np.repeat(start, counts)
        for at in range(0, len(owners), BUILD_BLOCK):
            rows = owners[at : at + BUILD_BLOCK]
            lo, hi = start[at], start[at] + counts[at : at + BUILD_BLOCK].sum()
            here = np.arange(lo, hi)[place[lo:hi] < ef]
            width = min(ef, int(counts[at : at + BUILD_BLOCK].max()))
            grid, grades = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), -3.0, np.float32)
            which = np.searchsorted(rows, owner[here])
            grid[which, place[here]], grades[which, place[here]] = near[here], score[here]
            self._put(table, rows, grid, grades)

    def without(self, gone: np.ndarray) -> Graph:
        """The graph without some rows (a mask); a row that loses a neighbour may take over that one's neighbours."""
        number = np.where(gone, -1, np.cumsum(~gone) - 1)
        links = []
        for table in self.links:
            table = table.copy()
            lost = np.where(table >= 0, gone[table], False)
            rows = np.flatnonzero(lost.any(axis=1) & ~gone)
            owner, place = np.nonzero(lost[rows])
            inherited = table[table[rows[owner], place]]
            owner = np.concatenate([np.repeat(rows, table.shape[1]), np.repeat(rows[owner], table.shape[1])])
            near = np.concatenate([table[rows].ravel(), inherited.ravel()])
            good = (near >= 0) & (near != owner)
            good[good] = ~gone[near[good]]
            both = np.unique(owner[good] << 32 | near[good].astype(np.int64))
            table[rows] = -1
            self._settle(table, both >> 32, both & 0xFFFFFFFF, EF_BUILD)
            kept = table[~gone]
            links.append(np.where(kept >= 0, number[kept], -1).astype(np.int32))
        return Graph(self.vectors[~gone], self.levels[~gone], links)

    def extended(self, vectors: np.ndarray, levels: np.ndarray, m: int, ef: int) -> Graph:
        """The graph with more rows, which come last."""
        old, more = len(self.vectors), len(vectors)
        graph = Graph(np.concatenate([self.vectors.reshape(old, -1) if old else vectors[:0], vectors]), np.concatenate([self.levels, levels]), [])
        for level in range(int(graph.levels.max(initial=0)) + 1):
            width = 2 * m if level == 0 else m
            before = self.links[level] if level < len(self.links) else np.full((old, width), -1, np.int32)
            graph.links.append(np.concatenate([before, np.full((more, width), -1, np.int32)]))
            fresh = old + np.flatnonzero(levels >= level)
            if len(fresh):
                graph._link(level, fresh, np.flatnonzero(graph.levels >= level), ef)
        return graph

    def _beam(self, queries: np.ndarray, beam: np.ndarray, table: np.ndarray, ef: int) -> np.ndarray:
        """The ef best rows found from the rows of ``beam``, for all queries in step: (queries, ef), best first, -1 for none."""
        n, q = len(self.vectors), np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), n + 1), bool)  # the last column takes the missing ones
        seen[q, beam] = True
        score = np.where(beam >= 0, np.einsum("qd,qbd->qb", queries, self.vectors[beam]), -3.0)
        expanded = beam < 0
        while not expanded.all():
            turn = np.argsort(np.where(expanded, 4.0, -score), axis=1, kind="stable")[:, :EXPAND]
            ready = ~np.take_along_axis(expanded, turn, 1)
            row = np.where(ready, np.take_along_axis(beam, turn, 1), -1)
            np.put_along_axis(expanded, turn, True, 1)
            near = np.where(row[:, :, None] >= 0, table[row], -1).reshape(len(queries), -1)
            near = np.where(seen[q, near], -1, near)
            # A row that several expanded ones name counts once.
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[q, near] = True
            seen[:, n] = True
            fresh = np.where(near >= 0, np.einsum("qd,qbd->qb", queries, self.vectors[near]), -3.0)
            beam, score = np.concatenate([beam, near], axis=1), np.concatenate([score, fresh], axis=1)
            expanded = np.concatenate([expanded, near < 0], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :ef]
            beam, score, expanded = (np.take_along_axis(x, best, 1) for x in (beam, score, expanded))
        return beam

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Rows of the k nearest, best first; -1 for none."""
        queries = queries.astype(np.float32)
        top = int(self.levels.max())
        entry = np.flatnonzero(self.levels == top)
        beam = np.full((len(queries), max(1, min(8, len(entry)))), -1)
        score = queries @ self.vectors[entry].T
        beam[:] = entry[np.argsort(-score, axis=1, kind="stable")[:, : beam.shape[1]]]
        for level in range(top, -1, -1):
            beam = self._beam(queries, beam, self.links[level], max(ef, k) if level == 0 else 8)
        return beam[:, :k]


def _levels(urls: list[str], m: int) -> np.ndarray:
    """The level of each url: above 0 for one in m, above 1 for one in m squared, and so on."""
    import xxhash

    draw = (np.array([xxhash.xxh64_intdigest(u, 5) for u in urls], np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.minimum(np.floor(-np.log(np.maximum(draw, 1e-15)) / np.log(m)), 8).astype(np.int32)


def _rows(shard: int, table: pa.Table, graph: Graph) -> pa.Table:
    n = table.num_rows
    neighbours = [[[x for x in links[i].tolist() if x >= 0] for links in graph.links[: graph.levels[i] + 1]] for i in range(n)]
    fixed = [np.full(n, shard, np.int32), np.arange(n, dtype=np.int32), np.full(n, n, np.int32)]
    columns = [*fixed, *[table.column(c) for c in ("article_id", "url", "publish_date", "embedding")], graph.levels, neighbours]
    return pa.Table.from_arrays([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _graph(rows: pa.Table, m: int) -> tuple[pa.Table, Graph]:
    """The stored rows of one shard, in order, and their graph."""
    rows = rows.sort_by("node")
    if rows.num_rows and rows.num_rows != rows.column("size")[0].as_py():
        raise ValueError("a shard of the vector graph has to be read by one task; set spark.sql.files.maxPartitionBytes above the size of a shard")
    levels = rows.column("level").to_numpy()
    links = [np.full((rows.num_rows, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
    for i, by_level in enumerate(rows.column("neighbours").to_pylist()):
        for level, near in enumerate(by_level):
            links[level][i, : len(near)] = near
    vectors = unit_rows(rows.column("embedding")) if rows.num_rows else np.zeros((0, 0))
    return rows, Graph(vectors, levels, links)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("url", F.lit("shard")), F.lit(shards)).cast("int")


def _settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/settings").first()[0])


def _newest(vectors: DataFrame) -> DataFrame:
    """Rows with a url and a vector, one for each url: the latest, then the largest id."""
    rows = vectors.where("url IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select(F.col("article_id").cast("long"), "url", F.col("publish_date").cast("long"), F.col("embedding").cast("array<float>"))
    return first_per_key(rows, ["url"], [F.col("publish_date").desc_nulls_last(), F.col("article_id").desc_nulls_last()])


def write_graph(vectors: DataFrame, path: str, m: int = M, ef: int = EF_BUILD, shard_rows: int = SHARD_ROWS) -> None:
    """Build and store the index of ``vectors(article_id, url, publish_date, embedding)`` under a new path.

    Rows without url or vector are left out; of several rows of a url the latest counts. All vectors
    have one length.
    """
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard_rows))
    rows = _newest(vectors).withColumn("shard", _shard(shards))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("url")
        graph = Graph.built(unit_rows(table.column("embedding")), _levels(table.column("url").to_pylist(), m), m, ef)
        return _rows(key[0].as_py(), table, graph)

    spark.createDataFrame([(json.dumps({"shards": shards, "m": m, "ef": ef}),)], "value string").coalesce(1).write.text(f"{path}/settings")
    rows.groupBy("shard").applyInArrow(build, ROW).write.partitionBy("shard").parquet(f"{path}/rows")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(f"{path}/rows")


def upsert_graph(vectors: DataFrame, path: str, gone: DataFrame | None = None) -> int:
    """Replace the vectors of urls that are stored, add new ones, and remove those of ``gone(url)``; the number of shards rewritten.

    Only the shards of these urls are read and written. The new content is written aside first.
    """
    spark = vectors.sparkSession
    known = _settings(spark, path)
    m, ef = known["m"], known["ef"]
    batch = _newest(vectors).withColumn("gone", F.lit(False))
    if gone is not None:
        left = gone.where("url IS NOT NULL").select("url").distinct().join(batch.select("url"), "url", "left_anti")
        none = {"article_id": "long", "publish_date": "long", "embedding": "array<float>"}
        left = left.select(F.lit(None).cast("long").alias("article_id"), "url", *[F.lit(None).cast(none[c]).alias(c) for c in ("publish_date", "embedding")], F.lit(True).alias("gone"))
        batch = batch.unionByName(left)
    batch = batch.withColumn("shard", _shard(known["shards"]))
    touched = sorted(r.shard for r in batch.select("shard").distinct().collect())  # at most one small number a shard
    if not touched:
        return 0
    stored = read_graph(spark, path).where(F.col("shard").isin(touched))

    def merge(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        urls = set(new.column("url").to_pylist())
        old, graph = _graph(old, m) if old.num_rows else (_ARROW.empty_table(), Graph(np.zeros((0, 0)), np.zeros(0, np.int32), []))
        away = np.array([u in urls for u in old.column("url").to_pylist()], bool)
        if away.any():
            old, graph = old.filter(pa.array(~away)), graph.without(away)
        new = new.filter(pc.invert(new.column("gone"))).sort_by("url")
        if new.num_rows:
            graph = graph.extended(unit_rows(new.column("embedding")).astype(np.float32), _levels(new.column("url").to_pylist(), m), m, ef)
        columns = ["article_id", "url", "publish_date", "embedding"]
        whole = pa.concat_tables([old.select(columns), new.select(columns).cast(old.select(columns).schema)])
        return _rows(key[0].as_py(), whole, graph)

    fresh = stored.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(merge, ROW)
    aside = new_path(spark, "graph-aside")
    fresh.write.parquet(aside)
    done = spark.read.schema(ROW).parquet(aside)
    done.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/rows")
    kept = {r.shard for r in done.select("shard").distinct().collect()}
    for empty in set(touched) - kept:
        delete_path(spark, f"{path}/rows/shard={empty}")
    delete_path(spark, aside)
    return len(touched)


def query_graph(spark: SparkSession, path: str, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, article_id, url, rank, score``: about the k nearest articles of each query of ``queries(query_id, embedding)``.

    Scores are true cosines. Queries without vector are left out. Up to 4096 queries go to every task
    that reads a shard, and no shard is shuffled; more of them meet the shards in a co-group.
    """
    m, shards = (_settings(spark, path)[x] for x in ("m", "shards"))
    asked = queries.where("query_id IS NOT NULL AND embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    kind = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, article_id long, url string, score double"

    def look(rows: pa.Table, named: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, graph = _graph(rows, m)
        ids, urls, exact = rows.column("article_id").to_numpy(), np.array(rows.column("url").to_pylist(), object), unit_rows(rows.column("embedding"))
        vectors = unit_rows(named.column("embedding"))
        for at in range(0, named.num_rows, QUERY_BLOCK):
            some = vectors[at : at + QUERY_BLOCK]
            found = graph.search(some, k, ef)
            who, place = np.nonzero(found >= 0)
            row = found[who, place]
            score = np.einsum("rd,rd->r", some[who], exact[row])
            yield pa.RecordBatch.from_arrays(
                [named.column("query_id").combine_chunks().take(pa.array(who + at)), pa.array(ids[row], pa.int64()), pa.array(urls[row], pa.string()), pa.array(score)],
                ["query_id", "article_id", "url", "score"],
            )

    few = bounded_vectors(asked, ["query_id", "embedding"])
    if few is not None:

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                start = 0
                while start < batch.num_rows:
                    shard = batch.column("shard")[start].as_py()
                    stop = start + int(np.argmin(np.append(batch.column("shard").to_numpy()[start:] == shard, False)))
                    if held and held[0].column("shard")[0].as_py() != shard:
                        yield from look(pa.Table.from_batches(held), few)
                        held = []
                    held.append(batch.slice(start, stop - start))
                    start = stop
            if held:
                yield from look(pa.Table.from_batches(held), few)

        found = read_graph(spark, path).mapInArrow(scan, schema) if few.num_rows else spark.createDataFrame([], schema)
    else:
        each = asked.withColumn("home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

        def both(rows: pa.Table, named: pa.Table) -> pa.Table:
            names = pa.schema([("query_id", named.column("query_id").type), ("article_id", pa.int64()), ("url", pa.string()), ("score", pa.float64())])
            return pa.Table.from_batches([b.cast(names) for b in look(rows, named)] if rows.num_rows and named.num_rows else [], names)

        found = read_graph(spark, path).groupBy("shard").cogroup(each.groupBy("home")).applyInArrow(both, schema)
    return rank_top(found, k)


def graph_rows(spark: SparkSession, path: str) -> DataFrame:
    """``article_id, url, publish_date, embedding`` of all stored articles."""
    return read_graph(spark, path).select("article_id", "url", "publish_date", "embedding")
