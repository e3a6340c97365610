"""A stored search index in segments: a batch of documents costs what the batch is, not what the index is.

A batch becomes a segment: postings, lengths, and deletion keys of its own. Documents that it
replaces or removes are not looked for in older segments; their ids are written down as *dead* from this
segment backwards, and reading leaves out postings of dead documents. ``compact`` merges segments of
about one size once there are FANOUT of them, so there are never many, and each posting is
rewritten about once for each size.

Totals by field are kept as differences: a batch adds its documents and takes away what its ids had
before, looked up by id in the lengths (sorted by id). How many documents hold a term is counted from the living
postings of the query's terms, which are read anyway. The log says which segments live, in
order; it is written last, so a batch that fails half-way does not count.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.search import BOUND_DOCS, FILE_ROWS, MAX_PUSHED, SearchIndex, _variants, head, head_keys, range_bounds, range_count, range_of, sorted_terms
from newsloom.schema import FIELD_BOOSTS
from newsloom.sources.sinks import delete_path, remove_aside, table_exists, write_aside

#: Segments of about one size before they are merged; sizes differ by the same factor.
FANOUT = 4
#: Ids of a batch that go into the scan of the lengths at most; more of them are joined.
MOST_IDS = 1000
#: Bits for each dead document of a filter that goes to every task, places looked at, and bytes of a filter at most.
MARK_BITS, MARK_PLACES, MOST_MARKS = 32, 4, 64 << 20
TABLES = ("postings", "lengths", "terms", "keys", "dead", "stats")


@dataclass(frozen=True)
class Log:
    """The living segments, oldest first: (number, postings); the number of the next one; the analyzers."""

    live: tuple[tuple[int, int], ...]
    following: int
    analyzers: tuple[tuple[str, str], ...] = ()

    def order(self) -> dict[int, int]:
        return {number: place for place, (number, _) in enumerate(self.live)}


def read_log(spark: SparkSession, path: str) -> Log:
    if not table_exists(spark, f"{path}/log"):
        return Log((), 0)
    entries = [(json.loads(r.value), r.entry) for r in spark.read.text(f"{path}/log").select("value", "entry").collect()]  # one line a batch since the last compaction
    found = max(entries, key=lambda e: e[1])[0]
    return Log(tuple(map(tuple, found["live"])), found["following"], tuple(map(tuple, found["analyzers"])))


def _write_log(spark: SparkSession, path: str, log: Log, entry: int) -> None:
    text = json.dumps({"live": log.live, "following": log.following, "analyzers": log.analyzers})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/log/entry={entry}")


def _table(spark: SparkSession, path: str, name: str, segments: Sequence[int]) -> DataFrame:
    """A table of some segments, with its segment's number as ``seg``."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/seg={n}" for n in segments])


def _place(log: Log) -> Column:
    """The place of a segment in the order of age."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in log.order().items() for x in pair]), F.col("seg"))


def _living(spark: SparkSession, path: str, log: Log, table: str, segments: Sequence[int] | None = None) -> DataFrame:
    """Rows of a table (with doc_id) that no later segment declares dead; ``seg`` is left out."""
    segments = [n for n, _ in log.live] if segments is None else list(segments)
    rows = _table(spark, path, table, segments).withColumn("_place", _place(log))
    dead = _table(spark, path, "dead", [n for n, _ in log.live]).withColumn("_until", _place(log))
    dead = dead.groupBy("doc_id").agg(F.max("_until").alias("_until"))
    kept = rows.join(dead.withColumnRenamed("doc_id", "_dead"), (F.col("doc_id") == F.col("_dead")) & (F.col("_place") < F.col("_until")), "left_anti")
    return kept.drop("_place", "seg")


def _marked(bits: Column, size: int) -> Column:
    """Whether a filter of so many bits (a power of two) has the segment and document of a row."""
    h = F.xxhash64("seg", "doc_id")
    one, two = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    found = F.lit(True)
    for i in range(MARK_PLACES):
        place = (one + two * i).bitwiseAND(F.lit(size - 1))
        found &= F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found


def _filter_bits(hashes: np.ndarray) -> np.ndarray:
    """The words of the filter that ``_marked`` asks."""
    size = 64
    while size < MARK_BITS * len(hashes):
        size *= 2
    words, h = np.zeros(size // 64, np.uint64), hashes.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(MARK_PLACES):
        place = (one + two * np.uint64(i)) & np.uint64(size - 1)
        np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return words


def _living_postings(spark: SparkSession, path: str, log: Log, merged: Sequence[int]) -> tuple[DataFrame, int, DataFrame]:
    """The postings of some segments that no later segment declares dead, about how many they are, and the living ``seg, doc_id``, stored.

    Which documents are dead is found among the lengths, a few rows a document. A Bloom filter of them goes to every task that
    reads postings, with the living documents it takes for dead, which are listed; so it decides exactly and no posting is
    shuffled or joined for it. Only more dead documents than such a filter holds, or too many mistakes, lead to a join.
    """
    sizes = dict(log.live)
    held = _table(spark, path, "lengths", merged).select("seg", "doc_id").distinct()
    dead = _table(spark, path, "dead", [n for n, _ in log.live]).withColumn("_until", _place(log))
    dead = dead.groupBy("doc_id").agg(F.max("_until").alias("_until"))
    gone = F.coalesce(_place(log) < F.col("_until"), F.lit(False))
    documents = write_aside(held.join(dead, "doc_id", "left").select("seg", "doc_id", gone.alias("gone")), "segment-documents")
    counts = documents.groupBy("seg").agg(F.count("*").alias("n"), F.count_if("gone").alias("gone")).collect()
    rows = sum(sizes[r.seg] * (r.n - r.gone) // r.n for r in counts)
    # A segment without a living document is not read.
    full = sorted(r.seg for r in counts if r.gone < r.n) or merged
    postings = _table(spark, path, "postings", full)
    documents_in = documents.where(F.col("seg").isin(full))
    most = sum(r.gone for r in counts if r.seg in full)
    if most and 8 * MOST_MARKS < MARK_BITS * most:
        postings = _living(spark, path, log, "postings", full)
    elif most:
        hashes = documents_in.where("gone").select(F.xxhash64("seg", "doc_id").alias("h")).toArrow().column("h").combine_chunks().to_numpy()
        words = _filter_bits(hashes)
        one = pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words.view(np.int64)))})
        bits = F.broadcast(spark.createDataFrame(one))
        marked = _marked(F.col("_bits"), 64 * len(words))
        wrong = documents_in.where("NOT gone").crossJoin(bits).where(marked).select("seg", "doc_id").limit(MAX_PUSHED + 1).collect()
        if len(wrong) > MAX_PUSHED:
            postings = _living(spark, path, log, "postings", full)
        else:
            alive = ~marked
            for n in sorted({r.seg for r in wrong}):
                alive |= (F.col("seg") == n) & F.col("doc_id").isin([r.doc_id for r in wrong if r.seg == n])
            postings = postings.crossJoin(bits).where(alive).drop("_bits")
    return postings.drop("seg"), rows, documents.where("NOT gone").drop("gone")


def _write_segment(
    spark: SparkSession, path: str, number: int, postings: DataFrame, dead: DataFrame, large: bool, lengths: DataFrame | None = None
) -> tuple[int, DataFrame]:
    """Store the tables of a segment but its totals; the number of its postings, and its lengths. ``postings`` come sorted by ranges.

    The other tables are taken from the stored postings, where a term's rows lie together. ``dead`` is a stored table. What is large is range-sorted, what is small is one file.
    """
    at = lambda name: f"{path}/{name}/seg={number}"
    postings.write.mode("overwrite").parquet(at("postings"))
    postings = spark.read.schema(postings.schema).parquet(at("postings"))
    size = postings.count()

    def store(df: DataFrame, name: str, *by: str, rows: int = size) -> None:
        ranged = large or rows > FILE_ROWS
        (df.repartitionByRange(*by) if ranged else df.coalesce(1)).sortWithinPartitions(*by).write.mode("overwrite").parquet(at(name))

    lengths = postings.where("first") if lengths is None else lengths
    store(lengths.select("doc_id", "field", "len"), "lengths", "doc_id", "field")
    store(postings.select("term").distinct().withColumn("head", head("term")), "terms", "term")
    store(head_keys(spark.read.schema("term string, head string").parquet(at("terms"))), "keys", "key", "head")
    store(dead.select("doc_id").distinct(), "dead", "doc_id", rows=dead.count())
    return size, spark.read.schema(lengths.select("doc_id", "field", "len").schema).parquet(at("lengths"))


def add_segment(
    path: str, docs: DataFrame, doc_id: str = "doc_id", fields: Sequence[str] = tuple(FIELD_BOOSTS), analyzers: Mapping[str, str] | None = None,
    removed: DataFrame | None = None, large: bool = False,
) -> int:
    """Add the documents of ``docs`` to the index at ``path``, those of the same id replaced, and take out those of ``removed(doc_id)``.

    The number of the new segment. A missing index begins with this batch (and its analyzers). A batch of more than
    ``FILE_ROWS`` postings is sorted by ranges in many tasks; ``large`` does so with any. ``doc_id`` is unique in ``docs`` and not NULL.
    Nothing of older segments is read but the lengths of the batch's ids.
    """
    spark = docs.sparkSession
    log = read_log(spark, path)
    if not log.live:
        log = Log((), log.following, tuple(sorted((analyzers or {}).items())))
    known = dict(log.analyzers)
    docs = docs.where(F.col(doc_id).isNotNull())
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    some = ids if removed is None else ids.unionByName(removed.select(F.col("doc_id").cast(ids.schema["doc_id"].dataType)))
    ids = write_aside(some.where("doc_id IS NOT NULL").distinct(), "segment-ids")
    number = log.following
    size, lengths = _write_segment(spark, path, number, sorted_terms(docs, doc_id, fields, known, ids.count(), large), ids, large)
    new = lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("len").cast("long").alias("words"))
    if log.live:
        before = _living(spark, path, log, "lengths")
        few = ids.limit(MOST_IDS + 1).collect()
        before = before.where(F.col("doc_id").isin([r.doc_id for r in few])) if len(few) <= MOST_IDS else before.join(ids, "doc_id", "left_semi")
        old = before.groupBy("field").agg((-F.count("*")).alias("docs"), (-F.sum("len")).cast("long").alias("words"))
        new = new.unionByName(old).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/seg={number}")
    remove_aside(ids)
    _write_log(spark, path, Log((*log.live, (number, size)), number + 1, log.analyzers), number)
    return number


def tiers(live: Sequence[tuple[int, int]], fanout: int = FANOUT) -> list[int]:
    """The youngest run of neighbouring segments that should become one: ``fanout`` or more of one size class, together with all younger ones."""

    def kind(size: int) -> int:
        n = 0
        while size >= fanout:
            size, n = size // fanout, n + 1
        return n

    kinds = [kind(size) for _, size in live]
    for start in range(len(live)):
        run = [n for n in kinds[start:] if n <= kinds[start]]
        if len(run) == len(kinds) - start and sum(n == kinds[start] for n in run) >= fanout:
            return [number for number, _ in live[start:]]
    return []


def compact(spark: SparkSession, path: str, fanout: int = FANOUT, everything: bool = False) -> list[int]:
    """Merge segments of one size class into one (or ``everything``); the numbers of those merged, none if there was nothing to do.

    Dead documents inside the merged segments go; marks against older segments stay. Files of the merged
    segments are removed after the log names the new one.
    """
    log = read_log(spark, path)
    merged = [n for n, _ in log.live] if everything else tiers(log.live, fanout)
    if len(merged) < 2:
        return []
    by = ["term", "field", "doc_id"]
    postings, rows, documents = _living_postings(spark, path, log, merged)
    # The keys of some documents tell the ranges, so the postings are read once.
    bounds, parts = [], range_count(rows, spark.sparkContext.defaultParallelism)
    if parts > 1:
        share = max(1, documents.count() // BOUND_DOCS)
        some = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("bounds")), F.lit(share)) == 0)
        seen = write_aside(_table(spark, path, "postings", merged).select("seg", *by).join(F.broadcast(some), ["seg", "doc_id"]).select(*by), "bounds")
        bounds = range_bounds(seen, seen.count(), parts)
        remove_aside(seen)
    remove_aside(documents)
    postings = postings.withColumn("part", range_of(bounds)) if bounds else postings.withColumn("part", F.lit(0))
    postings = postings.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(*by).drop("part")
    rest = [x for x in log.live if x[0] not in merged]
    dead = _table(spark, path, "dead", merged).select("doc_id")
    dead = write_aside(dead if rest else dead.limit(0), "segment-ids")
    number = log.following
    size, _ = _write_segment(spark, path, number, postings, dead, True, _living(spark, path, log, "lengths", merged))
    stats = _table(spark, path, "stats", merged).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/seg={number}")
    remove_aside(dead)
    _write_log(spark, path, Log((*rest, (number, size)), number + 1, log.analyzers), number)
    for old in merged:
        for name in TABLES:
            delete_path(spark, f"{path}/{name}/seg={old}")
        delete_path(spark, f"{path}/log/entry={old}")
    return merged


@dataclass
class SegmentIndex(SearchIndex):
    """The living part of all segments, to be searched like an index of plain tables; its dictionary has terms and heads only."""

    def matching(self, terms_by_field: Mapping[str, Sequence[str]], fuzziness=None) -> DataFrame:
        """As in ``SearchIndex``; the terms are found among the keys, and counted from the postings that are read."""
        wanted = sorted({t for terms in terms_by_field.values() for t in terms})
        near = self.variants(wanted, fuzziness)
        if near is None:
            near = self.dictionary.select("term").distinct()
        terms = near.limit(MAX_PUSHED + 1).toArrow()
        postings = self.postings.where(F.col("field").isin(list(terms_by_field)))
        few = terms.num_rows <= MAX_PUSHED
        postings = postings.where(F.col("term").isin(sorted(terms.column("term").to_pylist()))) if few else postings.join(near, "term", "left_semi")
        matched = postings.withColumn("_m", F.explode(_variants(terms_by_field, fuzziness)))
        counted = postings.groupBy("term", "field").agg(F.count("*").alias("df"))
        return matched.join(counted, ["term", "field"]).join(self.stats, "field").select("*", "_m.position", "_m.weight").drop("_m")


def read_segments(spark: SparkSession, path: str) -> SegmentIndex:
    """The index as it is now; later batches do not change it, a later compaction ends it."""
    log = read_log(spark, path)
    if not log.live:
        raise ValueError(f"no search index at {path}")
    numbers = [n for n, _ in log.live]
    postings = _living(spark, path, log, "postings")
    totals = _table(spark, path, "stats", numbers).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    stats = totals.where("docs > 0").select("field", "docs", (F.col("words") / F.col("docs")).alias("avg_len"))
    terms, keys = (_table(spark, path, name, numbers).drop("seg") for name in ("terms", "keys"))
    return SegmentIndex(postings, terms, stats, dict(log.analyzers), keys)
