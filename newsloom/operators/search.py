"""Full-text search: analysis, inverted index, BM25, multi-field matching, highlighting.

The index is four tables: postings (term, field, doc_id, len, tf, places, first), the dictionary
(term, field, df, head), the totals per field, and keys (key, head) for misspelt words. ``len`` is the length of
the field, carried along so that ranking needs no join with a length table; ``places`` are
the numbers of the words in the field, by which matches are marked and word order is asked for. A
query is matched against the dictionary, which is small, and only the postings of the matching
terms are read.

A text is analysed once: the words of a field are sorted and counted inside the row, so nothing is
grouped across rows. Misspelt words are found by *deletion keys*: the first letters (heads) of a word and of a
term that are at most two edits apart agree in something that is left when up to two letters of each
are removed. A key leads to heads, a head to its terms, and only those are compared letter by letter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.stemming import porter_stem
from newsloom.functions.text import col, let
from newsloom.schema import BM25_B, BM25_K1, FIELD_BOOSTS, STOP_WORDS
from newsloom.session import new_path
from newsloom.sources.sinks import remove_aside, table_exists, write_aside

# Dictionary entries of one query that are brought to the driver at most.
MAX_PUSHED = 2048

STANDARD, ENGLISH = "standard", "english"
_SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(col(c)), _SEPARATOR), lambda t: t != "")


def query_terms(query: str, analyzer: str = STANDARD) -> list[str]:
    """The distinct terms of a query, in order."""
    words = [w for w in re.split(r"[^\w]|_", query.lower()) if w]
    if analyzer == ENGLISH:
        words = [porter_stem(w) for w in words if w not in STOP_WORDS]
    return list(dict.fromkeys(words))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Each word's stem; a batch stems its different words."""
    known = words.flatten().dictionary_encode()
    stems = pa.array([porter_stem(w) for w in known.dictionary.to_pylist()], pa.string())
    offsets = pa.array(words.offsets.to_numpy() - words.offsets[0].as_py(), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(known.indices) if len(known) else pa.array([], pa.string()))


def _placed(f: str, analyzer: str) -> tuple[Column, Column]:
    """The words of a field as an array, stop words left out, and the numbers they have among all words of the field."""
    words = F.coalesce(tokens(f), F.array().cast("array<string>"))
    if analyzer != ENGLISH:
        return words, F.sequence(F.lit(0), F.size(words) - 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~F.array_contains(stop, x["w"]))
    return _stems(F.transform(kept, lambda x: x["w"])), F.transform(kept, lambda x: x["i"])


#: Words that are counted at a time, about; a longer text is counted whole.
COUNTED_WORDS = 1 << 18


def _counted(words: pa.ListArray, places: pa.ListArray | None) -> tuple[np.ndarray, np.ndarray, pa.Array, list[pa.Array]]:
    """The different words of each row, ordered by word and row: the row and the word's rank of each, all words by rank, and ``term, len, tf, places, first``."""
    sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if places is None else places.flatten().to_numpy()
    by_word = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(by_word), np.int64)
    rank[by_word] = np.arange(len(by_word))
    # Words of a row come in order of place, so a stable sort by word and row leaves the places sorted. What is
    # sorted by term already is sorted faster afterwards.
    key = rank[flat.indices.to_numpy()] * max(1, len(words)) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    of = row[order[start]]
    ends = np.r_[start, len(key)].astype(np.int32)
    # Of several places that are assigned the last one stays, which is the least.
    least = np.full(len(words), -1)
    least[of[::-1]] = np.arange(len(of))[::-1]
    first = np.zeros(len(of), bool)
    first[least[least >= 0]] = True
    return of, key[start] // max(1, len(words)), flat.dictionary.take(pa.array(by_word)), [
        flat.dictionary.take(flat.indices.take(pa.array(order[start]))), pa.array(sizes[of], pa.int32()), pa.array(np.diff(ends), pa.int64()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order], pa.int32())), pa.array(first),
    ]


def _parts(bounds: Sequence[tuple], field: str, by_rank: pa.Array, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the sorted ``(term, field, doc_id)`` are below each posting of a field: the range it belongs to."""
    known, ahead, same = by_rank.to_pylist(), [], {}
    for b in bounds:
        at = bisect_left(known, b[0])
        equal = at < len(known) and known[at] == b[0]
        ahead.append(at + equal)
        if equal:
            same.setdefault(at, []).append(b)
    out = np.searchsorted(np.array(ahead, np.int64), np.arange(len(known)), "right")[rank] if len(known) else np.zeros(0, np.int64)
    # The postings of a common term are many ranges, told apart by field and document.
    for at, here in same.items():
        rows = slice(*np.searchsorted(rank, [at, at + 1]))
        within = np.array([b[2] for b in here if b[1] == field], ids.dtype)
        out[rows] += sum(b[1] < field for b in here) + np.searchsorted(within, ids[rows])
    return out


def document_terms(
    df: DataFrame, doc_id: str, fields: Sequence[str], analyzers: Mapping[str, str] | None = None, bounds: Sequence[tuple] | None = None,
) -> DataFrame:
    """One row per document, field and term: ``term, field, doc_id, len, tf, places``, and whether it is the ``first`` term of the field. No shuffle; NULL and empty fields have none.

    With ``bounds``, sorted, each row also has the number of its range between them, ``part``.
    """
    analyzers = analyzers or {}
    placed = [_placed(f, analyzers.get(f, STANDARD)) for f in fields]
    # Without stop words a word's place is its number in the array, which need not travel.
    numbered = [analyzers.get(f, STANDARD) != ENGLISH for f in fields]
    columns = [c.alias(f"_{n}{i}") for i, pair in enumerate(placed) for n, c in zip("wp", pair, strict=True) if n == "w" or not numbered[i]]
    rows = df.select(F.col(doc_id).alias("doc_id"), *columns)
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("field", T.StringType()), rows.schema["doc_id"], T.StructField("len", T.IntegerType()),
        T.StructField("tf", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("first", T.BooleanType()),
    ])

    if bounds is not None:
        schema = schema.add("part", T.IntegerType())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            for i, f in enumerate(fields):
                words = batch.column(f"_w{i}")
                places = None if numbered[i] else batch.column(f"_p{i}")
                share = words.offsets.to_numpy()
                cuts = np.flatnonzero(np.diff((share - share[0]) // COUNTED_WORDS)) + 1
                for a, b in pairwise(np.unique(np.r_[0, cuts, len(words)])):
                    of, rank, by_rank, (term, size, tf, at, first) = _counted(words[a:b], None if places is None else places[a:b])
                    if len(of):
                        field = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(of), np.int8)), pa.array([f])).cast(pa.string())
                        own = ids.take(pa.array(of + a))
                        part = [] if bounds is None else [pa.array(_parts(bounds, f, by_rank, rank, own.to_numpy(zero_copy_only=False)), pa.int32())]
                        yield pa.RecordBatch.from_arrays([term, field, own, size, tf, at, first, *part], schema.names)

    return rows.mapInArrow(count, schema)


def tokenize_terms(df: DataFrame, doc_id: str, fields: Sequence[str], analyzers: Mapping[str, str] | None = None) -> DataFrame:
    """One row per token: doc_id, field, len (tokens in the field), term. One scan for all fields."""
    analyzers = analyzers or {}
    parts = [F.struct(F.lit(f).alias("field"), _placed(f, analyzers.get(f, STANDARD))[0].alias("words")) for f in fields]
    per_field = df.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*parts)).alias("f"))
    return per_field.select("doc_id", "f.field", F.size("f.words").alias("len"), F.explode("f.words").alias("term"))


#: Letters that may be removed, and letters at the beginning of a word that are looked at.
MOST_EDITS, HEAD = 2, 5


def head(word: str | Column) -> Column:
    return F.substring(col(word), 1, HEAD)


def deletions(word: Column) -> Column:
    """What is left of a short text when none, one or two letters are removed."""

    def shorter(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    return let(word, lambda w: let(shorter(w), lambda once: F.array_distinct(F.concat(F.array(w), once, F.flatten(F.transform(F.filter(once, lambda x: x != ""), shorter))))))


def query_keys(word: str, edits: int) -> list[str]:
    """The keys under which the heads of terms of at most so many edits from a query word are stored.

    An alignment of two words with that many edits leaves their heads with something in common, if each may lose
    as many letters: those edited, and at its end those the edits have pushed out of the other head.
    """
    short = word[:HEAD]
    return sorted({"".join(c for i, c in enumerate(short) if i not in gone) for n in range(edits + 1) for gone in combinations(range(len(short)), min(n, len(short)))})


def head_keys(terms: DataFrame) -> DataFrame:
    """``key, head`` of every different head of the terms."""
    # Spelled out for the few letters of a head, which is compiled; a place beyond the end of a short head removes nothing.
    kept = [[i for i in range(1, HEAD + 1) if i not in gone] for n in range(MOST_EDITS + 1) for gone in combinations(range(1, HEAD + 1), n)]
    keys = F.array(*[F.concat(*[F.substring("head", i, 1) for i in places]) for places in kept])
    return terms.select(head("term").alias("head")).distinct().select(F.explode(F.array_distinct(keys)).alias("key"), "head")


@dataclass
class SearchIndex:
    """Plain tables that can be stored, and the analyzer of each field.

    With ``keys`` the dictionary has the ``head`` of each term; without, misspelt words are looked for in all of it.
    """

    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    analyzers: Mapping[str, str]
    keys: DataFrame | None = None

    def matching(self, terms_by_field: Mapping[str, Sequence[str]], fuzziness=None) -> DataFrame:
        """The postings of all entries that match a query term, with ``position, weight`` of the match and ``df, docs, avg_len``.

        The dictionary is asked first. Up to ``MAX_PUSHED`` matching entries become a filter on
        the postings scan, so only their row groups are read; more of them are joined.
        """
        postings = self.postings.where(F.col("field").isin(list(terms_by_field)))
        expanded = expand_terms(self, terms_by_field, fuzziness).join(self.stats, "field")
        entries = expanded.limit(MAX_PUSHED + 1).toArrow()
        if entries.num_rows <= MAX_PUSHED:
            expanded = postings.sparkSession.createDataFrame(entries, expanded.schema)
            postings = postings.where(F.col("term").isin(sorted(set(entries.column("term").to_pylist()))))
        return postings.join(expanded, ["term", "field"])

    def variants(self, words: Sequence[str], fuzziness) -> DataFrame | None:
        """The stored terms that may be within the allowed edits of a word, found by their keys; None without keys or beyond their reach."""
        edits = {w: allowed_edits(w, fuzziness) for w in words}
        if self.keys is None or max(edits.values(), default=0) > MOST_EDITS:
            return None
        wanted = sorted({k for w, n in edits.items() for k in query_keys(w, n)})
        heads = self.keys.where(F.col("key").isin(wanted)).select("head").distinct()
        few = heads.limit(MAX_PUSHED + 1).toArrow()
        terms = self.dictionary.select("head", "term")
        terms = terms.where(F.col("head").isin(sorted(few.column("head").to_pylist()))) if few.num_rows <= MAX_PUSHED else terms.join(heads, "head", "left_semi")
        return terms.select("term").distinct()


def search_index_build(
    docs: DataFrame, doc_id: str = "doc_id", fields: Sequence[str] = tuple(FIELD_BOOSTS),
    analyzers: Mapping[str, str] | None = None,
) -> SearchIndex:
    """The inverted index. The words of a document are counted inside its row, so there is no shuffle of tokens."""
    analyzers = dict(analyzers or {})
    postings = document_terms(docs, doc_id, fields, analyzers)
    return SearchIndex(postings, term_dictionary(postings), field_stats(postings), analyzers)


def term_dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "field").agg(F.count("*").alias("df"))


def field_stats(postings: DataFrame) -> DataFrame:
    """Documents that have the field and its average length: one row per field.

    A document counts by its posting that is marked as the first one of the field, so nothing is grouped by document.
    """
    return postings.where("first").groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))


#: Postings that one task sorts into a file, about; fewer of them are dealt to the cores, down to SMALL_ROWS a file.
FILE_ROWS, SMALL_ROWS = 1 << 20, 1 << 16


def range_count(rows: int, cores: int) -> int:
    """Ranges for so many postings: their number follows the rows, so that a task's share does not grow with the table."""
    return max(1, -(-rows // FILE_ROWS), min(cores, -(-rows // SMALL_ROWS)))


def sorted_ranges(stored: DataFrame, *by: str) -> DataFrame:
    """A stored table sorted by ranges."""
    parts = range_count(stored.count(), stored.sparkSession.sparkContext.defaultParallelism)
    return stored.repartitionByRange(parts, *by).sortWithinPartitions(*by)


#: Documents, and postings of them, from which the bounds of ranges are taken, about.
BOUND_DOCS, BOUND_ROWS = 1 << 11, 1 << 19


def range_bounds(seen: DataFrame, rows: int, parts: int) -> list[tuple]:
    """``(term, field, doc_id)`` between so many ranges of about one size, from some postings, which are stored."""
    by = ["term", "field", "doc_id"]
    thin = max(1, rows // BOUND_ROWS)
    found = (seen.where(F.pmod(F.xxhash64(*by), F.lit(thin)) == 0) if thin > 1 else seen).select(*by).toArrow().sort_by([(c, "ascending") for c in by])
    return sorted({tuple(r[c] for c in by) for r in found.take(pa.array(np.arange(1, parts) * found.num_rows // parts)).to_pylist()}) if found.num_rows else []


def range_of(bounds: Sequence[tuple]) -> Column:
    """The range of a posting between sorted bounds. Rows that come sorted are mostly of one range, which the least and greatest term of a batch tell."""
    terms = [b[0] for b in bounds]

    @F.arrow_udf("int")
    def part(term: pa.Array, field: pa.Array, doc: pa.Array) -> pa.Array:
        ends = pc.min_max(term).as_py() if len(term) else {"min": "", "max": ""}
        low, high = bisect_left(terms, ends["min"]), bisect_right(terms, ends["max"])
        out = np.full(len(term), low, np.int32)
        if low < high and len(term):
            known = term.dictionary_encode()
            words, code = known.dictionary.to_pylist(), known.indices.to_numpy()
            out = np.array([bisect_left(terms, w, low, high) for w in words], np.int32)[code]
            # The postings of a common term are many ranges, told apart by field and document.
            for at, w in enumerate(words):
                same = bounds[bisect_left(terms, w, low, high) : bisect_right(terms, w, low, high)]
                if same:
                    rows = np.flatnonzero(code == at)
                    fields, ids = (c.take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in (field, doc))
                    out[rows] += sum(((fields > f) | ((fields == f) & (ids > d))).astype(np.int32) for _, f, d in same)
        return pa.array(out, pa.int32())

    return part("term", "field", "doc_id")


def sorted_terms(df: DataFrame, doc_id: str, fields: Sequence[str], analyzers: Mapping[str, str], documents: int, large: bool) -> DataFrame:
    """``document_terms`` sorted by ranges of term, field and document, or in one file if they are few and not ``large``.

    Bounds come from the postings of some of the ``documents``, so that all texts are analysed once and their postings are dealt
    out as they are made, not stored unsorted and read again to choose bounds and to deal them out.
    """
    by = ["term", "field", "doc_id"]
    share = max(1, documents // BOUND_DOCS)
    some = df.where(F.pmod(F.xxhash64(doc_id, F.lit("bounds")), F.lit(share)) == 0) if share > 1 else df
    seen = write_aside(document_terms(some, doc_id, fields, analyzers).select(*by), "bounds")
    rows = seen.count()
    parts = range_count(rows * share, df.sparkSession.sparkContext.defaultParallelism) if large or rows * share > FILE_ROWS else 1
    bounds = range_bounds(seen, rows, parts) if parts > 1 else []
    remove_aside(seen)
    dealt = document_terms(df, doc_id, fields, analyzers, bounds).repartitionById(len(bounds) + 1, F.col("part"))
    return dealt.sortWithinPartitions(*by).drop("part")


def write_index(index: SearchIndex, path: str) -> SearchIndex:
    """Store the index and return the stored one.

    Postings are sorted by term, so that a query reads only the row groups of its terms.
    The range key ends with the document, so the postings of one common word can fill many
    files. They are written once unsorted before: choosing the ranges samples its input, and
    the texts should not be analysed twice. Dictionary, totals and keys are counted from the stored postings.
    """
    spark = index.postings.sparkSession
    staged = write_aside(index.postings, "postings")
    sorted_ranges(staged, "term", "field", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    remove_aside(staged)
    postings = spark.read.schema(index.postings.schema).parquet(f"{path}/postings")
    dictionary = term_dictionary(postings).withColumn("head", head("term"))
    dictionary.repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{path}/dictionary")
    field_stats(postings).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    keys = head_keys(spark.read.parquet(f"{path}/dictionary"))
    keys.repartitionByRange("key", "head").sortWithinPartitions("key", "head").write.mode("overwrite").parquet(f"{path}/keys")
    return read_index(spark, path, index.analyzers)


def read_index(spark: SparkSession, path: str, analyzers: Mapping[str, str] | None = None) -> SearchIndex:
    postings, dictionary, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "dictionary", "stats"))
    keys = spark.read.parquet(f"{path}/keys") if table_exists(spark, f"{path}/keys") else None
    return SearchIndex(postings, dictionary, stats, dict(analyzers or {}), keys)


def search_index_upsert(
    index: SearchIndex, docs: DataFrame, doc_id: str = "doc_id", fields: Sequence[str] = tuple(FIELD_BOOSTS)
) -> SearchIndex:
    """The index with the documents of ``docs`` added, those of the same id replaced, as new tables.

    Only the new documents are analysed; the postings of the others are taken over. Store it with
    ``write_index`` under another path than the old one, which it still reads. To add a few
    documents at their own cost, keep the index in segments (``operators/segments.py``).
    """
    fresh = search_index_build(docs, doc_id, fields, index.analyzers)
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    columns = index.postings.columns
    postings = index.postings.join(ids, "doc_id", "left_anti").select(*columns).unionByName(fresh.postings.select(*columns))
    return SearchIndex(postings, term_dictionary(postings), field_stats(postings), index.analyzers)


def allowed_edits(term: str, fuzziness: str | int | None) -> int:
    """AUTO: none up to 2 letters, 1 up to 5, then 2."""
    if fuzziness == "AUTO":
        return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    return int(fuzziness or 0)


def _variants(terms_by_field: Mapping[str, Sequence[str]], fuzziness) -> Column:
    """For a dictionary entry: the query terms it matches, as (position, weight).

    A variant some edits away counts 1 - edits / length of the shorter word.
    """
    matches = []
    for field, terms in terms_by_field.items():
        for position, q in enumerate(terms):
            edits = allowed_edits(q, fuzziness)
            if edits == 0:
                hit, weight = F.col("term") == q, F.lit(1.0)
            else:
                distance = F.levenshtein(F.col("term"), F.lit(q), edits)
                hit = (F.abs(F.length("term") - len(q)) <= edits) & (distance >= 0)
                weight = 1 - distance / F.least(F.length("term"), F.lit(len(q)))
            matches.append(
                F.when((F.col("field") == field) & hit, F.struct(F.lit(position).alias("position"), weight.alias("weight")))
            )
    return F.filter(F.array(*matches), lambda m: m.isNotNull())


def expand_terms(index: SearchIndex, terms_by_field: Mapping[str, Sequence[str]], fuzziness=None) -> DataFrame:
    """Dictionary entries that match a query term: term, field, df, position, weight."""
    entries = index.dictionary.where(F.col("field").isin(list(terms_by_field)))
    wanted = sorted({t for terms in terms_by_field.values() for t in terms})
    if all(allowed_edits(t, fuzziness) == 0 for t in wanted):
        entries = entries.where(F.col("term").isin(wanted))
    else:
        near = index.variants(wanted, fuzziness)
        entries = entries if near is None else entries.join(near, "term", "left_semi")
    return entries.select("term", "field", "df", F.explode(_variants(terms_by_field, fuzziness)).alias("m")).select(
        "term", "field", "df", "m.position", "m.weight"
    )


def bm25(tf: Column, length: Column, df: Column, docs: Column, avg_len: Column) -> Column:
    idf = F.log1p((docs - df + 0.5) / (df + 0.5))
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / avg_len))


def score_fields(index: SearchIndex, terms_by_field: Mapping[str, Sequence[str]], fuzziness=None) -> DataFrame:
    """doc_id, field, score and the number of different query terms found, one row per document and field."""
    points = bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("docs"), F.col("avg_len")) * F.col("weight")
    return index.matching(terms_by_field, fuzziness).groupBy("doc_id", "field").agg(
        F.sum(points).alias("score"), F.size(F.collect_set("position")).alias("found")
    )


def bm25_rank(index: SearchIndex, terms: Sequence[str], field: str) -> DataFrame:
    """Documents holding any of the terms in a field, with their BM25 score."""
    return score_fields(index, {field: list(terms)}).select("doc_id", "score")


def search_scores(
    index: SearchIndex, query: str, boosts: Mapping[str, float] = FIELD_BOOSTS, operator: str = "and", fuzziness="AUTO"
) -> DataFrame:
    """doc_id and score of the matching documents: the best boosted field counts.

    With operator "and" a field matches if it holds every query term itself.
    """
    terms = {f: query_terms(query, index.analyzers.get(f, STANDARD)) for f in boosts}
    terms = {f: t for f, t in terms.items() if t}
    if not terms:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    scored = score_fields(index, terms, fuzziness)
    boost, need = F.lit(None).cast("double"), F.lit(None).cast("int")
    for f, t in terms.items():
        boost = F.when(F.col("field") == f, F.lit(float(boosts[f]))).otherwise(boost)
        need = F.when(F.col("field") == f, F.lit(len(t))).otherwise(need)
    if operator == "and":
        scored = scored.where(F.col("found") == need)
    return scored.groupBy("doc_id").agg(F.max(F.col("score") * boost).alias("score"))


def search(
    index: SearchIndex,
    docs: DataFrame,
    query: str,
    doc_id: str = "doc_id",
    date: str = "publish_ts",
    boosts: Mapping[str, float] = FIELD_BOOSTS,
    operator: str = "and",
    fuzziness: str | int | None = "AUTO",
    order: str = "date",
    page: int = 1,
    size: int = 20,
) -> DataFrame:
    """A page of matching documents with score and the total number of hits.

    ``order="date"``: newest first, the score breaks ties; ``order="score"``: the other way
    round. A blank query matches everything. The ids of the page and the total are found when the
    page is asked for; the documents of those ids are read when it is shown.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    dated = docs.select(doc_id, date)
    if query and query.strip():
        # Scored once; page and total are read from the stored scores.
        scores = write_aside(search_scores(index, query, boosts, operator, fuzziness).withColumnRenamed("doc_id", doc_id), "scores")
        hits, total = dated.join(scores, doc_id), scores
    else:
        hits, total = dated.withColumn("score", F.lit(1.0)), docs
    keys = [F.desc_nulls_last(date), F.desc("score")] if order == "date" else [F.desc("score"), F.desc_nulls_last(date)]
    # The page is cut on ids and dates. Its ``size`` ids come to the driver and go into the scan of the documents.
    paged = hits.orderBy(*keys, F.asc(doc_id)).offset((page - 1) * size).limit(size).select(doc_id, "score").toArrow()
    n = total.count()
    if total is not docs:
        remove_aside(total)
    here = docs.where(F.col(doc_id).isin(paged.column(doc_id).to_pylist())) if paged.num_rows else docs.limit(0)
    found = here.join(docs.sparkSession.createDataFrame(paged, hits.select(doc_id, "score").schema), doc_id)
    return found.orderBy(*keys, F.asc(doc_id)).withColumn("total", F.lit(n).cast("long"))


def _any_word(terms: Sequence[str]) -> str:
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def highlight(c: str | Column, terms: Sequence[str], pre: str = "<strong>", post: str = "</strong>") -> Column:
    """The text with every whole-word occurrence of a term marked."""
    return F.regexp_replace(col(c), _any_word(terms), f"{pre}$0{post}")


def fragments(c: str | Column, terms: Sequence[str], size: int = 150, count: int = 3) -> Column:
    """The first ``count`` pieces of at most ``size`` characters that hold a term, marked.

    Pieces end at white space; a longer run without any is cut at ``size``, and no part of it is lost.
    """
    pieces = F.regexp_extract_all(col(c), F.lit(rf"[\s\S]{{1,{size}}}(?:\s|\z)|\S{{{size}}}"), 0)
    hits = F.filter(pieces, lambda p: p.rlike(_any_word(terms)))
    return F.transform(F.slice(hits, 1, count), lambda p: highlight(F.trim(p), terms))


def _pattern(words: Column) -> Column:
    """The pattern of any of the words (letters and digits only) as a whole word, longer ones first."""
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def matched_places(index: SearchIndex, ids: Sequence, query: str, fields: Sequence[str], fuzziness) -> DataFrame:
    """The places of the words of some documents that a query found, variants included: ``doc_id`` and one array ``_at_<field>`` a field.

    ``ids`` are those of one result page; they and the terms go into the scan of the postings.
    """
    terms = {f: query_terms(query, index.analyzers.get(f, STANDARD)) for f in fields}
    found = index.matching({f: t for f, t in terms.items() if t}, fuzziness).where(F.col("doc_id").isin(list(ids)))
    return found.groupBy("doc_id").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(F.col("field") == f, F.col("places"))))).alias(f"_at_{f}") for f in fields])


def in_order(index: SearchIndex, phrase: str, field: str) -> DataFrame:
    """``doc_id`` of the documents that hold the words of a phrase one behind the other in a field (stop words of a stemmed field may differ)."""
    words = [w for w in re.split(r"[^\w]|_", phrase.lower()) if w]
    english = index.analyzers.get(field) == ENGLISH
    wanted = [(i, porter_stem(w) if english else w) for i, w in enumerate(words) if not (english and w in STOP_WORDS)]
    if not wanted:
        return index.postings.select("doc_id").limit(0)
    postings = index.postings.where((F.col("field") == field) & F.col("term").isin(sorted({w for _, w in wanted})))

    # Where the phrase would begin, by each of its words; all have to agree.
    def begin(i: int, w: str) -> Column:
        return F.when(F.col("term") == w, F.transform("places", lambda p: F.struct(F.lit(i).alias("i"), (p - i).alias("at"))))

    begins = [begin(i, w) for i, w in wanted]
    found = postings.select("doc_id", F.explode(F.flatten(F.filter(F.array(*begins), lambda x: x.isNotNull()))).alias("b"))
    return found.groupBy("doc_id", "b.at").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("doc_id").distinct()


def mark_places(c: str | Column, places: Column, pre: str = "<strong>", post: str = "</strong>") -> Column:
    """The text with the words at the given places marked; words are counted as the index counts them."""
    parts = F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0)

    def marked(pieces: Column) -> Column:
        ahead = F.when(F.get(pieces, 0).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
        return F.array_join(F.transform(pieces, lambda p, i: F.when(
            ((i + ahead) % 2 == 0) & F.array_contains(places, F.floor((i - ahead) / 2).cast("int")), F.concat(F.lit(pre), p, F.lit(post))
        ).otherwise(p)), "")

    return let(parts, marked)


def search_hits(
    index: SearchIndex, docs: DataFrame, query: str, doc_id: str = "doc_id", size: int = 150, count: int = 3, fuzziness="AUTO",
    boosts: Mapping[str, float] = FIELD_BOOSTS, pre: str = "<strong>", post: str = "</strong>", **options,
) -> DataFrame:
    """A result page as a client gets it: the words that really matched are marked, misspelt queries and stemmed fields included.

    title and summary are marked whole, content becomes its first ``count`` marked pieces of at
    most ``size`` characters. Missing texts have the defaults 'No title available' and '',
    a missing category is 'Uncategorized', a missing image ''.
    """
    page = search(index, docs, query, doc_id, fuzziness=fuzziness, boosts=boosts, **options)
    none = F.array().cast("array<int>")
    ids = [r[0] for r in page.select(doc_id).collect()] if query.strip() else []
    if ids:
        found = page.join(matched_places(index, ids, query, list(boosts), fuzziness).withColumnRenamed("doc_id", doc_id), doc_id, "left")
    else:
        found = page.withColumns({f"_at_{f}": none for f in boosts})
    rest = rf"[\s\S]{{1,{size}}}(?:\s|\z)|\S{{{size}}}"

    def at(f: str) -> Column:
        return F.coalesce(f"_at_{f}", none) if f in boosts else none

    # The pieces of the content, each with the number of words that begin in it; a word cut in two belongs to its first part.
    letter, word = r"[\p{L}\p{N}]", r"[\p{L}\p{N}]+"

    def parts(texts: Column) -> Column:
        goes_on = lambda p, i: (i > 0) & p.rlike(f"^{letter}") & F.get(texts, i - 1).rlike(f"{letter}$")
        return F.transform(texts, lambda p, i: let(
            F.coalesce(goes_on(p, i), F.lit(False)).cast("int"), lambda cut: F.struct(p.alias("p"), cut.alias("cut"), (F.regexp_count(p, F.lit(word)) - cut).alias("n"))
        ))

    def held(pieces: Column) -> Column:
        return F.transform(pieces, lambda x, i: let(F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, y: s + y["n"]), lambda first: F.struct(
            x["p"].alias("p"), F.transform(F.filter(at("content"), lambda w: (w >= first) & (w < first + x["n"])), lambda w: w - first + x["cut"]).alias("at"),
        )))

    texts = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(rest), 0)
    shown_pieces = F.filter(let(let(texts, parts), held), lambda y: F.size(y["at"]) > 0)
    shown = {
        "title": mark_places(F.when(F.coalesce("title", F.lit("")) == "", F.lit("No title available")).otherwise(F.col("title")), F.when(F.coalesce("title", F.lit("")) == "", none).otherwise(at("title")), pre, post),
        "summary": mark_places(F.coalesce("summary", F.lit("")), at("summary"), pre, post),
        "content": F.transform(F.slice(shown_pieces, 1, count), lambda y: F.trim(mark_places(y["p"], y["at"], pre, post))),
    }
    for name, default in (("main_category", "Uncategorized"), ("image_url", "")):
        given = F.col(name) if name in docs.columns else F.lit(None).cast("string")
        shown[name] = F.coalesce(F.nullif(given, F.lit("")), F.lit(default))
    # Ordered again: the join with the places forgets the order of the page.
    order = [F.desc_nulls_last(options.get("date", "publish_ts")), F.desc("score")]
    order = order if options.get("order", "date") == "date" else order[::-1]
    return found.withColumns(shown).orderBy(*order, F.asc(doc_id)).drop(*[f"_at_{f}" for f in boosts])
