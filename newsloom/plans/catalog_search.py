"""Full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import search as op
from newsloom.operators import segments
from newsloom.plans.catalog import query
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import DOCS, search_docs
from newsloom.schema import BM25_B, BM25_K1, STOP_WORDS
from newsloom.session import new_path
from newsloom.sources.sinks import table_exists

TOKENS = r"[x FOR x IN regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
INDEX = DOCS + f""", toks AS (
  SELECT doc_id, 'title' AS field, {TOKENS.format('title')} AS ws FROM docs UNION ALL
  SELECT doc_id, 'summary', {TOKENS.format('summary')} FROM docs UNION ALL
  SELECT doc_id, 'content', {TOKENS.format('content')} FROM docs),
terms AS (SELECT doc_id, field, len(ws) AS len, unnest(ws) AS term FROM toks),
postings AS (SELECT term, field, doc_id, len, count(*) AS tf FROM terms GROUP BY ALL),
stats AS (SELECT field, count(*) AS docs, avg(len(ws)) AS avg_len FROM toks WHERE len(ws) > 0 GROUP BY field),
dfs AS (SELECT term, field, count(*) AS df FROM postings GROUP BY ALL)"""
POINTS = f"ln(1 + (s.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * {BM25_K1 + 1} / (p.tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * p.len / s.avg_len))"
SCORED = f"SELECT p.*, {POINTS} AS points FROM postings p JOIN dfs d USING (term, field) JOIN stats s USING (field)"
BOOST = "CASE field WHEN 'title' THEN 3.0 WHEN 'summary' THEN 2.0 ELSE 1.0 END"


_STORED: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """The stored index of the table; the first query of a session builds it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED or not table_exists(spark, _STORED[key]):
        _STORED[key] = new_path(spark, "index")
        op.write_index(op.search_index_build(search_docs(spark, sf)), _STORED[key])
    return op.read_index(spark, _STORED[key])


@query(f"WITH {INDEX} SELECT field, count(*) AS tokens, count(DISTINCT term) AS terms FROM terms GROUP BY field")
def tokenize_terms(spark, sf):
    tokens = op.tokenize_terms(search_docs(spark, sf), "doc_id", ["title", "summary", "content"])
    # Counting per term first lets a common word be combined before the shuffle.
    per_term = tokens.groupBy("field", "term").agg(F.count("*").alias("n"))
    return per_term.groupBy("field").agg(F.sum("n").alias("tokens"), F.count("*").alias("terms"))


@query(f"WITH {INDEX} SELECT term, field, doc_id, len::INT AS len, tf FROM postings")
def search_index_build(spark, sf):
    return op.search_index_build(search_docs(spark, sf)).postings.drop("places", "first")


_CHANGED = INDEX.replace("toks AS (", """changed AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN concat('replaced ', title) ELSE title END AS title) FROM docs), toks AS (""").replace("FROM docs UNION", "FROM changed UNION").replace("FROM docs),\nterms", "FROM changed),\nterms")


@query(f"WITH {_CHANGED}, scored AS ({SCORED}) SELECT doc_id, round(sum(points), 6) AS score FROM scored WHERE field = 'title' AND term IN ('replaced', 'the') GROUP BY doc_id")
def search_index_upsert(spark, sf):
    """An index of some documents, stored; then all with a new title replace theirs or are added, and titles are ranked."""
    docs = search_docs(spark, sf)
    number = F.col("doc_id")
    old = op.write_index(op.search_index_build(docs.where(number % 3 != 0)), new_path(spark, "index"))
    new = docs.where((number % 3 == 0) | (number % 5 == 0))
    new = new.withColumn("title", F.when(number % 5 == 0, F.concat(F.lit("replaced "), "title")).otherwise(F.col("title")))
    index = op.write_index(op.search_index_upsert(old, new), new_path(spark, "index"))
    return op.bm25_rank(index, ["replaced", "the"], "title").withColumn("score", F.round("score", 6))


def _batches(spark, sf):
    """An index of segments after a first load, four small batches that replace, add and remove documents, and with them merged or not."""
    docs, number, path = search_docs(spark, sf), F.col("doc_id"), new_path(spark, "segments")
    segments.add_segment(path, docs.where(number % 3 != 0), large=True)
    segments.add_segment(path, docs.where(number % 3 == 0).withColumn("title", F.concat(F.lit("draft of "), "title")), removed=docs.where(number % 7 == 0).select("doc_id"))
    segments.add_segment(path, docs.where(number % 5 == 0).withColumn("title", F.concat(F.lit("replaced "), "title")))
    segments.add_segment(path, docs.where((number % 3 == 0) & (number % 5 != 0)))
    segments.add_segment(path, docs.where("false"), removed=docs.where(number % 11 == 0).select("doc_id"))
    return path


_BATCHED = INDEX.replace("toks AS (", """changed AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN concat('replaced ', title) ELSE title END AS title) FROM docs
  WHERE doc_id % 11 <> 0 AND (doc_id % 7 <> 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0)), toks AS (""").replace("FROM docs UNION", "FROM changed UNION").replace("FROM docs),\nterms", "FROM changed),\nterms")
_BATCH_SCORES = f"""WITH {_BATCHED}, scored AS ({SCORED})
SELECT doc_id, round(sum(points), 6) AS score FROM scored WHERE field = 'title' AND term IN ('replaced', 'draft', 'the') GROUP BY doc_id"""


@query(_BATCH_SCORES)
def search_segments(spark, sf):
    """Titles ranked in an index of five segments."""
    index = segments.read_segments(spark, _batches(spark, sf))
    return op.bm25_rank(index, ["replaced", "draft", "the"], "title").withColumn("score", F.round("score", 6))


@query(_BATCH_SCORES)
def search_segments_compacted(spark, sf):
    """The same after the small segments, and then all, were merged."""
    path = _batches(spark, sf)
    segments.compact(spark, path, fanout=2)
    segments.compact(spark, path, everything=True)
    index = segments.read_segments(spark, path)
    return op.bm25_rank(index, ["replaced", "draft", "the"], "title").withColumn("score", F.round("score", 6))


@query(f"""WITH {INDEX}, p AS (SELECT doc_id, list_position(ws, 'the') AS at, ws FROM toks WHERE field = 'content'),
n AS (SELECT doc_id, unnest(range(1, len(ws))) AS i, ws FROM p) SELECT DISTINCT doc_id FROM n WHERE ws[i] = 'of' AND ws[i + 1] = 'the'""")
def search_in_order(spark, sf):
    """Documents with two words one behind the other."""
    return op.in_order(_index(spark, sf), "of the", "content")


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM docs) AS docs, count(*) AS postings, count(DISTINCT doc_id) AS indexed_docs FROM postings")
def reindex_count(spark, sf):
    """Write a fresh index, read it, and compare its size with the table."""
    docs = search_docs(spark, sf)
    stored = op.write_index(op.search_index_build(docs), new_path(spark, "index")).postings
    per_doc = stored.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per_doc.agg(F.sum("n").alias("postings"), F.count("*").alias("indexed_docs")).withColumn(
        "docs", docs.agg(F.count("*")).scalar()
    )


@query(f"""WITH {INDEX}, sc AS ({SCORED} WHERE p.field = 'content' AND p.term IN ('the', 'that', 'with'))
SELECT doc_id, round(sum(points), 4) AS score FROM sc GROUP BY doc_id""")
def bm25_rank(spark, sf):
    found = op.bm25_rank(_index(spark, sf), ["the", "that", "with"], "content")
    return found.select("doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH {INDEX}, sc AS ({SCORED} WHERE p.term IN ('the', 'with')),
f AS (SELECT doc_id, field, sum(points) * {BOOST} AS score FROM sc GROUP BY doc_id, field HAVING count(DISTINCT term) = 2),
m AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id)
SELECT doc_id, round(score, 4) AS score, strftime(publish_ts, '{TS}') AS publish_date, (SELECT count(*) FROM m) AS total
FROM m JOIN docs USING (doc_id) ORDER BY publish_ts DESC, m.score DESC, doc_id LIMIT 20 OFFSET 20""")
def search_best_fields(spark, sf):
    """Second page of the documents with both words in one field, newest first."""
    page = op.search(_index(spark, sf), search_docs(spark, sf), "The WITH", fuzziness=0, page=2, size=20)
    return page.select("doc_id", F.round("score", 4).alias("score"), stamp("publish_ts").alias("publish_date"), "total")


@query(f"""WITH {INDEX}, sc AS ({SCORED} WHERE p.term IN ('the', 'with')),
f AS (SELECT doc_id, field, sum(points) * {BOOST} AS score FROM sc GROUP BY doc_id, field HAVING count(DISTINCT term) = 2),
m AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id)
SELECT doc_id, round(m.score, 4) AS score, title FROM m JOIN docs USING (doc_id) ORDER BY m.score DESC, publish_ts DESC, doc_id LIMIT 20""")
def search_by_score(spark, sf):
    page = op.search(_index(spark, sf), search_docs(spark, sf), "the with", fuzziness=0, order="score", size=20)
    return page.select("doc_id", F.round("score", 4).alias("score"), "title")


@query(f"""WITH {INDEX}, sc0 AS ({SCORED}),
q AS (SELECT unnest(['thes', 'wihtin']) AS q, unnest([1, 2]) AS edits),
v AS (SELECT sc0.*, q.q, 1 - levenshtein(term, q.q)::DOUBLE / least(length(term), length(q.q)) AS w FROM sc0 JOIN q ON levenshtein(term, q.q) <= q.edits),
f AS (SELECT doc_id, field, sum(points * w) * {BOOST} AS score FROM v GROUP BY doc_id, field HAVING count(DISTINCT q) = 2),
m AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id)
SELECT doc_id, round(m.score, 4) AS score, (SELECT count(*) FROM m) AS total FROM m JOIN docs USING (doc_id) ORDER BY publish_ts DESC, m.score DESC, doc_id LIMIT 20""")
def search_fuzzy(spark, sf):
    """Misspelt words still match: one edit for short words, two from six letters on."""
    page = op.search(_index(spark, sf), search_docs(spark, sf), "thes wihtin")
    return page.select("doc_id", F.round("score", 4).alias("score"), "total")


@query(f"""WITH {DOCS} SELECT doc_id, (SELECT count(*) FROM docs) AS total FROM docs ORDER BY publish_ts DESC, doc_id LIMIT 20 OFFSET 20""")
def search_match_all(spark, sf):
    return op.search(_index(spark, sf), search_docs(spark, sf), "  ", page=2, size=20).select("doc_id", "total")


_MARK = "replace(regexp_replace(regexp_replace({0}, '([\\p{{L}}\\p{{N}}]+)', '␞\\1␞', 'g'), '(?i)␞(the|with)␞', '<strong>\\1</strong>', 'g'), '␞', '')"
_PIECES = "[p FOR p IN regexp_extract_all(content, '([\\s\\S]{1,150}(?:\\s|\\z))', 1) IF regexp_matches(regexp_replace(p, '([\\p{L}\\p{N}]+)', '␞\\1␞', 'g'), '(?i)␞(the|with)␞')]"


@query(f"""WITH {DOCS} SELECT doc_id, {_MARK.format('title')} AS title,
  array_to_string([{_MARK.format("trim(p, ' ')")} FOR p IN ({_PIECES})[1:3]], ' ... ') AS content FROM docs""")
def search_highlight(spark, sf):
    return search_docs(spark, sf).select(
        "doc_id", op.highlight("title", ["the", "with"]).alias("title"),
        F.array_join(op.fragments("content", ["the", "with"]), " ... ").alias("content"),
    )


_MARKED = "replace(regexp_replace(regexp_replace({0}, '([\\p{{L}}\\p{{N}}]+)', '␞\\1␞', 'g'), concat('(?i)␞(', array_to_string({1}, '|'), ')␞'), '<strong>\\1</strong>', 'g'), '␞', '')"
_HOLDS = "[p FOR p IN regexp_extract_all(content, '[\\s\\S]{1,150}(?:\\s|\\z)') IF regexp_matches(regexp_replace(p, '([\\p{L}\\p{N}]+)', '␞\\1␞', 'g'), concat('(?i)␞(', array_to_string(tc, '|'), ')␞'))]"


@query(f"""WITH {INDEX}, sc0 AS ({SCORED}),
q AS (SELECT unnest(['thes', 'wihtin']) AS q, unnest([1, 2]) AS edits),
v AS (SELECT sc0.*, q.q, 1 - levenshtein(term, q.q)::DOUBLE / least(length(term), length(q.q)) AS w FROM sc0 JOIN q ON levenshtein(term, q.q) <= q.edits),
f AS (SELECT doc_id, field, sum(points * w) * {BOOST} AS score FROM v GROUP BY doc_id, field HAVING count(DISTINCT q) = 2),
m AS (SELECT doc_id, max(score) AS score FROM f GROUP BY doc_id),
page AS (SELECT doc_id, title, content FROM m JOIN docs USING (doc_id) ORDER BY publish_ts DESC, m.score DESC, doc_id LIMIT 20),
t AS (SELECT doc_id, list(DISTINCT term) FILTER (field = 'title') AS tt, list(DISTINCT term) FILTER (field = 'content') AS tc FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN tt IS NULL THEN title ELSE {_MARKED.format('title', 'tt')} END AS title,
  CASE WHEN tc IS NULL THEN '' ELSE array_to_string([{_MARKED.format("trim(p, ' ')", 'tc')} FOR p IN ({_HOLDS})[1:3]], ' ... ') END AS content,
  'Uncategorized' AS main_category, '' AS image_url FROM page JOIN t USING (doc_id)""")
def search_hits(spark, sf):
    """The page of a misspelt query as a client gets it: the words that matched are marked, defaults filled."""
    page = op.search_hits(_index(spark, sf), search_docs(spark, sf), "thes wihtin")
    return page.select("doc_id", "title", F.array_join("content", " ... ").alias("content"), "main_category", "image_url")


# Stems by hand: of the words of the tables these become "on", the stem of "ones".
_STEMMED = "(VALUES ('one'), ('ones'), ('oned'), ('oning')) s(w)"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"""WITH {INDEX}, kept AS (SELECT doc_id, field, CASE WHEN field = 'title' THEN [w FOR w IN ws IF w NOT IN ({_STOPS})] ELSE ws END AS ws FROM toks),
t AS (SELECT doc_id, field, len(ws) AS len, unnest(ws) AS w FROM kept),
hits AS (SELECT doc_id, field, len, CASE WHEN field = 'title' THEN 'on' ELSE w END AS term FROM t
  WHERE (field = 'title' AND w IN (SELECT w FROM {_STEMMED})) OR (field <> 'title' AND w IN ('ones', 'there'))),
p AS (SELECT term, field, doc_id, len, count(*) AS tf FROM hits GROUP BY ALL),
d AS (SELECT term, field, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT field, count(*) AS docs, avg(len(ws)) AS avg_len FROM kept WHERE len(ws) > 0 GROUP BY field),
f AS (SELECT p.doc_id, p.field, sum({POINTS}) * {BOOST.replace("field", "p.field")} AS score FROM p JOIN d USING (term, field) JOIN s USING (field)
  GROUP BY p.doc_id, p.field HAVING count(DISTINCT p.term) = CASE WHEN p.field = 'title' THEN 1 ELSE 2 END)
SELECT doc_id, round(max(score), 4) AS score FROM f GROUP BY doc_id""")
def search_english(spark, sf):
    """Titles analysed with stop words and stemming; a plural finds the singular."""
    docs = search_docs(spark, sf)
    built = op.search_index_build(docs, analyzers={"title": op.ENGLISH})
    index = op.write_index(built, new_path(spark, "index-english"))
    return op.search_scores(index, "ones there", fuzziness=0).select("doc_id", F.round("score", 4).alias("score"))
