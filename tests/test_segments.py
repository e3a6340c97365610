"""The search index in segments against one built at once; what a batch reads and writes; tiers; keys, places and marks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import search, segments
from newsloom.session import new_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa running runs ran the of".split()


def docs(spark, rows):
    data = [(i, f"{t} title", t, f"{t} and more {t}") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, title string, summary string, content string").withColumn("publish_ts", F.timestamp_seconds("doc_id"))


def text(pick):
    return " ".join(pick.choices(WORDS, k=pick.randint(0, 9)))


def scores(index, query, **options):
    return sorted((r.doc_id, round(r.score, 9)) for r in search.search_scores(index, query, **options).collect())


@pytest.mark.parametrize("analyzers", [{}, {"title": search.ENGLISH}])
def test_batches_equal_one_build(spark, analyzers):
    pick, path, now = random.Random(1), new_path(spark, "test-segments"), {}
    for step in range(4):
        batch = {pick.randrange(120): text(pick) for _ in range(60 if step == 0 else 12)}
        gone = [pick.randrange(120) for _ in range(5)]
        gone = [g for g in gone if g not in batch]
        segments.add_segment(path, docs(spark, batch.items()), analyzers=analyzers, removed=spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        now = {i: t for i, t in now.items() if i not in gone} | batch
        if step == 3:
            assert segments.compact(spark, path, fanout=2)
        if step in (2, 3):
            fresh, stored = search.search_index_build(docs(spark, now.items()), analyzers=analyzers), segments.read_segments(spark, path)
            for query, options in (("the runs", {"fuzziness": 0}), ("gama dleta", {"operator": "or"})):
                assert scores(stored, query, **options) == scores(fresh, query, **options), (step, query)
            want = {(r.field, r.docs, round(r.avg_len, 9)) for r in fresh.stats.collect()}
            assert {(r.field, r.docs, round(r.avg_len, 9)) for r in stored.stats.collect()} == want
    numbers = [n for n, _ in segments.read_log(spark, path).live]
    assert sorted(segments.compact(spark, path, everything=True)) == sorted(numbers)
    assert scores(segments.read_segments(spark, path), "alpha") == scores(fresh, "alpha")
    assert segments._table(spark, path, "dead", [n for n, _ in segments.read_log(spark, path).live]).count() == 0
    assert segments.compact(spark, path) == []


def test_a_batch_leaves_older_files_alone(spark):
    path = new_path(spark, "test-segments")
    segments.add_segment(path, docs(spark, [(i, "alpha beta") for i in range(200)]), large=True)
    files = lambda: {r[0] for r in spark.read.parquet(f"{path}/postings").select(F.input_file_name()).distinct().collect()}
    before = files()
    segments.add_segment(path, docs(spark, [(7, "gamma")]))
    assert before < files() and len(files() - before) == 1
    assert scores(segments.read_segments(spark, path), "gamma") and not [d for d, _ in scores(segments.read_segments(spark, path), "alpha") if d == 7]
    # Not in the log, not in the index.
    segments.delete_path(spark, f"{path}/log/entry=1")
    assert not scores(segments.read_segments(spark, path), "gamma")


def test_tiers():
    assert segments.tiers([(0, 1000), (1, 10), (2, 12), (3, 9)], 4) == []
    assert segments.tiers([(0, 1000), (1, 5), (2, 12), (3, 9), (4, 5), (5, 1)], 4) == [1, 2, 3, 4, 5]
    assert segments.tiers([], 4) == []


def test_pages_and_hits_of_segments(spark):
    path, rows = new_path(spark, "test-segments"), [(i, "the runs " + WORDS[i % 5]) for i in range(40)]
    segments.add_segment(path, docs(spark, rows[:30]), analyzers={"title": search.ENGLISH})
    segments.add_segment(path, docs(spark, rows[20:]))
    table, index = docs(spark, rows), segments.read_segments(spark, path)
    hits = search.search_hits(index, table, "running", fuzziness=0, size=150).collect()
    assert len(hits) == 20 and all("the <strong>runs</strong>" in h.title and "<strong>" not in h.summary for h in hits) and hits[0].total == 40
    plan = index.matching({"title": ["run"]}, 0)._jdf.queryExecution().executedPlan().toString()
    assert "= run)" in plan or "IN (run)" in plan


def test_misspelt_words_are_looked_up_by_key(spark):
    pick = random.Random(4)
    words = ["".join(pick.choices("abc", k=pick.randint(1, 9))) for _ in range(300)] + ["x" * 23, "x" * 24, "x" * 25, "x" * 40]
    index = search.write_index(search.search_index_build(spark.createDataFrame(list(enumerate(words)), "doc_id long, title string"), fields=["title"]), new_path(spark, "test-keys"))
    for asked in ("abcab", "ccbbaa", "x" * 24, "x" * 22, "b", "aabbccaabb", "a", ""):
        for edits in (0, 1, 2):
            near = index.variants([asked], edits)
            found = {r.term for r in near.where(F.levenshtein("term", F.lit(asked)) <= edits).collect()}
            assert found == {w for w in words if _distance(w, asked) <= edits}, (asked, edits)
    plan = index.keys.where(F.col("key").isin(search.query_keys("abcab", 1)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan
    assert "PushedFilters: [In(head" in index.variants(["abcab"], 1)._jdf.queryExecution().executedPlan().toString()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_marks_of_places(spark):
    rows = [("Ran, RAN -- ran!", [0, 2]), ("  ran to", [0]), ("", [0]), ("--", [0]), ("a b c", [])]
    got = spark.createDataFrame(rows, "t string, at array<int>").select(search.mark_places("t", F.col("at"), "<", ">")).collect()
    assert [r[0] for r in got] == ["<Ran>, RAN -- <ran>!", "  <ran> to", "", "--", "a b c"]


def test_a_large_batch_is_sorted_by_many_tasks(spark, monkeypatch):
    """Whatever the caller says, one task does not sort all postings of a large batch."""
    monkeypatch.setattr(segments, "FILE_ROWS", 500)
    monkeypatch.setattr(search, "FILE_ROWS", 500)
    path = new_path(spark, "test-segments")
    segments.add_segment(path, docs(spark, [(i, f"alpha beta w{i}") for i in range(400)]))
    postings = spark.read.parquet(f"{path}/postings/seg=0")
    files = [r["count"] for r in postings.groupBy(F.input_file_name()).count().collect()]
    assert len(files) >= postings.count() // 500 and max(files) < 1000
    assert len(scores(segments.read_segments(spark, path), "alpha")) == 400


def test_compaction_sends_no_posting_for_the_dead(spark, monkeypatch):
    """Dead documents are found among the lengths and left out by a filter; whatever way is taken, the same postings stay."""
    path, rows = new_path(spark, "test-segments"), [(i, f"alpha beta w{i}") for i in range(300)]
    segments.add_segment(path, docs(spark, rows[:200]), large=True)
    segments.add_segment(path, docs(spark, [(i, "gamma") for i in range(150, 200)]))
    segments.add_segment(path, docs(spark, rows[100:]), removed=spark.createDataFrame([(3,), (7,)], "doc_id long"))
    log = segments.read_log(spark, path)
    numbers = [n for n, _ in log.live]
    want = segments._living(spark, path, log, "postings", numbers)
    rows_of = lambda df: sorted(tuple(map(str, r)) for r in df.select("term", "field", "doc_id", "len", "tf", "places", "first").collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got, about, living = segments._living_postings(spark, path, log, numbers)
    assert {r.doc_id for r in living.collect()} == {r.doc_id for r in want.select("doc_id").distinct().collect()}
    assert "LeftAnti" not in plan(got) and abs(about - want.count()) <= 2 and rows_of(got) == rows_of(want)
    # Living documents that the filter takes for dead ones are listed.
    monkeypatch.setattr(segments, "MARK_BITS", 1)
    monkeypatch.setattr(segments, "MARK_PLACES", 1)
    assert rows_of(segments._living_postings(spark, path, log, numbers)[0]) == rows_of(want)
    monkeypatch.setattr(segments, "MAX_PUSHED", 0)
    joined = segments._living_postings(spark, path, log, numbers)[0]
    assert "LeftAnti" in plan(joined) and rows_of(joined) == rows_of(want)


def test_texts_of_a_batch_are_dealt_to_ranges_as_they_are_counted(spark, monkeypatch):
    """The stored files are ranges of term, field and document; a common term is several of them. Nothing is stored unsorted."""
    monkeypatch.setattr(search, "FILE_ROWS", 300)
    monkeypatch.setattr(search, "BOUND_DOCS", 64)
    monkeypatch.setattr(segments, "FILE_ROWS", 300)
    aside = []
    monkeypatch.setattr(search, "write_aside", lambda df, name, write=search.write_aside: aside.append(write(df, name)) or aside[-1])
    path = new_path(spark, "test-segments")
    segments.add_segment(path, docs(spark, [(i, f"alpha é w{i} alpha") for i in range(500)]))
    assert [a.columns for a in aside] == [["term", "field", "doc_id"]]
    stored = spark.read.parquet(f"{path}/postings/seg=0")
    files = {}
    for r in stored.select(F.input_file_name().alias("f"), "term", "field", "doc_id").collect():
        files.setdefault(r.f, []).append((r.term, r.field, r.doc_id))
    assert len(files) > 10 and all(rows == sorted(rows) for rows in files.values())
    ranges = sorted((rows[0], rows[-1]) for rows in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and sum(a[0] == b[0] == "alpha" for a, b in ranges) > 1
    # Title, summary and content have 4, 3 and 5 different words.
    assert stored.count() == 500 * 12 and stored.where("first").count() == 1500 and max(map(len, files.values())) < 900


def test_merged_files_are_ranges(spark, monkeypatch):
    monkeypatch.setattr(search, "FILE_ROWS", 300)
    path = new_path(spark, "test-segments")
    for some in (range(0, 300, 2), range(1, 300, 2), range(100, 200)):
        segments.add_segment(path, docs(spark, [(i, f"alpha beta w{i} alpha") for i in some]))
    assert segments.compact(spark, path, everything=True)
    stored, files = spark.read.parquet(f"{path}/postings"), {}
    for r in stored.select(F.input_file_name().alias("f"), "term", "field", "doc_id").collect():
        files.setdefault(r.f, []).append((r.term, r.field, r.doc_id))
    ranges = sorted((rows[0], rows[-1]) for rows in files.values())
    assert len(files) > 6 and max(map(len, files.values())) < 900 and all(rows == sorted(rows) for rows in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and stored.count() == stored.select("term", "field", "doc_id").distinct().count() == 300 * 12


def test_lead_sentences_are_those_of_the_whole_text(spark):
    from newsloom.functions.text import lead_sentences, sentences, strip

    texts = ["A. B! C? D. E", "A. B! C? ", "  A. \n B", ". . . . x", "", "  ", ". ", "no end", None, "A.  B.  ", "x. ", "a! b! "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.array_join(F.transform(F.slice(sentences("t"), 1, 3), strip), " ")
    rows = df.select(lead_sentences("t", 3), whole, lead_sentences("t", 1)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and rows[0][0] == "A. B! C?" and rows[0][2] == "A."
    plan = df.select(lead_sentences("t", 3))._jdf.queryExecution().optimizedPlan().toString()
    assert ", 4)" in plan
