from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from newsloom.operators import search as op
from newsloom.session import new_path

DOCS = [
    (1, "Cats and dogs", "A cat story", "The cat sat on the mat", "2024-01-01"),
    (2, "Dogs", "", "the dog and the cat ran", "2024-01-03"),
    (3, "Market news", None, "stocks fell", "2024-01-02"),
    (4, "Running the cats", "x", "y", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id int, title string, summary string, content string, d string")
    return df.withColumn("publish_ts", F.col("d").cast("timestamp")).drop("d")


@pytest.fixture(scope="module")
def index(docs):
    return op.search_index_build(docs)


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_all_words_have_to_be_in_one_field(index, docs):
    assert ids(op.search(index, docs, "the cat", fuzziness=0)) == [2, 1]
    assert ids(op.search(index, docs, "dogs sat", fuzziness=0)) == []
    assert sorted(ids(op.search(index, docs, "dogs sat", fuzziness=0, operator="or"))) == [1, 2]


def test_dates_come_first_and_missing_ones_last(index, docs):
    assert ids(op.search(index, docs, "")) == [2, 3, 1, 4]
    assert ids(op.search(index, docs, " ", page=2, size=3)) == [4]
    hits = op.search(index, docs, "cats", fuzziness=0, order="score").collect()
    assert [r.doc_id for r in hits] == [1, 4] and hits[0].total == 2


def test_score_by_hand(index):
    got = {r.doc_id: r.score for r in op.bm25_rank(index, ["cat"], "content").collect()}
    lengths, n, df = {1: 6, 2: 6, 3: 2, 4: 1}, 4, 2
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    for d in (1, 2):
        want = idf * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[d] / (15 / 4)))
        assert got[d] == pytest.approx(want)


def test_the_best_boosted_field_counts(index):
    scores = {r.doc_id: r.score for r in op.search_scores(index, "dogs", fuzziness=0).collect()}
    title = {r.doc_id: r.score for r in op.bm25_rank(index, ["dogs"], "title").collect()}
    assert scores == {d: pytest.approx(3 * s) for d, s in title.items()}


def test_fuzzy_words(index, docs):
    assert ids(op.search(index, docs, "stoks")) == [3]
    assert ids(op.search(index, docs, "xtoxs")) == []
    assert [op.allowed_edits("a" * n, "AUTO") for n in (1, 2, 3, 5, 6, 9)] == [0, 0, 1, 1, 2, 2]


def test_a_variant_of_two_words_counts_for_both(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "cats cart")], "doc_id int, title string")
    index = op.search_index_build(docs, fields=["title"])
    found = op.search_scores(index, "cat cart", {"title": 1.0})
    assert {r.doc_id for r in found.collect()} == {1, 2}


def test_english_titles(docs):
    index = op.search_index_build(docs, analyzers={"title": op.ENGLISH})
    terms = {(r.field, r.term) for r in index.postings.where("doc_id = 4").collect()}
    assert {("title", "run"), ("title", "cat")} <= terms and ("title", "the") not in terms
    assert sorted(r.doc_id for r in op.search_scores(index, "the cats", {"title": 3.0}, fuzziness=0).collect()) == [1, 4]
    assert op.search_scores(index, "the", {"title": 3.0}, fuzziness=0).count() == 0


def test_stored_index_gives_the_same_scores(spark, index):
    stored = op.write_index(index, new_path(spark, "index"))
    for query in ("the cat", "dgs"):
        a, b = (sorted((r.doc_id, r.score) for r in op.search_scores(i, query).collect()) for i in (index, stored))
        assert a == [(d, pytest.approx(s)) for d, s in b] and a


def test_terms_reach_the_stored_scan(spark, index):
    stored = op.write_index(index, new_path(spark, "index"))
    plan = op.search_scores(stored, "the cat", fuzziness=0)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [cat,the])" in plan


def test_more_variants_than_can_be_pushed_are_joined(index, docs, monkeypatch):
    pushed = sorted((r.doc_id, r.score) for r in op.search_scores(index, "the cats").collect())
    monkeypatch.setattr(op, "MAX_PUSHED", 1)
    assert sorted((r.doc_id, pytest.approx(r.score)) for r in op.search_scores(index, "the cats").collect()) == pushed and pushed


def test_highlight_and_fragments(spark):
    df = spark.createDataFrame([("The catalog, CAT cat-like été cat",)], "t string")
    got = df.select(op.highlight("t", ["cat"])).first()[0]
    assert got == "The catalog, <strong>CAT</strong> <strong>cat</strong>-like été <strong>cat</strong>"
    long = " ".join(["word"] * 100 + ["cat"] + ["word"] * 100 + ["cat"] * 2)
    pieces = spark.createDataFrame([(long,)], "t string").select(op.fragments("t", ["cat"])).first()[0]
    assert len(pieces) == 2 and all("<strong>cat</strong>" in p for p in pieces)
    assert all(len(p.replace("<strong>", "").replace("</strong>", "")) <= 150 for p in pieces)


def test_many_terms(index):
    assert op.search_scores(index, " ".join(f"w{i}" for i in range(70))).collect() == []


def test_fragments_keep_runs_without_white_space(spark):
    run = "x" * 130 + "-cat-" + "y" * 130
    pieces = spark.createDataFrame([("dog " + run + " cat end",)], "t string").select(op.fragments("t", ["cat"], size=150, count=5)).first()[0]
    assert len(pieces) >= 2 and "<strong>cat</strong> end" in pieces[-1]
    assert sum(p.count("<strong>cat</strong>") for p in pieces) == 2


def test_files_of_a_stored_index_stay_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(op, "FILE_ROWS", 300)
    docs = spark.createDataFrame([(i, f"the word{i}", None, "the the end") for i in range(500)], "doc_id long, title string, summary string, content string")
    stored = op.write_index(op.search_index_build(docs), new_path(spark, "test-index")).postings
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 6 and max(sizes) < 600


def test_words_are_counted_inside_a_row(spark, monkeypatch):
    rows = [(1, "b a b", "", None), (1, "b", "É é", "x"), (None, None, "the running the", "Ǆ 日本")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, summary string, content string")
    found = op.document_terms(docs, "doc_id", ["title", "summary", "content"], {"summary": op.ENGLISH}).collect()
    assert sorted((r.doc_id or 0, r.field, r.term, r.len, r.tf, tuple(r.places), r.first) for r in found) == sorted([
        (1, "title", "a", 3, 1, (1,), True), (1, "title", "b", 3, 2, (0, 2), False), (1, "title", "b", 1, 1, (0,), True), (1, "summary", "é", 2, 2, (0, 1), True),
        (1, "content", "x", 1, 1, (0,), True), (0, "summary", "run", 1, 1, (1,), True), (0, "content", "ǆ", 2, 1, (0,), True), (0, "content", "日本", 2, 1, (1,), False),
    ])


def test_head_keys_are_all_deletions(spark):
    terms = spark.createDataFrame([(w,) for w in ("a", "aa", "abc", "aabbcc", "é日本x", "abcdefgh")], "term string")
    want = {(k, r.h) for r in terms.select(op.head("term").alias("h"), op.deletions(op.head("term")).alias("k")).collect() for k in r.k}
    found = [(r.key, r.head) for r in op.head_keys(terms).collect()]
    assert len(found) == len(set(found)) and set(found) == want
