"""The pipeline, each stage followed by brute force on the rows it was given."""

from __future__ import annotations

import public_tokenizers
from test_minhash import _left_rows
from test_minhash import exact as exact_components
from test_mixing import count
from test_suffix import exact as exact_cuts
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    seen = {"input": docs}
    for name, stage in stages.items():
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        seen[name] = docs
        assert name == "tokens" or docs.columns == seen["input"].columns
    rows = {name: df.collect() for name, df in seen.items()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in rows["input"]} - {r.doc_id for r in rows["toxicity"]}
    assert len(gone & toxic) > len(toxic) / 2 and len(rows["toxicity"]) > 0.85 * len(rows["input"])
    component = exact_components([(r.doc_id, r.text) for r in rows["toxicity"]], 4, 5)
    assert sorted(r.doc_id for r in rows["near duplicates"]) == sorted(i for i, c in component.items() if i == c)
    given = sorted(rows["near duplicates"])
    cut = {r.doc_id: r for r in rows["repeated passages"]}
    for r, (*_, kept) in zip(given, exact_cuts([r.text for r in given], 200), strict=True):
        text = kept.decode("utf-8", "ignore")
        assert (cut[r.doc_id].text, cut[r.doc_id].n_chars) == (text, len(text))
    mixed, sizes, taken = rows["mixing"], {}, {}
    for r in rows["repeated passages"]:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + count(r.text)
    assert sum(taken.values()) > 0.9 * sum(sizes.values()) and all(taken[s] <= 3 * sizes[s] for s in taken)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    assert len(rows["tokens"]) == len(mixed)
    for r in rows["tokens"]:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and df.count() > 0


def test_odd_rows(spark, frame, odd_texts, sf_dir):
    docs = frame(odd_texts)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs.withColumn("n_chars", docs.doc_id) if "n_chars" not in docs.columns and "text" in docs.columns else docs, sf_dir), "test-stage")
    assert docs.count() > 0
    empty = frame([]).selectExpr("*", "0L AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, sf_dir), "test-stage")
    assert empty.count() == 0


def test_documents_that_stay_are_not_joined(frame, monkeypatch):
    """Two of many documents are copies; only few others are looked up among those that go. Rows without id stay."""
    rows = [(i, f"one two three four five six number {i} of many {i * 7919}", "s") for i in range(1500)]
    rows += [(5000 + i, rows[i][1], "s") for i in (3, 4)] + [(None, rows[3][1], "s")]
    docs = frame(rows)
    sizes = _left_rows(monkeypatch, docs, docs.columns)
    got = corpus_pipeline.minhash_stage(docs.sparkSession, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, *_ in rows if i is None or i < 5000)
    assert sizes and max(sizes) < 300
