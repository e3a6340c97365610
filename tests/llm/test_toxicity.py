"""Held-out accuracy, and what the model does with odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from newsloom.llm.queries import QUERIES
from newsloom.llm.toxicity import fit, score, toxicity, train


def ranking(scores, truth):
    order = np.argsort(np.argsort(scores))
    good = truth == 1
    return (order[good].mean() - (good.sum() - 1) / 2) / (~good).sum()


def invented(rng, n):
    marks = ["zorgluk", "blarnix", "quimble"]
    for i in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 200))]
        toxic = rng.random() < 0.12
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(marks))
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy(spark, frame):
    rows = list(invented(random.Random(2), 3000))
    docs = frame([(i, t, "s") for i, t, _ in rows])
    # Half of the documents have a label.
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 3000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].score, got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    scores, predicted, truth = map(np.array, zip(*held, strict=True))
    assert ranking(scores, truth) > 0.98
    assert (predicted[truth == 0] == 1).mean() < 0.02 and (predicted[truth == 1] == 1).mean() > 0.9


def test_held_out_labels_are_not_read(spark, frame):
    rows = list(invented(random.Random(3), 800))
    docs = frame([(i, t, "s") for i, t, _ in rows])
    schema = "doc_id long, quality int, toxic int"
    honest = [(i, 1, y) for i, _, y in rows]
    turned = [(i, q, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, y) for i, q, y in honest]
    assert train(docs, spark.createDataFrame(honest, schema)) == train(docs, spark.createDataFrame(turned, schema))


def test_fixture_columns(spark, sf_dir):
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_edge_cases(spark, frame, odd_texts):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (7, 1, None), (None, 1, 1), (99, 1, 1), (4, 0, 1)], schema)
    got = toxicity(frame(odd_texts), labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity(frame([]), labels).collect() == []
    none = toxicity(frame(odd_texts), spark.createDataFrame([], schema)).collect()
    assert {r.predicted for r in none} == {0}


def test_score_is_the_same_for_copies(frame):
    df = score(frame([(1, "Foo bar", "s"), (2, "foo  BAR", "s"), (3, None, "s")]), ({5: 1.0}, -1.0), ["doc_id", "score", "text"])
    assert df.columns == ["doc_id", "score", "text", "score"] and df.count() == 3


def test_risk_stays_non_negative():
    """Positive rows alone carry a feature; the fit finds it and gives the rest a low score."""
    rows = np.zeros((400, 2), np.float32)
    rows[:50, 0] = 1
    rows[50:70, 0] = 1
    rows[::2, 1] = 1
    weights, bias = fit(rows, np.arange(400) < 50, 20 / 350)
    assert weights[0] + bias > 0 and bias < 0 and abs(weights[1]) < abs(weights[0]) / 3


def test_held_out_accuracy_on_the_given_labels(spark):
    """Of the held-out documents of the larger table: toxic ones stand above others, most are caught, few others are."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, sf_dir).collect() if r.held_out and labels.get(r.doc_id) is not None]
    truth, scores = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert ranking(scores, truth) > 0.9
    assert (scores[truth == 1] >= 0.5).mean() > 0.8 and (scores[truth == 0] >= 0.5).mean() < 0.05
