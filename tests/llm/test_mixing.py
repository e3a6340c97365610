"""The mix against following its rules step by step."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from newsloom.llm.mixing import curriculum, due, mixed, segments, word_count


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair(sizes, weights, most=3):
    """Targets by sharing again and again what is above the most."""
    total, target = sum(sizes.values()), {s: 0.0 for s in sizes}
    open_, left = {s for s in sizes if sizes[s]}, float(sum(sizes.values()))
    while left > 1e-9 and open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        left = 0.0
        for s, extra in share.items():
            target[s] += extra
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    assert abs(sum(target.values()) - total) < 1e-6
    return target


def check(df, rows):
    plan = curriculum(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = fair(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert sum(r.copies for r in plan) == len(rows)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in plan:
        assert 0 <= r.takes <= 3 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        assert (r.positions is None) == (r.takes == 0) and sorted(r.positions or []) == (r.positions or [])
        assert all(0 <= p <= 1 for p in r.positions or [])
        taken[r.source] += r.size * r.takes * r.copies
        largest[r.source] = max(largest[r.source], r.size * r.copies)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return plan


def test_edge_cases(frame, odd_texts):
    check(frame(odd_texts), odd_texts)
    check(frame([(1, None, None), (2, "", "a")]), [(1, None, None), (2, "", "a")])
    assert curriculum(frame([])).collect() == []


def test_targets_stop_and_reruns_agree(frame):
    rows = [(i, "w " * (i % 37 + 1), f"s{(i * i) % 11 if i % 3 else 0}") for i in range(900)]
    first = check(frame(rows), rows)
    again = check(frame(rows[::-1]), rows)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mixed_repeats_rows_in_order(frame):
    rows = [(i, f"t{i} " * (i % 5 + 1), "big" if i % 4 else "small") for i in range(200)]
    df = frame(rows)
    plan = {r.doc_id: r for r in curriculum(df).collect()}
    out = mixed(df).collect()
    assert out[0].asDict().keys() == set(df.columns)
    assert len(out) == sum(r.takes for r in plan.values())
    wanted = sorted((p, r.doc_id) for r in plan.values() for p in r.positions or [])
    assert [r.doc_id for r in out] == [d for _, d in wanted]


def test_due_inverts_the_integral(spark):
    knots = "array(struct(0D AS t, 0D AS w), struct(0.25D AS t, 2D AS w), struct(0.5D AS t, 0D AS w), struct(0.75D AS t, 0D AS w), struct(1D AS t, 3D AS w))"
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u"), segments(F.expr(knots)).alias("p"))
    for r in df.select("u", due(F.col("p"), F.col("u")).alias("t"), F.element_at("p", -1)["a1"].alias("all")).collect():
        area = 0.0
        for t0, t1, w0, w1 in ((0, 0.25, 0, 2), (0.25, 0.5, 2, 0), (0.5, 0.75, 0, 0), (0.75, 1, 0, 3)):
            x = min(max(r.t - t0, 0), t1 - t0)
            area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        assert area == pytest.approx(r.u * r["all"], abs=1e-9)


def test_word_count(spark, odd_texts):
    df = spark.createDataFrame([(t,) for _, t, _ in odd_texts], "text string")
    assert [r.n for r in df.select(word_count("text").alias("n")).collect()] == [count(t) for _, t, _ in odd_texts]


def test_empty_documents_of_a_source_taken_whole(frame):
    """A document without words is not taken more often than others."""
    rows = [(i, "" if i % 2 else "two words", "a") for i in range(60)] + [(100 + i, "word " * 50, "b") for i in range(40)]
    plan = check(frame(rows), rows)
    assert max(r.takes for r in plan if r.source == "a") == 3
