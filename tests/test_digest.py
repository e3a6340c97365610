from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import lead_sentences
from newsloom.operators import digest as op


def news(spark, rows):
    df = spark.createDataFrame(rows, "article_id bigint, main_category string, d string")
    return df.withColumn("publish_ts", F.col("d").cast("timestamp")).drop("d")


def picks(df, k=5):
    return [r.article_id for r in op.diverse_topk(df, k).orderBy("pick").collect()]


def test_few_articles_are_all_taken_newest_first(spark):
    assert picks(news(spark, [(1, "a", "2024-01-01"), (2, "a", "2024-01-03"), (3, "b", "2024-01-02"), (4, "b", None)])) == [2, 3, 1, 4]


def test_round_robin_skips_nothing_and_ends(spark):
    rows = [(i, "a", f"2024-01-{30 - i}") for i in range(6)] + [(10, "b", "2024-01-31"), (11, "c", "2024-01-01"), (12, None, None)]
    # a has six articles; b, c and the one without a category have one each, b has the newest of them.
    assert picks(news(spark, rows)) == [0, 10, 11, 12, 1]
    assert picks(news(spark, rows), 8) == [0, 10, 11, 12, 1, 2, 3, 4]


def test_groups_are_independent(spark):
    df = news(spark, [(i, f"c{i % 2}", f"2024-01-{i + 1:02d}") for i in range(20)]).withColumn("g", F.col("article_id") >= 12)
    got = op.diverse_topk(df, 3, by=["g"]).groupBy("g").agg(F.array_sort(F.collect_list("article_id")).alias("ids"))
    assert {r.g: r.ids for r in got.collect()} == {False: [9, 10, 11], True: [17, 18, 19]}


def reference_timing(text):
    now, out = 0.0, []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if not s.strip():
            continue
        d = len(s.split()) * 0.4
        if len(s) > 100:
            d *= 1.1
        d += 0.1 * s.count(",")
        out.append((round(now, 2), round(now + d, 2), s.strip()))
        now += d + 0.3
    return out


def test_timing(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id < 20")
    extra = spark.createDataFrame([(-1, 0, "x", " Lead, in!  Then. "), (-2, 0, "x", ""), (-3, 0, "x", None)], talks.schema)
    df = talks.unionByName(extra)
    got: dict = {}
    for r in op.transcript_timing(df, "text", ["conv_id", "turn"]).orderBy("conv_id", "turn", "pos").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.start_time, r.end_time, r.text))
    for r in df.where("text <> ''").collect():
        want = reference_timing(r.text)
        assert [(pytest.approx(a, abs=0.011), pytest.approx(b, abs=0.011), s) for a, b, s in want] == got[(r.conv_id, r.turn)]
    assert (-2, 0) not in got and (-3, 0) not in got


def test_running_offset_over_many_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"), (F.col("id") % 11).alias("v"))
    got = {(r.k, r.p): r.offset for r in op.running_offset(df, "k", "p", "v", chunk=16).collect()}
    total = {0: 0, 1: 0, 2: 0}
    for i in range(1000):
        assert got[(i % 3, i)] == total[i % 3]
        total[i % 3] += i % 11


def test_line_at_a_moment(spark):
    lines = spark.createDataFrame(
        [(1, 0, 0.0, 2.0, "a"), (1, 1, 2.0, 30.0, "b"), (1, 2, 25.0, 40.0, "c"), (1, 3, 40.0, 40.0, "none")],
        "k int, pos int, start_time double, end_time double, text string",
    )
    points = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate([(1, 0.0), (1, 2.0), (1, 29.9), (1, 30.0), (1, 40.0), (2, 1.0), (1, -1.0)])],
                                   "id int, k int, t double")
    got = [r.text for r in op.transcript_at(lines, points, "k", "id").orderBy("id").collect()]
    assert got == ["a", "b", "b", "c", None, None, None]


def test_lengths(spark):
    cases = ["120", '{"female_voice": 90.5, "male_voice": 80}', '{"male_voice": 80}', "null", "oops", None]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(op.digest_length_any("c")).collect()] == [120.0, 90.5, 0.0, 0.0, 0.0, 0.0]


def test_stored_script_may_be_text_or_array(spark):
    line = '[{"startTime":0.0,"endTime":1.5,"text":"x"}]'
    text = '{"female_voice": "[{\\"startTime\\":0.0,\\"endTime\\":1.5,\\"text\\":\\"x\\"}]"}'
    df = spark.createDataFrame([(text,), (f'{{"female_voice": {line}}}',), ("{}",)], "c string")
    got = [r[0] for r in df.select(op.read_voice_script("c", "female_voice")).collect()]
    assert [[tuple(x) for x in lines] for lines in got] == [[(0.0, 1.5, "x")], [(0.0, 1.5, "x")], []]


def test_digest(spark):
    p = spark.createDataFrame([(1, 2, "two.", "u2", "2024-05-05 09:00:00"), (1, 1, "one.", "u1", "2024-05-04 09:00:00"), (1, 3, "three.", "", None)],
                              "g int, pick int, summary string, url string, d string")
    row = op.digest_build(p.withColumn("publish_ts", F.col("d").cast("timestamp")), ["g"], "Hi.", "Bye.", "X", "2000-01-01 00:00:00").first()
    assert row.script == "Hi. one. two. three. Bye." and row.links == ["u1", "u2"]
    assert row.title == "X Morning Update - May 05, 2024 09:00 AM"


def test_summaries_are_filled_only_where_missing(spark):
    df = spark.createDataFrame([("A. B! C? D.", None), ("A. B.", "kept"), ("A.", "")], "content string, summary string")
    assert [r.summary for r in op.summary_fill(df).collect()] == ["A. B! C?", "kept", "A."]
    assert [r.summary for r in op.summary_fill(df, F.upper).collect()] == ["A. B! C? D.", "kept", "A."]
    assert df.select(lead_sentences("content", 1)).first()[0] == "A."


def test_diverse_selection_by_text_ids(spark):
    rows = [("b", "A", 5), ("a", "A", 5), ("c", "A", 4), ("e", "B", 5), ("d", "B", 1), ("f", None, 9)]
    df = spark.createDataFrame(rows, "article_id string, main_category string, n int").selectExpr("article_id", "main_category", "timestamp_seconds(n) AS publish_ts")
    picks = op.diverse_topk(df, 4).orderBy("pick").collect()
    assert [r.article_id for r in picks] == ["a", "e", "f", "b"]
