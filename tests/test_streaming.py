from __future__ import annotations

import json

from pyspark.sql import functions as F

from newsloom.session import new_path
from newsloom.streaming import jobs


def drop(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def run(*queries):
    for q in queries:
        q.awaitTermination()
        assert q.exception() is None


def test_bronze_takes_each_file_once(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    drop(raw, "1.json", [{"url": "a", "src": "s"}, {"url": "b", "src": "s"}])

    def go():
        df = jobs.article_stream(spark, str(raw))
        run(*jobs.bronze_stream(df, f"{out}/bronze", f"{out}/errors", f"{out}/cp", F.lit("2024-01-01 05:00:00").cast("timestamp")))
        return (sorted(r.url for r in spark.read.parquet(f"{out}/bronze").collect()), spark.read.schema("_corrupt string").parquet(f"{out}/errors").count())

    assert go() == (["a", "b"], 0)
    drop(raw, "2.json", [{"url": "c", "src": "s", "hour": ""}])
    drop(raw, "3.json", '[{"url": ')
    assert go() == (["a", "b", "c"], 1)
    assert go() == (["a", "b", "c"], 1)
    assert {(str(r.ingest_date), r.ingest_hour) for r in spark.read.parquet(f"{out}/bronze").collect()} == {("2024-01-01", 5)}


def message(**over):
    base = {
        "update_type": "general", "timestamp": "t", "details": {"date": "2024-01-01", "hours": [5, 6], "table": "Articles"},
        "time_range": {"from": "2024-01-01T05:10:00Z", "to": "2024-01-01T06:20:00+00:00"},
    }
    return json.dumps({**base, **over})


def test_messages(spark):
    bad = [
        "{oops", "[]", message(update_type="other"), message(details=None), message(details={"date": "d", "hours": []}),
        message(details={"hours": [1]}), message(time_range={}), message(time_range={"from": "x", "to": ""}),
    ]
    df = spark.createDataFrame([(t,) for t in [message(), *bad]], "value string")
    parsed = jobs.parse_messages(df)
    assert [r.is_update for r in parsed.collect()] == [True] + [False] * len(bad)
    keys = [r.window_key for r in jobs.update_windows(parsed).collect()]
    assert keys == ["2024-01-01_5-2024-01-01_6"]
    unreadable = spark.createDataFrame([(message(time_range={"from": "x", "to": "y"}),)], "value string")
    assert jobs.update_windows(jobs.parse_messages(unreadable)).count() == 0


def test_a_window_goes_through_once(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    schema = "window_key string, t timestamp"

    def go():
        df = spark.readStream.schema(schema).json(str(raw))
        run(jobs.append_stream(jobs.once_per_window(df, "window_key", "t"), f"{out}/t", f"{out}/cp"))
        return sorted(r.window_key for r in spark.read.parquet(f"{out}/t").collect())

    drop(raw, "1.json", '{"window_key":"a","t":"2024-01-01T05:00:00Z"}\n{"window_key":"a","t":"2024-01-01T05:01:00Z"}')
    assert go() == ["a"]
    drop(raw, "2.json", '{"window_key":"a","t":"2024-01-01T05:20:00Z"}\n{"window_key":"b","t":"2024-01-01T05:30:00Z"}')
    assert go() == ["a", "b"]
    # Long after its time the key is forgotten, as a lock that has expired.
    drop(raw, "3.json", '{"window_key":"c","t":"2024-01-02T05:00:00Z"}')
    go()
    drop(raw, "4.json", '{"window_key":"a","t":"2024-01-02T05:10:00Z"}')
    assert go() == ["a", "a", "b", "c"]


def test_replayed_batch_replaces_itself(spark):
    path = new_path(spark, "batches")
    for _ in range(2):
        jobs.replace_batch(spark.range(3), path, 7)
    jobs.replace_batch(spark.range(2), path, 8)
    assert spark.read.parquet(path).count() == 5


def test_dedup_looks_at_the_table_too(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "t")
    schema = "src string, url string, t timestamp, day string"

    def go(cp):
        df = spark.readStream.schema(schema).json(str(raw))
        run(jobs.dedup_stream(df, out, cp, ["src", "url"], "t", ["day"]))
        return sorted(r.url for r in spark.read.parquet(out).collect())

    drop(raw, "1.json", "\n".join(json.dumps({"src": "s", "url": u, "t": "2024-01-01T00:00:00Z", "day": "1"}) for u in "aab"))
    assert go(new_path(spark, "cp")) == ["a", "b"]
    drop(raw, "2.json", json.dumps({"src": "s", "url": "c", "t": "2024-01-01T01:00:00Z", "day": "2"}))
    # A lost checkpoint replays everything; the table still holds each article once.
    assert go(new_path(spark, "cp")) == ["a", "b", "c"]


def test_announced_batches_are_scored(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "t")
    articles = spark.createDataFrame(
        [(1, "b1", [1.0, 0.0]), (2, "b1", [0.0, 1.0]), (3, "b2", [1.0, 1.0])], "article_id bigint, batch_id string, embedding array<float>"
    ).withColumns({"categories": F.lit(None).cast("array<string>"), "main_category": F.lit("")})
    trends = spark.createDataFrame([(1, "x", [1.0, 0.0])], "trend_id int, query string, embedding array<float>")
    cp = new_path(spark, "cp")

    def go():
        df = spark.readStream.schema("batch_id string, end_time timestamp").json(str(raw))
        run(jobs.score_batches(df, articles, trends, out, cp))
        return sorted((r.article_id, r.trend, r.main_category) for r in spark.read.parquet(out).collect())

    drop(raw, "1.json", '{"batch_id":"b1","end_time":"2024-01-01T00:00:00Z"}\n{"batch_id":"b1","end_time":"2024-01-01T00:00:00Z"}')
    assert go() == [(1, "x", "General"), (2, None, "General")]
    drop(raw, "2.json", '{"batch_id":"b2","end_time":"2024-01-01T00:10:00Z"}\n{"batch_id":"b1","end_time":"2024-01-01T00:10:00Z"}')
    assert go() == [(1, "x", "General"), (2, None, "General"), (3, "x", "General")]


def test_an_announced_batch_commits_all_its_state(spark, tmp_path):
    """A join that shuffles skips the partitions that have no article; the state of the stream is committed all the same."""
    raw, out = tmp_path / "raw", str(tmp_path / "t")
    articles = spark.createDataFrame([(1, "b1", [1.0, 0.0])], "article_id bigint, batch_id string, embedding array<float>").withColumns(
        {"categories": F.lit(None).cast("array<string>"), "main_category": F.lit("")}
    )
    trends = spark.createDataFrame([(1, "x", [1.0, 0.0])], "trend_id int, query string, embedding array<float>")
    drop(raw, "1.json", "\n".join(json.dumps({"batch_id": f"b{i}", "end_time": "2024-01-01T00:00:00Z"}) for i in range(40)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(jobs.score_batches(spark.readStream.schema("batch_id string, end_time timestamp").json(str(raw)), articles, trends, out, new_path(spark, "cp")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [(r.article_id, r.trend) for r in spark.read.parquet(out).collect()] == [(1, "x")]
