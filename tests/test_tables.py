from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from newsloom.operators import incremental, serving, tables
from newsloom.plans import medallion
from newsloom.session import new_path
from newsloom.sources import articles as sources
from newsloom.sources import sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = tables.upsert(target, source, ["k"])
    assert rows(once, "k", "v") == [(1, "a"), (2, "B"), (3, "C"), (None, "n")]
    assert rows(tables.upsert(once, source, ["k"]), "k", "v") == rows(once, "k", "v")
    assert rows(tables.upsert(target, source, ["k"], "insert_new").where("k = 2"), "v") == [("b",)]
    with pytest.raises(ValueError):
        tables.upsert(target, source, ["k"], "other")


def test_merge_moves_rows_between_folders(spark):
    path = new_path(spark, "t")
    first = spark.createDataFrame(
        [(1, "x", "a"), (2, "x", "b"), (3, "y", "c"), (4, "z: 1/2", "d"), (6, None, "f")], "k int, p string, v string"
    )
    sinks.merge_into(spark, path, first, ["k"], ["p"])
    source = spark.createDataFrame([(1, "y", "A"), (4, "x", "D"), (5, "w", "E"), (6, "w", "F")], "k int, p string, v string")
    for _ in range(2):
        sinks.merge_into(spark, path, source, ["k"], ["p"])
        want = [(1, "y", "A"), (2, "x", "b"), (3, "y", "c"), (4, "x", "D"), (5, "w", "E"), (6, "w", "F")]
        assert rows(spark.read.parquet(path), "k", "p", "v") == want


def test_merge_rewrites_only_touched_folders(spark):
    import os

    path = new_path(spark, "t")
    sinks.merge_into(spark, path, spark.range(9).selectExpr("id AS k", "id % 3 AS p", "0 AS v"), ["k"], ["p"])
    files = {p: sorted(os.listdir(f"{path}/p={p}")) for p in range(3)}
    sinks.merge_into(spark, path, spark.createDataFrame([(4, 1, 7)], "k bigint, p bigint, v int"), ["k"], ["p"])
    assert [sorted(os.listdir(f"{path}/p={p}")) == files[p] for p in range(3)] == [True, False, True]
    assert rows(spark.read.parquet(path).where("v = 7"), "k") == [(4,)]


def test_merge_keeps_folder_names_and_reads_only_touched_folders(spark):
    import os

    path = new_path(spark, "t")
    sinks.merge_into(spark, path, spark.createDataFrame([(1, "03"), (2, "04"), (3, None)], "k int, h string"), ["k"], ["h"])
    sinks.merge_into(spark, path, spark.createDataFrame([(1, "03"), (4, None)], "k int, h string"), ["k"], ["h"])
    assert sorted(d for d in os.listdir(path) if d.startswith("h=")) == ["h=03", "h=04", "h=__HIVE_DEFAULT_PARTITION__"]
    stored = sinks.read_like(spark, path, ["h"], spark.createDataFrame([], "h string"))
    assert rows(stored, "k", "h") == [(1, "03"), (2, "04"), (3, None), (4, None)]
    scan = stored.where(sinks._folder(["h"]).isin(["03"]))
    assert "PartitionFilters: [(concat_ws" in scan._jdf.queryExecution().executedPlan().toString()


def test_merge_insert_new_keeps_stored_rows(spark):
    path = new_path(spark, "t")
    sinks.merge_into(spark, path, spark.createDataFrame([(1, "a")], "k int, p string"), ["k"], ["p"])
    sinks.merge_into(spark, path, spark.createDataFrame([(1, "b"), (2, "b")], "k int, p string"), ["k"], ["p"], "insert_new")
    assert rows(spark.read.parquet(path), "k", "p") == [(1, "a"), (2, "b")]


def test_dedup_is_deterministic_and_survives_a_hot_key(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("t"), "id"
    )
    got = tables.dedup_latest(df, ["k"], ["t"], ["id"])
    assert got.count() == 20001
    assert rows(got.where("k = 'hot'"), "t", "id") == [(6, 6)]


def test_batch_assign_is_dense(spark):
    got = tables.batch_assign(spark.range(1234), 100, "id")
    assert [r.row_index for r in got.orderBy("row_index").collect()] == list(range(1234))
    sizes = [r["count"] for r in got.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [100] * 12 + [34]


def test_crawl_frontier_prefers_top_stories(spark):
    e = spark.createDataFrame(
        [(1, "news", "u"), (2, "cnn_top_stories", "u"), (3, "news", "seen"), (4, "news", ""), (5, "news", None)],
        "entry_id int, category string, url string",
    )
    got = tables.crawl_frontier(e, spark.createDataFrame([("seen",)], "url string"))
    assert rows(got, "entry_id") == [(2,)]


def test_pages_partition_the_result(spark):
    df = spark.range(23).select(F.col("id").alias("article_id"), F.lit("2024-01-01").cast("timestamp").alias("publish_ts"))
    ids = [r.article_id for p in range(1, 6) for r in serving.articles_page(df, p, 5).collect()]
    assert ids == list(range(23))
    assert serving.articles_page(df, 1, 5).first().total == 23


@pytest.mark.parametrize(
    "call",
    [
        lambda: serving.check_page(0, 10), lambda: serving.check_page(1, 51), lambda: serving.check_page(1, 0),
        lambda: serving.check_category("Cooking"), lambda: serving.check_score(-0.1),
    ],
)
def test_parameters_are_checked(call):
    with pytest.raises(ValueError):
        call()
    serving.check_page(1, 500, None)


def test_empty_category_gives_a_null_row(spark):
    df = spark.createDataFrame([(1, "Science", 0.5, "t")], "article_id int, main_category string, similarity_score double, title string")
    got = serving.category_top_picks(df.withColumn("publish_ts", F.lit(None).cast("timestamp")))
    assert [(r.category, r.article_id) for r in got.orderBy("category_ord").collect()] == [
        ("Politics", None), ("Science", 1), ("Sports", None), ("Technology", None), ("Climate", None)
    ]


def test_watermark_takes_the_greatest(spark):
    path = new_path(spark, "control")
    assert incremental.read_watermark(spark, path, "j") == incremental.EPOCH
    for last in ("2024-01-02 00:00:00", "2024-01-01 00:00:00"):
        incremental.advance_watermark(spark, path, "j", last)
    assert incremental.read_watermark(spark, path, "j").startswith("2024-01-02 00:00:00")
    assert incremental.read_watermark(spark, path, "other") == incremental.EPOCH


def test_no_notification_for_an_empty_batch(spark):
    empty = spark.createDataFrame([], "ingest_time timestamp")
    assert incremental.batch_notification(empty, "t", "d", [1], "s", "UTC").count() == 0


def article(n, **over):
    base = {
        "url": f"https://s.org/{n}", "src": "s.org", "title": f"title {n}", "content": f"text {n}", "language": "english",
        "publish_date": "2024-01-01 10:00:00", "categories": ["time_politics"], "hour": "", "author": "Jo",
    }
    return {**base, **over}


def write_raw(folder, name, articles):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(articles), encoding="utf-8")


def test_json_arrays_with_empty_numbers_are_not_corrupt(spark, tmp_path):
    write_raw(tmp_path / "raw", "a.json", [article(1), article(2, hour=7)])
    (tmp_path / "raw" / "b.json").write_text('[{"url": "x", "src"', encoding="utf-8")
    df = sources.read_articles_json(spark, str(tmp_path / "raw")).cache()
    assert df.count() == 3
    kept, damaged = sinks.split_corrupt(df)
    assert damaged.count() == 1 and "_corrupt" not in kept.columns
    assert rows(kept.where("title IS NOT NULL"), "hour") == [("",), ("7",)]


def test_crawled_urls(spark, tmp_path):
    write_raw(tmp_path / "d", "a.json", [{"url": "u1"}, {"url": "u2"}, {"x": 1}])
    write_raw(tmp_path / "d", "b.json", {"url": "u1"})
    assert rows(sources.crawled_urls(spark, str(tmp_path / "d")), "url") == [("u1",), ("u2",)]


def test_stored_schema_wins(spark, tmp_path):
    assert sources.stored_schema(spark, str(tmp_path / "none")) == sources.RAW_ARTICLE
    spark.range(1).write.parquet(str(tmp_path / "t"))
    assert sources.stored_schema(spark, str(tmp_path / "t")).names == ["id"]


def test_slot_scan_prunes_folders(spark):
    path = new_path(spark, "bronze")
    df = spark.range(48).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"))
    sinks.write_partitioned(sinks.with_ingest_columns(df, F.col("ts")), path, ["ingest_date", "ingest_hour"])
    stored = spark.read.parquet(path)
    got = sources.slot_scan(stored, "2024-01-02", range(5, 8))
    assert rows(got, "id") == [(29,), (30,), (31,)]
    assert sources.slot_scan(stored, "2030-01-01", [1]).count() == 0
    two_days = sources.hours_scan(stored, [("2024-01-01", 23), ("2024-01-02", 0)])
    assert rows(two_days, "id") == [(23,), (24,)]
    for scan in (got, two_days):
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_feeds_and_audio(spark, tmp_path):
    xml = "<rss><channel><item><link> u1 </link><title>a</title></item><item><link>u2</link></item></channel></rss>"
    feed = spark.createDataFrame([("c", xml), ("d", "<rss><channel></channel></rss>")], "category string, xml string")
    assert rows(sources.feed_entries(feed), "category", "url") == [("c", "u1"), ("c", "u2")]
    (tmp_path / "a.mp3").write_bytes(b"0" * 40000)
    assert rows(sources.audio_lengths(spark, str(tmp_path)), "seconds") == [(2,)]


def test_whole_run(spark, tmp_path):
    raw = tmp_path / "raw"
    write_raw(raw, "a.json", [
        article(1), article(1, publish_date="2024-01-03 10:00:00", title='newer "title"'), article(2, title="No title"),
        article(3, publish_date="some day"), article(4, publish_date="No publish date"), article(5, url="https://s.org/video/5"),
    ])
    paths = medallion.Paths.under(str(tmp_path / "lake"), str(raw))
    counts = medallion.run(spark, paths, "2024-02-01 03:00:00", "run-1")
    assert counts == {"checked": 5, "invalid": 1, "unreadable": 1}
    silver = spark.read.parquet(paths.silver)
    assert rows(silver, "url", "title", "main_category", "weekday") == [("https://s.org/1", "newer title", "Politics", "Wednesday")]
    assert rows(spark.read.parquet(f"{paths.silver}_errors"), "url", "problem") == [
        ("https://s.org/2", "invalid"), ("https://s.org/3", "unreadable date")
    ]
    # The same run again: nothing doubles in silver and serving.
    medallion.run(spark, paths, "2024-02-01 03:00:00", "run-1")
    assert spark.read.parquet(paths.silver).count() == 1
    # A later run brings one new article; it alone is new for the serving table.
    write_raw(tmp_path / "raw2", "b.json", [article(1, title="again"), article(9)])
    later = medallion.Paths.under(str(tmp_path / "lake"), str(tmp_path / "raw2"))
    medallion.run(spark, later, "2024-02-01 05:00:00", "run-2")
    serving_rows = spark.read.parquet(paths.serving)
    assert rows(serving_rows, "url", "batch_id") == [("https://s.org/1", "run-1"), ("https://s.org/9", "run-2")]
    notes = [json.loads(r.value) for r in spark.read.text(f"{paths.serving}_messages").collect()]
    assert sorted(n["details"]["processed_rows"] for n in notes) == [1, 1]
    gold = spark.read.parquet(paths.gold)
    assert rows(gold, "url", "publish_date") == [
        ("https://s.org/1", datetime.date(2024, 1, 3)), ("https://s.org/9", datetime.date(2024, 1, 1))
    ]


def _shuffled_texts(monkeypatch, df):
    """The sizes of the tables with a content that are joined with others or ranked by key."""
    kind, sizes = type(df), []
    join, column = kind.join, kind.withColumn

    def joined(self, other, *args, **named):
        if "content" in self.columns:
            sizes.append(self.count())
        return join(self, other, *args, **named)

    def ranked(self, name, *args):
        if name == "_rn":
            sizes.append(self.count())
        return column(self, name, *args)

    monkeypatch.setattr(kind, "join", joined)
    monkeypatch.setattr(kind, "withColumn", ranked)
    return sizes


def test_batch_run_shuffles_no_content_while_keys_are_unique(spark, tmp_path, monkeypatch):
    import json

    asides, stored = [], medallion.write_aside
    monkeypatch.setattr(medallion, "write_aside", lambda df, name: asides.append(name) or stored(df, name))
    sizes = _shuffled_texts(monkeypatch, spark.range(1))
    for k, stamp in enumerate(("2024-02-01 03:00:00", "2024-02-01 05:00:00", "2024-02-01 05:00:00")):
        raw = tmp_path / f"raw{k}"
        raw.mkdir()
        some = [{"url": f"https://x/{min(k, 1)}/{i}", "src": "s", "title": f"t {i}", "content": f"text {i}", "publish_date": "2024-01-31 10:00:00", "categories": ["sports"]} for i in range(40)]
        (raw / "a.json").write_text(json.dumps(some))
        medallion.run(spark, medallion.Paths.under(str(tmp_path / "lake"), str(raw)), stamp, f"run-{k}")
    assert sizes == [] and set(asides) == {"checked", "serving-batch"}
    for layer in ("silver", "serving", "gold"):
        assert spark.read.parquet(str(tmp_path / "lake" / layer)).groupBy("url").count().where("count = 1").count() == 80


def test_merge_adds_to_folders_without_a_matched_row(spark):
    import os

    path = new_path(spark, "t")
    sinks.merge_into(spark, path, spark.range(9).selectExpr("id AS k", "id % 3 AS p", "0 AS v"), ["k"], ["p"])
    before = set(os.listdir(f"{path}/p=0"))
    sinks.merge_into(spark, path, spark.createDataFrame([(100, 0, 1)], "k bigint, p bigint, v int"), ["k"], ["p"])
    assert before < set(os.listdir(f"{path}/p=0"))
    batch = spark.createDataFrame([(4, 1, 7), (5, 0, 7), (100, 0, 7), (101, 3, 7)], "k bigint, p bigint, v int")
    for _ in range(2):
        sinks.merge_into(spark, path, batch, ["k"], ["p"])
        want = sorted([(k, k % 3, 0) for k in range(9) if k not in (4, 5)] + [(4, 1, 7), (5, 0, 7), (100, 0, 7), (101, 3, 7)])
        assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "p", "v").collect()) == want


def test_stored_helpers_agree_with_the_plain_ones(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 3, "d"), (2, 1, "e")], "k int, t int, x string")
    assert rows(tables.dedup_stored(df, ["k"], ["t"], ["x"]), "x") == rows(tables.dedup_latest(df, ["k"], ["t"], ["x"]), "x")
    for known in ([], [1], [2], [1, 2, 2], [None]):
        have = spark.createDataFrame([(k,) for k in known], "k int")
        for part in (df, df.where("k = 1"), df.where("k IS NULL")):
            assert rows(tables.new_stored_rows(part, have, ["k"]), "x") == rows(tables.new_rows(part, have, ["k"]), "x")
