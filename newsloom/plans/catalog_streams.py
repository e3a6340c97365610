"""Streaming jobs run to the end over the tables, next to the batch answer; and the pipeline as a whole."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from newsloom.plans import medallion
from newsloom.plans.catalog import query
from newsloom.plans.catalog_clean import SPACES
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import RECRAWLED, TRENDS, VECTORS, articles, article_vectors, raw_articles, recrawled, table, trends
from newsloom.plans.medallion import check_articles, silver_rows
from newsloom.session import new_path
from newsloom.sources.sinks import write_aside
from newsloom.streaming import jobs

SLOTS = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start,
  (CASE WHEN h < 5 THEN 0 WHEN h < 11 THEN 5 WHEN h < 17 THEN 11 ELSE 17 END)::INT AS slot_start, count(*) AS n
FROM (SELECT ts, hour(ts + INTERVAL 7 HOUR) AS h FROM events) GROUP BY 1, 2"""


def _shown(counts):
    return counts.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "slot_start", "n")


@query(SLOTS)
def slot_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return _shown(jobs.slot_counts(e, "ts"))


def _stream(spark, sf, name):
    """A given table as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(SLOTS)
def slot_counts_stream(spark, sf):
    """The same counts kept by a stream; the last state of every window counts."""
    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    out = new_path(spark, "slot-counts")
    jobs.run_batches(
        jobs.slot_counts(events, "ts"), new_path(spark, "checkpoint"), lambda df, n: jobs.replace_batch(df, out, n), "update"
    ).awaitTermination()
    states = spark.read.parquet(out).groupBy("hour_start", "slot_start").agg(F.max_by("n", "stream_batch").alias("n"))
    return _shown(states)


@query("""SELECT doc_id::VARCHAR AS url, source AS src, lang AS language, md5(text) AS content_md5, 'bronze' AS stored FROM documents WHERE lang <> 'de'
UNION ALL SELECT NULL, NULL, NULL, md5('{"url": ' || doc_id), 'errors' FROM documents WHERE lang = 'de'""")
def bronze_stream(spark, sf):
    """Articles arriving as JSON files; the German ones are cut off in transit."""
    incoming, out = new_path(spark, "incoming"), new_path(spark, "bronze-stream")
    whole = F.to_json(
        F.struct(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("src"), F.col("lang").alias("language"), F.col("text").alias("content"))
    )
    cut = F.concat(F.lit('{"url": '), F.col("doc_id").cast("string"))
    table(spark, sf, "documents").select(F.when(F.col("lang") != "de", whole).otherwise(cut)).write.text(incoming)
    arriving = jobs.article_stream(spark, incoming, multiline=False)
    for q in jobs.bronze_stream(arriving, f"{out}/bronze", f"{out}/errors", f"{out}/checkpoint"):
        q.awaitTermination()
    good = spark.read.parquet(f"{out}/bronze").select("url", "src", "language", F.md5("content").alias("content_md5"), F.lit("bronze").alias("stored"))
    bad = spark.read.parquet(f"{out}/errors").select("url", "src", "language", F.md5("_corrupt").alias("content_md5"), F.lit("errors").alias("stored"))
    return good.unionByName(bad)


def _messages(df):
    """An update message per event; errors are not JSON, sign-ups lack the end of the range."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    span = F.struct(hour.alias("from"), F.when(F.col("event_type") != "signup", hour).alias("to"))
    details = F.struct(
        F.col("user_id").alias("processed_rows"), F.lit("Articles").alias("table"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.array(F.hour("ts")).alias("hours"),
    )
    text = F.to_json(F.struct(F.lit("general").alias("update_type"), hour.alias("timestamp"), details.alias("details"), span.alias("time_range")))
    return df.select("event_id", F.when(F.col("event_type") == "error", F.lit("{oops")).otherwise(text).alias("value"))


@query("""SELECT event_id, event_type NOT IN ('error', 'signup') AS is_update, CASE WHEN event_type NOT IN ('error', 'signup') THEN
  strftime(date_trunc('hour', ts), '%Y-%m-%d_%-H-%Y-%m-%d_%-H') END AS window_key FROM events""")
def messages_stream(spark, sf):
    """Messages parsed and checked by a stream; all of them are kept with the verdict."""
    out = new_path(spark, "messages")
    parsed = jobs.parse_messages(_messages(_stream(spark, sf, "events")))
    jobs.append_stream(parsed, out, new_path(spark, "checkpoint")).awaitTermination()
    stored = spark.read.parquet(out)
    windows = jobs.update_windows(stored).select("event_id", "window_key")
    return stored.select("event_id", "is_update").join(windows, "event_id", "left")


@query("""SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%d_%-H-%Y-%m-%d_%-H') AS window_key FROM events WHERE event_type NOT IN ('error', 'signup')""")
def once_per_window(spark, sf):
    """Many messages announce a window; one of them is let through."""
    out = new_path(spark, "windows")
    windows = jobs.update_windows(jobs.parse_messages(_messages(_stream(spark, sf, "events"))))
    once = jobs.once_per_window(windows.select("window_key", "end_time"), "window_key", "end_time")
    jobs.append_stream(once, out, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("window_key")


@query(f"""WITH {RECRAWLED} SELECT DISTINCT src, url FROM recrawled""")
def dedup_stream(spark, sf):
    """Articles and their re-crawls as a stream; every (src, url) is stored once."""
    incoming, out = new_path(spark, "incoming"), new_path(spark, "dedup")
    rows = recrawled(spark, sf).withColumn("publish_ts", F.col("publish_ts").cast("timestamp"))
    rows.write.parquet(incoming)
    arriving = spark.readStream.schema(rows.schema).parquet(incoming)
    jobs.dedup_stream(arriving, out, new_path(spark, "checkpoint"), ["src", "url"], "publish_ts", ["main_category"], "40 days").awaitTermination()
    return spark.read.parquet(out).select("src", "url")


@query(f"""WITH {VECTORS}, {TRENDS}, s AS (SELECT a.article_id, a.label, t.trend_id, t.query, list_cosine_similarity(a.embedding::DOUBLE[], t.embedding) AS score FROM article_vectors a, trends t),
r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, trend_id) AS rn FROM s)
SELECT article_id, CASE WHEN score >= 0.5 THEN query END AS trend, round(score, 4) AS similarity_score, concat('batch-', label) AS batch_id
FROM r WHERE rn = 1 AND label IN (SELECT user_id % 10 FROM events WHERE event_type = 'purchase')""")
def score_batches(spark, sf):
    """Every purchase announces an upload batch (many times over); its articles are scored once."""
    out = new_path(spark, "trending")
    windows = _stream(spark, sf, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("batch-"), (F.col("user_id") % 10).cast("string")).alias("batch_id"), F.col("ts").cast("timestamp").alias("end_time")
    )
    a = article_vectors(spark, sf).withColumns(
        {
            "batch_id": F.concat(F.lit("batch-"), F.col("label").cast("string")),
            "categories": F.lit(None).cast("array<string>"),
            "main_category": F.lit(None).cast("string"),
        }
    )
    jobs.score_batches(windows, a, trends(spark, sf), out, new_path(spark, "checkpoint"), ttl="40 days").awaitTermination()
    return spark.read.parquet(out).select("article_id", "trend", F.round("similarity_score", 4).alias("similarity_score"), "batch_id")


SILVER = f"""WITH {RECRAWLED}, raw AS (SELECT article_id, src, url, main_category, publish_ts, content,
    CASE src WHEN 'src3' THEN 'No title' WHEN 'src5' THEN '   ' ELSE title END AS title FROM recrawled),
cleaned AS (SELECT * REPLACE (translate(trim(regexp_replace(title, '{SPACES}', ' ', 'g'), ' '), '"''', '') AS title,
  translate(trim(regexp_replace(content, '{SPACES}', ' ', 'g'), ' '), '"''', '') AS content) FROM raw WHERE main_category <> 'Other'),
good AS (SELECT *, row_number() OVER (PARTITION BY src, url ORDER BY publish_ts DESC, title) AS rn FROM cleaned
  WHERE trim(title, ' ') <> '' AND lower(trim(title, ' ')) <> 'no title')
SELECT src, url, title, main_category, md5(content) AS content_md5, strftime(publish_ts, '%Y-%m-%d %H:%M') AS publish_date, dayname(publish_ts) AS weekday,
  '2024-02-01' AS processed_date FROM good WHERE rn = 1"""


@query(SILVER)
def silver_build(spark, sf):
    """Bronze rows cleaned, checked, dated, deduplicated and categorised; "Other" has no readable date."""
    from newsloom.schema import RAW_ARTICLE

    name = F.col("main_category")
    date = F.when(name != "Other", F.date_format("publish_ts", "h:mm a 'UTC', EEE MMMM dd, yyyy")).otherwise(F.lit("some day"))
    title = F.when(F.col("src") == "src3", "No title").when(F.col("src") == "src5", "   ").otherwise(F.col("title"))
    bronze = recrawled(spark, sf).select(
        "src", "url", title.alias("title"), "content", date.alias("publish_date"), F.array(name).alias("categories")
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RAW_ARTICLE if f.name not in bronze.columns}
    full = bronze.withColumns({**missing, "ingest_time": F.lit("2024-02-01 00:00:00").cast("timestamp")})
    silver = silver_rows(write_aside(check_articles(full.drop("_corrupt")), "checked"), "2024-02-01 00:00:00")
    return silver.select(
        "src", "url", "title", "main_category", F.md5("content").alias("content_md5"), F.date_format("publish_ts", "yyyy-MM-dd HH:mm").alias("publish_date"), "weekday", "processed_date"
    )


@query("""WITH d AS (SELECT doc_id, concat('https://news.example.com/', doc_id) AS url, doc_id % 10 = 0 AS untitled, doc_id % 10 = 1 AS undated FROM documents),
good AS (SELECT url FROM d WHERE NOT untitled AND NOT undated)
SELECT 'bronze' AS layer, url, 1::BIGINT AS n FROM d UNION ALL SELECT 'silver', url, 1 FROM good UNION ALL SELECT 'serving', url, 1 FROM good
UNION ALL SELECT 'gold', url, 1 FROM good UNION ALL SELECT CASE WHEN untitled THEN 'invalid' ELSE 'unreadable date' END, url, 1 FROM d WHERE untitled OR undated""")
def medallion_run(spark, sf):
    """The batch run over two slots: the later one first, then the late one, then that once more. Nothing is lost or doubled."""
    d = table(spark, sf, "documents")
    number = F.col("doc_id")
    raw = d.select(
        "doc_id", F.concat(F.lit("https://news.example.com/"), number.cast("string")).alias("url"), F.col("source").alias("src"),
        F.when(number % 10 == 0, "No title").otherwise(F.concat(F.lit("title "), number.cast("string"))).alias("title"),
        F.col("text").alias("content"), F.col("lang").alias("language"),
        F.when(number % 10 == 1, "some day").otherwise("2024-01-31 10:00:00").alias("publish_date"), F.array(F.lit("time_politics")).alias("categories"),
    )
    root = new_path(spark, "lake")
    for slot in (0, 1):
        # Files of one JSON array each, as crawlers leave them.
        arrays = raw.where(number % 2 == slot).groupBy(F.floor(number / 400).alias("file")).agg(F.to_json(F.collect_list(F.struct("url", "src", "title", "content", "language", "publish_date", "categories"))).alias("value"))
        arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/raw{slot}")
    for slot, stamp_, batch in ((1, "2024-02-01 11:00:00", "run-1"), (0, "2024-02-01 05:00:00", "run-2"), (0, "2024-02-01 05:00:00", "run-3")):
        paths = medallion.Paths.under(f"{root}/lake", f"{root}/raw{slot}")
        medallion.run(spark, paths, stamp_, batch)
    layers = [(name, getattr(paths, name)) for name in ("bronze", "silver", "serving", "gold")]
    found = [spark.read.parquet(path).select(F.lit(name).alias("layer"), "url") for name, path in layers]
    found.append(spark.read.parquet(f"{paths.silver}_errors").select(F.col("problem").alias("layer"), "url"))
    return functools.reduce(lambda a, b: a.unionByName(b), found).groupBy("layer", "url").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT event_id, concat('w', event_id % 97) AS window_key, ts FROM events),
last AS (SELECT window_key, max(ts) AS done FROM m WHERE event_id % 3 = 0 GROUP BY window_key),
first AS (SELECT window_key, min(ts) AS ts FROM m WHERE event_id % 3 = 1 GROUP BY window_key)
SELECT f.window_key, done IS NULL AS never FROM first f LEFT JOIN last l USING (window_key) WHERE done IS NULL OR f.ts >= done + INTERVAL 24 HOUR OR window_key IN ('w1', 'w2')""")
def open_windows(spark, sf):
    """Windows asked for by a third of all events, when those of another third are completed and two of them released."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("w"), (F.col("event_id") % 97).cast("string")).alias("window_key"), F.col("ts").cast("timestamp").alias("end_time"))
    done = e.where("event_id % 3 = 0").groupBy("window_key").agg(F.max("end_time").alias("at"))
    log = done.select("window_key", F.lit("completed").alias("state"), "at", F.lit("2024-06-01").cast("timestamp").alias("noted"), F.lit(2).alias("phase"))
    freed = log.where("window_key IN ('w1', 'w2')").withColumns({"state": F.lit("released"), "noted": F.lit("2024-06-02").cast("timestamp"), "phase": F.lit(1)})
    free = jobs.open_windows(e.where("event_id % 3 = 1"), log.unionByName(freed))
    return free.join(done.select("window_key", "at"), "window_key", "left").select("window_key", F.col("at").isNull().alias("never"))
