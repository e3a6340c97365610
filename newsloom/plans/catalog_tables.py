"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.dates import local_date, slot_start
from newsloom.operators import incremental, tables
from newsloom.operators.vectors import vector_rows
from newsloom.plans.catalog import query
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import ARTICLES, RECRAWLED, articles, recrawled, table
from newsloom.session import new_path
from newsloom.sources import articles as sources
from newsloom.sources import sinks

KEY = ["src", "url"]


def _bronze_events(spark, sf):
    """The events as a table partitioned by ingest date and hour; four ingest runs a day."""
    path = new_path(spark, "bronze")
    runs = table(spark, sf, "events").withColumn("run", F.expr("date_trunc('day', ts)") + F.make_dt_interval(hours=slot_start(F.hour("ts"))))
    bronze = sinks.with_ingest_columns(runs, F.col("run").cast("timestamp")).drop("run")
    sinks.write_partitioned(bronze, path, ["ingest_date", "ingest_hour"], 5000)
    return spark.read.option("mergeSchema", True).parquet(path)


RUNS = """runs AS (SELECT *, CASE WHEN hour(ts) < 5 THEN 0 WHEN hour(ts) < 11 THEN 5 WHEN hour(ts) < 17 THEN 11 ELSE 17 END AS h FROM events)"""


@query(f"""WITH {RUNS} SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS ingest_date, printf('%02d', h) AS ingest_hour FROM runs
WHERE strftime(ts, '%Y-%m-%d') = '2024-01-02' AND h >= 5 AND h < 17""")
def slot_scan(spark, sf):
    bronze = sources.slot_scan(_bronze_events(spark, sf), "2024-01-02", range(5, 17))
    return bronze.select(
        "event_id", "event_type", F.col("ingest_date").cast("string").alias("ingest_date"),
        F.lpad(F.col("ingest_hour").cast("string"), 2, "0").alias("ingest_hour"),
    )


@query(f"""WITH {RUNS} SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, h::INT AS ingest_hour, count(*) AS n, sum(event_id)::BIGINT AS ids,
  strftime(max(ts), '{TS}') AS last FROM runs GROUP BY 1, 2""")
def bronze_write_read(spark, sf):
    """Append to a partitioned table, read it back, count per folder."""
    return _bronze_events(spark, sf).groupBy(
        F.col("ingest_date").cast("string").alias("ingest_date"), F.col("ingest_hour").cast("int").alias("ingest_hour")
    ).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), stamp(F.max("ts")).alias("last"))


@query("""SELECT doc_id::VARCHAR AS url, source AS src, CASE WHEN lang = 'fr' THEN 'No title' ELSE source END AS title,
  'No author' AS author, md5(text) AS content_md5 FROM documents""")
def csv_import_defaults(spark, sf):
    """Documents written as an import CSV with gaps, read back with renamed columns and defaults."""
    path = new_path(spark, "import-csv")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("URL"), F.col("source").alias("Source"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("Title"),
        F.col("text").alias("Contents"), F.lit(None).cast("string").alias("Author(s)"),
    )
    sinks.write_csv(rows, path, ["URL", "Source", "Title", "Contents", "`Author(s)`"])
    got = sources.read_articles_csv(
        spark, path,
        {"URL": "url", "Source": "src", "Title": "title", "Contents": "content", "Author(s)": "author"},
        {"url": "No URL", "src": "No source", "title": "No title", "content": "No content", "author": "No author"},
    )
    return got.select("url", "src", "title", "author", F.md5("content").alias("content_md5"))


@query("""SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS date, count(*) AS n, true AS within_limit FROM events GROUP BY 1""")
def json_batch_sizes(spark, sf):
    """JSON files of at most 500 rows in a folder per local date."""
    path = new_path(spark, "json-batches")
    rows = table(spark, sf, "events").select(local_date(F.col("ts").cast("timestamp")).alias("date"), "event_id", "event_type")
    sinks.write_json_batches(rows, path, 500, ["date"])
    read = spark.read.schema("event_id bigint, event_type string, date string").json(path)
    per_file = read.groupBy("date", F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return per_file.groupBy("date").agg(F.sum("rows").alias("n"), (F.max("rows") <= 500).alias("within_limit"))


UPSERTED = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'"""


def _orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    target = o.where("o_orderstatus <> 'P'")
    source = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return target, source


@query(UPSERTED)
def upsert_merge(spark, sf):
    """Urgent orders update or extend the settled ones."""
    return tables.upsert(*_orders(spark, sf), ["o_orderkey"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def upsert_insert_new(spark, sf):
    return tables.upsert(*_orders(spark, sf), ["o_orderkey"], "insert_new").select("o_orderkey", "o_totalprice")


@query(UPSERTED)
def merge_into_partitions(spark, sf):
    """The same merge into a stored table, rewriting only the folders it touches."""
    target, source = _orders(spark, sf)
    path = new_path(spark, "orders")
    sinks.write_partitioned(target, path, ["o_orderpriority"])
    sinks.merge_into(spark, path, source, ["o_orderkey"], ["o_orderpriority"])
    return spark.read.parquet(path).select(*target.columns)


@query("""SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS uploaded_date, NULL::VARCHAR AS batch_id FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, o_totalprice + 1, '2024-02-01 00:00:00', 'run-1' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def upsert_batch_stamp(spark, sf):
    target, source = _orders(spark, sf)
    merged = tables.upsert_stamped(target, source, ["o_orderkey"], "2024-02-01 00:00:00", "run-1")
    return merged.select(
        "o_orderkey", "o_totalprice", F.date_format("uploaded_date", "yyyy-MM-dd HH:mm:ss").alias("uploaded_date"), "batch_id"
    )


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delete_by_keys(spark, sf):
    """Drop the orders of customers in debt."""
    debt = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.delete_by_keys(table(spark, sf, "orders"), debt, ["o_custkey"]).select("o_orderkey")


@query("""SELECT concat('v/', vec_id) AS url, epoch(ts + CASE WHEN label >= 7 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::BIGINT AS publish_date,
  CASE WHEN label >= 7 THEN 'new' ELSE 'old' END AS state, len(embedding)::INT AS size,
  floor(list_sum([CASE WHEN label >= 7 THEN 2 * x::DOUBLE ELSE x::DOUBLE END FOR x IN embedding]) * 1000 + 0.5)::BIGINT AS total FROM embeddings JOIN (SELECT event_id, date_trunc('second', ts) AS ts FROM events) ON event_id = vec_id WHERE label >= 7 OR label < 9""")
def vector_upsert(spark, sf):
    """Vector rows replaced by url: a new batch overlaps the stored one."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("vec_id"), F.date_trunc("second", "ts").alias("publish_ts"))
    v = table(spark, sf, "embeddings").join(e, "vec_id").withColumn("url", F.concat(F.lit("v/"), F.col("vec_id").cast("string")))
    later = v.where("label >= 7").withColumn("publish_ts", F.col("publish_ts") + F.expr("INTERVAL 1 DAY"))
    later = later.withColumn("embedding", F.transform("embedding", lambda x: 2 * x))
    stored = vector_rows(v.where("label < 9")).withColumn("state", F.lit("old"))
    merged = tables.upsert(stored, vector_rows(later).withColumn("state", F.lit("new")), ["url"])
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    total = F.floor(total * 1000 + 0.5).cast("bigint")
    return merged.select("url", "publish_date", "state", F.size("embedding").alias("size"), total.alias("total"))


@query(f"""WITH {ARTICLES} SELECT a.article_id, a.src, a.url FROM articles a
WHERE NOT EXISTS (SELECT 1 FROM articles b WHERE b.language = 'en' AND b.src = a.src AND b.url = a.url)""")
def new_articles_anti(spark, sf):
    a = articles(spark, sf)
    return tables.new_rows(a, a.where("language = 'en'"), KEY).select("article_id", "src", "url")


@query(f"""WITH {RECRAWLED}, r AS (SELECT *, row_number() OVER (PARTITION BY src, url ORDER BY publish_ts DESC, title) AS rn FROM recrawled)
SELECT article_id, src, url, title, strftime(publish_ts, '{TS}') AS publish_date FROM r WHERE rn = 1""")
def dedup_latest(spark, sf):
    latest = tables.dedup_latest(recrawled(spark, sf), KEY, ["publish_ts"], ["title"])
    return latest.select("article_id", "src", "url", "title", stamp("publish_ts").alias("publish_date"))


@query(f"""WITH {RECRAWLED}, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY similarity_score DESC, title) AS rn FROM recrawled)
SELECT article_id, title, similarity_score FROM r WHERE rn = 1""")
def dedup_best_score(spark, sf):
    return tables.dedup_best(recrawled(spark, sf), "article_id", "similarity_score", "title").select(
        "article_id", "title", "similarity_score"
    )


@query(f"WITH {RECRAWLED} SELECT article_id, count(*) AS n FROM recrawled GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return tables.duplicate_groups(recrawled(spark, sf), "article_id")


@query(f"""WITH {ARTICLES} SELECT article_id, url, '' AS categories, CASE main_category WHEN 'Other' THEN 'General' ELSE main_category END AS main_category,
  title, NULL::VARCHAR AS summary, 0.0::DOUBLE AS similarity_score, md5(content) AS content_md5 FROM articles
WHERE article_id NOT IN (SELECT doc_id FROM labels)""")
def migrate_missing(spark, sf):
    """Articles without a label row move over with default values."""
    a = articles(spark, sf).withColumn("main_category", F.nullif("main_category", F.lit("Other")))
    moved = tables.migrate_missing(a, table(spark, sf, "labels").select(F.col("doc_id").alias("article_id")))
    return moved.select(
        "article_id", "url", F.array_join("categories", ",").alias("categories"), "main_category", "title", "summary",
        "similarity_score", F.md5("content").alias("content_md5"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS inserted,
  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS skipped
FROM documents WHERE doc_id IN (SELECT event_id FROM events)""")
def migration_report(spark, sf):
    return tables.migration_report(
        articles(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"))
    )


@query(f"""WITH {RECRAWLED}, r AS (SELECT *, row_number() OVER (PARTITION BY url, src ORDER BY publish_ts DESC, title) AS rn FROM recrawled)
SELECT url, src, title, main_category, md5(content) AS content_md5, language, concat('https://img.example.com/', article_id) AS image_url,
  concat('by ', src) AS author, strftime(ingest_ts, '%Y-%m-%d %H') AS ingest_time,
  strftime(publish_ts, '%Y-%m-%d') AS publish_date, '2024-03-01' AS upload_date FROM r WHERE rn = 1""")
def gold_build(spark, sf):
    """Deduplicate, project, write clustered by category, read back."""
    from newsloom.schema import GOLD_COLUMNS

    a = recrawled(spark, sf)
    extra = {
        "image_url": F.concat(F.lit("https://img.example.com/"), F.col("article_id").cast("string")), "author": F.concat(F.lit("by "), "src"),
        "ingest_time": F.col("ingest_ts"), "time": F.date_format("publish_ts", "HH:mm"), "timezone": F.lit("UTC"),
        "categories": F.array("main_category"), "time_reading": F.length("content").cast("string"), "processed_date": F.to_date("ingest_ts"),
    }
    path = new_path(spark, "gold")
    gold = tables.gold_build(a.withColumns(extra), "2024-03-01")
    if gold.columns != GOLD_COLUMNS:
        raise ValueError("gold has other columns")
    sinks.write_clustered(gold, path, "upload_date", "main_category")
    return spark.read.parquet(path).select(
        "url", "src", "title", "main_category", F.md5("content").alias("content_md5"), "language", "image_url", "author",
        F.date_format("ingest_time", "yyyy-MM-dd HH").alias("ingest_time"), F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"),
        F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"),
    )


@query(f"""WITH {ARTICLES}, e AS (
  SELECT article_id AS entry_id, concat(CASE main_category WHEN 'Sports' THEN 'cnn_top_stories' ELSE 'feed_' || language END) AS category,
         concat('https://', src, '.example.com/', split_part(title, ' ', 1)) AS url FROM articles),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN contains(category, 'top_stories') THEN 0 ELSE 1 END, category, entry_id) AS rn
  FROM e WHERE url NOT IN (SELECT url FROM e WHERE category = 'feed_es'))
SELECT entry_id, category, url FROM r WHERE rn = 1""")
def crawl_frontier(spark, sf):
    """Feed entries with clashing urls; those of the Spanish feeds were crawled already."""
    feed = F.when(F.col("main_category") == "Sports", F.lit("cnn_top_stories")).otherwise(F.concat(F.lit("feed_"), "language"))
    entries = articles(spark, sf).select(
        F.col("article_id").alias("entry_id"), feed.alias("category"),
        F.concat(F.lit("https://"), "src", F.lit(".example.com/"), F.split_part("title", F.lit(" "), F.lit(1))).alias("url"),
    )
    return tables.crawl_frontier(entries, entries.where("category = 'feed_es'"))


@query("""SELECT event_id, row_number() OVER (ORDER BY substr(md5(event_id::VARCHAR), 1, 4), event_id) - 1 AS row_index,
  ((row_number() OVER (ORDER BY substr(md5(event_id::VARCHAR), 1, 4), event_id) - 1) // 1000)::BIGINT AS batch_id FROM events""")
def batch_assign(spark, sf):
    return tables.batch_assign(table(spark, sf, "events"), 1000, "event_id").select("event_id", "row_index", "batch_id")


@query("""SELECT event_id, event_type, value, NULL::BIGINT AS user_id FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, event_type, NULL, user_id FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, event_type, value, user_id FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view')""")
def union_slots(spark, sf):
    """Slots whose files lack a column each, and one with all of them."""
    e = table(spark, sf, "events")
    return sources.union_all(
        e.where("event_type = 'click'").select("event_id", "event_type", "value"),
        e.where("event_type = 'view'").select("user_id", "event_type", "event_id"),
        e.where("event_type IS NULL OR event_type NOT IN ('click', 'view')").select("event_type", "value", "event_id", "user_id"),
    )


@query(f"""WITH {ARTICLES} SELECT article_id, CASE WHEN language = 'de' THEN concat('about ', src) ELSE title END AS title
FROM articles""")
def column_backfill(spark, sf):
    """German titles are missing and come from an update table."""
    a = articles(spark, sf)
    holes = a.withColumn("title", F.when(F.col("language") != "de", F.col("title")))
    updates = a.where("language <> 'fr'").select("article_id", F.concat(F.lit("about "), "src").alias("title"))
    updates = updates.join(a.where("language = 'de'").select("article_id"), "article_id", "left_semi")
    return tables.column_backfill(holes, updates, "article_id", "title").select("article_id", "title")


@query(f"""WITH {ARTICLES} SELECT article_id, strftime(ingest_ts, '{TS}') AS ingest_time FROM articles WHERE ingest_ts > TIMESTAMP '2024-01-02 00:00:00'""")
def incremental_load(spark, sf):
    """Stored watermark, rows after it, watermark moved on to the newest row."""
    path = new_path(spark, "control")
    incremental.advance_watermark(spark, path, "to-serving", "2024-01-02 00:00:00")
    last = incremental.read_watermark(spark, path, "to-serving")
    return incremental.incremental_load(articles(spark, sf), last, "ingest_ts").select(
        "article_id", stamp("ingest_ts").alias("ingest_time")
    )


@query(f"""WITH {ARTICLES} SELECT strftime(min(ingest_ts), '{TS}') AS min_ingest_time, strftime(max(ingest_ts), '{TS}') AS max_ingest_time,
  count(*) AS processed_rows FROM articles""")
def batch_bounds(spark, sf):
    b = incremental.batch_bounds(articles(spark, sf), "ingest_ts")
    return b.select(stamp("min_ingest_time").alias("min_ingest_time"), stamp("max_ingest_time").alias("max_ingest_time"), "processed_rows")


@query(f"""WITH {ARTICLES} SELECT 'general' AS update_type, count(*) AS processed_rows, 'articles' AS table_name, '5,6,7' AS hours,
  strftime(min(ingest_ts) - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S') || 'Z' AS time_from, '2024-02-01T00:00:00Z' AS time_to FROM articles""")
def batch_notification(spark, sf):
    """The update message of a batch, read back from its JSON."""
    from newsloom.schema import UPDATE_MESSAGE

    sent = incremental.batch_notification(
        articles(spark, sf), "articles", "2024-01-01", [5, 6, 7], "2024-02-01T00:00:00Z", "Asia/Bangkok", "ingest_ts"
    )
    m = sent.select(F.from_json("message", UPDATE_MESSAGE).alias("m"))
    return m.select(
        "m.update_type", "m.details.processed_rows", F.col("m.details.table").alias("table_name"),
        F.array_join(F.col("m.details.hours").cast("array<string>"), ",").alias("hours"),
        F.col("m.time_range.from").alias("time_from"), F.col("m.time_range.to").alias("time_to"),
    )


@query("""SELECT doc_id, floor(octet_length(encode(text)) / 16384.0)::BIGINT AS seconds FROM documents""")
def duration_from_size(spark, sf):
    """Seconds of audio, if every text were a file."""
    return table(spark, sf, "documents").select(
        "doc_id", sources.duration_from_size(F.octet_length("text")).alias("seconds")
    )


@query("""SELECT source AS category, concat('https://example.com/', doc_id, '/', k) AS url, concat(lang, ' ', k) AS title,
  concat('Tue, 22 Apr 2025 ', lpad((doc_id % 24)::VARCHAR, 2, '0'), ':00:00 +0000') AS publish_date
FROM documents, generate_series(0, doc_id % 4) AS t(k) WHERE k > 0""")
def feed_entries(spark, sf):
    """One stored feed file per document with none to three items of its own hour, read back as entries."""
    number = F.col("doc_id").cast("string")
    hour = F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0")

    def item(k):
        return F.concat(
            F.lit("<item><link>https://example.com/"), number, F.lit("/"), k.cast("string"), F.lit("</link><title>"), F.col("lang"), F.lit(" "),
            k.cast("string"), F.lit("</title><pubDate>Tue, 22 Apr 2025 "), hour, F.lit(":00:00 +0000</pubDate></item>"),
        )

    items = F.transform(F.filter(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda k: k > 0), item)
    xml = F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(items, ""), F.lit("</channel></rss>"))
    feeds = table(spark, sf, "documents").select(F.col("source").alias("category"), xml.alias("xml"))
    return sources.feed_entries(feeds)
