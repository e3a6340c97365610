"""Readers and hooks over files derived from the given tables: damaged JSON, crawled urls, free-form dates, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.operators.embedding import embed
from newsloom.plans.catalog import query
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import table
from newsloom.session import new_path
from newsloom.sources import articles as sources

# Pages of one array file, and the number of the file that is damaged.
_PAGES, _DAMAGED = 25, 3


@query(f"""SELECT CASE WHEN f = {_DAMAGED} THEN NULL ELSE concat('https://p.example.com/', page_id) END AS url,
  CASE WHEN f = {_DAMAGED} THEN NULL ELSE md5(html) END AS content_md5, f = {_DAMAGED} AS damaged FROM (SELECT *, page_id // {_PAGES} AS f FROM pages) WHERE f <> {_DAMAGED}
UNION ALL SELECT NULL, NULL, true WHERE EXISTS (SELECT 1 FROM pages WHERE page_id // {_PAGES} = {_DAMAGED})""")
def json_arrays(spark, sf):
    """Files of one multi-line JSON array each, one of them cut off in the middle: its one record keeps the text of the file."""
    path = new_path(spark, "arrays")
    pages = table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / _PAGES).alias("f"), F.concat(F.lit("https://p.example.com/"), F.col("page_id").cast("string")).alias("url"),
        F.lit("s").alias("src"), F.col("html").alias("content"),
    )
    items = F.array_join(F.transform(F.collect_list(F.to_json(F.struct("url", "src", "content"))), lambda x: x), ",\n")
    files = pages.groupBy("f").agg(items.alias("body"))
    value = F.when(F.col("f") == _DAMAGED, F.concat(F.lit("[\n{\"url\": \"x\", "), F.substring("body", 1, 20))).otherwise(F.concat(F.lit("[\n"), "body", F.lit("\n]")))
    files.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = sources.read_articles_json(spark, path)
    return read.select("url", F.md5("content").alias("content_md5"), F.col("_corrupt").isNotNull().alias("damaged"))


@query("SELECT DISTINCT url FROM pages WHERE url IS NOT NULL")
def crawled_urls(spark, sf):
    """Crawl files (arrays of a bounded number of records) that name urls several times, and records without any."""
    path = new_path(spark, "crawled")
    pages = table(spark, sf, "pages").select("page_id", "url")
    twice = pages.unionByName(pages.where("page_id % 3 = 0")).unionByName(pages.withColumn("url", F.lit(None).cast("string")))
    files = F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, -(-pages.count() // 200)))).alias("file")
    arrays = twice.groupBy(files).agg(F.to_json(F.collect_list(F.struct("url")), {"ignoreNullFields": "false"}).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return sources.crawled_urls(spark, path)


@query("""SELECT event_id, value IS NULL AS missing, CASE WHEN value > 50 THEN -1.0 ELSE coalesce(value, -1.0) END AS value FROM events""")
def default_if_missing(spark, sf):
    """NULL and NaN values become a default; values above 50 are turned into NaN first."""
    e = table(spark, sf, "events")
    odd = F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", F.col("value").isNull().alias("missing"), text.default_if_missing(odd, -1.0).alias("value"))


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(date_trunc('day', ts) + INTERVAL 1 HOUR * (CASE WHEN event_id % 3 = 0 THEN 20 ELSE 0 END), '{TS}') END AS publish_date
FROM events""")
def free_form_dates(spark, sf):
    """Dates no known format matches: words around a date with a zone, a day with its ending, and no date at all."""
    day = F.dayofmonth("ts")
    ending = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    spoken = F.concat(F.lit("on "), F.date_format("ts", "d MMMM yyyy"), F.lit(" at 3pm EST"))
    ended = F.concat(F.date_format("ts", "MMMM "), day.cast("string"), ending, F.date_format("ts", ", yyyy"))
    number = F.col("event_id") % 3
    written = F.when(number == 0, spoken).when(number == 1, ended).otherwise("no day known")
    return dates.parse_dates(table(spark, sf, "events").select("event_id", "ts", written.alias("d")), "d").select("event_id", stamp("publish_ts").alias("publish_date"))


@query("SELECT 'orders' AS name, column_name FROM (DESCRIBE orders) UNION ALL SELECT 'none', unnest(['url', 'src', 'title', 'language', 'content', 'image_url', 'publish_date', 'time', 'timezone', 'hour', 'minute', 'day', 'month', 'month_number', 'year', 'weekday', 'time_reading', 'author', 'categories', '_corrupt'])")
def stored_schema(spark, sf):
    """The columns of a stored table, and the default where there is none."""
    path = new_path(spark, "stored")
    table(spark, sf, "orders").write.parquet(path)
    names = [("orders", c) for c in sources.stored_schema(spark, path).names] + [("none", c) for c in sources.stored_schema(spark, path + "-none").names]
    return spark.createDataFrame(names, "name string, column_name string")


def _letters():
    """A model in place of a real one: how often a, e and n occur."""
    return lambda texts: [[float(t.count(c)) for c in "aen"] for t in texts]


@query("""SELECT doc_id, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'e', '')) AS e,
  length(text) - length(replace(text, 'n', '')) AS n FROM documents""")
def embed_model(spark, sf):
    """Texts embedded by a model given as a function."""
    rows = embed(table(spark, sf, "documents"), ["text"], _letters)
    return rows.select("doc_id", *[F.col("embedding")[k].cast("bigint").alias(c) for k, c in enumerate("aen")])
