"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import ranked
from newsloom.operators import serving as op
from newsloom.plans.catalog import query
from newsloom.plans.fixtures import ARTICLES, articles, table
from newsloom.session import new_path


TS = "%Y-%m-%d %H:%M:%S.%f"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(f"""WITH {ARTICLES}, valid AS (
  SELECT *, trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t0 FROM articles),
  cleaned AS (SELECT * REPLACE (translate(t0, '"''', '') AS title) FROM valid),
  best AS (SELECT *, row_number() OVER (PARTITION BY src, url ORDER BY publish_ts DESC, article_id) AS rn
    FROM cleaned WHERE trim(title) <> '' AND lower(trim(title)) <> 'no title' AND trim(content) <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY main_category ORDER BY similarity_score DESC, publish_ts DESC, article_id) AS rank
    FROM best WHERE rn = 1),
  dim AS (SELECT unnest([0,1,2,3,4]) AS category_ord, unnest(['Politics','Science','Sports','Technology','Climate']) AS category)
SELECT category_ord::INT AS category_ord, category, article_id, title, similarity_score, strftime(publish_ts, '{TS}') AS publish_date
FROM dim LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.main_category = dim.category""")
def category_top_picks(spark, sf):
    """Minimum slice end to end: clean, check, deduplicate, rank, pick per category."""
    from newsloom.operators.clean import clean_columns, valid_expr
    from newsloom.operators.tables import dedup_latest

    cleaned = clean_columns(articles(spark, sf).where(valid_expr(None, cleaned=False)))
    latest = dedup_latest(cleaned, ["src", "url"], ["publish_ts"], ["article_id"])
    return op.category_top_picks(latest).select(
        "category_ord", "category", "article_id", "title", "similarity_score", stamp("publish_ts").alias("publish_date")
    )


@query(f"""WITH {ARTICLES} SELECT article_id, src, strftime(publish_ts, '{TS}') AS publish_date, (SELECT count(*) FROM articles) AS total
FROM articles ORDER BY publish_ts DESC, article_id LIMIT 20 OFFSET 40""")
def articles_page(spark, sf):
    return op.articles_page(articles(spark, sf), 3, 20).select("article_id", "src", stamp("publish_ts").alias("publish_date"), "total")


@query(f"""WITH {ARTICLES} SELECT article_id, src, strftime(publish_ts, '{TS}') AS publish_date, (SELECT count(*) FROM articles) AS total
FROM articles ORDER BY publish_ts DESC, article_id LIMIT 20 OFFSET 180""")
def articles_page_by_rank(spark, sf):
    """Page ten of all articles, read from a table that is stored in the order of pages."""
    path = new_path(spark, "ranked")
    lean = articles(spark, sf).select("article_id", "src", "publish_ts")
    ranked.write_ranked(lean, path, [F.desc_nulls_last("publish_ts"), F.asc("article_id")], part_rows=150)
    page = ranked.ranked_page(spark, path, 10, 20)
    return page.select("article_id", "src", stamp("publish_ts").alias("publish_date"), "total")


_ASKED = """asked AS (SELECT event_id, event_id % 5 - 1 AS page, CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_id % 61 - 3 END AS size,
  CASE event_type WHEN 'view' THEN 'Politics' WHEN 'click' THEN 'Science' WHEN 'signup' THEN 'Nonsense' END AS category, value - 20 AS score FROM events)"""


@query(f"""WITH {_ASKED} SELECT event_id, CASE WHEN page < 1 THEN 'page' WHEN size IS NULL OR size NOT BETWEEN 1 AND 50 THEN 'size'
  WHEN category = 'Nonsense' THEN 'category' WHEN score < 0 THEN 'score' END AS fault FROM asked""")
def request_faults(spark, sf):
    """Requests made of all events, each with the first of its parameters that is refused."""
    e = table(spark, sf, "events")
    category = F.when(F.col("event_type") == "view", "Politics").when(F.col("event_type") == "click", "Science").when(F.col("event_type") == "signup", "Nonsense")
    size = F.when(F.col("event_id") % 53 != 0, F.col("event_id") % 61 - 3)
    return e.select("event_id", op.request_fault(F.col("event_id") % 5 - 1, size, category, F.col("value") - 20).alias("fault"))


@query(f"""WITH {ARTICLES}, f AS (SELECT * FROM articles WHERE publish_ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-03 00:00:00')
SELECT article_id, strftime(publish_ts, '{TS}') AS publish_date, (SELECT count(*) FROM f) AS total
FROM f ORDER BY publish_ts DESC, article_id LIMIT 10 OFFSET 10""")
def articles_by_date_page(spark, sf):
    page = op.articles_page(articles(spark, sf), 2, 10, start="2024-01-01 06:00:00", end="2024-01-03 00:00:00")
    return page.select("article_id", stamp("publish_ts").alias("publish_date"), "total")


@query(f"""WITH {ARTICLES}, f AS (SELECT * FROM articles WHERE main_category = 'Science')
SELECT article_id, main_category, (SELECT count(*) FROM f) AS total FROM f ORDER BY publish_ts DESC, article_id LIMIT 100""")
def articles_by_category_page(spark, sf):
    op.check_category("Science")
    page = op.articles_page(articles(spark, sf), 1, 100, category="Science", max_size=None)
    return page.select("article_id", "main_category", "total")


@query(f"""WITH {ARTICLES}, f AS (SELECT * FROM articles WHERE similarity_score >= 0.3)
SELECT article_id, similarity_score, (SELECT count(*) FROM f) AS total FROM f
ORDER BY similarity_score DESC, publish_ts DESC, article_id LIMIT 50 OFFSET 50""")
def trending_page(spark, sf):
    return op.trending_page(articles(spark, sf), 2, 50, 0.3).select("article_id", "similarity_score", "total")


@query(f"""WITH {ARTICLES}, f AS (SELECT * FROM articles WHERE similarity_score >= 0.3 AND main_category = 'Sports')
SELECT article_id, similarity_score, main_category, (SELECT count(*) FROM f) AS total FROM f
ORDER BY similarity_score DESC, publish_ts DESC, article_id LIMIT 10""")
def trending_category_page(spark, sf):
    page = op.trending_page(articles(spark, sf), 1, 10, 0.3, "Sports")
    return page.select("article_id", "similarity_score", "main_category", "total")


@query(f"""WITH {ARTICLES} SELECT article_id, strftime(publish_ts, '{TS}') AS publish_date FROM articles
WHERE ingest_ts BETWEEN TIMESTAMP '2024-01-01 05:00:00' AND TIMESTAMP '2024-01-02 05:00:00'""")
def articles_between(spark, sf):
    got = op.articles_between(articles(spark, sf), "2024-01-01 05:00:00", "2024-01-02 05:00:00", "ingest_ts")
    return got.orderBy(F.desc("publish_ts"), "article_id").select("article_id", stamp("publish_ts").alias("publish_date"))


@query(f"""WITH {ARTICLES} SELECT article_id, strftime(publish_ts, '{TS}') AS publish_date FROM articles
WHERE publish_ts >= TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOUR ORDER BY publish_ts DESC, article_id LIMIT 100""")
def recent_articles(spark, sf):
    got = op.recent_articles(articles(spark, sf), "2024-01-02 12:00:00", 24, 100)
    return got.select("article_id", stamp("publish_ts").alias("publish_date"))


@query(f"""WITH {ARTICLES} SELECT article_id, url FROM articles ORDER BY publish_ts DESC, article_id LIMIT 5""")
def latest_n(spark, sf):
    return op.latest_n(articles(spark, sf), 5).select("article_id", "url")


@query(f"""WITH {ARTICLES} SELECT a.article_id, a.url, a.title FROM articles a WHERE url IN (
  SELECT concat('https://', d.source, '.example.com/', d.lang, '/', d.doc_id) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)""")
def lookup_by_urls(spark, sf):
    """Articles by url; the list is a table here (the good ones by label)."""
    from newsloom.plans.fixtures import table

    good = articles(spark, sf).join(
        table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi"
    )
    return op.lookup_by_urls(articles(spark, sf), good).select("article_id", "url", "title")


@query(f"""WITH {ARTICLES} SELECT CASE WHEN coalesce(c, '') = '' THEN 'Uncategorized' ELSE c END AS main_category, count(*) AS n
FROM (SELECT nullif(main_category, 'Other') AS c FROM articles) GROUP BY 1""")
def category_counts(spark, sf):
    a = articles(spark, sf).withColumn("main_category", F.nullif("main_category", F.lit("Other")))
    return op.category_counts(a).orderBy(F.desc("n"), "main_category")


@query(f"""WITH {ARTICLES} SELECT DISTINCT array_to_string(list_sort([main_category, src]), ',') AS categories FROM articles""")
def distinct_category_sets(spark, sf):
    a = articles(spark, sf).select(F.array("main_category", "src").alias("categories"))
    return op.distinct_category_sets(a).select(F.array_join("categories", ",").alias("categories"))


@query("SELECT count(*) AS total, ceil(count(*) / 9)::BIGINT AS pages FROM documents")
def page_count(spark, sf):
    from newsloom.plans.fixtures import table

    return op.page_count(table(spark, sf, "documents"), 9)


@query(f"""WITH {ARTICLES} SELECT article_id, url, array_to_string([main_category, src], '|') AS categories,
  CASE WHEN main_category = 'Sports' THEN 'General' ELSE main_category END AS main_category,
  CASE main_category WHEN 'Sports' THEN 'General' WHEN 'Other' THEN 'Social' ELSE main_category END AS shown_category,
  CASE WHEN coalesce(title, '') = '' THEN 'No title available' ELSE title END AS title,
  '' AS summary, similarity_score, strftime(publish_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS publish_date FROM articles""")
def serving_projection(spark, sf):
    a = articles(spark, sf).withColumns(
        {
            "categories": F.array("main_category", "src"),
            "summary": F.lit(None).cast("string"),
            "main_category": F.nullif("main_category", F.lit("Sports")),
        }
    )
    return op.serving_projection(a).withColumn("categories", F.array_join("categories", "|"))


@query(f"""WITH {ARTICLES} SELECT 'top' AS kind, concat('kw_', user_id) AS query FROM (
  SELECT user_id, min(event_id) AS position, bool_or(event_type = 'purchase') AS active FROM events GROUP BY user_id)
WHERE active ORDER BY position LIMIT 10""")
def active_top_keywords(spark, sf):
    """Every user stands for a trending search; those with a purchase are active."""
    from newsloom.operators.trends import active_top_keywords as run
    from newsloom.plans.fixtures import table

    searches = table(spark, sf, "events").groupBy("user_id").agg(
        F.min("event_id").alias("position"), F.bool_or(F.col("event_type") == "purchase").alias("active")
    ).withColumn("query", F.concat(F.lit("kw_"), F.col("user_id").cast("string")))
    return run(searches, 10).select(F.lit("top").alias("kind"), "query")


@query("""WITH q AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, 'rising' AS kind, concat(event_type, ' news') AS query, concat('+', k, '%') AS value, k AS extracted_value FROM q WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'top', event_type, CAST(k AS VARCHAR), k FROM q WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'top', concat(event_type, ' today'), CAST(k AS VARCHAR), k + 1 FROM q WHERE event_type <> 'error'""")
def related_queries_flatten(spark, sf):
    """Payloads as an API returns them, built from the events; an error has an empty payload."""
    from newsloom.operators.trends import related_queries_flatten as run
    from newsloom.plans.fixtures import table

    k = F.get_json_object("props", "$.k").cast("int")

    def entry(text, value, number):
        return F.struct(text.alias("query"), value.alias("value"), number.alias("extracted_value"))

    full = F.to_json(
        F.struct(
            F.array(entry(F.concat("event_type", F.lit(" news")), F.concat(F.lit("+"), k.cast("string"), F.lit("%")), k)).alias("rising"),
            F.array(
                entry(F.col("event_type"), k.cast("string"), k),
                entry(F.concat("event_type", F.lit(" today")), k.cast("string"), k + 1),
            ).alias("top"),
        )
    )
    payload = F.when(F.col("event_type") != "error", full).otherwise(F.lit("{}"))
    events = table(spark, sf, "events").withColumn("payload", payload)
    return run(events, "payload", ["event_id"]).select("event_id", "kind", "query", "value", "extracted_value")
