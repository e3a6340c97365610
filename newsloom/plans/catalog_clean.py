"""Cleaning, dates, categories, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, text
from newsloom.operators import clean, pages
from newsloom.operators.categorize import fuzzy_category as match_category
from newsloom.plans.catalog import query
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import ARTICLES, RAW, articles, raw_articles, table
from newsloom.schema import CATEGORY_KEYWORDS, EXCLUDED_URL
from newsloom.session import new_path

SPACES = r"[ \t\n\x0B\f\r]+"
VALID = """(url IS NOT NULL AND src IS NOT NULL AND title IS NOT NULL AND trim(title, ' ') <> '' AND lower(trim(title, ' ')) <> 'no title'
  AND content IS NOT NULL AND trim(content, ' ') <> '' AND lower(trim(content, ' ')) <> 'no content')"""


@query(f"""SELECT doc_id, md5(translate(trim(regexp_replace(text, '{SPACES}', ' ', 'g'), ' '), '"''', '')) AS content_md5 FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_text("text")).alias("content_md5"))


@query(f"""WITH {ARTICLES}, u AS (SELECT article_id, CASE WHEN language = 'es' THEN NULL ELSE concat('https://', src, '.example.com/',
  CASE main_category WHEN 'Politics' THEN 'video/' WHEN 'Science' THEN 'crosswords/' WHEN 'Sports' THEN 'newsletters/signup/' ELSE 'a/' END, article_id) END AS url FROM articles)
SELECT article_id, url FROM u WHERE NOT regexp_matches(url, '{EXCLUDED_URL}')""")
def url_filter(spark, sf):
    part = F.lit("a/")
    for name, folder in {"Politics": "video/", "Science": "crosswords/", "Sports": "newsletters/signup/"}.items():
        part = F.when(F.col("main_category") == name, F.lit(folder)).otherwise(part)
    url = F.concat(F.lit("https://"), "src", F.lit(".example.com/"), part, F.col("article_id").cast("string"))
    a = articles(spark, sf).select("article_id", F.when(F.col("language") != "es", url).alias("url"))
    return clean.url_filter(a)


@query(f"""WITH {RAW} SELECT article_id, coalesce({VALID}, false) AS is_valid FROM raw""")
def validity_split(spark, sf):
    """Valid rows and error rows, each marked; together they are the input."""
    valid, invalid = clean.split_valid(raw_articles(spark, sf), None)
    return valid.select("article_id", F.lit(True).alias("is_valid")).unionByName(
        invalid.select("article_id", F.lit(False).alias("is_valid"))
    )


@query(f"""WITH {RAW} SELECT article_id, title, nullif(title, 'No title') AS title_or_null, nullif(publish_date, 'No publish date') AS date_or_null FROM raw""")
def sentinels_to_null(spark, sf):
    raw = raw_articles(spark, sf).select("article_id", F.col("title").alias("kept"), "title", "publish_date")
    return clean.sentinels_to_null(raw).select(
        "article_id", F.col("kept").alias("title"), F.col("title").alias("title_or_null"), F.col("publish_date").alias("date_or_null")
    )


@query(f"""WITH {RAW} SELECT article_id, CASE WHEN publish_date <> 'No publish date' THEN trim(regexp_replace(regexp_replace(publish_date, '^Updated +', ''), ' +', ' ', 'g')) END AS cleaned FROM raw""")
def clean_publish_date(spark, sf):
    return raw_articles(spark, sf).select("article_id", text.clean_publish_date("publish_date").alias("cleaned"))


@query(f"""WITH {RAW} SELECT article_id, strftime(read_ts, '%Y-%m-%d %H:%M:%S') AS publish_utc FROM raw""")
def parse_dates(spark, sf):
    parsed = dates.parse_dates(raw_articles(spark, sf).drop("publish_ts"), "publish_date")
    return parsed.select("article_id", F.date_format("publish_ts", "yyyy-MM-dd HH:mm:ss").alias("publish_utc"))


@query(f"""WITH {RAW} SELECT article_id, publish_date FROM raw WHERE NOT coalesce({VALID}, false)
UNION ALL SELECT article_id, publish_date FROM raw WHERE {VALID} AND read_ts IS NULL AND publish_date <> 'No publish date'""")
def unparseable_dates(spark, sf):
    """The error table: invalid rows, and valid rows whose date nobody can read."""
    valid, invalid = clean.split_valid(raw_articles(spark, sf).drop("publish_ts"), None)
    parsed = dates.parse_dates(valid.withColumn("text", text.clean_publish_date("publish_date")), "publish_date")
    bad = clean.unparseable_dates(parsed, "publish_ts", "text").drop("publish_ts", "text")
    return clean.error_rows(invalid, bad).select("article_id", "publish_date")


@query(f"""WITH {RAW}, q AS (SELECT coalesce({VALID}, false) AS v, read_ts IS NULL AND publish_date <> 'No publish date' AS u FROM raw)
SELECT count(*) AS rows_read, count(*) FILTER (WHERE v) AS rows_valid, count(*) FILTER (WHERE NOT v) AS rows_invalid,
  count(*) FILTER (WHERE v AND u) AS rows_unparseable, count(*) FILTER (WHERE v AND NOT u) AS rows_kept FROM q""")
def quality_report(spark, sf):
    raw = raw_articles(spark, sf).drop("publish_ts").withColumn("text", text.clean_publish_date("publish_date"))
    return clean.quality_report(dates.parse_dates(raw, "publish_date"), "publish_ts", "text")


@query("""SELECT event_id, strftime(ts, '%H:%M') AS time, 'UTC' AS timezone, hour(ts)::INT AS hour, minute(ts)::INT AS minute, day(ts)::INT AS day,
  monthname(ts) AS month, month(ts)::INT AS month_number, year(ts)::INT AS year, dayname(ts) AS weekday FROM events""")
def date_parts(spark, sf):
    return dates.date_parts(table(spark, sf, "events").select("event_id", "ts"), "ts").drop("ts")


REBUILT = """WITH p AS (SELECT event_id, year(ts) + CASE event_type WHEN 'error' THEN 9000 ELSE 0 END AS y, 1 + (user_id % 14) AS mo,
  CASE event_type WHEN 'click' THEN 31 WHEN 'view' THEN 29 ELSE day(ts) END AS d, hour(ts) AS h, minute(ts) + CASE event_type WHEN 'signup' THEN 20 ELSE 0 END AS mi FROM events)
SELECT event_id, strftime(CASE WHEN y BETWEEN 1900 AND 9999 AND mo BETWEEN 1 AND 12 AND mi BETWEEN 0 AND 59 THEN
  try_cast(printf('%04d-%02d-%02d %02d:%02d:00', y, mo, d, h, mi) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS publish_date FROM p"""


@query(REBUILT)
def rebuild_timestamp(spark, sf):
    """Parts that are out of range, or name a day the month does not have, give NULL."""
    e, ts, kind = table(spark, sf, "events"), F.col("ts"), F.col("event_type")
    parts = e.select(
        "event_id",
        (F.year(ts) + F.when(kind == "error", 9000).otherwise(0)).alias("year"),
        (1 + F.col("user_id") % 14).cast("string").alias("month_number"),
        F.when(kind == "click", 31).when(kind == "view", 29).otherwise(F.dayofmonth(ts)).cast("string").alias("day"),
        F.hour(ts).alias("hour"),
        (F.minute(ts) + F.when(kind == "signup", 20).otherwise(0)).alias("minute"),
    )
    return parts.select("event_id", F.date_format(dates.rebuild_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("publish_date"))


@query("""WITH l AS (SELECT event_id, ts + INTERVAL 7 HOUR AS t FROM events),
s AS (SELECT *, CASE WHEN hour(t) < 5 THEN 0 WHEN hour(t) < 11 THEN 5 WHEN hour(t) < 17 THEN 11 ELSE 17 END AS a,
  CASE WHEN hour(t) < 5 THEN 5 WHEN hour(t) < 11 THEN 11 WHEN hour(t) < 17 THEN 17 ELSE 24 END AS b FROM l)
SELECT event_id, a AS slot_start, b AS slot_end, strftime(CASE a WHEN 0 THEN t - INTERVAL 1 DAY ELSE t END, '%Y-%m-%d') AS effective_date FROM s""")
def time_slot(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return dates.time_slot(e, "ts").drop("ts").withColumn("effective_date", F.date_format("effective_date", "yyyy-MM-dd"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE strftime(date_trunc('minute', ts) - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') END AS publish_utc FROM events""")
def parse_vn_date(spark, sf):
    label = F.concat(F.lit("Thứ hai, "), F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit(" (GMT+7)"))
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", label).otherwise(F.lit("hôm nay")).alias("t"))
    return e.select("event_id", F.date_format(dates.parse_vn_date("t"), "yyyy-MM-dd HH:mm:ss").alias("publish_utc"))


@query("""SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events""")
def localize_bounds(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", dates.localize("ts").alias("utc"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE strftime(date_trunc('second', ts) - CASE event_type WHEN 'view' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def parse_iso(spark, sf):
    """ISO text with Z or an offset; anything else is NULL, not an error."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("event_type") == "error", F.lit("soon")).when(F.col("event_type") == "view", F.concat(t, F.lit("+02:00"))).otherwise(F.concat(t, F.lit("Z")))
    return table(spark, sf, "events").select("event_id", F.date_format(dates.parse_iso(iso), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_id, floor(epoch(ts))::BIGINT AS publish_date FROM events""")
def to_epoch(spark, sf):
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("publish_date"))


@query("""SELECT event_id, lower(trim(replace(CASE WHEN user_id > 75 THEN event_type || '_news' ELSE event_type || '  world' END, '_', ' '))) AS category FROM events""")
def clean_category(spark, sf):
    name = F.when(F.col("user_id") > 75, F.concat(F.lit("guardian_"), "event_type", F.lit("_news"))).otherwise(
        F.concat(F.upper("event_type"), F.lit("  world "))
    )
    return table(spark, sf, "events").select("event_id", text.clean_category(name).alias("category"))


@query("""SELECT page_id, url AS normalized FROM pages WHERE NOT ends_with(url, '/index.html')
UNION ALL SELECT page_id, left(url, length(url) - 11) FROM pages WHERE ends_with(url, '/index.html')
UNION ALL SELECT -1 - page_id, url FROM pages""")
def normalize_url(spark, sf):
    """Every page url as it is and with /index.html added."""
    p = table(spark, sf, "pages")
    added = p.select((-1 - F.col("page_id")).alias("page_id"), F.concat("url", F.lit("/index.html")).alias("url"))
    return p.select("page_id", "url").unionByName(added).select("page_id", text.normalize_url("url").alias("normalized"))


@query("""WITH s AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS t FROM pages)
SELECT page_id, concat(upper(left(t, 1)), lower(substr(t, 2))) AS section, u[1] AS first, u[-1] AS last
FROM (SELECT s.*, string_split(regexp_replace(split_part(url, '://', 2), '[/?#]+', ' > ', 'g'), ' > ') AS u FROM s JOIN pages USING (page_id))""")
def category_path(spark, sf):
    """The parts of a url as a category path."""
    parts = F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "[/?#]+", " > ")
    path = text.category_path(parts)
    return table(spark, sf, "pages").select(
        "page_id", text.last_segment(F.regexp_replace("url", r"[?#].*$", "")).alias("section"),
        path[0].alias("first"), F.element_at(path, -1).alias("last"),
    )


@query("""WITH p AS (SELECT doc_id, [regexp_replace(x, '^[\\s\\p{Z}\\x{0B}\\x{85}]+|[\\s\\p{Z}\\x{0B}\\x{85}]+$', '', 'g') FOR x IN string_split(concat(text, chr(10), 'Sign up here for more', chr(10), '(CNN) — ', lang), chr(10))] AS ps FROM documents),
t AS (SELECT doc_id, array_to_string([x FOR x IN ps IF NOT contains(x, 'Sign up here')], ' ') AS t FROM p)
SELECT doc_id, CASE WHEN instr(t, '(CNN) —') > 0 THEN substr(t, instr(t, '(CNN) —')) ELSE t END AS content,
  md5(regexp_replace(t, '^(.*?)\\(CNN\\) —.*$', '\\1', 's')) AS before_md5 FROM t""")
def boilerplate_strip(spark, sf):
    """Lines as paragraphs, with a boilerplate line and a dateline added."""
    paragraphs = F.split(F.concat("text", F.lit("\nSign up here for more\n(CNN) — "), "lang"), "\n")
    d = table(spark, sf, "documents").select(
        "doc_id", clean.boilerplate_strip(paragraphs).alias("content"), clean.boilerplate_strip(paragraphs, marker="no such marker").alias("whole")
    )
    return d.select("doc_id", "content", F.md5(F.regexp_replace("whole", r"(?s)\(CNN\) —.*$", "")).alias("before_md5"))


@query("""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'No author' ELSE split_part(text, ' ', 1) END AS author,
  CASE WHEN turn = 0 THEN 'No author' ELSE concat(split_part(text, ' ', 1), ', ', role) END AS authors,
  CASE WHEN role = 'user' THEN '' ELSE role END AS categories FROM conversations""")
def author_pick(spark, sf):
    names = F.when(F.col("turn") > 0, F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.concat(F.lit(" "), "role"))).otherwise(
        F.array().cast("array<string>")
    )
    c = table(spark, sf, "conversations").withColumn("names", names).withColumn("kind", F.when(F.col("role") != "user", F.col("role")))
    return c.select(
        "conv_id", "turn", text.first_author("names").alias("author"), text.join_authors("names").alias("authors"),
        F.array_join(text.category_array("kind"), ",").alias("categories"),
    )


# ---- fuzzy categories: the twin computes the longest common subsequence with list steps ----

_KEYWORDS = ", ".join(
    f"({n}, '{name}', '{word.lower()}')"
    for n, (name, word) in enumerate((name, word) for name, words in CATEGORY_KEYWORDS.items() for word in words)
)


def _sql_lcs(a: str, b: str) -> str:
    """Row by row over the letters of a; a row is a list of b-prefix lengths."""
    row = (
        f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, CASE WHEN ch = substr({b}, j::INT, 1) "
        f"THEN p[j::INT] + 1 ELSE greatest(p[j::INT + 1], r[j::INT]) END), [0::BIGINT])"
    )
    step = row.replace("ch", "substr({a}, i::INT, 1)".replace("{a}", a))
    return f"list_last(list_reduce(range(1, length({a}) + 1), lambda p, i: {step}, list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))"


def _sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * l_{a}_{b} / (length({a}) + length({b})) END)"


FUZZY = f"""WITH kw AS (SELECT * FROM (VALUES {_KEYWORDS}) AS t(ord, category, keyword)),
feeds AS (SELECT event_id, concat(event_type, '_', CASE WHEN user_id < 50 THEN 'tech world' WHEN user_id < 100 THEN 'mental helth news' ELSE 'football' END) AS one, 'guardian_' || event_type AS two FROM events),
names AS (SELECT DISTINCT one, two FROM feeds),
cats AS (SELECT one, two, 0 AS pos, lower(trim(replace(one, '_', ' '))) AS cat FROM names
  UNION ALL SELECT one, two, 1, lower(trim(replace(replace(two, 'guardian_', ''), '_', ' '))) FROM names),
toks AS (SELECT *, list_distinct([x FOR x IN string_split(cat, ' ') IF x <> '']) AS ta, list_distinct([x FOR x IN string_split(keyword, ' ') IF x <> '']) AS tb
  FROM (SELECT DISTINCT cat, ord, category, keyword FROM cats, kw)),
parts AS (SELECT *, list_sort([x FOR x IN ta IF list_contains(tb, x)]) AS shared, list_sort([x FOR x IN ta IF NOT list_contains(tb, x)]) AS da,
  list_sort([x FOR x IN tb IF NOT list_contains(ta, x)]) AS db FROM toks),
strs AS (SELECT *, array_to_string(shared, ' ') AS s, array_to_string(list_concat(shared, da), ' ') AS sa, array_to_string(list_concat(shared, db), ' ') AS sb FROM parts),
lcs AS (SELECT *, {_sql_lcs('sa', 'sb')} AS l_sa_sb, {_sql_lcs('s', 'sa')} AS l_s_sa, {_sql_lcs('s', 'sb')} AS l_s_sb FROM strs),
scores AS (SELECT cat, ord, category, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(shared) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 100.0
  WHEN len(shared) > 0 THEN greatest({_sql_ratio('sa', 'sb')}, {_sql_ratio('s', 'sa')}, {_sql_ratio('s', 'sb')}) ELSE {_sql_ratio('sa', 'sb')} END AS score FROM lcs),
best AS (SELECT one, two, category, score, row_number() OVER (PARTITION BY one, two ORDER BY score DESC, pos, ord) AS rn FROM cats JOIN scores USING (cat))
SELECT event_id, CASE WHEN score >= 60 THEN category ELSE 'Other' END AS main_category
FROM feeds JOIN best USING (one, two) WHERE rn = 1"""


@query(FUZZY)
def fuzzy_category(spark, sf):
    who = F.col("user_id")
    feed = F.when(who < 50, "tech world").when(who < 100, "mental helth news").otherwise("football")
    e = table(spark, sf, "events").select(
        "event_id",
        F.array(F.concat("event_type", F.lit("_"), feed), F.concat(F.lit("guardian_"), "event_type")).alias("categories"),
    )
    return match_category(e).select("event_id", "main_category")


# ---- pages -----------------------------------------------------------------------------------


# What the given pages hold, spelled out here; the operator's own patterns are not used.
_PAGE_NOISE = [rf"<{t}\b.*?</{t}>" for t in ("script", "style", "noscript", "nav", "footer")] + ["<!--.*?-->", '<div class="ad".*?</div>']
_PAGE_BREAK = "(?i)</?(?:" + "|".join("p h1 h2 h3 h4 h5 h6 br div li ul ol tr table section article blockquote pre".split()) + r")(?:\s[^>]*)?/?>"
_PAGE_SIGNS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&amp;": "&"}


def _sql_plain(x: str) -> str:
    for sign, char in _PAGE_SIGNS.items():
        x = f"replace({x}, '{sign}', '{char}')"
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'), ' ')"


_STRIPPED = "regexp_replace({0}, '<[^>]*>', ' ', 'g')"
PAGES = f"""WITH c AS (SELECT *, regexp_replace(html, '(?is){'|'.join(_PAGE_NOISE)}', ' ', 'g') AS clean FROM pages),
b AS (SELECT *, regexp_extract(clean, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS art, regexp_replace(clean, '(?is)<head\\b.*?</head>', ' ', 'g') AS rest FROM c),
s AS (SELECT *, string_split(regexp_replace(CASE WHEN art <> '' THEN art ELSE rest END, '{_PAGE_BREAK}', '␞', 'g'), '␞') AS blocks FROM b),
t AS (SELECT *, array_to_string([y FOR y IN [{_sql_plain(_STRIPPED.format('x'))} FOR x IN blocks] IF y <> ''], chr(10) || chr(10)) AS body FROM s)
SELECT page_id, url, coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), ''), 'No source') AS src,
  coalesce(nullif({_sql_plain(_STRIPPED.format("regexp_extract(html, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title>', 1)"))}, ''), 'No title') AS title,
  'No author' AS author, coalesce(nullif(body, ''), 'No content') AS content, '' AS image_url, NULL::VARCHAR AS publish_date,
  nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang="([^"]*)"', 1), '') AS language FROM t"""


@query(PAGES)
def page_extract(spark, sf):
    return pages.page_extract(table(spark, sf, "pages"))


@query("""WITH l AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1)::INT - 1 AS pos FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS hrefs FROM pages)),
site AS (SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site FROM l)
SELECT page_id, pos, href, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS link FROM site
WHERE NOT regexp_matches(href, '/video/|/gallery/')""")
def page_links(spark, sf):
    return pages.page_links(table(spark, sf, "pages")).select("page_id", "pos", "href", "link")


@query("""SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) GROUP BY 1""")
def text_scan(spark, sf):
    """Raw text lines: pages written as text files and read back, counted by content."""
    path = new_path(spark, "text")
    table(spark, sf, "pages").select("html").write.text(path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.md5("value").alias("line_md5")).agg(F.count("*").alias("n"))
