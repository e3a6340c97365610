"""Audio digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.dates import digest_title as title_of
from newsloom.operators import digest as op
from newsloom.plans.catalog import query
from newsloom.plans.catalog_serving import TS, stamp
from newsloom.plans.fixtures import ARTICLES, WS, articles, sql_sentences, sql_strip, table

CONV = ["conv_id", "turn"]
LINES = f"""sents AS (SELECT conv_id, turn, {sql_sentences('text')} AS ss FROM conversations),
pieces AS (SELECT conv_id, turn, unnest(ss) AS raw, generate_subscripts(ss, 1)::INT - 1 AS pos FROM sents),
counted AS (SELECT *, {sql_strip('raw')} AS text, len([w FOR w IN regexp_split_to_array(raw, '{WS}+') IF w <> '']) AS words FROM pieces),
smart0 AS (SELECT *, words * CASE WHEN length(raw) > 100 THEN 44 ELSE 40 END + 10 * (length(raw) - length(replace(raw, ',', ''))) AS d FROM counted),
smart AS (SELECT *, coalesce(sum(d + 30) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM smart0),
plain AS (SELECT *, words * 40 AS d, coalesce(sum(words * 40) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM counted)"""
TIMES = "conv_id, turn, pos, b / 100.0::DOUBLE AS start_time, (b + d) / 100.0::DOUBLE AS end_time, text"


def _talks(spark, sf):
    return table(spark, sf, "conversations")


@query(f"WITH {LINES} SELECT conv_id, turn, pos, text AS sentence FROM counted")
def sentence_split(spark, sf):
    return op.sentence_split(_talks(spark, sf), "text", CONV)


@query(f"WITH {LINES} SELECT {TIMES} FROM smart")
def transcript_timing(spark, sf):
    return op.transcript_timing(_talks(spark, sf), "text", CONV)


@query(f"WITH {LINES} SELECT {TIMES} FROM plain")
def transcript_timing_plain(spark, sf):
    return op.transcript_timing_plain(_talks(spark, sf), "conv_id", "turn", "text")


@query(f"WITH {LINES} SELECT conv_id, (max(b + d) // 100)::BIGINT AS length_seconds FROM plain GROUP BY conv_id")
def digest_length(spark, sf):
    return op.digest_length(op.transcript_timing_plain(_talks(spark, sf), "conv_id", "turn", "text"), "conv_id")


@query(f"""WITH {LINES}, l AS (SELECT conv_id, (max(b + d) // 100)::BIGINT AS s FROM plain GROUP BY conv_id)
SELECT conv_id, printf('%02d:%02d', s // 60, s % 60) AS shown FROM l""")
def format_mmss(spark, sf):
    lengths = op.digest_length(op.transcript_timing_plain(_talks(spark, sf), "conv_id", "turn", "text"), "conv_id")
    return lengths.select("conv_id", text.mmss("length_seconds").alias("shown"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN length(text)::DOUBLE WHEN 'assistant' THEN turn + 0.5::DOUBLE ELSE 0::DOUBLE END AS seconds FROM conversations""")
def digest_length_any(spark, sf):
    """Lengths stored as a number, as an object per voice, or as something else."""
    stored = (
        F.when(F.col("role") == "user", F.length("text").cast("string"))
        .when(F.col("role") == "assistant", F.to_json(F.struct((F.col("turn") + 0.5).alias("female_voice"))))
        .otherwise(F.lit('{"other": 1}'))
    )
    return _talks(spark, sf).select(*CONV, op.digest_length_any(stored).alias("seconds"))


DIVERSE = """named AS (SELECT *, CASE WHEN coalesce(nullif(main_category, 'Other'), '') = '' THEN 'Uncategorized' ELSE main_category END AS cat FROM articles),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} cat ORDER BY publish_ts DESC, article_id) AS round,
  count(*) OVER (PARTITION BY {by} cat) AS size, max(publish_ts) OVER (PARTITION BY {by} cat) AS newest FROM named),
picked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN total > 5 THEN round END, CASE WHEN total > 5 THEN -size END,
  CASE WHEN total > 5 THEN newest END DESC, publish_ts DESC, article_id) AS pick
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS total FROM ranked))"""
DIVERSE_ALL = f"{ARTICLES}, " + DIVERSE.format(by="", group="1")
DIVERSE_DAY = f"{ARTICLES}, days AS (SELECT *, strftime(publish_ts, '%Y-%m-%d %H') AS slot FROM articles), " + DIVERSE.replace(
    "FROM articles)", "FROM days)"
).format(by="slot,", group="slot")


def _news(spark, sf):
    return articles(spark, sf).withColumn("main_category", F.nullif("main_category", F.lit("Other")))


@query(f"WITH {DIVERSE_ALL} SELECT article_id, cat AS main_category, pick::INT AS pick FROM picked WHERE pick <= 5")
def diverse_topk(spark, sf):
    picks = op.diverse_topk(_news(spark, sf), 5)
    return picks.select("article_id", F.coalesce("main_category", F.lit("Uncategorized")).alias("main_category"), "pick")


@query(f"WITH {DIVERSE_DAY} SELECT slot, article_id, pick::INT AS pick FROM picked WHERE pick <= 5")
def diverse_topk_per_slot(spark, sf):
    """Five articles for every hour of the month."""
    hourly = _news(spark, sf).withColumn("slot", F.date_format("publish_ts", "yyyy-MM-dd HH"))
    return op.diverse_topk(hourly, 5, by=["slot"]).select("slot", "article_id", "pick")


@query(f"""WITH {DIVERSE_DAY}, p AS (SELECT *, array_to_string([{sql_strip('s')} FOR s IN ({sql_sentences('content')})[1:3]], ' ') AS summary FROM picked WHERE pick <= 5),
g AS (SELECT slot, max(publish_ts) AS newest, string_agg(summary, ' ' ORDER BY pick) AS body, string_agg(url, ' ' ORDER BY pick) AS links FROM p GROUP BY slot)
SELECT slot, strftime(newest, '{TS}') AS publish_date,
  concat('Loom ', CASE WHEN hour(newest) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(newest) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour(newest) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END,
    ' Update - ', strftime(newest, '%B %d, %Y %I:%M %p')) AS title, concat('Welcome. ', body, ' Good bye.') AS script, links FROM g""")
def digest_build(spark, sf):
    """A digest per hour: pick, summarise, assemble."""
    hourly = _news(spark, sf).withColumn("slot", F.date_format("publish_ts", "yyyy-MM-dd HH"))
    picks = op.diverse_topk(hourly, 5, by=["slot"]).withColumn("summary", text.lead_sentences("content", 3))
    made = op.digest_build(picks, ["slot"], "Welcome.", "Good bye.", "Loom", "2024-01-01 00:00:00")
    return made.withColumns({"publish_date": stamp("publish_date"), "links": F.array_join("links", " ")})


TITLE = """concat('Loom ', CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon'
  WHEN hour(ts) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END, ' Update - ', strftime(ts, '%B %d, %Y"""


@query(f"SELECT event_id, {TITLE} %I:%M %p')) AS title FROM events")
def digest_title(spark, sf):
    return table(spark, sf, "events").select("event_id", title_of("ts", "Loom").alias("title"))


@query(f"SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE {TITLE}')) END AS title FROM events")
def digest_title_short(spark, sf):
    full = F.when(F.col("event_type") != "error", title_of("ts", "Loom")).otherwise(F.lit("error"))
    return table(spark, sf, "events").select("event_id", text.short_digest_title(full).alias("title"))


@query(f"""WITH {LINES}, p AS (SELECT event_id, user_id AS conv_id, value / 4 AS t FROM events),
h AS (SELECT p.event_id, first(l.turn::INT ORDER BY l.turn, l.pos) AS turn, first(l.pos ORDER BY l.turn, l.pos) AS pos, first(l.text ORDER BY l.turn, l.pos) AS text
  FROM p JOIN plain l ON l.conv_id = p.conv_id AND p.t >= l.b / 100.0::DOUBLE AND p.t < (l.b + l.d) / 100.0::DOUBLE GROUP BY p.event_id)
SELECT p.event_id, p.conv_id, p.t, (h.turn * 1000000 + h.pos)::BIGINT AS line, h.text FROM p LEFT JOIN h USING (event_id)""")
def transcript_at(spark, sf):
    """The line spoken at every event's moment, in the talk of the event's user."""
    lines = op.transcript_timing_plain(_talks(spark, sf), "conv_id", "turn", "text")
    lines = lines.withColumn("pos", F.col("turn") * 1000000 + F.col("pos")).drop("turn")
    points = table(spark, sf, "events").select("event_id", F.col("user_id").alias("conv_id"), (F.col("value") / 4).alias("t"))
    return op.transcript_at(lines, points, "conv_id", "event_id")


@query(f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN array_to_string([{sql_strip('s')} FOR s IN ({sql_sentences('text')})[1:3]], ' ') ELSE role END AS summary FROM conversations""")
def summary_fill(spark, sf):
    """What users said has no summary yet."""
    talks = _talks(spark, sf).withColumn("summary", F.when(F.col("role") != "user", F.col("role")))
    return op.summary_fill(talks, content="text").select(*CONV, "summary")


@query(f"""WITH {LINES} SELECT conv_id, turn, count(*) AS lines, round(max((b + d) / 100.0::DOUBLE), 2) AS last_end, sum(length(text))::BIGINT AS chars FROM smart GROUP BY conv_id, turn""")
def voice_script_roundtrip(spark, sf):
    """Lines of a script stored as JSON inside JSON, read back for one voice."""
    timed = op.transcript_lines(_talks(spark, sf), "text")
    stored = timed.select(*CONV, op.voice_script(["lines", "lines"]).alias("stored"))
    line = F.explode(op.read_voice_script("stored", "male_voice")).alias("l")
    return stored.select(*CONV, line).groupBy(*CONV).agg(
        F.count("*").alias("lines"), F.round(F.max("l.endTime"), 2).alias("last_end"), F.sum(F.length("l.text")).alias("chars")
    )


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'estimated' ELSE text END AS transcript, CASE WHEN role = 'system' THEN 0 ELSE 1 END::INT AS parsed FROM conversations""")
def fenced_json_parse(spark, sf):
    """Model answers: JSON in a tagged fence, in a plain fence, or no JSON at all."""
    body = F.to_json(F.struct(F.col("text").alias("fullTranscript")))
    answer = (
        F.when(F.col("role") == "user", F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("role") == "assistant", F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .otherwise(F.lit("Sorry, no transcript."))
    )
    parsed = F.from_json(text.fenced_json("answer"), "fullTranscript string")["fullTranscript"]
    return _talks(spark, sf).withColumn("answer", answer).select(
        *CONV, F.coalesce(parsed, F.lit("estimated")).alias("transcript"), F.when(parsed.isNull(), 0).otherwise(1).alias("parsed")
    )
