"""Audio digests: diverse selection, script, timing, transcript lookup."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.dates import digest_title
from newsloom.functions.text import col, comma_count, lead_sentences, sentences, strip, word_count
from newsloom.schema import COMMA_CS, LONG_SENTENCE_CHARS, LONG_SENTENCE_WORD_CS, PAUSE_CS, WORD_CS


def diverse_topk(
    df: DataFrame, k: int = 5, by: Sequence[str] = (), category: str = "main_category", date: str = "publish_ts",
    key: str = "article_id",
) -> DataFrame:
    """k articles per group of ``by`` (or overall): round-robin over categories, the biggest first.

    Every round takes the next newest article of each category. Categories of one size go
    by their newest article. A group of at most k articles is returned whole, newest
    first. Adds ``pick`` (1, 2, ...). No category sends more than k rows per task on.
    """
    named = df.withColumn("_cat", F.when(F.coalesce(category, F.lit("")) == "", F.lit("Uncategorized")).otherwise(F.col(category)))
    newest = [F.desc_nulls_last(date), F.asc(key)]
    sizes = named.groupBy(*by, "_cat").agg(F.count("*").alias("_size"))
    total = F.sum("_size").over(Window.partitionBy(*(by or [F.lit(0)])))
    sizes = sizes.withColumn("_total", total)
    ranked = named.withColumn("_round", F.row_number().over(Window.partitionBy(*by, "_cat").orderBy(*newest))).where(
        F.col("_round") <= k
    )
    # The newest article of each category; keys of any type are only compared.
    first = Window.partitionBy(*by, "_cat").orderBy("_round")
    ranked = ranked.withColumns({"_top_date": F.first(date).over(first), "_top_key": F.first(key).over(first)})
    few = F.col("_total") <= k
    order = [
        F.when(~few, F.col("_round")),
        F.when(~few, -F.col("_size")),
        F.when(~few, F.col("_top_date")).desc_nulls_last(),
        F.when(~few, F.col("_top_key")),
        *newest,
    ]
    joined = ranked.join(sizes, [*by, "_cat"])
    pick = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))
    return joined.withColumn("pick", pick).where(F.col("pick") <= k).drop("_cat", "_round", "_size", "_top_date", "_top_key", "_total")


def sentence_split(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per sentence with its position."""
    return df.select(*keep, F.posexplode(sentences(text)).alias("pos", "sentence")).withColumn("sentence", strip("sentence"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sums_before(values: pa.Array) -> pa.Array:
    """For every array of numbers the sum of the elements before each."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(values.value_lengths().fill_null(0))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    before = np.concatenate([[0], np.cumsum(flat)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(before[:-1] - np.repeat(before[offsets[:-1]], lengths), pa.int64())
    )


def _spoken_cs(s: Column, adjust: bool) -> Column:
    """Hundredths of a second to speak a sentence.

    Every rate is a whole number of hundredths, so sums are exact in any order.
    """
    words = word_count(s).cast("bigint")
    if not adjust:
        return words * WORD_CS
    pace = F.when(F.length(s) > LONG_SENTENCE_CHARS, LONG_SENTENCE_WORD_CS).otherwise(WORD_CS)
    return words * pace + comma_count(s) * COMMA_CS


def _timed(df: DataFrame, text: str, adjust: bool, pause: int) -> DataFrame:
    """Add _s (sentences), _d (their durations) and _b (time before each); no rows move."""
    return (
        df.withColumn("_s", sentences(text))
        .withColumn("_d", F.transform("_s", lambda s: _spoken_cs(s, adjust)))
        .withColumn("_b", _sums_before(F.transform("_d", lambda d: d + pause)))
    )


def _line_rows(df: DataFrame, keep: Sequence[str], offset: Column) -> DataFrame:
    lines = df.select(*keep, offset.alias("_o"), F.posexplode(F.arrays_zip("_s", "_d", "_b")).alias("pos", "_l"))
    start = F.col("_o") + F.col("_l._b")
    return lines.select(
        *keep,
        "pos",
        (start / 100).alias("start_time"),
        ((start + F.col("_l._d")) / 100).alias("end_time"),
        strip(F.col("_l._s")).alias("text"),
    )


def transcript_timing(df: DataFrame, text: str, keep: Sequence[str], adjust: bool = True, pause: int = PAUSE_CS) -> DataFrame:
    """Estimated start and end of every sentence of a script (one row each), in seconds."""
    return _line_rows(_timed(df, text, adjust, pause), keep, F.lit(0).cast("bigint"))


def transcript_lines(df: DataFrame, text: str, adjust: bool = True, pause: int = PAUSE_CS, out: str = "lines") -> DataFrame:
    """Add the timed lines of a script as an array of struct(startTime, endTime, text)."""
    line = F.transform(
        F.arrays_zip("_s", "_d", "_b"),
        lambda x: F.struct(
            (x["_b"] / 100).alias("startTime"), ((x["_b"] + x["_d"]) / 100).alias("endTime"), strip(x["_s"]).alias("text")
        ),
    )
    return _timed(df, text, adjust, pause).withColumn(out, line).drop("_s", "_d", "_b")


def running_offset(df: DataFrame, key: str, pos: str, value: str, chunk: int = 1024) -> DataFrame:
    """(key, pos, offset): the sum of ``value`` over smaller positions of the same key.

    ``pos`` is unique and not negative within the key. Sums run inside chunks of positions, and one total per
    chunk carries them on, so a key with a huge share of the rows is spread over tasks.
    """
    lean = df.select(key, pos, F.col(value).alias("_v"), F.floor(F.col(pos) / chunk).alias("_chunk"))
    totals = lean.groupBy(key, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = lean.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(carried, [key, "_chunk"]).select(key, pos, (F.col("_carry") + F.col("_local")).alias("offset"))


def transcript_timing_plain(df: DataFrame, key: str, section: str, text: str) -> DataFrame:
    """Timing across the sections of a digest, without pauses or adjustments."""
    timed = _timed(df.select(key, section, text), text, False, 0)
    # From the text again, so that the lean side of the join does not run the timing UDF.
    lean = df.select(
        key, section,
        F.aggregate(sentences(text), F.lit(0).cast("bigint"), lambda acc, s: acc + _spoken_cs(s, False)).alias("_total"),
    )
    offsets = running_offset(lean, key, section, "_total")
    return _line_rows(timed.join(offsets, [key, section]), [key, section], F.col("offset"))


def digest_length(lines: DataFrame, key: str) -> DataFrame:
    """Whole seconds up to the end of the last line."""
    return lines.groupBy(key).agg(F.floor(F.max("end_time")).cast("bigint").alias("length_seconds"))


def digest_length_any(c: str | Column) -> Column:
    """Length from JSON that is a number or an object with a length per voice; 0 if neither."""
    voice = F.get_json_object(col(c), "$.female_voice").try_cast("double")
    return F.coalesce(voice, col(c).try_cast("double"), F.lit(0.0))


def digest_build(
    picks: DataFrame, by: Sequence[str], intro: str, outro: str, brand: str, default_date, summary: str = "summary",
    date: str = "publish_ts",
) -> DataFrame:
    """One digest per group of picked articles: script, links, date of the newest article, title.

    ``picks`` comes from ``diverse_topk``: a handful of rows per group with their ``pick``.
    """
    section = F.struct(F.col("pick"), F.col(summary).alias("text"), F.col("url").alias("url"))
    grouped = picks.groupBy(*by).agg(
        F.array_sort(F.collect_list(section)).alias("_s"), F.max(date).alias("_newest")
    )
    texts = F.concat(F.array(F.lit(intro)), F.transform("_s", lambda s: s["text"]), F.array(F.lit(outro)))
    newest = F.coalesce("_newest", F.lit(default_date).cast(picks.schema[date].dataType))
    links = F.filter(F.transform("_s", lambda s: s["url"]), lambda u: u.isNotNull() & (u != ""))
    return grouped.select(
        *by,
        newest.alias("publish_date"),
        digest_title(newest, brand).alias("title"),
        F.array_join(texts, " ").alias("script"),
        links.alias("links"),
    )


def voice_script(lines: Sequence[str], voices: Sequence[str] = ("female_voice", "male_voice")) -> Column:
    """JSON object of voice -> JSON text of the lines (encoded twice, as it is stored).

    ``lines``: names of array columns of struct(startTime, endTime, text), one per voice.
    """
    return F.to_json(F.struct(*[F.to_json(c).alias(v) for v, c in zip(voices, lines)]))


def read_voice_script(c: str | Column, voice: str) -> Column:
    """The lines of a voice, whether they are stored as JSON text or as an array; else empty."""
    schema = "array<struct<startTime:double,endTime:double,text:string>>"
    stored = F.get_json_object(col(c), f"$.{voice}")
    return F.coalesce(F.from_json(stored, schema), F.array().cast(schema))


def transcript_at(
    lines: DataFrame, points: DataFrame, key: str, point_id: str, time: str = "t", bucket: float = 8.0
) -> DataFrame:
    """The first line of the digest with start <= t < end for every point; NULL if there is none.

    Lines are listed under every time bucket they touch, so a point meets only the lines
    of its own bucket, and one long digest does not end up in one task.
    """
    span = F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))
    listed = lines.where("end_time > start_time").withColumn("_b", F.explode(span))
    asked = points.withColumn("_b", F.floor(F.col(time) / bucket)).alias("p")
    spoken = listed.select(key, "_b", "start_time", "end_time", F.struct("pos", "text").alias("_l")).alias("l")
    now = F.col(f"p.{time}")
    same = (F.col(f"p.{key}") == F.col(f"l.{key}")) & (F.col("p._b") == F.col("l._b"))
    met = asked.join(spoken, same & (now >= F.col("l.start_time")) & (now < F.col("l.end_time")), "left")
    rest = [c for c in points.columns if c not in (key, point_id)]
    return (
        met.groupBy(f"p.{key}", f"p.{point_id}")
        .agg(*[F.first(f"p.{c}").alias(c) for c in rest], F.min_by("_l", F.col("_l.pos")).alias("_l"))
        .select(*points.columns, F.col("_l.pos").alias("line"), F.col("_l.text").alias("text"))
    )


def summary_fill(df: DataFrame, summarize=None, n: int = 3, content: str = "content", out: str = "summary") -> DataFrame:
    """Fill missing summaries, by default with the first n sentences; ``summarize`` maps a Column to a Column."""
    empty = F.col(out).isNull() | (F.col(out) == "")
    text = F.when(empty, F.col(content))
    made = summarize(text) if summarize else lead_sentences(text, n)
    return df.withColumn(out, F.when(empty, made).otherwise(F.col(out)))
