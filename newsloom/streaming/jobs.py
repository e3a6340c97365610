"""Structured Streaming jobs.

Every job runs with the available-now trigger: it takes what has arrived, commits, and
ends, so a scheduler can start it several times a day. State is bounded by a watermark.
Results are written so that a replayed batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.dates import local_time, slot_start
from newsloom.operators.tables import first_per_key
from newsloom.operators.trends import trend_assign, trending_rows
from newsloom.schema import RAW_ARTICLE, SLOT_ZONE, UPDATE_MESSAGE
from newsloom.sources.sinks import merge_into, remove_aside, table_exists, with_ingest_columns, write_aside


def article_stream(
    spark: SparkSession, folder: str, schema: T.StructType = RAW_ARTICLE, multiline: bool = True,
    max_files: int | None = None,
) -> DataFrame:
    """Arriving article files; damaged records carry their text in ``_corrupt``."""
    reader = (
        spark.readStream.schema(schema)
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def append_stream(
    df: DataFrame, path: str, checkpoint: str, by: Sequence[str] = (), max_records: int = 5000
) -> StreamingQuery:
    """Append to a parquet table exactly once (the file sink keeps a commit log)."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_records)
        .partitionBy(*by)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def bronze_stream(
    articles: DataFrame, bronze: str, errors: str, checkpoint: str, ingest_ts: Column | None = None
) -> list[StreamingQuery]:
    """Append arriving articles to bronze, and the damaged ones with their text to the error table."""
    stamped = with_ingest_columns(articles, F.current_timestamp() if ingest_ts is None else ingest_ts)
    by = ["ingest_date", "ingest_hour"]
    return [
        append_stream(stamped.where("_corrupt IS NULL").drop("_corrupt"), bronze, f"{checkpoint}/bronze", by),
        append_stream(stamped.where("_corrupt IS NOT NULL"), errors, f"{checkpoint}/errors", by),
    ]


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``m`` (the parsed update message, NULL if it is not JSON) and ``is_update``.

    An update names a date, at least one hour and both ends of a time range.
    """
    parsed = df.withColumn("m", F.from_json(value, UPDATE_MESSAGE))
    ends = [F.coalesce(F.col(f"m.time_range.{end}"), F.lit("")) for end in ("from", "to")]
    is_update = (
        (F.col("m.update_type") == "general")
        & (F.size(F.coalesce("m.details.hours", F.array().cast("array<int>"))) > 0)
        & (F.coalesce("m.details.date", F.lit("")) != "")
        & (ends[0] != "")
        & (ends[1] != "")
    )
    return parsed.withColumn("is_update", F.coalesce(is_update, F.lit(False)))


def update_windows(messages: DataFrame) -> DataFrame:
    """Valid updates with their window: start, end and the key that makes it unique."""
    start, end = (F.col(f"m.time_range.{e}").try_cast("timestamp") for e in ("from", "to"))
    windows = messages.where("is_update").withColumns({"start_time": start, "end_time": end})
    hour = "yyyy-MM-dd'_'H"
    return windows.where("start_time IS NOT NULL AND end_time IS NOT NULL").withColumn(
        "window_key", F.concat_ws("-", F.date_format("start_time", hour), F.date_format("end_time", hour))
    )


def once_per_window(df: DataFrame, key: str | Sequence[str], event_time: str, ttl: str = "1 hour") -> DataFrame:
    """The first row of every key; a key is forgotten ``ttl`` after its event time."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark(keys)


def run_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )


def replace_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a micro-batch under its number; a replay replaces it."""
    (
        df.withColumn("stream_batch", F.lit(batch))
        .write.partitionBy("stream_batch")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def dedup_stream(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], event_time: str, by: Sequence[str], ttl: str = "1 day"
) -> StreamingQuery:
    """Insert articles not stored yet: duplicates in the stream go by state, older ones by the table."""

    def handle(batch: DataFrame, number: int) -> None:
        merge_into(batch.sparkSession, path, batch, keys, by, mode="insert_new")

    return run_batches(once_per_window(df, keys, event_time, ttl), checkpoint, handle)


def score_batches(
    windows: DataFrame, articles: DataFrame, trends: DataFrame, path: str, checkpoint: str, threshold: float = 0.5,
    event_time: str = "end_time", ttl: str = "1 hour",
) -> StreamingQuery:
    """For every announced upload batch, score its articles against the trends and store them.

    ``articles`` carries ``batch_id``; a window's ``batch_id`` picks its rows. A batch is
    scored once: repeated announcements are dropped by state, and the rows of a batch are
    kept in a folder of their own, which a replay replaces.
    """

    def handle(batch: DataFrame, number: int) -> None:
        # Stored first: the join may skip partitions of the batch that have no row, and then their state is not committed.
        asked = write_aside(batch.select("batch_id", F.col("end_time").alias("analyzed")), "announced")
        rows = articles.join(asked.dropDuplicates(["batch_id"]), "batch_id")
        scored = trending_rows(trend_assign(rows, trends, threshold), F.col("analyzed")).drop("analyzed", "embedding")
        (
            scored.write.partitionBy("batch_id")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(path)
        )
        remove_aside(asked)

    return run_batches(once_per_window(windows, "batch_id", event_time, ttl), checkpoint, handle)


CLAIM = "window_key string, state string, at timestamp, noted timestamp, phase int"


def open_windows(windows: DataFrame, claims: DataFrame, lock: str = "1 hour", completion: str = "24 hours", key: str = "window_key", event_time: str = "end_time") -> DataFrame:
    """The windows that may be handled, one row each: neither claimed within ``lock`` nor completed within ``completion`` of their event time.

    ``claims`` is the log of ``CLAIM`` rows; the latest row of a window says its state, and a released window is free.
    """
    latest = first_per_key(claims, ["window_key"], [F.desc("noted"), F.desc("phase")]).select(F.col("window_key").alias("_key"), "state", "at")
    asked = first_per_key(windows.where(F.col(key).isNotNull()), [key], [F.asc(event_time)])
    known = asked.join(latest, F.col(key) == F.col("_key"), "left")
    held = ((F.col("state") == "claimed") & (F.col(event_time) < F.col("at") + F.expr(f"INTERVAL {lock}"))) | (
        (F.col("state") == "completed") & (F.col(event_time) < F.col("at") + F.expr(f"INTERVAL {completion}"))
    )
    return known.where(~F.coalesce(held, F.lit(False))).drop("_key", "state", "at")


def handle_windows(
    windows: DataFrame, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], lock: str = "1 hour", completion: str = "24 hours",
    key: str = "window_key", event_time: str = "end_time",
) -> StreamingQuery:
    """Handle each announced window once, with two lifetimes: a claim that lasts ``lock``, a completion that lasts ``completion``.

    Claims are a log of small rows under ``path``, so several streams (and a restarted one) see them. The windows of
    a micro-batch are claimed before ``handle`` gets them and completed after; if it fails they are
    released and the query fails, so the next run handles them again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        claims = spark.read.schema(CLAIM).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], CLAIM)
        free = write_aside(open_windows(batch, claims, lock, completion, key, event_time), "windows")

        def note(state: str, phase: int) -> None:
            rows = free.select(F.col(key).cast("string").alias("window_key"), F.lit(state).alias("state"), F.col(event_time).cast("timestamp").alias("at"))
            rows.withColumns({"noted": F.current_timestamp(), "phase": F.lit(phase)}).coalesce(1).write.mode("append").parquet(path)

        note("claimed", 0)
        try:
            handle(free, number)
        except Exception:
            note("released", 1)
            raise
        note("completed", 2)
        remove_aside(free)

    return run_batches(windows, checkpoint, run)


def slot_counts(df: DataFrame, ts: str, zone: str = SLOT_ZONE) -> DataFrame:
    """Rows per hour and processing slot (slots are uneven, so the hour is the window).

    Works on a table and on a stream; ``ts`` has to be a timestamp with a watermark there.
    """
    hour = F.window(ts, "1 hour")
    return df.groupBy(hour, slot_start(F.hour(local_time(ts, zone))).alias("slot_start")).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("hour_start"), "slot_start", "n"
    )
