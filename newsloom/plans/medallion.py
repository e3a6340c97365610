"""The batch pipeline: raw files -> bronze -> silver -> serving table and gold.

Date, hours and stamps all derive from one ``process_ts`` (UTC text), so a run can be
repeated. Each stage reads only the folders of its slot and ends in one write; what two
outputs share is written aside once rather than computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import date_parts, parse_dates, rebuild_timestamp
from newsloom.functions.text import clean_publish_date
from newsloom.operators.categorize import fuzzy_category
from newsloom.operators.clean import clean_columns, url_filter, valid_expr
from newsloom.operators.incremental import batch_notification, loaded_runs, mark_loaded
from newsloom.operators.tables import dedup_stored, gold_build, new_stored_rows
from newsloom.schema import ARTICLE_KEY, SILVER_COLUMNS, SLOT_STARTS, SLOT_ZONE
from newsloom.sources.articles import hours_scan, read_articles_json
from newsloom.sources.sinks import (
    merge_into,
    remove_aside,
    split_corrupt,
    table_exists,
    with_ingest_columns,
    write_aside,
    write_clustered,
    write_partitioned,
)

JOB, GOLD_JOB = "silver_to_serving", "silver_to_gold"
BRONZE_FOLDERS = ["ingest_date", "ingest_hour", "run"]


@dataclass(frozen=True)
class Paths:
    raw: str
    bronze: str
    silver: str
    gold: str
    serving: str
    control: str

    @classmethod
    def under(cls, root: str, raw: str) -> Paths:
        return cls(raw, *[f"{root}/{name}" for name in ("bronze", "silver", "gold", "serving", "control")])


def slot_hours(process_ts: str, zone: str = SLOT_ZONE) -> list[tuple[str, int]]:
    """The UTC (date, hour) folders of the local slot a moment falls in."""
    local = datetime.fromisoformat(process_ts).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
    start = max(s for s in SLOT_STARTS if s <= local.hour)
    end = min([s for s in SLOT_STARTS if s > start], default=24)
    first = local.replace(hour=start, minute=0, second=0, microsecond=0)
    hours = [(first + timedelta(hours=h)).astimezone(timezone.utc) for h in range(end - start)]
    return [(h.strftime("%Y-%m-%d"), h.hour) for h in hours]


def run_name(process_ts: str) -> str:
    """The name of a run's folders: its stamp, readable as text only."""
    return "run-" + "".join(c for c in process_ts if c.isdigit())


def bronze_stage(spark: SparkSession, paths: Paths, process_ts: str) -> None:
    """Store the raw files in the folder of the run; damaged records also go to the error table with their text.

    A repeated run replaces its own folder.
    """
    raw = with_ingest_columns(read_articles_json(spark, paths.raw), process_ts).withColumn("run", F.lit(run_name(process_ts)))
    rows, damaged = split_corrupt(raw)
    # Reading the raw files twice costs less than storing and shuffling them; all rows of a run go to one folder.
    write_partitioned(rows, paths.bronze, BRONZE_FOLDERS, 5000, "overwrite", gather=False)
    write_partitioned(damaged, f"{paths.bronze}_errors", BRONZE_FOLDERS, 5000, "overwrite")


def check_articles(bronze: DataFrame) -> DataFrame:
    """Clean and read dates; ``problem`` is NULL, "invalid" or "unreadable date"."""
    judged = url_filter(bronze).withColumn("_valid", valid_expr(None, cleaned=False))
    cleaned = clean_columns(judged).withColumn("_date_text", clean_publish_date("publish_date"))
    dated = date_parts(parse_dates(cleaned, "publish_date"), "publish_ts")
    unreadable = F.col("publish_ts").isNull() & F.col("_date_text").isNotNull()
    # The day comes from the date read here, so the crawler's own day part is not checked.
    problem = F.when(~F.col("_valid"), "invalid").when(unreadable, "unreadable date")
    return dated.withColumn("problem", problem).drop("_valid", "_date_text")


def silver_rows(checked: DataFrame, process_ts: str) -> DataFrame:
    """Valid, dated, newest per (src, url), categorised, in the silver columns.

    ``checked`` should be a stored table: categories are matched first, because that reads
    one column of it a second time, and after the deduplication would repeat the shuffle.
    """
    good = checked.where("problem IS NULL AND publish_ts IS NOT NULL")
    latest = dedup_stored(fuzzy_category(good), ARTICLE_KEY, ["publish_ts", "ingest_time"], ["title", "content"], good)
    stamp = F.lit(process_ts).cast("timestamp")
    stamped = latest.withColumns(
        {"processed_date": F.date_format(stamp, "yyyy-MM-dd"), "processed_hour": F.date_format(stamp, "HH")}
    )
    return stamped.select(*SILVER_COLUMNS, "publish_ts")


def silver_stage(spark: SparkSession, paths: Paths, process_ts: str, mode: str = "insert_new") -> dict[str, int]:
    """Merge the slot's bronze rows into silver and append the rest to the error table; counts of the run."""
    bronze = hours_scan(spark.read.parquet(paths.bronze), slot_hours(process_ts)).drop("run")
    seen = Observation("silver")
    checked = check_articles(bronze).observe(
        seen,
        F.count("*").alias("checked"),
        F.count_if(F.col("problem") == "invalid").alias("invalid"),
        F.count_if(F.col("problem") == "unreadable date").alias("unreadable"),
    )
    checked = write_aside(checked, "checked")
    damaged = checked.where("problem IS NOT NULL").withColumn("run", F.lit(run_name(process_ts)))
    write_partitioned(damaged, f"{paths.silver}_errors", ["run"], 10000, "overwrite")
    merge_into(spark, paths.silver, silver_rows(checked, process_ts), ARTICLE_KEY, ["processed_date", "processed_hour"], mode, gather=False)
    remove_aside(checked)
    return dict(seen.get)


def serving_stage(spark: SparkSession, paths: Paths, process_ts: str, batch_id: str) -> DataFrame | None:
    """Upsert the silver rows no run has served yet; returns the notification, None if nothing is new.

    What is new goes by folder, not by time: the folders (day and hour of processing) not marked
    as loaded in the control table are read, whatever their hour, so a late slot is served and a
    missed run caught up. The folder of this run may have got more rows since it was loaded, so
    it is compared with the serving table. Folders are marked only after the write.
    """
    waiting = _new_folders(spark, paths, JOB, process_ts)
    new = _in_folders(spark.read.parquet(paths.silver), waiting)
    if table_exists(spark, paths.serving):
        own = F.concat_ws(" ", F.col("processed_date").cast("string"), F.lpad(F.col("processed_hour").cast("string"), 2, "0")) == process_ts[:13]
        served = spark.read.parquet(paths.serving).where(F.col("upload_day").cast("string") == process_ts[:10])
        new = new.where(~own).unionByName(new_stored_rows(new.where(own), served, ARTICLE_KEY))
    stamp = F.lit(process_ts).cast("timestamp")
    rows = dedup_stored(new, ARTICLE_KEY, ["publish_ts", "ingest_time"], ["title"]).select(
        "url", "src", "language", "title", "content", "image_url", rebuild_timestamp().alias("publish_date"),
        "time_reading", "author", "main_category", "categories", "ingest_time",
        stamp.alias("uploaded_date"), F.lit(batch_id).alias("batch_id"), F.date_format(stamp, "yyyy-MM-dd").alias("upload_day"),
    )
    rows = write_aside(rows, "serving-batch")
    if not rows.take(1):
        mark_loaded(spark, paths.control, JOB, waiting)
        return None
    merge_into(spark, paths.serving, rows, ARTICLE_KEY, ["upload_day"], stored=True, gather=False)
    slot = slot_hours(process_ts)
    note = batch_notification(
        rows, "Articles", slot[0][0], [h for _, h in slot], process_ts.replace(" ", "T") + "Z", "UTC", "ingest_time"
    )
    mark_loaded(spark, paths.control, JOB, waiting)
    return note


def _new_folders(spark: SparkSession, paths: Paths, job: str, process_ts: str) -> list[str]:
    """"day hour" of the silver folders a job has not loaded, and that of this run; read from folder names."""
    folder = F.concat_ws(" ", F.col("processed_date").cast("string"), F.lpad(F.col("processed_hour").cast("string"), 2, "0"))
    have = {r[0] for r in spark.read.parquet(paths.silver).select(folder).distinct().collect()}
    return sorted((have - set(loaded_runs(spark, paths.control, job))) | {process_ts[:13]})


def _in_folders(silver: DataFrame, folders: list[str]) -> DataFrame:
    return hours_scan(silver, [(f[:10], int(f[11:13])) for f in folders], "processed_date", "processed_hour")


def gold_stage(spark: SparkSession, paths: Paths, process_ts: str) -> None:
    """Append the silver folders not in gold yet, clustered by category; a repeated run adds none again.

    Like serving, gold goes by folder, so what a failed or late run left behind is caught up.
    """
    day = process_ts[:10]
    waiting = _new_folders(spark, paths, GOLD_JOB, process_ts)
    gold = gold_build(_in_folders(spark.read.parquet(paths.silver), waiting), day)
    if table_exists(spark, paths.gold):
        today = spark.read.parquet(paths.gold).where(F.col("upload_date") == F.lit(day).cast("date"))
        gold = new_stored_rows(gold, today, ["url", "src"])
    write_clustered(gold, paths.gold, "upload_date", "main_category")
    mark_loaded(spark, paths.control, GOLD_JOB, waiting)


def run(spark: SparkSession, paths: Paths, process_ts: str, batch_id: str) -> dict[str, int]:
    bronze_stage(spark, paths, process_ts)
    counts = silver_stage(spark, paths, process_ts)
    if table_exists(spark, paths.silver):
        note = serving_stage(spark, paths, process_ts, batch_id)
        if note is not None:
            note.write.mode("append").text(f"{paths.serving}_messages")
        gold_stage(spark, paths, process_ts)
    return counts
