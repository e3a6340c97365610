from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions.text import clean_publish_date
from newsloom.plans.medallion import slot_hours

CASES = [
    ("9:41 AM EDT, Tue April 22, 2025", "2025-04-22 13:41:00"),
    ("Updated  9:41 AM EDT, Tue April 22, 2025", "2025-04-22 13:41:00"),
    ("  published 12:05 pm ET,   Wed January 1, 2025", "2025-01-01 17:05:00"),
    ("9:41 AM ET, Tue April 22, 2025", "2025-04-22 13:41:00"),
    ("2025-04-22 10:00:00", "2025-04-22 10:00:00"),
    ("2025-04-22 10:00:00.250", "2025-04-22 10:00:00"),
    ("2025-04-22T10:00:00+02:00", "2025-04-22 08:00:00"),
    ("2025-04-22T10:00:00Z", "2025-04-22 10:00:00"),
    ("2025-04-22T10:00:00.123456-0530", "2025-04-22 15:30:00"),
    ("2025-04-22T10:00:00", "2025-04-22 10:00:00"),
    ("Tue, 22 Apr 2025 10:00:00 +0000", "2025-04-22 10:00:00"),
    ("Tue, 22 Apr 2025 10:00:00 GMT", "2025-04-22 10:00:00"),
    ("22 Apr 2025 10:00", "2025-04-22 10:00:00"),
    ("2025-04-22", "2025-04-22 00:00:00"),
    ("Apr 22, 2025 10:00", "2025-04-22 10:00:00"),
    ("September 2, 2025 10:00", "2025-09-02 10:00:00"),
    ("May 5, 2025 10:00", "2025-05-05 10:00:00"),
    ("22/04/2025 10:00", "2025-04-22 10:00:00"),
    ("02/04/2025 10:00", "2025-04-02 10:00:00"),
    ("2025/04/22 10:00", "2025-04-22 10:00:00"),
    ("Apr 22 2025 10:00:00 EST", "2025-04-22 15:00:00"),
    ("Apr 22 2025 10:00:00 PDT", "2025-04-22 17:00:00"),
    ("Tue Apr 22 2025 10:00:00", "2025-04-22 10:00:00"),
    ("No publish date", None),
    ("null", None),
    ("", None),
    (None, None),
    ("garbage", None),
    ("2025-02-31 10:00:00", None),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_publish_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
        parsed = dates.parse_dates(df, "t").select("i", F.unix_timestamp("publish_ts").alias("s")).orderBy("i").collect()
        import pandas as pd

        want = [None if w is None else int(pd.Timestamp(w, tz="UTC").timestamp()) for _, w in CASES]
        assert {CASES[r.i][0]: r.s for r in parsed} == {t: w for (t, _), w in zip(CASES, want)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_known_formats_need_no_python(spark):
    df = spark.createDataFrame([(t,) for t, w in CASES if w], "t string")
    known = df.select(dates.parse_known_formats(clean_publish_date("t")).alias("ts"))
    assert known.where("ts IS NULL").count() == 0


def test_free_form_dates(spark):
    df = spark.createDataFrame([("on 5 March 2024 at 3pm EST",), ("March 5th, 2024",)], "t string")
    got = [str(r.publish_ts) for r in dates.parse_dates(df, "t").collect()]
    assert got == ["2024-03-05 20:00:00", "2024-03-05 00:00:00"]


def test_unreadable_is_not_missing(spark):
    df = spark.createDataFrame([("garbage",), ("No publish date",)], "t string").withColumn("x", clean_publish_date("t"))
    from newsloom.operators.clean import unparseable_dates

    rows = unparseable_dates(dates.parse_dates(df, "t"), "publish_ts", "x").collect()
    assert [r.t for r in rows] == ["garbage"]


def test_rebuild_rejects_what_is_out_of_range(spark):
    rows = [("2024", "2", "29", 1, 2), ("2023", "2", "29", 1, 2), ("1899", "1", "1", 0, 0), ("2024", "13", "1", 0, 0),
            ("2024", "1", "1", 24, 0), ("2024", "1", "1", 0, 60), ("x", "1", "1", 0, 0), (None, "1", "1", 0, 0)]
    df = spark.createDataFrame(rows, "year string, month_number string, day string, hour int, minute int")
    got = [r[0] for r in df.select(dates.rebuild_timestamp().cast("string")).collect()]
    assert got == ["2024-02-29 01:02:00"] + [None] * 7


def test_slots_are_half_open(spark):
    df = spark.range(24).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"))
    rows = dates.time_slot(df, "ts", "UTC").orderBy("ts").collect()
    assert [r.slot_start for r in rows] == [0] * 5 + [5] * 6 + [11] * 6 + [17] * 7
    assert [r.slot_end for r in rows] == [5] * 5 + [11] * 6 + [17] * 6 + [24] * 7
    assert [str(r.effective_date) for r in rows] == ["2023-12-31"] * 5 + ["2024-01-01"] * 19


def test_slot_hours_follow_local_time():
    assert slot_hours("2024-01-01 22:30:00") == [
        ("2024-01-01", 22), ("2024-01-01", 23), *[("2024-01-02", h) for h in range(4)]
    ]
    every = [h for ts in ("2024-01-01 17:00:00", "2024-01-01 22:00:00", "2024-01-02 04:00:00", "2024-01-02 10:00:00") for h in slot_hours(ts)]
    assert len(every) == len(set(every)) == 24


def test_digest_titles(spark):
    df = spark.createDataFrame([(f"2025-05-05 {h:02d}:30:00",) for h in (4, 5, 11, 12, 16, 17, 20, 21)], "t string")
    got = [r[0].split()[1] for r in df.select(dates.digest_title(F.col("t").cast("timestamp"), "X")).collect()]
    assert got == ["Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night"]
    title = df.limit(1).select(dates.digest_title(F.col("t").cast("timestamp"), "X")).first()[0]
    assert title == "X Night Update - May 05, 2025 04:30 AM"
