"""Date and time expressions.

Reading a publish date never depends on the session time zone: a text without an
offset is taken as UTC, and every format below is parsed together with an offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import clean_publish_date, col, let
from newsloom.schema import SLOT_STARTS, SLOT_ZONE, ZONE_OFFSETS

_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_WEEKDAY = r"(?i)\b(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\b,?\s*"
_LONG_MONTH = (
    r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)\b"
)
_ZONE_NAME = r"\b(" + "|".join(["ET", *ZONE_OFFSETS]) + r")\b"
# A numeric offset counts only right after a time of day.
_OFFSET = r"(?<=:\d{2}|\.\d{3}|\.\d{6})\s*(Z|[+-]\d{2}:?\d{2})(?=$|,)"
_M = rf"(?i:{_MONTHS})"

# (pattern the text has to match after normalisation, format); the first match wins.
DATE_FORMATS = [
    (rf"^\d{{1,2}}:\d{{2}} (?i:[ap]m), {_M} \d{{1,2}}, \d{{4}}$", "h:mm a, MMM d, yyyy"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$", None),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (rf"^\d{{1,2}} {_M} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}}$", "d MMM yyyy HH:mm:ss"),
    (rf"^\d{{1,2}} {_M} \d{{4}} \d{{2}}:\d{{2}}$", "d MMM yyyy HH:mm"),
    (rf"^{_M} \d{{1,2}}, \d{{4}} \d{{2}}:\d{{2}}$", "MMM d, yyyy HH:mm"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$", "dd/MM/yyyy HH:mm"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$", "yyyy/MM/dd HH:mm"),
    (rf"^{_M} \d{{1,2}} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}}$", "MMM d yyyy HH:mm:ss"),
]


def parse_known_formats(c: str | Column) -> Column:
    """A cleaned publish date as a UTC instant, NULL if no known format fits."""
    zones = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])

    def pieces(text: Column) -> Column:
        zone, number = F.regexp_extract(text, _ZONE_NAME, 1), F.regexp_extract(text, _OFFSET, 1)
        body = F.regexp_replace(F.regexp_replace(text, f"{_OFFSET}|{_ZONE_NAME}", ""), r"\s+(?=,|$)", "")
        return F.struct(zone.alias("zone"), number.alias("number"), F.trim(body).alias("body"))

    def with_offset(p: Column) -> Column:
        offset = (
            F.when(p["number"] == "Z", F.lit("+00:00"))
            .when(p["number"] != "", F.regexp_replace(p["number"], r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
            .otherwise(F.coalesce(F.try_element_at(zones, p["zone"]), F.lit("+00:00")))
        )
        eastern = (p["zone"] == "ET") & (p["number"] == "")
        return F.struct(p["body"].alias("body"), offset.alias("offset"), eastern.alias("eastern"))

    def read(p: Column) -> Column:
        tries = [
            F.when(
                p["body"].rlike(guard),
                F.try_to_timestamp(F.concat(p["body"], F.lit(" "), p["offset"]), F.lit(f"{fmt} XXX"))
                if fmt
                else F.concat(p["body"], p["offset"]).try_cast("timestamp"),
            )
            for guard, fmt in DATE_FORMATS
        ]
        return F.struct(F.coalesce(*tries).alias("at"), p["eastern"].alias("eastern"))

    def shift(p: Column) -> Column:
        return F.when(p["eastern"], F.to_utc_timestamp(p["at"], "America/New_York")).otherwise(p["at"])

    norm = F.regexp_replace(F.regexp_replace(col(c), _WEEKDAY, ""), _LONG_MONTH, "$1")
    return let(let(let(let(norm, pieces), with_offset), read), shift)


@F.pandas_udf(T.TimestampType())
def _parse_freely(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Free-form dates; only the rows no known format matched carry a text."""
    from dateutil import parser, tz

    zones = {
        name: tz.tzoffset(name, (1 if o[0] == "+" else -1) * (int(o[1:3]) * 3600 + int(o[4:]) * 60))
        for name, o in ZONE_OFFSETS.items()
    }
    zones["ET"] = tz.gettz("America/New_York")

    def read(text):
        if not text:
            return pd.NaT
        try:
            stamp = pd.Timestamp(parser.parse(text, fuzzy=True, tzinfos=zones, dayfirst=False))
        except (ValueError, OverflowError):
            return pd.NaT
        return stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")

    for batch in batches:
        out = pd.Series(pd.NaT, index=batch.index, dtype="datetime64[ns, UTC]")
        todo = batch[batch.notna()]
        if len(todo):
            values = {text: read(text) for text in todo.unique()}
            out.loc[todo.index] = pd.to_datetime(todo.map(values), utc=True)
        yield out


def parse_dates(df: DataFrame, c: str, out: str = "publish_ts", fallback: bool = True) -> DataFrame:
    """Add ``out``: the publish date as a timestamp, NULL if it is missing or unreadable.

    The Python fallback sees NULL for every row a known format already matched.
    """
    df = df.withColumn("_text", clean_publish_date(c)).withColumn(out, parse_known_formats("_text"))
    if fallback:
        rest = F.when(F.col(out).isNull(), F.col("_text"))
        df = df.withColumn(out, F.coalesce(F.col(out), _parse_freely(rest)))
    return df.drop("_text")


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add the calendar parts of a timestamp; they are NULL where it is NULL."""
    t = F.col(ts)
    return df.withColumns(
        {
            "time": F.date_format(t, "HH:mm"),
            "timezone": F.lit("UTC"),
            "hour": F.hour(t),
            "minute": F.minute(t),
            "day": F.dayofmonth(t),
            "month": F.date_format(t, "MMMM"),
            "month_number": F.month(t),
            "year": F.year(t),
            "weekday": F.date_format(t, "EEEE"),
        }
    )


def rebuild_timestamp() -> Column:
    """A timestamp from the columns year, month_number, day, hour, minute; NULL if out of range."""
    year, month, day, hour, minute = (
        F.col(c).try_cast("int") for c in ("year", "month_number", "day", "hour", "minute")
    )
    in_range = (
        year.between(1900, 9999) & month.between(1, 12) & day.between(1, 31)
        & hour.between(0, 23) & minute.between(0, 59)
    )
    return F.when(in_range, F.try_make_timestamp(year, month, day, hour, minute, F.lit(0)))


def local_time(ts: str | Column, zone: str = SLOT_ZONE) -> Column:
    """Wall-clock time in a zone of a UTC timestamp."""
    return F.from_utc_timestamp(col(ts), zone)


def local_date(ts: str | Column, zone: str = SLOT_ZONE) -> Column:
    """The date in a zone, as it names a day's folder."""
    return F.date_format(local_time(ts, zone), "yyyy-MM-dd")


def parse_iso(c: str | Column) -> Column:
    """ISO text with Z or an offset as a timestamp, NULL if it is not one."""
    return col(c).try_cast("timestamp")


def slot_start(hour: str | Column) -> Column:
    """First hour of the half-open slot an hour of the day belongs to."""
    return F.coalesce(*[F.when(col(hour) >= start, F.lit(start)) for start in reversed(SLOT_STARTS)])


def slot_end(hour: str | Column) -> Column:
    """First hour after the slot."""
    slots = list(zip(SLOT_STARTS, SLOT_STARTS[1:] + [24]))
    return F.coalesce(*[F.when(col(hour) >= start, F.lit(end)) for start, end in reversed(slots)])


def time_slot(df: DataFrame, ts: str, zone: str = SLOT_ZONE) -> DataFrame:
    """Add slot_start, slot_end and effective_date (the day before for the first slot)."""
    local = local_time(ts, zone)
    day = F.to_date(local)
    return df.withColumns(
        {
            "slot_start": slot_start(F.hour(local)),
            "slot_end": slot_end(F.hour(local)),
            "effective_date": F.when(slot_start(F.hour(local)) == 0, F.date_sub(day, 1)).otherwise(day),
        }
    )


def parse_vn_date(c: str | Column, zone: str = "GMT+7") -> Column:
    """The first dd/MM/yyyy HH:mm in a text, local time in the zone, as a UTC timestamp."""
    found = F.nullif(F.regexp_extract(col(c), r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2})", 1), F.lit(""))
    return F.to_utc_timestamp(
        F.try_to_timestamp(F.concat(found, F.lit(" +00:00")), F.lit("dd/MM/yyyy HH:mm XXX")), zone
    )


def localize(ts: str | Column, zone: str = "Asia/Bangkok") -> Column:
    """A naive local time as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(col(ts), zone), "yyyy-MM-dd'T'HH:mm:ssXXX")


def digest_title(ts: str | Column, brand: str) -> Column:
    """"<brand> Morning Update - May 05, 2025 07:30 AM"."""
    hour = F.hour(col(ts))
    part = (
        F.when(hour.between(5, 11), "Morning")
        .when(hour.between(12, 16), "Afternoon")
        .when(hour.between(17, 20), "Evening")
        .otherwise("Night")
    )
    return F.concat(
        F.lit(f"{brand} "), part, F.lit(" Update - "), F.date_format(col(ts), "MMMM dd, yyyy hh:mm a")
    )
