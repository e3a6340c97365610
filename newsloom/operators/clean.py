"""Cleaning, validity and the error side output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_text, col, let, strip
from newsloom.schema import BOILERPLATE_PHRASES, DATELINE_MARKER, EXCLUDED_URL, SENTINELS
from newsloom.sources.articles import union_all


def sentinels_to_null(df: DataFrame, sentinels: Mapping[str, Sequence[str]] = SENTINELS) -> DataFrame:
    """Text standing for a missing value becomes NULL."""
    present = [c for c in sentinels if c in df.columns]
    return df.withColumns({c: F.when(~F.col(c).isin(list(sentinels[c])), F.col(c)) for c in present})


def clean_columns(df: DataFrame, columns: Sequence[str] = ("title", "content")) -> DataFrame:
    return df.withColumns({c: clean_text(c) for c in columns})


def url_filter(df: DataFrame, pattern: str = EXCLUDED_URL) -> DataFrame:
    """Rows whose url does not match; a NULL url is dropped."""
    return df.where(~F.col("url").rlike(pattern))


# A text with ten characters besides white space and quotes is not blank and no sentinel,
# whatever cleaning does to it; the pattern gives up or succeeds at its first letters.
_LONG_ENOUGH = r"^(?:[\s\"']*[^\s\"']){10}"


def valid_expr(day: str | None = "day", cleaned: bool = True) -> Column:
    """Never NULL: url, src, title and content are there and mean something, day is NULL or a number.

    With ``cleaned=False`` title and content are still as crawled and are judged as they
    will be after cleaning; only very short ones are cleaned for it.
    """
    ok = F.col("url").isNotNull() & F.col("src").isNotNull()
    for c, sentinel in (("title", "no title"), ("content", "no content")):
        text = F.col(c) if cleaned else clean_text(c)
        ok = ok & (F.col(c).rlike(_LONG_ENOUGH) | ~text.rlike(rf"(?i)^ *({sentinel})? *\z"))
    if day:
        ok = ok & (F.col(day).isNull() | F.col(day).try_cast("int").isNotNull())
    return F.coalesce(ok, F.lit(False))


def with_validity(df: DataFrame, day: str | None = "day") -> DataFrame:
    return df.withColumn("is_valid", valid_expr(day))


def split_valid(df: DataFrame, day: str | None = "day") -> tuple[DataFrame, DataFrame]:
    """(valid rows, the rest); every row is in exactly one of them."""
    return df.where(valid_expr(day)), df.where(~valid_expr(day))


def unparseable_dates(df: DataFrame, parsed: str = "publish_ts", text: str = "publish_date") -> DataFrame:
    """Rows that carry a publish date nobody could read."""
    return df.where(F.col(parsed).isNull() & F.col(text).isNotNull())


def error_rows(invalid: DataFrame, unparseable: DataFrame) -> DataFrame:
    """Both kinds of errors on their common columns, in the order of the first."""
    common = [c for c in invalid.columns if c in unparseable.columns]
    return union_all(invalid.select(*common), unparseable.select(*common))


def quality_report(df: DataFrame, parsed: str = "publish_ts", text: str = "publish_date") -> DataFrame:
    """All stage counts in one pass."""
    valid = valid_expr(None)
    unreadable = F.col(parsed).isNull() & F.col(text).isNotNull()
    return df.agg(
        F.count("*").alias("rows_read"),
        F.count_if(valid).alias("rows_valid"),
        F.count_if(~valid).alias("rows_invalid"),
        F.count_if(valid & unreadable).alias("rows_unparseable"),
        F.count_if(valid & ~unreadable).alias("rows_kept"),
    )


def boilerplate_strip(
    paragraphs: str | Column, phrases: Sequence[str] = BOILERPLATE_PHRASES, marker: str = DATELINE_MARKER
) -> Column:
    """Join paragraphs without boilerplate ones, then drop what stands before the dateline."""
    kept = F.filter(
        F.transform(col(paragraphs), strip),
        lambda p: ~F.exists(F.array(*[F.lit(x) for x in phrases]), lambda x: F.contains(p, x)),
    )

    def after_dateline(text: Column) -> Column:
        at = F.instr(text, marker)
        return F.when(at > 0, F.substr(text, at)).otherwise(text)

    return let(F.array_join(kept, " "), after_dateline)
