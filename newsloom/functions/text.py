"""Text expressions. All are native Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense, spelled so that it works without flags.
WS = r"[\s\p{Z}\x{0B}\x{85}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Without it the optimizer may copy a costly expression into every place it is used.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def collapse_whitespace(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def clean_text(c: str | Column) -> Column:
    """Collapse white space, trim, then drop quotes (without trimming again)."""
    return F.replace(F.replace(collapse_whitespace(c), F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))


def clean_publish_date(c: str | Column) -> Column:
    """Drop a leading "Updated"/"Published" and collapse white space; sentinels become NULL."""
    text = F.trim(F.regexp_replace(F.regexp_replace(col(c), r"(?i)^\s*(Updated|Published)\s+", ""), r"\s+", " "))
    return let(text, lambda t: F.when(~F.lower(t).isin("", "null", "no publish date"), t))


def clean_category(c: str | Column) -> Column:
    return F.lower(F.trim(F.translate(F.regexp_replace(col(c), "^guardian_", ""), "_", " ")))


def normalize_url(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"/index\.html$", "")


def last_segment(c: str | Column) -> Column:
    """The last path segment, first letter upper case and the rest lower case."""
    segment = F.element_at(F.split(col(c), "/"), -1)
    return F.concat(F.upper(F.substring(segment, 1, 1)), F.lower(F.substr(segment, F.lit(2))))


def category_path(c: str | Column) -> Column:
    return F.split(col(c), " > ")


def absolute_url(base: str | Column, href: str | Column) -> Column:
    """Resolve a link against the page it stands on."""
    base, href = col(base), col(href)
    page = F.regexp_replace(base, r"[?#].*$", "")
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(site, folder, href))
    )


def host(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit(""))


_SENTENCE_END = rf"(?<=[.!?]){WS}+"


def sentences(c: str | Column) -> Column:
    """Split after . ! ? followed by white space; blank pieces are dropped."""
    return F.filter(F.split(col(c), _SENTENCE_END), lambda s: strip(s) != "")


def word_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(col(c), f"{WS}+"), lambda w: w != ""))


def comma_count(c: str | Column) -> Column:
    return F.length(col(c)) - F.length(F.translate(col(c), ",", ""))


def lead_sentences(c: str | Column, n: int = 3) -> Column:
    """The first n sentences of the whole text: the default summary.

    Only the last piece of a text can be blank, as all others end in . ! or ?, so the text is split no further than n pieces.
    """
    ahead = F.slice(F.split(col(c), _SENTENCE_END, n + 1), 1, n)
    return F.array_join(F.filter(F.transform(ahead, strip), lambda s: s != ""), " ")


def mmss(seconds: str | Column) -> Column:
    whole = F.floor(col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def short_digest_title(c: str | Column) -> Column:
    """Drop the time of day from a digest title that ends in date and time."""
    return F.regexp_replace(col(c), r"^(.+\s-\s.+\d{4})\s\d{1,2}:\d{2}\s[APM]{2}$", "$1")


def fenced_json(c: str | Column) -> Column:
    """The body of the first ``` block (with or without a json tag), else the whole text."""
    tagged = F.regexp_extract(col(c), r"```json\s*([\s\S]*?)\s*```", 1)
    plain = F.regexp_extract(col(c), r"```\s*([\s\S]*?)\s*```", 1)
    return strip(
        F.when(col(c).rlike(r"```json\s*[\s\S]*?\s*```"), tagged)
        .when(col(c).rlike(r"```\s*[\s\S]*?\s*```"), plain)
        .otherwise(col(c))
    )


def first_author(authors: str | Column) -> Column:
    return F.coalesce(F.try_element_at(col(authors), F.lit(1)), F.lit("No author"))


def join_authors(authors: str | Column) -> Column:
    joined = F.array_join(F.transform(col(authors), strip), ", ")
    return F.when(F.size(col(authors)) > 0, joined).otherwise(F.lit("No author"))


def category_array(c: str | Column) -> Column:
    """A one-element category array; NULL gives an empty array."""
    return F.when(col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(col(c)))


def default_if_missing(c: str | Column, default) -> Column:
    """NULL and (for floating numbers) NaN give the default."""
    return F.coalesce(F.when(~F.isnan(col(c).try_cast("double")) | col(c).try_cast("double").isNull(), col(c)), F.lit(default))
