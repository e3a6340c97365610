"""Articles and links from stored web pages."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import absolute_url, col, collapse_whitespace, let
from newsloom.schema import EXCLUDED_LINK

# The named characters of HTML 4, by Python's table, and &apos;. A no-break space reads as a blank.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
NOISE = (
    r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<nav\b.*?</nav>"
    r"|<footer\b.*?</footer>|<div class=\"ad\".*?</div>"
)
BREAK = r"(?i)</?(?:p|h[1-6]|br|div|li|ul|ol|tr|table|section|article|blockquote|pre)\b[^>]*>"


# The value of an attribute: in double quotes, in single quotes or bare.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _character(reference: Column) -> Column:
    """The text of one reference ``&...;``; an unknown one stays as it is."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    # One text literal, folded into a map when planning.
    named = F.try_element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>"), body)
    digits = F.when(body.rlike("^#[xX]"), F.substring(body, F.lit(3), F.length(body))).otherwise(
        F.conv(F.substring(body, F.lit(2), F.length(body)), 10, 16)
    )
    # No character is beyond 10FFFF, and surrogates are none.
    known = digits.rlike("^0*(?:10|[1-9a-fA-F])?[0-9a-fA-F]{1,4}$") & ~digits.rlike("^0*[dD][89a-fA-F][0-9a-fA-F]{2}$")
    code = F.lpad(F.regexp_replace(digits, "^0+", ""), 8, "0")
    numeric = F.when(known, F.decode(F.unhex(code), "UTF-32"))
    return F.coalesce(F.when(body.startswith("#"), numeric).otherwise(named), reference)


def unescape(c: str | Column) -> Column:
    """Character references decoded in one go: named ones, decimal and hexadecimal numbers."""
    text = col(c)
    found = F.regexp_extract_all(text, F.lit("&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"), 0)

    def decoded(pair: Column) -> Column:
        # &amp; is last, so that what it stands in front of is not decoded a second time.
        references = F.concat(F.filter(pair["refs"], lambda r: r != "&amp;"), F.filter(pair["refs"], lambda r: r == "&amp;"))
        return F.aggregate(references, pair["text"], lambda done, r: F.replace(done, r, _character(r)))

    plain = F.when(text.contains("&"), let(F.struct(text.alias("text"), F.array_distinct(found).alias("refs")), decoded))
    return F.when(text.isNotNull(), F.coalesce(plain, text))


def _value(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, written in any of the three ways; empty if there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*{VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, n) for n in (1, 2, 3)])


def _meta_tags(html: Column) -> Column:
    """``name, content`` of the meta tags in order, as they are written."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:"[^"]*"|'[^']*'|[^"'>])*>"""), 0)
    return F.transform(tags, lambda t: F.struct(F.lower(_value(t, "(?:property|name)")).alias("name"), _value(t, "content").alias("content")))


def _named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: t["name"] == name)


def _without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def _blocks(html: Column) -> Column:
    """The blocks inside <article>, or of the whole page if it has none, without tags."""
    clean = F.regexp_replace(html, NOISE, " ")
    article = F.regexp_extract(clean, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    head_off = F.regexp_replace(clean, r"(?is)<head\b.*?</head>", " ")
    body = F.when(article != "", article).otherwise(head_off)
    return F.split(_without_tags(F.regexp_replace(body, BREAK, "␞")), "␞")


def _plain(texts: Column) -> Column:
    """All texts decoded, white space collapsed. One place for all texts of a page, because decoding is a large expression."""
    return F.transform(texts, lambda t: collapse_whitespace(unescape(t)))


def paragraphs(html: str | Column) -> Column:
    """The non-blank blocks of text inside <article>, or of the whole page if it has none."""
    return F.filter(_plain(_blocks(col(html))), lambda b: b != "")


def page_extract(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Article fields of every page, with the defaults the crawler writes for missing ones."""
    page = F.col(html)
    site = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    names = ["og:title", "author", "og:image", "article:published_time"]

    def first(tags: Column) -> list[Column]:
        """The content of the first meta tag of each name."""
        return [F.get(F.transform(F.slice(_named(tags, n), 1, 1), lambda t: t["content"]), F.lit(0)) for n in names]

    headings = [_without_tags(F.regexp_extract(page, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)) for t in ("title", "h1")]
    raw = let(_meta_tags(page), lambda tags: F.concat(F.array(*first(tags), *headings), _blocks(page)))

    def fields(texts: Column) -> Column:
        og_title, author, image, published, title, h1 = (F.nullif(F.get(texts, F.lit(i)), F.lit("")) for i in range(len(names) + 2))
        content = F.array_join(F.filter(F.slice(texts, len(names) + 3, F.size(texts)), lambda b: b != ""), "\n\n")
        return F.struct(
            F.coalesce(og_title, title, h1, F.lit("No title")).alias("title"), F.coalesce(author, F.lit("No author")).alias("author"),
            F.coalesce(F.nullif(content, F.lit("")), F.lit("No content")).alias("content"), F.coalesce(image, F.lit("")).alias("image_url"), published.alias("publish_date"),
        )

    found = df.select(
        *[c for c in df.columns if c != html],
        F.coalesce(F.nullif(site, F.lit("")), F.lit("No source")).alias("src"),
        let(_plain(raw), fields).alias("_page"),
        F.nullif(_value(F.regexp_extract(page, r"(?is)<html\b[^>]*>", 0), "lang"), F.lit("")).alias("language"),
    )
    return found.select(*[c for c in df.columns if c != html], "src", "_page.*", "language")


def page_links(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per link of a page in page order, made absolute; links to videos and galleries are left out."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s(?:"[^"]*"|'[^']*'|[^"'>])*>"""), 0)
    found = F.filter(F.transform(tags, lambda t: F.when(t.rlike(r"(?i)[\s\"'/]href\s*="), _value(t, "href"))), lambda h: h.isNotNull())
    links = df.select(*[c for c in df.columns if c != html], F.posexplode(found).alias("pos", "href"))
    kept = links.where(~F.col("href").rlike(EXCLUDED_LINK))
    return kept.withColumn("link", absolute_url(url, unescape("href")))
