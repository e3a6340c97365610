from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.fuzzy import indel_ratio, token_set_ratio
from newsloom.functions.stemming import porter_stem
from newsloom.operators import clean
from newsloom.operators.categorize import fuzzy_category
from newsloom.operators.pages import page_extract, page_links


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_clean_text_keeps_backslash_and_drops_quotes(spark):
    assert one(spark, text.clean_text(F.lit("  a \t\n b \"c' \\ "))) == "a b c \\"


def test_sentences(spark):
    got = one(spark, text.sentences(F.lit("A b. C!  D?\nE.f g.  H")))
    assert got == ["A b.", "C!", "D?", "E.f g.", "H"]


@pytest.mark.parametrize(
    "href, want",
    [
        ("/x/y", "https://a.com/x/y"), ("z.html", "https://a.com/p/z.html"), ("//b.com/q", "https://b.com/q"),
        ("http://c.com", "http://c.com"), ("?k=1", "https://a.com/p/q?k=1"), ("#top", "https://a.com/p/q?x=1#top"),
    ],
)
def test_absolute_url(spark, href, want):
    assert one(spark, text.absolute_url(F.lit("https://a.com/p/q?x=1#f"), F.lit(href))) == want


def test_absolute_url_on_a_bare_host(spark):
    assert one(spark, text.absolute_url(F.lit("https://a.com"), F.lit("x"))) == "https://a.com/x"


def test_small_formats(spark):
    assert one(spark, text.mmss(F.lit(125.9))) == "02:05"
    assert one(spark, text.short_digest_title(F.lit("X Night Update - May 05, 2025 12:00 AM"))) == "X Night Update - May 05, 2025"
    assert one(spark, text.short_digest_title(F.lit("Other - 2025"))) == "Other - 2025"
    assert one(spark, text.last_segment(F.lit("/world/aSIA"))) == "Asia"
    assert one(spark, text.host(F.lit("https://n.vn/a/b"))) == "n.vn"
    assert one(spark, text.first_author(F.array().cast("array<string>"))) == "No author"
    assert one(spark, text.default_if_missing(F.lit(float("nan")), 1.0)) == 1.0
    assert one(spark, text.word_count(F.lit(" a  b\nc "))) == 3
    assert one(spark, text.word_count(F.lit("  "))) == 0


@pytest.mark.parametrize(
    "answer, want",
    [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("```\n[1]\n```", "[1]"), (' {"b": 2} ', '{"b": 2}')],
)
def test_fenced_json(spark, answer, want):
    assert one(spark, text.fenced_json(F.lit(answer))) == want


def test_ratio_is_indel_not_levenshtein():
    assert indel_ratio("technplogy", "technology") == pytest.approx(200 * 9 / 20)
    assert indel_ratio("ab", "cd") == 0


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("", "x", 0), ("tech news", "tech", 100), ("tech", "tech", 100), ("mental helth", "mental health", 96.0),
        ("a b", "c d", 100 / 3),
    ],
)
def test_token_set_ratio(a, b, want):
    assert token_set_ratio(a, b) == pytest.approx(want)
    assert token_set_ratio(b, a) == pytest.approx(want)


def test_fuzzy_category(spark):
    rows = [
        (1, ["time_business"]), (2, ["guardian_football"]), (3, ["government"]), (4, None), (5, []), (6, [None, ""]),
        (7, ["zzzz"]), (8, ["techcrunch_technplogy", "gadjets"]), (9, ["law", "politics"]),
    ]
    df = spark.createDataFrame(rows, "id int, categories array<string>")
    got = {r.id: r.main_category for r in fuzzy_category(df).collect()}
    assert got == {
        1: "Business and Finance", 2: "Sports", 3: "Politics", 4: "Other", 5: "Other", 6: "Other", 7: "Other",
        8: "Technology", 9: "Law and Government",
    }


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"),
        ("vietnamization", "vietnam"), ("formaliti", "formal"), ("electriciti", "electr"), ("adoption", "adopt"),
        ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("is", "is"), ("été", "été"),
    ],
)
def test_porter_stem(word, stem):
    assert porter_stem(word) == stem


def test_validity(spark):
    good = ("u", "s", "t", "c", None)
    bad = [
        (None, "s", "t", "c", None), ("u", None, "t", "c", None), ("u", "s", None, "c", None), ("u", "s", "  ", "c", None),
        ("u", "s", " No Title ", "c", None), ("u", "s", "t", "NO CONTENT", None), ("u", "s", "t", "", None),
        ("u", "s", "t", "c", "soon"),
    ]
    kept = [good, ("u", "s", "No title here", "c", "7"), ("u", "s", "t", "no content yet", "")]
    df = spark.createDataFrame([good, *bad, *kept[1:]], "url string, src string, title string, content string, day string")
    valid, invalid = clean.split_valid(df)
    assert valid.count() + invalid.count() == df.count()
    assert {(r.title, r.content) for r in valid.collect()} == {("t", "c"), ("No title here", "c")}
    assert clean.split_valid(df, None)[0].count() == 4


def test_validity_before_cleaning_is_validity_after(spark):
    texts = ["'\" '", '"No" \n title', "no  title", "n'o title", "No title!", "no content", "", " \t", "a", "'a b c d e f g h i j'", "abcdefghij", None]
    df = spark.createDataFrame([("u", "s", t, c) for t in texts for c in texts], "url string, src string, title string, content string")
    before = df.withColumn("b", clean.valid_expr(None, cleaned=False))
    after = clean.clean_columns(before).withColumn("a", clean.valid_expr(None))
    assert after.where("a <> b").count() == 0 and after.where("a").count() > 20


def test_url_filter_drops_null(spark):
    urls = [None, "a/crossword/", "a/crosswords/x", "a/videos/1", "a/video/1", "a/newsletters/signup/", "a/videogames/1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.url for r in clean.url_filter(df).collect()] == ["a/videogames/1"]


def test_boilerplate(spark):
    p = F.array(F.lit(" intro"), F.lit("Sign up here now"), F.lit("x (CNN) — a"), F.lit("b (CNN) — c"))
    assert one(spark, clean.boilerplate_strip(p)) == "(CNN) — a b (CNN) — c"


def test_page(spark):
    html = (
        '<html lang="en"><head><title>A &amp; B</title><meta property="og:image" content="i.png">'
        '<meta name="author" content="Jo"></head><body><nav>menu</nav><article><h1>A</h1><p>one<br>two</p>'
        "<script>x</script><!-- no --><p> three &lt;3 </p></article><footer>f</footer>"
        '<a class="k" href="/a?x=1&amp;y=2">l</a><a href="/video/1">v</a></body></html>'
    )
    df = spark.createDataFrame([("https://s.org/d/p", html), ("x", "")], "url string, html string")
    full, empty = page_extract(df).collect()
    assert (full.src, full.title, full.author, full.image_url, full.language) == ("https://s.org", "A & B", "Jo", "i.png", "en")
    assert full.content == "A\n\none\n\ntwo\n\nthree <3"
    assert (empty.src, empty.title, empty.author, empty.content) == ("No source", "No title", "No author", "No content")
    assert [(r.pos, r.link) for r in page_links(df).collect()] == [(0, "https://s.org/a?x=1&y=2")]
