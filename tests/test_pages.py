"""Pages as they are found in the wild: attributes in all forms, references of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import pages

PAGE = """<html data-x=1 lang='de'><head><meta content='The &quot;T&quot; &#8212; x' property="og:title"><META name=author content=Ann>
<meta name='article:published_time' content="2024"><meta property="og:image" content="i.png?a=1&amp;b=2"/></head>
<a class="x" href='/a?b=1&amp;c=2'>1</a><a href=/b>2</a><A HREF="http://x/c">3</A><a name="n">4</a><a data-href="no" href="yes">5</a>
<p>caf&eacute; &#x27;q&#x27; &bogus; &#8217;</p></html>"""


def test_references(spark):
    text = "&#8217;|&#x27;|&eacute;|&#8212;|&amp;lt;|&lt;b&gt;|&bogus;|&#x110000;|&#xD800;|&#128512;|&nbsp;x|AT&T|&#0065;|&amp;"
    df = spark.createDataFrame([(text,), (None,), ("",), ("plain",)], "t string").select(pages.unescape("t").alias("t"))
    assert [r.t for r in df.collect()] == ["’|'|é|—|&lt;|<b>|&bogus;|&#x110000;|&#xD800;|😀| x|AT&T|A|&", None, "", "plain"]


def test_attributes_in_all_forms(spark):
    df = spark.createDataFrame([(1, "https://s.org/p", PAGE)], "page_id int, url string, html string")
    row = pages.page_extract(df).first()
    assert (row.title, row.author, row.publish_date, row.image_url, row.language) == ('The "T" — x', "Ann", "2024", "i.png?a=1&b=2", "de")
    assert "café 'q' &bogus; ’" in row.content
    links = pages.page_links(df).orderBy("pos").select("pos", "link").collect()
    assert [tuple(r) for r in links] == [(0, "https://s.org/a?b=1&c=2"), (1, "https://s.org/b"), (2, "http://x/c"), (3, "https://s.org/yes")]


def test_empty_page(spark):
    df = spark.createDataFrame([(1, "u", ""), (2, "u", None)], "page_id int, url string, html string")
    assert pages.page_extract(df).select(F.col("title")).distinct().first().title == "No title"
    assert pages.page_links(df).collect() == []
