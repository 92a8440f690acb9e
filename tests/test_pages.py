"""HTML extraction on a page of our own (meta, OG, card, JSON-LD, headings,
images, links, main text)."""

import pytest
from pyspark.sql import functions as F

from pagewise.operators import pages as P

URL = "https://example.org/blog/post"
HTML = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">
<meta name="viewport" content="width=device-width">
<title> Garden Notes &amp; Tips </title>
<meta name="description" content="How to grow beans">
<meta name="author" content="Ada Lovelace">
<meta property="og:title" content=" Garden Notes "><meta property="og:type" content="article">
<meta property="article:published_time" content="2024-05-01">
<meta name="twitter:card" content="summary"><meta property="twitter:site" content="@garden">
<meta name='robots' content='index, follow'>
<link rel="canonical" href="https://example.org/garden">
<script type="application/ld+json">{"@type": "Article", "author": {"name": "Ada"}}</script>
<script type="application/ld+json">[{"@type": ["A", "B"]}, {"name": "x"}, 3]</script>
<script type="application/ld+json">{not json</script>
<style>p { color: red }</style><script>var s = "</p>";</script>
</head><body><header>Site header</header><nav><a href="/home">Home</a></nav>
<!-- a comment <p>hidden</p> -->
<article><h1>Growing Beans</h1><h2>Soil</h2><p>Beans like <b>warm</b> soil.</p><h2>Water</h2>
<p>Water them often.<p>  </p>
<img src="/img/a.png" alt="A bean"><img src="b.png"><img src="b.png" alt="">
<a href="https://other.net/x">Other</a><a href="mailto:me@example.org">Mail</a><a href="../up">Up</a>
</article><footer>Footer</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, URL, HTML)], "page_id BIGINT, url STRING, html STRING")


def test_seo_record(page):
    r = P.seo_record(page).first()
    assert r.title == "Garden Notes & Tips"
    assert r.meta_description == "How to grow beans"
    assert r.canonical_url == "https://example.org/garden"
    assert r.h1_tags == ["Growing Beans"] and r.h2_tags == ["Soil", "Water"]
    assert r.open_graph.og_title == "Garden Notes" and r.open_graph.og_type == "article"
    assert r.open_graph.og_description is None
    assert r.twitter_card.card == "summary" and r.twitter_card.site == "@garden"
    assert r.robots == "index, follow" and r.viewport == "width=device-width" and r.charset == "utf-8"
    assert r.language == "en"
    assert r.schema_markup.types == ["Article", '["A","B"]', "Unknown"]
    assert len(r.schema_markup.data) == 3
    assert r.total_images == 3 and r.images_without_alt == 2
    # /home and ../up and mailto: (empty netloc) are internal; other.net is external
    assert r.internal_links == 3 and r.external_links == 1


def test_content_record(page):
    r = P.content_record(page, include_images=True, include_links=True).first()
    assert r.title == "Garden Notes & Tips"
    assert r.author == "Ada Lovelace"
    assert r.published_date == "2024-05-01"
    assert r.text == "Beans likewarmsoil.\n\nWater them often."
    assert r.word_count == 5
    assert r.images == ["https://example.org/img/a.png", "https://example.org/blog/b.png"]
    # web links only (mailto dropped), resolved, first occurrence order
    assert r.links == ["https://example.org/home", "https://other.net/x", "https://example.org/up"]
    assert r.readability is None  # < 20 whitespace words


def test_author_jsonld_and_blank_meta(spark):
    html_ld = '<html><head><script type="application/ld+json">{"author": "Bob"}</script></head><body></body></html>'
    html_blank = ('<html><head><meta name="author" content="  "><script type="application/ld+json">'
                  '{"author": {"name": "Zed"}}</script></head><body></body></html>')
    df = spark.createDataFrame([(1, URL, html_ld), (2, URL, html_blank)], "page_id BIGINT, url STRING, html STRING")
    got = {r.page_id: r.author for r in P.content_record(df).collect()}
    assert got == {1: "Bob", 2: None}


def test_url_join_cases(spark):
    from pyspark.sql import functions as F
    from pagewise.functions.urls import join_url
    from urllib.parse import urljoin
    base = "http://a.example/b/c/d;p?q#f"
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "..", "../g", "../..", "../../g",
             "../../../g", "", "https://x.org/p", "mailto:x@y", " /spaced ", "a/./b/../c"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h STRING")
    got = [r.j for r in df.select(join_url(F.lit(base), F.col("h")).alias("j")).collect()]
    exp = [urljoin(base, h) for h in hrefs]
    # the ;params of the base path stay in the path (we do not split params)
    diffs = [(h, g, e) for h, g, e in zip(hrefs, got, exp) if g != e and ";p" not in e and ";p" not in g]
    assert not diffs, diffs


def _html(spark, html, *cols):
    from pagewise.operators import pages as P
    df = spark.createDataFrame([(1, "http://h.example/", html)], "page_id long, url string, html string")
    return P.with_main_text(P.tag_stage(df)).select(*cols).first()


def test_quoted_angle_brackets_stay_in_their_tag(spark):
    from pagewise.functions import html as H
    page = ('<html><head><meta name="description" content="Home > Shop > Tea"></head><body>'
            '<img src="a.png" alt="a > b"><p title=\'x > y\'>It\'s 5 < 6 here</p></body></html>')
    r = _html(spark, page, H.meta_structs(*P.parsed()).alias("m"), H.tags(*P.parsed(), "img").alias("i"),
              H.body_text(*P.parsed()).alias("b"), "text")
    assert r.m[0].content == "Home > Shop > Tea"
    assert r.i == ['<img src="a.png" alt="a > b">']
    assert r.b == "It's 5 < 6 here" and r.text == "It's 5 < 6 here"


def test_numeric_references(spark):
    from pagewise.functions import html as H
    r = _html(spark, "<title>Tom &#38; Jerry &#8212; &#x27;x&#X1F600; &#0; &#xD800; &amp;#39; &#12 &#;</title>",
              H.title(*P.parsed()).alias("t"))
    assert r.t == "Tom & Jerry — 'x\U0001F600 � � &#39; &#12 &#;"


def test_the_first_existing_region_wins(spark):
    assert _html(spark, "<body><article></article><main><p>inner</p></main> tail</body>", "text").text == "inner tail"
    assert _html(spark, "<body><div data-role=\"main\"><p>a</p></div><p>b</p></body>", "text").text == "a\n\nb"
    assert _html(spark, "<body><div role=\"main-menu\"><p>a</p></div><p>b</p></body>", "text").text == "a\n\nb"
    assert _html(spark, "<body><p>a</p><div id=q role='main'><p>b</p></div></body>", "text").text == "b"
    assert _html(spark, "<body><p>a</p><div data-class='post'>x</div><p>c</p></body>", "text").text == "a\n\nc"


def test_unclosed_scripts_and_long_runs_take_linear_time(spark):
    import time
    from pagewise.functions import text as T
    _html(spark, "<script>", "text")
    t = time.time()
    _html(spark, "<body>" + "<script>a" * 30_000, "text")
    _html(spark, "<body>" + "<!-- a" * 30_000, "text")
    assert time.time() - t < 10
    df = spark.createDataFrame([(" " * 1_000_000 + "x",), ("a." * 300_000,), ("\n" * 1_000_000,)], "text string")
    df.select(T.sentence_count(F.col("text"))).collect()
    t = time.time()
    got = df.select(T.sentence_count(F.col("text")).alias("n"), T.excerpt(F.col("text")).alias("e"),
                    F.length(T.ws_trim(F.col("text"))).alias("k")).collect()
    assert time.time() - t < 5
    assert [r.n for r in got] == [1, 300_000, 0] and [r.k for r in got] == [1, 600_000, 0]


def test_repeated_json_keys_and_link_counts(spark):
    page = ('<script type="application/ld+json">{"@type":"A","@type":"B","author":"x","author":"y"}</script><body>'
            '<a href="http://z.example/1">a</a><a href="//z.example/2">b</a><a href="/in">c</a><a href="mailto:q">d</a></body>')
    df = spark.createDataFrame([(1, URL, page), (2, URL, page)], "page_id long, url string, html string")
    r = P.seo_record(df).first()
    assert r.schema_markup.types == ["B"] and P.content_record(df).first().author == "y"
    got = sorted(tuple(x) for x in P.link_edges(df).collect())
    assert got == [("example.org", "example.org", 2, 2), ("example.org", "z.example", 4, 2)]
