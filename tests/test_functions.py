import random
from html import unescape
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, html, text, urls
from tidemark.plans import queries


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x string"
    row = tuple(cols.values()) or (None,)
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


CANONICAL = [
    ("HTTP://EX.com/A/?b=2&a=1&utm_X=3&c=&d", "http://ex.com/A?a=1&b=2"),
    ("//h.com/p;x=1/?q=a%20b~*#f", "https://h.com/p;x=1?q=a+b~%2A"),
    ("https://h.com/a;p1?k=1", "https://h.com/a?k=1"),
    ("  http://h.com//  ", "http://h.com"),
    ("https://news.google.com/rss/articles/XYZ?hl=en&gl=US", "https://news.google.com/rss/articles/XYZ"),
    ("path", "https:path"),
    ("", ""),
    (None, ""),
    ("http://h.com/?b=1&a=2&a=1", "http://h.com?a=1&a=2&b=1"),
    ("http://h.com/?a=%zz", "http://h.com?a=%25zz"),
]


@pytest.mark.parametrize(("url", "want"), CANONICAL)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url("u"), u=url) == want
    if ";" not in want:
        assert one(spark, urls.canonical_url("u"), u=want) == want


def test_url_keys(spark):
    assert one(spark, urls.norm_url("u"), u=" HTTP://H.com/A/?x=1/ ") == "http://h.com/a/?x=1"
    for u, h in (("http://u:p@H.com:80/x", "h.com"), ("h.com/x", ""), ("", ""), ("https://a_b.com?x", "a_b.com"), ("//x.y/z", "x.y")):
        assert one(spark, urls.url_host("u"), u=u) == h


@pytest.mark.parametrize(
    ("src", "want"),
    [("../c.png", "https://h.com/c.png"), ("c.png", "https://h.com/a/c.png"), ("/x/./y/../z.png?q=1", "https://h.com/x/z.png?q=1"), ("//i.com/p.png", "https://i.com/p.png"), ("http://o.com/a", "http://o.com/a"), ("?x=1", "https://h.com/a/b?x=1"), ("data:image/png;base64,AA", None), (" ", None), (None, None)],
)
def test_resolve_img_src(spark, src, want):
    assert one(spark, urls.resolve_img_src("s", F.lit("https://h.com/a/b?k=2")), s=src) == want


def test_small_functions(spark):
    assert [one(spark, urls.first_int("x"), x=v) for v in ("100%", "auto", None, "99999999999")] == [100, 0, 0, 0]
    assert one(spark, text.norm_text("x"), x="Hello, 世界! A_1") == "hello世界a_1"
    assert one(spark, text.title_key("x"), x="A b, C") == "ab,c"
    assert one(spark, text.normalize_snippet("x"), x="<b>x</b>&amp;**y**  z") == "x &y z"
    assert one(spark, text.normalize_snippet("x"), x="&eacute;&#x41; &#8217;&mdash;") == "éA ’—"
    assert one(spark, text.normalize_site("x"), x=" HTTPS://www.Ex.com/news/ ") == "ex.com"
    assert one(spark, text.sanitize_summary("x"), x="**a** \r\nb") == "a\nb"
    assert one(spark, text.sanitize_summary("x"), x=" a \t\n\n b\r\rc ") == "a\n\n b\n\nc"
    assert one(spark, text.parse_list("x"), x="a， b,,c ,") == ["a", "b", "c"]
    assert one(spark, text.distinct_sites("x"), x="http://www.a.com/x,a.com,B.com") == ["a.com", "b.com"]
    assert [one(spark, text.looks_garbled("x"), x=v) for v in ("âï", "âï¿", "")] == [False, True, False]
    assert [one(spark, text.is_too_short("x"), x=" x " * n) for n in (99, 100)] == [True, False]
    assert one(spark, text.fallback_summary("t", "x", 40), t="T", x="a  b\n" * 30) == "【摘要】T\na b a b a b a b a b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("标题 - 新浪网", "标题"), ("A | B | C | D | E", "A - B"), ("eVTOL-news", "eVTOL"), ("Title -", "Title"), ("- A", "未命名"), ("One fact - a very long closing clause here", "One fact - a very long closing clause here"), (None, "未命名"), ("a very long closing clause of the daily-x finance", "a very long closing clause of the daily")],
)
def test_normalize_title(spark, raw, want):
    assert one(spark, text.normalize_title("x"), x=raw) == want


def test_feed_title(spark):
    assert one(spark, text.feed_title("t", "d"), t="Google News", d='x <a href="u">Real &amp; long enough title</a>') == "Real & long enough title"
    assert one(spark, text.feed_title("t", "d"), t="Google News", d="none") == "Google News"
    assert one(spark, text.feed_title("t", "d"), t=None, d=None) == "未命名"


def test_dates(spark):
    from datetime import datetime

    assert one(spark, dates.parse_pubdate("x"), x="Mon, 15 Jan 2024 10:00:00 +0200") == datetime(2024, 1, 15, 8)
    assert one(spark, dates.parse_pubdate("x"), x="15 Jan 2024 10:00:00 GMT") == datetime(2024, 1, 15, 10)
    assert one(spark, dates.parse_pubdate("x"), x="soon") is None
    assert one(spark, dates.parse_iso("x"), x="2024-01-15T10:00:00Z") == datetime(2024, 1, 15, 10)
    assert one(spark, dates.parse_iso("x"), x="2024-01-15T10:00:00") is None


PAGE = """<html><head><title> My page | Site </title><meta property="og:image" content="/og.png"></head><body><script>var t="<p>no</p>";</script>
<!-- <p>hidden hidden hidden hidden</p> --><article><p>The first paragraph is long enough.<p>The second one is also <b>long</b> enough &amp; fine.</p><li>short</li>
<img src="logo.png"><img src="big.png" width="640" height="480" class="x"></article><h2>A heading that is long enough too</h2></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, "http://h.com/a/b", PAGE), (2, "http://h.com/", None)], "page_id long, url string, html string")
    blocks = html.assemble_text(html.min_block(html.explode_blocks(df))).collect()
    want = "The first paragraph is long enough.\nThe second one is also long enough & fine.\nA heading that is long enough too"
    assert [(r["page_id"], r["text"]) for r in blocks] == [(1, want)]
    assert {r["page_id"]: r["t"] for r in df.select("page_id", html.block_text("html").alias("t")).collect()} == {1: want, 2: ""}
    titles = {r["page_id"]: r["t"] for r in df.select("page_id", html.page_title("html", F.lit("Hit title")).alias("t")).collect()}
    assert titles == {1: "My page", 2: "Hit title"}
    cands = html.image_candidates(df)
    assert {r["page_id"]: r["cover_url"] for r in html.pick_cover(cands).collect()} == {1: "http://h.com/a/big.png"}


def test_references_equal_the_standard_library(spark):
    rnd, names = random.Random(3), list(html5)
    texts = ["&amp;lt;", "&notit;", "&copyx &AMP &#x80; &#0; &#13; &#xD800; &#x110000; &#99999999999; &#x1F600;", "& a &; &# &#; &#x; &&amp;", "no", "", "&#38;#38;", "&#000065;&#x000041", "&#x1;&#xb;&#xFFFE;&#xFDD0;&#127;"]
    some = lambda: rnd.choice(["&" + rnd.choice(names), "&" + rnd.choice(names).rstrip(";"), f"&#{rnd.randrange(0x11FFFF)};", f"&#x{rnd.randrange(0x3000):x}", " ", "a", "z;", "&", "#", "é"])
    texts += ["".join(some() for _ in range(rnd.randrange(8))) for _ in range(500)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string").select("i", text.unescape_html("x").alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [*map(unescape, texts), None]


def test_unclosed_references_can_stay(spark):
    assert one(spark, text.unescape_html("x", unclosed=False), x="a&amp;b &amp &copyx &#65 &lt;&amp;lt;") == "a&b &amp &copyx A <&lt;"
    assert one(spark, html.page_title("x", F.lit(""), unclosed=False), x="<title>Cut &amp; off&amp</title>") == "Cut & off&amp"


@pytest.mark.parametrize("name", ["t7_normalize_snippet", "t9_unescape_html", "t11_page_title", "t27_article_record", "s1_read_feed", "s2_read_results", "s4_s5_history_round_trip", "articles_of_crawl", "d2_extract_articles", "j2_jaccard_titles"])
def test_queries_read_references_as_their_sql_does(spark, tmp_path, name):
    """Titles cut within a reference, as some of sf0.1 are."""
    page = "<html><head><title>{} and&amp;&ampers {}&amp</title></head><body><p>A paragraph of twenty-five characters and &lt;more&gt;.</p></body></html>"
    pages = [(i, f"http://h.com/{i}", page.format(("Some words", "Another title")[i // 2 % 2], i // 4)) for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    made, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLES[name]).df()
    rows = lambda df: sorted(df[sorted(df.columns)].astype(str).values.tolist())
    assert len(made) and rows(made) == rows(want)


def test_nested_blocks(spark):
    page = "<ul><li>a <p>b</p> c<script>x</script></li><li>d</li></ul><p>e<p>f</p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r["pos"], r["text"]) for r in html.nested_blocks(df).orderBy("pos").collect()] == [(0, "a b c"), (1, "b"), (2, "d"), (3, "e f"), (4, "f")]
    assert [r["text"] for r in html.explode_blocks(df).orderBy("pos").collect()] == ["a", "b", "d", "e", "f"]


def test_malformed_pages_have_candidates(spark):
    page = '<![foo[ x><![ y]><div class="content"><img src="/a.jpg"><![if !IE]></span></div>' + "<b>" * 30_000 + "</i>" * 30_000
    df = spark.createDataFrame([(1, "https://h.com/x", page)], "page_id long, url string, html string")
    assert [(r["priority"], r["src"]) for r in html.image_candidates(df).collect()] == [(0, "https://h.com/a.jpg"), (3, "https://h.com/a.jpg")]


def test_cover_order(spark):
    def cover(body):
        df = spark.createDataFrame([(1, "http://h.com/", body)], "page_id long, url string, html string")
        r = html.pick_cover(html.image_candidates(df)).first()
        return r and r["cover_url"]

    og = '<meta property="og:image" content="/og.png"><meta name="twitter:image" content="/tw.png">'
    assert cover(og + '<div class="content"><img src="a.png" width="199"></div><img src="b.png">') == "http://h.com/og.png"
    assert cover('<meta property="og:image" content="/logo.png"><img src="/plain.png">') == "http://h.com/plain.png"
    assert cover('<img src="x.png" alt="Logo"><img src="data:image/png;base64,A">') is None


def test_page_text(spark):
    got = lambda t, s: one(spark, html.page_text("t", "s"), t=t, s=s)
    assert got("body", "snip") == "body" and got("", "snip") == "snip" and got("ââ¤ body", " snip ") == "snip" and got(None, None) == ""


def test_decode_bytes(spark):
    rows = [("中文网页".encode("gb18030"), None, "text/html; charset=gb2312"), ("中文网页".encode(), "utf-8", None), (b"", None, None), (None, None, None), ("中文網頁".encode("big5"), "no-such-charset", "text/html; charset=big5")]
    df = spark.createDataFrame(rows, "b binary, e string, c string").select(html.decode_bytes("b", "e", "c").alias("v"))
    assert [r["v"] for r in df.collect()] == ["中文网页", "中文网页", "", "", "中文網頁"]


def test_decode_bytes_keeps_utf8_with_letters_that_count_as_garbled(spark):
    said = "Èou sur enai, oiê âï âï. Les éeux ç"
    rows = [(said.encode(), "utf-8", "text/html"), (said.encode(), None, None), (said.encode(), "iso-8859-1", None)]
    df = spark.createDataFrame(rows, "b binary, e string, c string").select(html.decode_bytes("b", "e", "c").alias("v"))
    assert [r["v"] for r in df.collect()] == [said, said, said]
