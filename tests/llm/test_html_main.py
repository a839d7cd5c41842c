import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import html_main as H

from .util import words

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore. "
P1 = P.strip()

CASES = {
    "named": (
        f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- c --><div class="ad">Buy now!</div><article><h1>Head &amp; line</h1><p><b>{P}<br><p>Short.</p><p>a\n b&nbsp;c &eacute;&#233;&#x1F600;</p></article><footer>&copy; x</footer></body></html>',
        ["Head & line", P1, "Short.", "a b c éé😀"],
    ),
    "classes": (
        f'<body><div class="top-menu"><a href=/>Home</a></div><div id="wrap"><div class="sidebar"><p>{P * 3}</p></div><div class="post"><h1>Title here</h1><p>{P * 3}</p><p>Short.</p><p>{P * 2}</p><ul><li>one</li><li>two</li></ul></div><div id="comments"><p>{P * 4}</p></div></div><div id="footer">(c)</div></body>',
        ["Title here", (P * 3).strip(), "Short.", (P * 2).strip(), "one", "two"],
    ),
    "parts": (
        f'<main><header><h1>T</h1><p>By X</p></header><section class="comments"><p>{P * 9}</p></section><p>{P}</p><aside>{P * 5}</aside><form><p>{P}</p></form><div class="cookie-notice">{P}</div><p>{P}</p></main>',
        ["T", P1, P1],
    ),
    "comment articles": (f'<article><p>{P}</p><div class="ad">x</div><p>y</p></article><article class="comment"><p>{P * 8}</p></article>', [P1, "y"]),
    "no names": (f"<div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div><div><p>{P * 3}</p><p>x</p><p>{P * 3}</p></div></div><div><p>Contact us</p></div>", [(P * 3).strip(), "x", (P * 3).strip()]),
    "layout marks": (f'<div class="page has-sidebar"><div class="nav-layout"><article><p>{P}</p><p>z</p></article></div><div class="comments"><article><p>{P}</p></article></div></div>', [P1, "z"]),
    "unclosed": (f"<article><p>{P}<p>two<script>x</script><p>three", [P1, "two", "three"]),
    "article header": (f'<article><div class="entry-header"><h1>Title</h1></div><div class="entry-content"><p>{P}</p><p>x</p></div></article>', ["Title", P1, "x"]),
    "sections that sound alike": (
        f'<body><div id="page"><h1>T</h1><section class="related-work"><p>{P * 2}</p></section><section id="social-history"><p>{P * 3}</p></section><div class="search-results-study"><p>{P}</p></div></div></body>',
        ["T", (P * 2).strip(), (P * 3).strip(), P1],
    ),
    "split body": (f"<div id=content><h1>Head</h1><p>{P}</p><div class=text><p>{P * 3}</p><p>end</p><p>{P * 3}</p></div></div>", ["Head", P1, (P * 3).strip(), "end", (P * 3).strip()]),
    "two parts": (f"<div><div><p>{P * 3}</p><p>{P * 3}</p></div><div><p>{P * 2}</p><p>{P}</p></div></div><div>Imprint</div>", [(P * 3).strip()] * 2 + [(P * 2).strip(), P1]),
    "title above": (f"<div><h1>Head</h1><div><p>{P * 3}</p><p>{P * 3}</p></div></div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>", ["Head"] + [(P * 3).strip()] * 2),
    "comments are longer": (f'<div class="post"><h1>T</h1><p>{P}</p><p>{P}</p></div><div class="post-comments"><p>{P * 9}</p><p>{P * 9}</p></div>', ["T", P1, P1]),
    "page header": (f'<div class="site-header"><h2>Site</h2><p>{P}</p></div><div id="main"><h1>T</h1><p>{P}</p><p>{P}</p></div>', ["T", P1, P1]),
    "standfirst": (f"<article><header><h1>T</h1><p>{P * 2}</p><p>By X</p></header><p>{P * 2}</p></article>", ["T", (P * 2).strip(), (P * 2).strip()]),
    "unknown declarations": (f"<![foo[ x><p>{P}</p><![ x]><!x><!><p>{P}</p><![if !IE]><p>{P}</p><![endif]>", [P1] * 3),
    "unmarked comments": (f"<body><div><div><h1>T</h1><p>{P * 2}</p><p>{P * 2}</p></div><div><h3>3 comments</h3><div><p>{P}</p></div><div><p>{P * 2}</p><p>{P}</p></div></div></div></body>", ["T", (P * 2).strip(), (P * 2).strip()]),
    "comments in the article": (f"<article><h1>Comments</h1><p>{P}</p><h2>Comments (2)</h2><p>{P}</p><h3>x</h3><p>{P}</p><h2>Sources</h2><p>end</p></article>", ["Comments", P1, "Sources", "end"]),
    "poem": ("<body><h1>Poem</h1><p>Short lines</p><p>of a poem</p><p>end here</p><p>Copyright 2024 The Press, all rights reserved</p></body>", ["Poem", "Short lines", "of a poem", "end here"]),
    "inline": (f"<article><p>{P}<label>a label</label>, <math><mi>x</mi></math> and <button>a button</button></p><button>Share</button></article>", [P + "a label, x and a button"]),
    "own links": (f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>T</h1><p>{P * 3}</p><ul><li><a href=1>{P1}</a></li><li><a href=2>Two</a></li></ul><p>{P * 3}</p></div></body>", ["T", (P * 3).strip(), P1, "Two", (P * 3).strip()]),
    "nothing but a footer": (f"<footer><p>{P}</p></footer>", []),
    "text": ("just  text", ["just text"]),
    "markup only": ("<p></p><br>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert H.main_text(html) == "\n\n".join(want)


def test_long_page_is_whole():
    paras = [f"{P}{i}" for i in range(3000)]
    assert H.main_text("<article>" + "".join(f"<p>{x}</p>" for x in paras) + "</article>") == "\n\n".join(paras)


def unnamed(seed):
    """A page without article, nav, footer or class: a menu and a footer of short lines, an advert, and the article's lines straight in the body."""
    rnd = random.Random(seed)
    blocks = [words(seed, 7), *(words(seed * 100 + i, rnd.randrange(15, 120)) for i in range(rnd.randrange(3, 15)))]
    menu = "".join(f"<p>{words(i, 1)}</p>" for i in range(rnd.randrange(3, 8)))
    return f"<body><div>{menu}</div><div>{words(seed + 1, 6)}</div><h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" for x in blocks[1:]) + "<div><p>(c) x</p><p>Imprint</p><p>Contact us</p></div>", "\n\n".join(blocks)


def test_the_clusters_decide(monkeypatch):
    pages = [unnamed(i) for i in range(100)]
    assert sum(H.main_text(h) == want for h, want in pages) >= 95
    with monkeypatch.context() as m:
        m.setattr(H, "threshold", lambda x: float(x.min()) - 1)
        assert sum(H.main_text(h) == want for h, want in pages) <= 5
    # Short lines among long ones belong to them: smoothing carries them over the threshold.
    ratio = np.array([0, 0, 0, 5, 5, 1, 5, 5, 0, 0, 0], float)
    assert H.smooth(ratio)[5] > H.threshold(H.smooth(ratio)) and ratio[5] < H.threshold(ratio)


def plain(html):
    """The page without the names of its parts."""
    html = re.sub(r"<(/?)(article|main|nav|footer|header|aside)\b", r"<\1div", html or "")
    return re.sub(r'\s(class|id|role)=("[^"]*"|\S+?(?=[\s>]))', "", html)


def test_the_clusters_decide_on_given_pages(spark, monkeypatch):
    """On the pages as they are and without names: most texts change when every line counts as content."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [H.main_text(h) for h in pages]
    assert sum(H.main_text(plain(h)) == w for h, w in zip(pages, want, strict=True)) >= 0.95 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(H, "threshold", lambda x: float(x.min()) - 1)
        for given in (pages, map(plain, pages)):
            assert sum(H.main_text(h) == w for h, w in zip(given, want, strict=True)) <= 0.05 * len(pages)


@pytest.mark.parametrize("html", ["<div>" * 60_000 + "x" + "</div>" * 60_000, "<p><b>" * 30_000, "<div>" * 30_000 + "</span></p>" * 30_000, "".join(f"<div><p>part {i}</p>" for i in range(20_000))])
def test_deep_and_malformed_pages_take_linear_time(html):
    began = time.time()
    H.main_text(html)
    assert time.time() - began < 10


def test_frame(spark):
    rows = [(1, "u", None, "c", 1), (1, "u", None, "c", 1), (None, None, CASES["named"][0], "c", 1), (2, "v", "", "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_main(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), len(r["text"]) == r["n_chars"], r["n_chars"] > 0) for r in got.collect()) == [("1", True, False), ("1", True, False), ("2", True, False), ("None", True, True)]
    assert H.extract_main(df.limit(0)).count() == 0
