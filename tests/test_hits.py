import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hits as H
from tidemark.operators import rules

HIT = "query string, query_ord int, tool string, tool_rank int, scope_rank int, pos int, title string, url string, snippet string, published_at timestamp"


def hit(q, rank, scope, pos, url, at=None, title="t"):
    return (f"q{q}", q, f"tool{rank}", rank, scope, pos, title, url, "s", at)


def df(spark, rows):
    return spark.createDataFrame(rows, HIT)


def test_required_and_blocked(spark):
    rows = [hit(0, 1, 0, i, u) for i, u in enumerate(["http://zh.wikipedia.org/x", "http://notwikipedia.org/x", "http://h.com/x", " ", "wikipedia.org/no-scheme"])] + [hit(0, 1, 0, 9, "http://h.com/", title=" ")]
    src = df(spark, rows)
    assert sorted(r["pos"] for r in H.require(src, ["title", "url"]).collect()) == [0, 1, 2, 4]
    want = [2, 4, 9]
    assert sorted(r["pos"] for r in H.host_blocklist(src).collect()) == want
    table = spark.createDataFrame([(d,) for d in H.BLOCKED_HOSTS], "value string")
    assert sorted(r["pos"] for r in H.host_blocklist(src, "url", table).collect()) == want
    assert sorted(r["pos"] for r in src.filter(~H.is_blocked("url", suffix=True)).collect()) == [1, 2, 4, 9]


def test_urls_that_cannot_be_parsed_match_as_a_whole(spark):
    urls = ["http://[baike.com/x", "http://x]/baike.com", "http://[zz]/Wikipedia.org", "http://[::1]:80/wikipedia.org", "http://u@[::1%e]/wikipedia.org", "http://[x/"]
    src = df(spark, [hit(0, 1, 0, i, u) for i, u in enumerate(urls)])
    assert sorted(r["pos"] for r in H.host_blocklist(src).collect()) == [3, 4, 5]


def test_sites_then_global(spark):
    g = H.GLOBAL
    rows = [hit(0, 1, 0, i, f"http://s{i}/") for i in range(6)] + [hit(0, 1, 1, 10, "http://s1"), hit(0, 1, 1, 11, "http://t/"), hit(0, 1, g, 20, "http://baike.com/"), hit(0, 1, g, 21, "http://t/"), hit(0, 1, g, 22, "http://g/"), hit(0, 2, 0, 30, "http://z/")]
    got = H.site_then_global(df(spark, rows), 4).orderBy("tool_rank", "scope_rank", "pos").collect()
    # A site gives max(3, min(4, 10)) = 4, the whole list 4.
    assert [r["url"] for r in got] == ["http://s0/", "http://s1/", "http://s2/", "http://s3/", "http://z/"]
    got = H.site_then_global(df(spark, rows), 7).orderBy("tool_rank", "scope_rank", "pos").collect()
    assert [r["url"] for r in got] == [f"http://s{i}/" for i in range(6)] + ["http://t/", "http://z/"]
    assert H.site_then_global(df(spark, rows), None).count() == 9


def test_age(spark):
    at = [datetime(2024, 1, 14, 10), datetime(2024, 1, 14, 9, 59, 59), None]
    src = df(spark, [hit(0, 1, 0, i, "u", t) for i, t in enumerate(at)])
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    assert [r["pos"] for r in H.filter_by_age(src, "published_at", 14, as_of).collect()] == [0]
    assert H.filter_by_age(src, "published_at", 0, as_of).count() == 3


def test_dedupe_in_order(spark):
    src = df(spark, [hit(0, 1, 0, i, u) for i, u in enumerate(["u/", "U", "http://baike.com/x", "v", "w", " "])])
    assert [r["url"] for r in H.dedupe_hits(src, ["query"], ["pos"], 2).orderBy("pos").collect()] == ["u/", "v"]


def test_sources_and_coverage(spark):
    src = df(spark, [hit(0, 2, 0, 0, "a"), hit(0, 3, 0, 1, "b"), hit(1, 1, 0, 0, "c"), hit(1, 2, 0, 1, "d")])
    assert sorted(r["url"] for r in H.from_first_source(src).collect()) == ["a", "c"]
    assert {(r["query"], r["tool"]) for r in H.pick_source(src).collect()} == {("q0", "tool2"), ("q1", "tool1")}
    assert {(r["query"], r["tool"], r["n_rows"]) for r in H.rows_per_query(src).collect()} == {("q0", "tool2", 1), ("q0", "tool3", 1), ("q1", "tool1", 1), ("q1", "tool2", 1)}
    asked = spark.createDataFrame([("q0",), ("q1",), ("q2",)], "value string")
    with pytest.raises(RuntimeError, match="q2"):
        H.assert_covered(asked, src)
    assert [r["value"] for r in H.assert_covered(asked, src, report=True).collect()] == ["q2"]


def test_first_by_canonical_url(spark):
    src = df(spark, [hit(1, 1, 0, 0, "http://A.com/x/?utm_source=1"), hit(0, 1, 1, 5, "http://a.com/x"), hit(0, 1, 0, 7, "http://a.com/x#f"), hit(0, 1, 0, 8, "")])
    one = H.unique_candidates(src)
    assert [r["pos"] for r in one.collect()] == [7]
    from tidemark.functions.urls import canonical_url

    assert H.assert_unique(one, canonical_url("url")).count() == 1
    with pytest.raises(ValueError):
        H.assert_unique(src, canonical_url("url"))


def test_scopes_and_caps(spark):
    src = df(spark, [hit(0, 1, 0, i, f"http://{h}/{i}") for i, h in enumerate(["a.com", "x.a.com", "nota.com", "b.org"])])
    sites = spark.createDataFrame([("a.com",), ("org",)], "value string")
    assert {(r["pos"], r["site"]) for r in H.site_scope(src, sites).collect()} == {(0, "a.com"), (1, "a.com"), (3, "org")}
    many = df(spark, [hit(0, 1, 0, i, f"u{i}") for i in range(12)]).withColumn("site", F.lit("s"))
    assert [H.site_cap(n) for n in (1, 5, 50)] == [3, 5, 10]
    assert H.cap_per_site(many, 4).count() == 4
    both = H.priority_union(many.filter("pos = 9").drop("site"), many.filter("pos = 1").drop("site"))
    assert [r["pos"] for r in both.orderBy("scope_rank").collect()] == [9, 1]
    assert [r["pos"] for r in H.top_candidates(many, 2).collect()] == [0, 1] and H.top_candidates(many, None).count() == 12


def test_lookups(spark):
    corpus = spark.createDataFrame([(1, "Red sky at night"), (2, "red"), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(0, "RED night"), (1, "red"), (2, " ")], "ord int, value string")
    assert {(r["query_ord"], r["id"]) for r in H.keyword_hits(asked, corpus).collect()} == {(0, 1), (1, 1), (1, 2)}
    alias = spark.createDataFrame([("http://news.google.com/1", " http://real/1 "), ("http://news.google.com/2", " "), ("http://x/3", "http://y/3")], "url string, target string")
    src = df(spark, [hit(0, 1, 0, i, u) for i, u in enumerate(["http://news.google.com/1", "http://news.google.com/2", "http://x/3"])])
    assert [r["url"] for r in H.resolve_alias(src, alias).orderBy("pos").collect()] == ["http://real/1", "http://news.google.com/2", "http://x/3"]
    look = spark.createDataFrame([("a", "1", False), ("b", "2", True), ("c", " ", False)], "k string, v string, no boolean")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "x string")
    got = {r["x"]: r["v"] for r in H.with_default(rows, look, "x", "k", "v", F.lit("def"), "no").collect()}
    assert got == {"a": "1", "b": "def", "c": "def", "d": "def", None: "def"}


def test_long_lists_go_in_blocks(spark, monkeypatch):
    src = df(spark, [hit(0, 1, 0, i, f"http://h{i}.com/") for i in range(30)])
    listed = spark.createDataFrame([(f"h{i}.com",) for i in range(0, 30, 2)], "value string")
    corpus = spark.createDataFrame([(i, f"word{i} other") for i in range(20)], "id int, text string")
    asked = spark.createDataFrame([(i, f"word{i}") for i in range(2, 9)], "ord int, value string")
    keep = sorted(r["pos"] for r in H.host_blocklist(src, "url", listed).collect())
    met = sorted((r["query_ord"], r["id"]) for r in H.keyword_hits(asked, corpus).collect())
    monkeypatch.setattr(H, "MAX_LIST", 4)
    assert sorted(r["pos"] for r in H.host_blocklist(src, "url", listed).collect()) == keep == [i for i in range(30) if not any(f"h{j}.com" in f"h{i}.com" for j in range(0, 30, 2))]
    monkeypatch.setattr(H, "MAX_PATTERNS", 3)
    assert sorted((r["query_ord"], r["id"]) for r in H.keyword_hits(asked, corpus).collect()) == met


@pytest.mark.parametrize("n", [10, 3_000, 30_000])
def test_many_patterns_in_one_walk(spark, n):
    """Keyword queries, host lists and rules of any number give what trying each would; terms inside others, repeated, with wild characters, and empty ones."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcé%.*") for _ in range(rnd.randrange(1, 9)))
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(25)))) for i in range(60)] + [(98, None), (99, "")]
    asked = [(i, " ".join(word() for _ in range(rnd.randrange(1, 3))).upper()) for i in range(n)] + [(n, "  "), (n + 1, "a"), (n + 1, "a")]
    corpus = spark.createDataFrame(texts, "id long, text string")
    got = sorted((r["query_ord"], r["id"]) for r in H.keyword_hits(spark.createDataFrame(asked, "ord int, value string"), corpus).collect())
    need = {o: set(v.lower().split()) for o, v in asked}
    assert got == sorted((o, i) for o, ts in need.items() if ts for i, t in texts if all(x in (t or "") for x in ts))
    listed = [f"{word()}.x" for _ in range(n)]
    urls = spark.createDataFrame([(i, f"http://{(t or 'q').replace(' ', '').replace('%', '')}.x.y/p") for i, t in texts], "id long, url string")
    kept = {r["id"] for r in H.host_blocklist(urls, "url", spark.createDataFrame([(x,) for x in listed], "value string")).collect()}
    hosts = {r["id"]: r["h"] for r in urls.select("id", H.block_text("url").alias("h")).collect()}
    assert kept == {i for i, h in hosts.items() if not any(x in h for x in listed)}


def test_rules_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(2, 6)))
    listed = [(f"r{i % 40}", ("any", "pair", "host")[i % 40 % 3], rnd.choice("ab"), word()) for i in range(200)] + [("n", "any", None, None)]
    rows = [(i, word(), " ".join(word() for _ in range(12)), f"http://{word()}.{word()}/") for i in range(80)] + [(100, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, text string, url string")
    want = {}
    for i, t, x, u in rows:
        body, host = f"{t or ''}\n{x or ''}".lower(), (u or "///")[7:].strip("/")
        ids = set()
        for r in {r for r, *_ in listed}:
            mine = [(k, g, term) for q, k, g, term in listed if q == r and term]
            hit = {g if k == "pair" else "x" for k, g, term in mine if term in (host if k == "host" else body)}
            if "x" in hit or hit >= {"a", "b"}:
                ids.add(r)
        want[i] = sorted(ids)
    for most in (100_000, 15):
        monkeypatch.setattr(rules, "MAX_TERMS", most)
        got = rules.rule_filter(df, spark.createDataFrame(listed, "rule_id string, kind string, group string, term string"))
        assert {r["id"]: r["rule_ids"] for r in got.collect()} == want
