import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drafts as D
from tidemark.plans import run as P
from tidemark.sources import store as S
from tidemark.streaming import incremental as X

from .test_hits import HIT, hit

AS_OF = datetime(2024, 1, 15)


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("v")).first()["v"]


def test_records(spark):
    draft = one(spark, D.draft_record("t", "s", F.lit("u" * 600), F.lit("m"), "a" * 20), t="", s='a<b & "c"\nd')["articles"][0]
    assert draft["content"].startswith('<p>a&lt;b &amp; "c"<br/>d</p>') and draft["title"] == "未命名" and len(draft["content_source_url"]) == 500 and len(draft["author"]) == 16
    asked = one(spark, D.summary_request("t", "x", 2200), t="T", x=" text ")
    request = json.loads(asked["request"])
    assert asked["notice"] is None and request["max_tokens"] == 3000 and request["messages"][1]["content"].endswith("标题：T\n\n原文：\ntext\n\n仅输出摘要正文。")
    assert one(spark, D.summary_request("t", "x"), t="T", x=" ")["request"] is None
    assert one(spark, D.resolve_summary("a", "t", "x"), a="**done** ", t="T", x="text") == "done"
    assert one(spark, D.resolve_summary("a", "t", "x"), a=" ", t="T", x="text") == "【摘要】T\ntext"
    assert one(spark, D.resolve_summary("a", "t", "x"), a="z", t="T", x="") == "【摘要】T\n原文正文不足，暂不生成摘要。"
    audit = one(spark, D.summary_audit("s", "x"), s="重磅 3.5 and 7 **a** **b** **c** http://x", x="7")
    assert not one(spark, D.summary_audit("s", "x"), s="震撼", x="")["marketing"]
    assert [one(spark, D.summary_audit("s", "x"), s=v, x="")["dashes"] for v in ("a—b", "a——b", "a--b", "a-b")] == [True, True, True, False]
    assert (audit["marketing"], audit["too_bold"], audit["link"], audit["new_numbers"]) == (True, True, True, ["3.5"])


def page(words):
    return "<title>" + words + " as a page title of length</title><article><p>" + (words + " ") * 20 + "</p></article>"


@pytest.fixture(scope="module")
def world(spark):
    pages = [(1, "http://a.com/1", page("alpha beta gamma delta one")), (2, "http://a.com/2?utm_source=x", page("epsilon zeta eta theta two")), (3, "http://a.com/3", page("alpha beta gamma delta one")), (4, "http://a.com/4", "<p>x</p>"), (5, "http://bad.com/5", page("iota kappa lambda mu five"))]
    rows = [hit(0, 1, 0, i, u, AS_OF) for i, u in enumerate(["http://a.com/1/", "http://a.com/2", "http://a.com/3", "http://a.com/4", "http://bad.com/5", "http://a.com/missing"])]
    rules = spark.createDataFrame([("h", "host", None, "bad.com")], "rule_id string, kind string, group string, term string")
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(rows, HIT), rules


def test_run_twice_publishes_once(spark, world, tmp_path):
    pages, hits, rules = world
    path = f"file://{tmp_path}/history"
    params = P.Params(as_of=F.lit(AS_OF), default_cover="dflt")
    counts = []
    for batch in (0, 1):
        history = S.read_history(spark, path)
        out = P.run_batch(hits, pages, history, rules, P.Params(as_of=F.lit(AS_OF), default_cover="dflt", batch_id=batch))
        counts.append(out.stats.first().asDict())
        if batch == 0:
            assert {r["media_id"] for r in out.drafts.collect()} == {"dflt"}
            S.write_drafts(out.drafts, f"file://{tmp_path}/drafts")
            assert spark.read.text(f"file://{tmp_path}/drafts").count() == 2
        P.publish(out, path)
    assert counts[0] == {"total_candidates": 6, "published": 2, "skipped_duplicate": 1, "skipped_policy": 1, "skipped_too_short": 1, "failed": 1}
    assert counts[1]["published"] == 0 and sum(v for k, v in counts[1].items() if k != "total_candidates") == 6
    assert S.read_history(spark, path).count() == 2
    assert params.max_candidates == 20


def test_stream_equals_batch(spark, world, tmp_path):
    pages, hits, rules = world
    src, path = f"file://{tmp_path}/hits", f"file://{tmp_path}/history"
    for i in range(2):
        hits.filter(F.col("pos") % 2 == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(src)
    params = P.Params(as_of=F.lit(AS_OF), max_hours=0, max_candidates=None)
    X.start_incremental(stream, pages, rules, path, f"file://{tmp_path}/mark", params).awaitTermination()
    whole = P.run_batch(hits, pages, S.read_history(spark, f"file://{tmp_path}/none"), rules, params)
    titles = lambda df: sorted(r["title"] for r in df.select("title").collect())
    assert titles(S.read_history(spark, path)) == titles(whole.records)


def test_history_batch_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    rows = spark.createDataFrame([("t", "http://a/", AS_OF, "x", "s")], "title string, url string, published_at timestamp, text string, summary string")
    for batch in (1, 2, 2):
        S.append_history(D.article_record(rows, F.lit(AS_OF), batch), path)
    assert sorted(r["batch_id"] for r in S.read_history(spark, path).collect()) == [1, 2]
    (tmp_path / "old.json").write_text('[{"id": "1", "title": "t", "created_at": "2024-01-01T00:00:00Z"}, {"id": "2"}]')
    assert S.import_history(spark, f"file://{tmp_path}/old.json").filter("title IS NULL").count() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("damaged")
    with pytest.raises(Exception):  # noqa: B017
        S.read_history(spark, f"file://{tmp_path}/bad").count()


def test_feed(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><description>&lt;b&gt;x&lt;/b&gt; y</description><pubDate>Mon, 15 Jan 2024 00:00:00 GMT</pubDate></item>"
    items = [item.format(*x) for x in (("One long enough title", "http://a/1"), ("", "http://a/2"), ("Two long enough title", "http://a/3"), ("Again the same link", "http://a/1/"), ("Blocked by its host", "http://baike.com/x"), ("Three is over the cap", "http://a/4"))]
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(items) + "</channel></rss>")
    got = S.read_feed(spark, f"file://{tmp_path}/f.xml", 4).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["snippet"]) for r in got] == [("One long enough title", "http://a/1", "x y"), ("Two long enough title", "http://a/3", "x y")]
    assert got[0]["published_at"] == AS_OF


def test_items_outside_the_channel(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>C</title></channel><item><title>One long enough title</title><link>http://a/1</link><description>&amp;#8217;</description></item><item><title>Two long enough title</title><link>http://a/2</link></item></rdf:RDF>')
    assert [(r["pos"], r["url"], r["snippet"]) for r in S.read_feed(spark, f"file://{tmp_path}/f.xml", 9).orderBy("pos").collect()] == [(0, "http://a/1", "’"), (1, "http://a/2", "")]


def test_failed_drafts_make_no_duplicates(spark, world):
    pages, hits, rules = world
    fails = lambda made: made.filter("url = 'http://a.com/1/' OR url = 'http://a.com/3'").select("id")
    none = spark.createDataFrame([], S.ARTICLES)
    out = P.run_batch(hits, pages, none, rules, P.Params(as_of=F.lit(AS_OF)), fails=lambda made: fails(made).filter("id LIKE '%/1'"))
    assert {r["id"][-1]: r["status"] for r in out.outcomes.collect() if "a.com" in r["id"]} == {"1": "failed", "2": "published", "3": "published", "4": "too_short", "g": "failed"}
    both = P.run_batch(hits, pages, none, rules, P.Params(as_of=F.lit(AS_OF)), fails=fails)
    assert both.stats.first()["failed"] == 3 and sorted(r["source_url"] for r in both.records.collect()) == ["http://a.com/2"]


def test_candidates_and_bytes(spark):
    rows = [hit(0, 1, 0, 0, "http://zh.wikipedia.org/x", AS_OF), hit(0, 1, 0, 1, "https://news.google.com/rss/articles/abc", AS_OF), hit(0, 1, 0, 2, "http://a/1", AS_OF), hit(0, 2, 0, 0, "http://a/9", AS_OF)]
    alias = spark.createDataFrame([("https://news.google.com/rss/articles/abc", " http://a/1/ ")], "url string, target string")
    found = P.collect_candidates(spark.createDataFrame(rows, HIT), None, P.Params(as_of=F.lit(AS_OF)), alias)
    assert [(r["pos"], r["url"]) for r in found.collect()] == [(1, "http://a/1/")]
    body = "<title>一个足够长的中文标题在这里出现</title><p>" + "中文正文" * 30 + "&#8217;</p>"
    raw = spark.createDataFrame([(1, "http://a/1", body.encode("gb18030"), "gb18030", "text/html")], "page_id long, url string, body binary, encoding string, content_type string")
    got = P.extract_articles(raw, found).first()
    assert got["title"] == "一个足够长的中文标题在这里出现" and got["text"] == "中文正文" * 30 + "’" and not got["page_missing"]


def test_results(spark):
    df = spark.createDataFrame([(1, "A - Site", " http://a/ ", "<i>b</i>"), (2, "x", "", "b"), (3, "y", "http://baike.com/", "b")], "n int, title string, href string, body string")
    assert [(r["n"], r["title"], r["url"], r["snippet"]) for r in S.read_results(df, F.lit(AS_OF)).collect()] == [(1, "A", "http://a/", "b")]


def test_slots(spark):
    rows = [(datetime(2024, 1, 2, h, 30),) for h in (1, 7, 8, 19, 20, 23)]
    df = spark.createDataFrame(rows, "ts timestamp")
    got = {r["slot"]: r["n"] for r in X.slot_counts(df).collect()}
    assert got == {datetime(2024, 1, 1, 20): 2, datetime(2024, 1, 2, 8): 2, datetime(2024, 1, 2, 20): 2}
    assert {r["slot"]: r["n"] for r in X.window_counts(df).collect()} == got


def test_stream_dedupe(spark, tmp_path):
    rows = [("http://a/?utm_source=1", AS_OF), ("http://a/", AS_OF), ("http://b/", AS_OF)]
    spark.createDataFrame(rows, "url string, published_at timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("url string, published_at timestamp").parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    X.dedupe_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["canonical_url"] for r in spark.read.parquet(out).collect()) == ["http://a", "http://b"]


def batches(spark, tmp_path, schema, *parts):
    """A stream whose batches are ``parts``, in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for f in (tmp_path / "in").glob("part-*"):
            if not (tmp_path / "seen" / f.name).exists():
                (tmp_path / "seen").mkdir(exist_ok=True)
                (tmp_path / "seen" / f.name).touch()
                os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def emitted(spark, tmp_path, frame, schema):
    frame.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"file://{tmp_path}/out").collect()


def test_first_in_order_replaces_rows_until_the_watermark_passes(spark, tmp_path):
    """An earlier row of the list that arrives later wins; a late row goes; an expired key starts anew; open keys are not emitted."""
    at = lambda day, hour: datetime(2024, 1, day, hour, tzinfo=timezone.utc)
    schema = "url string, published_at timestamp, pos int"
    stream = batches(
        spark, tmp_path, schema,
        [("http://a.x/?utm_source=1", at(1, 10), 5), ("http://b.x", at(1, 10), 1), ("http://b.x/", at(1, 11), 3)],
        [("http://a.x", at(1, 12), 2), ("http://c.x", at(1, 9), 9)],
        [("http://d.x", at(3, 10), 1)],
        [("http://c.x", at(1, 8), 0), ("http://a.x", at(3, 11), 7)],
        [("http://e.x", at(6, 10), 4)],
    )
    got = emitted(spark, tmp_path, X.first_in_order(stream, ["pos"]), schema + ", canonical_url string")
    assert sorted((r["canonical_url"], r["pos"]) for r in got) == [("http://a.x", 2), ("http://a.x", 7), ("http://b.x", 1), ("http://c.x", 9), ("http://d.x", 1)]


def test_first_in_order_calls_python_by_groups(spark, tmp_path):
    """Keys of one group keep their own rows and times."""
    at = lambda day, hour: datetime(2024, 1, day, hour, tzinfo=timezone.utc)
    schema = "url string, published_at timestamp, pos int"
    first, second = ([(f"http://h.x/{i}", at(1, h), (i * 7 + h) % 10) for i in range(40)] for h in (10, 12))
    stream = batches(spark, tmp_path, schema, first, second, [("http://end.x", at(9, 1), 0)])
    got = emitted(spark, tmp_path, X.first_in_order(stream, ["pos"], groups=2), schema + ", canonical_url string")
    assert sorted((r["url"], r["pos"]) for r in got) == sorted((a[0], min(a[2], b[2])) for a, b in zip(first, second, strict=True))


def test_slots_of_any_spacing_on_a_stream(spark, tmp_path):
    at = lambda day, hour: datetime(2024, 1, day, hour, tzinfo=timezone.utc)
    stream = batches(
        spark, tmp_path, "ts timestamp",
        [(at(1, 7),), (at(1, 10),), (at(1, 20),)],
        [(at(1, 8),), (at(1, 12),), (at(2, 1),), (at(2, 7),)],
        [(at(4, 10),)],
        [(at(1, 7),), (at(4, 11),)],
        [(at(9, 1),)],
    )
    got = emitted(spark, tmp_path, X.slot_counts_stream(stream, hours=(6, 9, 19)), "slot timestamp, n long")
    by = {r["slot"].replace(tzinfo=None): r["n"] for r in got}
    assert len(by) == len(got) and by == {datetime(2024, 1, 1, 6): 2, datetime(2024, 1, 1, 9): 2, datetime(2024, 1, 1, 19): 2, datetime(2024, 1, 2, 6): 1, datetime(2024, 1, 4, 9): 2}
