"""The index of the history against the search in the whole history, and against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.operators import history_index, similar
from tidemark.operators.history_index import HistoryIndex
from tidemark.plans import queries
from tidemark.plans import run as P
from tidemark.sources import store as S
from tidemark.streaming import incremental as X

from .test_hits import HIT, hit
from .test_outcomes import mutate, scripts
from .test_runs import AS_OF, page

NEW = "id string, url string, title string, text string"


def publish(spark, path, batch, rows):
    S.append_history(spark.createDataFrame([(i, t, u, b, batch) for i, u, t, b in rows], "id string, title string, source_url string, extracted_text string, batch_id long").select(*[F.col(f.name) if f.name in ("id", "title", "source_url", "extracted_text", "batch_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in S.ARTICLES]), path)


def found(df):
    return {r["id"]: (r["is_dup"], r["reason"], r["matched_id"]) for r in df.collect()}


def articles(rnd, n, start, like=()):
    """Articles in three scripts; some are edits of ``like``, in title or body or both."""
    rows = []
    for i in range(n):
        write = scripts(rnd)[i % 3]
        title, body = write(rnd.randrange(8, 60)), write(rnd.choice([60, 110, 400]))
        if like and i % 2:
            old = rnd.choice(like)
            if i % 4 == 1:
                title = mutate(old[2], rnd, rnd.randrange(0, 7))
            else:
                body = mutate(old[3], rnd, rnd.randrange(0, len(old[3]) // 8))
        rows.append((f"{start + i:05d}", f"http://h.com/{start + i}", title, body))
    return rows


def brute(rows, old):
    """{new id: (reason, smallest id)} over all pairs."""
    norm = lambda x: "".join(c for c in (x or "").lower() if c.isalnum() or c == "_")[:3000]
    out = {}
    for i, u, t, b in rows:
        for reason, at, x in (("url", 1, u), ("title", 2, t), ("body", 3, b)):
            ids = [o[0] for o in old if (o[at] == x if at == 1 else norm(x) and norm(o[at]) and SequenceMatcher(None, norm(o[at]), norm(x)).ratio() >= 0.9)]
            if ids:
                out[i] = (True, reason, min(ids))
                break
        else:
            out[i] = (False, None, None)
    return out


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A history of two batches and its index, which grew with it."""
    rnd = random.Random(31)
    root = f"file://{tmp_path_factory.mktemp('grown')}"
    index = HistoryIndex(spark, root + "/index")
    batches = []
    for k in range(2):
        batches.append(articles(rnd, 60, 1000 * k, [r for b in batches for r in b]))
        publish(spark, root + "/history", k, batches[-1])
        index.sync(S.read_history(spark, root + "/history"))
    return root, index, batches, articles(rnd, 60, 9000, [r for b in batches for r in b]) + [("x0", "http://h.com/5/", "t", ""), ("x1", "", None, None), ("x2", "n", "未命名", "")]


def test_equals_all_pairs_and_reads_no_texts_but_of_candidates(spark, grown, monkeypatch):
    """A history that has lost all other texts gives the same."""
    root, index, batches, new = grown
    history, asked = S.read_history(spark, root + "/history"), spark.createDataFrame(new, NEW)
    ids, true = set(), HistoryIndex._strings
    monkeypatch.setattr(HistoryIndex, "_strings", lambda self, first, *more: (ids.update(r["hist_id"] for r in first.select("hist_id").collect()), true(self, first, *more))[1])
    got = found(index.lookup(asked, history))
    want = brute(new[:-3], [r for b in batches for r in b])
    assert {k: v for k, v in got.items() if k[0] != "x"} == want and {"body", "title", None} <= {r for _, r, _ in want.values()}
    assert got["x0"] == (True, "url", "00005") and got["x1"][0] is False and got["x2"][0] is False
    assert index._read(0, "urls").select("batch_id").distinct().count() == len(batches) and 0 < len(ids) < 100
    met = F.col("id").isin(list(ids))
    gone = history.withColumn("title", F.when(met, F.col("title"))).withColumn("extracted_text", F.when(met, F.col("extracted_text")))
    assert found(index.lookup(asked, gone)) == got


def test_a_batch_does_not_see_its_first_try(spark, grown):
    root, index, batches, _ = grown
    again = spark.createDataFrame(batches[1], NEW)
    history = S.read_history(spark, root + "/history")
    assert found(index.lookup(again, history, 1)) == brute(batches[1], batches[0])


def test_replaced_and_compacted(spark, tmp_path):
    rnd = random.Random(33)
    root = f"file://{tmp_path}"
    index = HistoryIndex(spark, root + "/index")
    first, second = articles(rnd, 20, 0), articles(rnd, 20, 100)
    for k, rows in enumerate((first, second)):
        publish(spark, root + "/history", k, rows)
    read = lambda: S.read_history(spark, root + "/history")
    index.sync(read().filter("batch_id = 0"))
    index.sync(read())
    other = articles(rnd, 20, 200)
    publish(spark, root + "/history", 1, other)
    index.add(read().filter("batch_id = 1"), 1)
    asked = spark.createDataFrame([(f"q{i}", f"u{i}", t, b) for i, (_, _, t, b) in enumerate(first + second + other)], NEW)
    want = {f"q{i}": r[0] if r in first + other else None for i, r in enumerate(first + second + other)}
    assert {k: v[2] for k, v in found(index.lookup(asked, read())).items()} == want
    index.compact(read())
    assert index._generations() == [1] and index._read(1, "urls").select("batch_id").distinct().count() == 1
    publish(spark, root + "/history", 2, second)
    index.sync(read())
    assert {k: v[2] for k, v in found(index.lookup(asked, read())).items()} == {f"q{i}": r[0] for i, r in enumerate(first + second + other)}


def test_common_phrases_stay_cheap_and_lose_nothing(spark, tmp_path, monkeypatch):
    """Batches of titles with one phrase: keys get longer as the history grows."""
    monkeypatch.setattr(history_index.S, "TITLE_CROWD", 8)
    rnd = random.Random(34)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    phrase = "".join(rnd.choice(letters) for _ in range(15))
    title = lambda: phrase + "".join(rnd.choice(letters) for _ in range(30))
    root, index, old = f"file://{tmp_path}", HistoryIndex(spark, f"file://{tmp_path}/index"), []
    for k in range(2):
        rows = [(f"{k}-{i:03d}", f"u{k}-{i}", title(), None) for i in range(110)]
        rows += [(f"{k}-c{i:02d}", f"v{k}-{i}", mutate(rows[0][2] if k == 0 else old[0][2], rnd, 2), None) for i in range(12)]
        old += rows
        publish(spark, root + "/history", k, rows)
        index.sync(S.read_history(spark, root + "/history"))
    assert index._read(0, "title_marks").count() > 0
    new = [(f"q{i}", f"w{i}", mutate(rnd.choice(old)[2], rnd, rnd.randrange(6)) if i % 2 else title(), None) for i in range(80)]
    made, true = [], similar._tested
    monkeypatch.setattr(similar, "_tested", lambda pairs, *more: (made.append(pairs.count()), true(pairs, *more))[1])
    got = found(index.lookup(spark.createDataFrame(new, NEW), S.read_history(spark, root + "/history")))
    assert got == brute(new, old) and sum(v[0] for v in got.values()) > 20
    assert sum(made) < 0.5 * len(new) * len(old)


def test_stream_with_an_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", page(w)) for i, w in enumerate(["alpha beta gamma delta one", "epsilon zeta eta theta two", "alpha beta gamma delta one", "iota kappa lambda mu nu"])], "page_id long, url string, html string")
    hits = spark.createDataFrame([hit(0, 1, 0, i, f"http://a.com/{i}", AS_OF) for i in range(4)], HIT)
    rules = spark.createDataFrame([], "rule_id string, kind string, group string, term string")
    src = f"file://{tmp_path}/hits"
    for i in range(2):
        hits.filter(F.floor(F.col("pos") / 2) == i).coalesce(1).write.mode("append").parquet(src)
    params = P.Params(as_of=F.lit(AS_OF), max_hours=0, max_candidates=None)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(src)
    path, index = f"file://{tmp_path}/history", f"file://{tmp_path}/index"
    X.start_incremental(stream, pages, rules, path, f"file://{tmp_path}/mark", params, index_path=index).awaitTermination()
    assert sorted(r["source_url"] for r in S.read_history(spark, path).collect()) == [f"http://a.com/{i}" for i in (0, 1, 3)]
    assert sorted((r["id"], r["batch_id"]) for r in HistoryIndex(spark, index)._read(0, "urls").collect()) == sorted((r["id"], r["batch_id"]) for r in S.read_history(spark, path).collect())


def test_query_equals_the_search_in_all_pages(spark):
    d = "/root/testdata/sf0.001"
    made = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id"), F.col("page_id").cast("string").alias("id"), "url", html.page_title("html", F.lit("")).alias("title"), html.block_text("html").alias("text"))
    want = similar.exists_duplicate(made.filter("page_id % 2 = 1"), made.filter("page_id % 2 = 0").select("id", "title", F.col("url").alias("source_url"), F.col("text").alias("extracted_text")))
    assert found(queries.QUERIES["x1_history_index"](spark, d)) == found(want)
