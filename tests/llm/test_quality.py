import random

import numpy as np

from tidemark.llm import quality as Q

from .util import frame, words


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, kind = words(seed * 10**6 + i, rnd.randrange(20, 150), 600), rnd.choice(["good", "good", "toxic", "junk"])
        if kind == "toxic":
            t = text.split()
            for _ in range(max(2, len(t) // 20)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["idiota", "idiotic,", "scumbag", "Scum"]))
            text = " ".join(t)
        if kind == "junk":
            text = " ".join(w + rnd.choice(["###", "$$$"]) for w in text.split())
        rows.append((i, text))
        labels.append((i, 0 if kind == "junk" else 1, 1 if kind == "toxic" else 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out(spark):
    rows, labels = corpus(700)
    model = Q.fit(frame(spark, rows), Q.grade_ratings(spark.createDataFrame(labels, LABELS)))
    assert (np.diff(model.thresholds) > 0).all()
    fresh, truth = corpus(300, 1)
    got = {r["doc_id"]: r for r in Q.score(frame(spark, fresh), model).collect()}
    good = [got[i]["kept"] for i, q, t in truth if q and not t]
    bad = [got[i]["kept"] for i, q, t in truth if not q or t]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    mean = lambda f: np.mean([got[i]["expected_grade"] for i, q, t in truth if f(q, t)])
    assert mean(lambda q, t: not q) < mean(lambda q, t: q and t) < mean(lambda q, t: q and not t)


def test_defined_cases(spark):
    rows, labels = corpus(200)
    ratings = Q.grade_ratings(spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0), (4, 1, 1), (4, 1, 0), (10**9, 0, 0)], LABELS))
    model = Q.fit(frame(spark, rows), ratings)
    odd = frame(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b " * 200_000)])
    got = Q.score(odd, model)
    assert got.count() == 5
    kept = Q.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == got.filter("kept").count()
    assert Q.score(odd.limit(0), model).count() == 0


def test_without_labels_nothing_is_rejected(spark):
    rows, labels = corpus(30)
    for some in ([], [x for x in labels if x[1] and not x[2]]):
        model = Q.fit(frame(spark, rows), Q.grade_ratings(spark.createDataFrame(some, LABELS)))
        assert Q.keep_good(frame(spark, rows), model).count() == 30


def test_sample_is_bounded(spark):
    rows, labels = corpus(60)
    assert Q.training_rows(frame(spark, rows), Q.grade_ratings(spark.createDataFrame(labels, LABELS)), max_train=25).count() == 25


def test_few_and_mostly_bad_ratings_do_not_reject_all(spark):
    """With three of four ratings bad, a text without evidence has a low tail probability and is kept all the same."""
    rows, labels = corpus(520, 5)
    good = [x[0] for x in labels if x[1] and not x[2]]
    some = [x for x in labels if x[0] not in set(good[:-60])]
    model = Q.fit(frame(spark, rows), Q.grade_ratings(spark.createDataFrame(some, LABELS)))
    kept = {r["doc_id"] for r in Q.keep_good(frame(spark, rows), model).collect()}
    bad = [x[0] for x in some if not x[1] or x[2]]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_figures_on_the_tables(spark):
    """Half of the rated documents of sf0.01 train, the other half is judged."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    graded = Q.grade_ratings(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = Q.fit(docs, graded.filter("doc_id % 2 = 0"))
    got = Q.score(docs, model).join(graded.filter("doc_id % 2 = 1"), "doc_id").groupBy("grade").agg({"kept": "count", "tail_prob": "avg"}).collect()
    kept = {r["grade"]: r["n"] for r in Q.score(docs, model).join(graded.filter("doc_id % 2 = 1"), "doc_id").filter("kept").groupBy("grade").count().withColumnRenamed("count", "n").collect()}
    total = {r["grade"]: r["count(kept)"] for r in got}
    assert kept.get(2, 0) >= 0.97 * total[2] and kept.get(0, 0) <= 0.45 * total[0] and kept.get(1, 0) <= 0.55 * total[1], (kept, total)
