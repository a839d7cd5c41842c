import math
import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import lexical as L

from .util import frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        wanted, scores = set(terms(text)), []
        for d, c, size in counted:
            m = 50 + (50 * size * n) // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted & set(c)), d))
        best = [x for x in scores if x[0] > 0]
        best.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(best[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, top=10, **more):
    got = L.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), top, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(n=300):
    rnd = random.Random(2)
    docs = [(i, " ".join([words(i, rnd.choice([1, 5, 30, 400]), 300), *["the"] * rnd.randrange(40)])) for i in range(n)]
    docs += [(1000 + i, docs[4][1]) for i in range(30)] + [(2000, "Über ÜBER über 42"), (2001, docs[9][1].upper())]
    items = [(i, words(5000 + i, 12, 300) + " the") for i in range(15)] + [(90, "über 42 Über"), (91, "nowhere"), (92, docs[4][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_blocks_and_shuffled_texts_give_the_same(spark, monkeypatch):
    docs, items = corpus(80)
    monkeypatch.setattr(L, "MAX_ITEMS", 7)
    monkeypatch.setattr(L, "BLOCK_DOCS", 5)
    assert run(spark, docs, items, max_broadcast_mb=-1) == brute(docs, items, 10)


def test_defined_cases(spark):
    docs = [(1, "alpha beta"), (1, "alpha gamma"), (2, None), (3, ""), (4, "?! -"), (None, "alpha beta"), (5, "alpha " * 30_000 + "beta"), (7, "alpha beta"), (7, "alpha beta"), (8, "other words")]
    items = [(1, "Beta beta"), (2, None), (3, ""), (None, "gamma"), (4, "beta"), (4, "beta")]
    assert run(spark, docs, items) == brute(docs, [x for i, x in enumerate(items) if x not in items[:i]], 10)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    two = run(spark, docs, [(6, "beta"), (6, "gamma")])
    assert {r[1] for r in two} == {1, 2, 3, 4, 5} and sum(r[1] == 1 for r in two) == 2


def test_clashing_columns(spark):
    docs, items = corpus(40)
    wide = frame(spark, docs).select("doc_id", "text").selectExpr("*", "doc_id AS doc", "text AS row", "1 AS items", "2 AS kind", "3 AS `a.b`")
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in L.search(wide, asked, 10).collect()), key=str) == brute(docs, items, 10)


def test_bounds_are_never_too_low():
    """Bounds of random documents against exact scores, and most documents without a query's rare terms are excluded."""
    rnd = random.Random(1)
    texts = [words(i, rnd.randrange(1, 300), 500) for i in range(200)]
    asked = [words(9000 + i, 6, 500) for i in range(10)]
    h = [np.unique(L.term_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0]) for x in asked]
    known, flat = np.unique(np.concatenate(h), return_inverse=True)
    q = L.Queries(known, np.arange(1, len(known) + 1), flat, np.r_[0, np.cumsum([len(x) for x in h])], len(texts), sum(len(x.split()) for x in texts))
    index, blocks = L._Index(), []
    exact = np.zeros((len(asked), len(texts)), np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        th, owner = L.term_hashes(data, np.array([0, len(data)]))
        _, t, c = L.term_counts(th, owner)
        if (b := index.add(i, 0, len(th), t, c)) is not None:
            blocks.append(b)
        gain = np.zeros(len(known), np.int64)
        for x, k in zip(t, c, strict=True):
            at = int(np.searchsorted(known, x))
            if at < len(known) and known[at] == x:
                gain[at] = q.weights[at] * q.gain(k, q.lengths(np.array([len(th)]))[0])
        exact[:, i] = q.sums(gain[:, None])[:, 0]
    blocks += [index.cut(s) for s in list(index.open)]
    seen = 0
    for b in blocks:
        doc, n = b[2][0].values.to_numpy(), b[4][0].values.to_numpy()
        got = L.bounds(q, b[1][0].as_py(), n, b[5][0].as_py())
        assert (got >= exact[:, doc]).all()
        seen += len(doc)
        assert (got == 0)[exact[:, doc] == 0].mean() > 0.9
    assert seen == len(texts)
