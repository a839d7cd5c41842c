import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import divergence as D

from .util import words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string, term string, n int, `a.b` string, doc_id long"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, min_docs, top):
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, s in docs:
        groups[lang].add(s)
        df[lang].update(set(terms(t)))
        count[lang, s].update(terms(t))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            below = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // below for t in kept}

        q = shares(total)
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", more)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows[: top if part == "term" else None])]
    return sorted(out)


def run(spark, docs, min_docs=3, top=5):
    rows = [(*d, "x", 1, "y", 2) for d in docs]
    return sorted(tuple(r) for r in D.audit(spark.createDataFrame(rows, SCHEMA), min_docs, top).collect())


def corpus(n=300):
    rnd = random.Random(3)
    docs = [(re.sub("[0-9]+", lambda m: "".join(chr(97 + int(x)) for x in m[0]), words(i, rnd.choice([2, 20, 80]), 700)), rnd.choice(["en", "de", "fr"]), f"s{rnd.randrange(6) if rnd.random() < 0.6 else 0}") for i in range(n)]
    return docs + [("Éa éa B2b b", "en", "é"), ("zz " * 3000, "en", "s1")]


def test_equals_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == brute(docs, 3, 5)


def test_chunks_and_flushes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 2)
    monkeypatch.setattr(D, "BLOCK", 16)
    docs = corpus(150)
    assert run(spark, docs) == brute(docs, 3, 5)
    held = D._Counter()
    monkeypatch.setattr(D, "HELD", 10)
    batch = spark.createDataFrame([(t, a, b) for t, a, b in docs], "text string, lang string, source string").select("lang", "source", "text").toArrow().to_batches()
    got = Counter()
    for rb in D._count(iter(batch)):
        for lang, s, t, n, _ in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            got[lang, s, t] += n
    want = Counter((lang, s, t) for text, lang, s in docs for t in terms(text))
    assert +got == want and not held.size


def test_defined_cases(spark):
    docs = [(None, "en", "a"), ("x y", None, None), ("x y", "", ""), ("x x", None, "b"), ("x", "", "b"), ("", "fr", "a"), ("une", "fr", "b"), ("x", "en", None), ("x", "en", "a"), ("x", "en", "a"), ("long " * 30_000, "en", "c")]
    assert run(spark, docs) == brute(docs, 3, 5)
    assert run(spark, []) == []


def test_counts_beyond_64_bits():
    rows = np.array([[10**12, 5, 0], [7, 0, 10**13]], np.int64)
    below = rows.sum(1) + 15
    got, _ = D.Trees(rows).distances(np.array([0]), np.array([1]), below)
    p = [[1 + 10**9 * (int(c) + 5) // int(b) for c in r] for r, b in zip(rows, below, strict=True)]
    assert int(got[0]) == sum(abs(x - y) for x, y in zip(*p, strict=True))


def test_equal_nodes_are_shared_and_priced_once():
    counts = np.zeros((8, 256), np.int64)
    counts[::2, 3] = 4
    counts[1, 200] = 9
    trees = D.Trees(counts)
    assert sum(map(len, trees.left)) < 40
    a, b = np.triu_indices(8, 1)
    below = np.full(8, 1000)
    value, priced = trees.distances(a, b, below)
    p = 1 + 10**9 * (counts + 5) // 1000
    assert (value == np.abs(p[a] - p[b]).sum(1)).all()
    assert priced < 200  # of 28 pairs of trees with 511 nodes each
