import hashlib
import re

import pytest

from tidemark.llm import decontaminate as D

from .util import DOC, check_clashing, clashing, frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    out = []
    for d in docs:
        w = WORD.findall(lower(d[1] or ""))
        hit, ids = set(), set()
        for win, i in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= i
        ids = sorted(str(x) for x in ids)
        out.append((d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    a, b = words(1, 40), words(2, 25)
    items = [(1, a), (2, b), (10, "Étre, two THREE"), (11, "solo"), (3, None), (4, ""), (5, "..."), (6, a), (7, "the the the the the the the the the the the the")]
    part = " ".join(a.split()[5:17])
    docs = [
        (1, "x y " + part.upper() + ". z"),
        (2, " ".join(a.split()[5:14])),  # nine words: no window
        (3, None),
        (4, ""),
        (5, "étre two three"),  # É is not lower-cased
        (6, "Étre two... three solo"),
        (7, a + " " + b + " " + a),
        (7, words(9, 50)),
        (8, "the " * 11),
        (8, "the " * 11),
        (None, part),
        (9, words(5, 6000) + " " + part),
        (12, part.replace(" ", "\n", 3)),
    ]
    return docs, items


def test_equals_brute_force(spark, cases):
    docs, items = cases
    got = D.contamination_digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_keys_give_the_same(spark, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = D.find_hits(frame(spark, docs), bench)
    split = D.find_hits(frame(spark, docs), bench, max_keys=7)
    key = lambda r: str((r["doc_id"], r["row"], r["start"], r["n"], sorted(r["items"])))
    assert sorted(map(key, whole.collect())) == sorted(map(key, split.collect()))


def test_empty_tables(spark, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination_digest(frame(spark, [], DOC), bench).count() == 0
    none = D.contamination_digest(frame(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)


def test_drop_keeps_columns_and_clean_rows(spark, cases):
    docs, items = cases
    src = frame(spark, docs)
    left = D.drop_contaminated(src, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == src.columns
    bad = {(r[0], r[1]) for r in docs if any(x[0] == r[0] and x[5] for x in brute([r], items))}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(((d[0], d[1]) for d in docs if (d[0], d[1]) not in bad), key=str)


def test_plan_is_native(spark, cases):
    docs, items = cases
    plan = D.contamination_digest(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_beyond_broadcast_limit(spark, cases, monkeypatch):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = sorted(str(r["doc_id"]) for r in D.drop_contaminated(frame(spark, docs), bench).collect())
    monkeypatch.setattr(D, "MAX_BAD", 0)
    assert sorted(str(r["doc_id"]) for r in D.drop_contaminated(frame(spark, docs), bench).collect()) == small


def test_clashing_columns_keep_their_values(spark, cases):
    docs, items = cases
    src = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    left = D.drop_contaminated(src, spark.createDataFrame(items, "item_id long, text string"))
    check_clashing(left, src)
    assert 0 < left.count() < len(docs)
