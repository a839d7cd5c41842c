import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import intervals
from tidemark.llm import repeats as R

from .util import DOC, frame, words


def brute(docs, k=100):
    """Rows (doc_id, n_bytes, n_removed, n_spans, sha256): every window of k bytes against all that start earlier."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs})
    raw = {(d, t or ""): (t or "").encode() for d, t in docs}
    seen, hit = set(), {}
    for known, d, t in order:
        data = raw[(d if known else None, t)]
        marks = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - k + 1):
            w = data[i : i + k]
            if w in seen:
                marks[i : i + k] = True
            seen.add(w)
        hit[(d if known else None, t)] = marks
    out = []
    for d, t in docs:
        data, marks = raw[(d, t or "")], hit[(d, t or "")]
        kept = bytes(b for b, m in zip(data, marks, strict=False) if not m)
        out.append((d, len(data), int(marks.sum()), int((marks[:-1] & ~np.r_[False, marks[:-2]][: len(data)]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, **more):
    got = R.cut_repeats(frame(spark, docs), **more).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str)


def corpus(seed=5, n=120):
    """Copies, near copies, a passage in words of each document's own, overlapping pieces, and texts that repeat themselves."""
    rnd = random.Random(seed)
    base = [words(i, rnd.randrange(5, 200), 500) for i in range(n)]
    passage = words(9_999, 60)
    docs = list(base)
    docs += [base[3]] * 6 + [base[i][rnd.randrange(50) :] for i in range(0, n, 5)]
    docs += [" ".join(w if rnd.random() > 0.03 else "edit" for w in base[7].split(" ")) for _ in range(12)]
    docs += [f"{words(20_000 + i, 30)} {passage} {words(30_000 + i, 30)}" for i in range(25)]
    docs += ["abc" * 200, "x" * 450, "x" * 451, "abcabd" * 90 + "abc" * 100, words(1, 300) + " " + words(1, 300), "é" * 120, "ñ" * 40, "", "short"]
    rnd.shuffle(docs)
    ids = rnd.sample(range(10 * len(docs)), len(docs))
    return list(zip(ids, docs, strict=True))


def test_equals_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == brute(docs)


def test_split_anchors_and_shuffled_texts_give_the_same(spark, monkeypatch):
    docs = corpus(6, 40)
    monkeypatch.setattr(R, "MAX_TEXT", 300)
    several = R.repeated_spans(frame(spark, docs)).groupBy("first").count().collect()
    assert len(several) == 2
    assert run(spark, docs, max_broadcast_mb=-1) == brute(docs)


def test_edges_and_folds(spark, monkeypatch):
    """Many partitions for few anchors, so that most lie at an edge; rows folded a few at a time."""
    monkeypatch.setattr(R, "partitions_for", lambda df: 40)
    docs = corpus(7, 10)
    assert run(spark, docs) == brute(docs)
    cols = [np.array(x, np.int64) for x in ([1, 1, 1, 2, 1], [5, 5, 5, 5, 5], [9, 3, 3, 1, 3], [0, 0, 0, 0, 0], [4, 2, 2, 0, 7], [1] * 5, [0] * 5)]
    kind, rows = R.fold(cols)
    got = sorted(zip(kind.tolist(), *(x.tolist() for x in rows), strict=True))
    assert got == [(R.REMOVED, 1, 5, 3, 0, 7, 1, 0), (R.REMOVED, 1, 5, 9, 0, 4, 1, 0), (R.SEGMENT, 1, 5, 3, 0, 2, 1, R.FOLDED), (R.SEGMENT, 2, 5, 1, 0, 0, 1, 0)]


def test_defined_cases(spark):
    long = words(1, 4000)
    docs = [(1, long), (1, long), (2, None), (3, ""), (None, long), (4, "tail " + long[500:900]), (5, "a" * 99), (6, "a" * 99), (7, "\0" * 150), (8, "\0" * 140), (9, "a\0" * 90), (1, words(2, 50) + long[:300])]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    docs = corpus(8, 10)
    plain = frame(spark, docs, DOC).select("doc_id", "text")
    wide = plain.selectExpr("doc_id", "text", "doc_id AS doc", "'x' AS row", "1 AS at", "2 AS kind", "text AS `a.b`")
    assert sorted(map(tuple, R.cut_repeats(plain).collect()), key=str) == sorted(map(tuple, R.cut_repeats(wide).collect()), key=str)


def test_groups_hold_all_occurrences(spark):
    """A string in five documents: its repeat lists all five, each between other bytes."""
    text = words(3, 60)
    docs = [(i, f"{words(100 + i, 20)}{i}{text}{i}{words(200 + i, 20)}") for i in range(5)]
    got = R.repeated_spans(frame(spark, docs))
    size = len(text.encode())
    by = defaultdict(set)
    for r in got.collect():
        assert docs[r["doc"]][1].encode()[r["at"] : r["at"] + r["len"]] in text.encode()
        by[r["repeat"]].add((r["doc"], r["first"]))
    assert any({d for d, _ in x} == set(range(5)) and sum(f for _, f in x) == 1 for x in by.values())
    covered = R.removed_runs(frame(spark, docs)).collect()
    assert {r["doc"]: [b - a for a, b in zip(r["from"], r["to"], strict=True)] for r in covered} == {i: [size] for i in range(1, 5)}


@pytest.mark.parametrize("seed", range(6))
def test_intervals_against_all_pairs(seed):
    """Maximal repeats of short strings over few letters: bytes covered by non-first occurrences are those of all equal windows."""
    rnd = random.Random(seed)
    k = 4
    texts = [bytes(rnd.choice(b"ab\0" if seed % 2 else b"abcd") for _ in range(rnd.randrange(k, 60))) for _ in range(12)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size) - size
    place = np.arange(len(data))
    rnd.shuffle(order := list(range(len(texts))))
    for i, o in enumerate(order):
        place[start[i] : start[i] + size[i]] = o << 32 | np.arange(size[i])
    spot, length, first = intervals.repeats(data, start, size - k + 1, place, k)
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, spot, 1)
    np.add.at(marks, spot + length, -1)
    assert all(data[a : a + n].tobytes() == data[b : b + n].tobytes() and place[b] < place[a] for a, n, b in zip(spot, length, first, strict=True))
    want, seen = np.zeros(len(data), bool), set()
    for i in sorted(range(len(texts)), key=lambda i: order[i]):
        for j in range(len(texts[i]) - k + 1):
            w = texts[i][j : j + k]
            if w in seen:
                want[start[i] + j : start[i] + j + k] = True
            seen.add(w)
    assert ((np.cumsum(marks)[:-1] > 0) == want).all()
