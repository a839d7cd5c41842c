import random
from collections import defaultdict

from tidemark.llm import line_dedup as L

from .util import DOC, frame, words

TRIM = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(TRIM))


def brute(docs):
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(d)
    top = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in held.items() if len(v) >= 3}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, docs):
    return sorted((tuple(r) for r in L.dedup_lines(frame(spark, docs)).collect()), key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    pool = [words(i, 4) for i in range(30)] + ["short", "é" * 19, "é" * 20, "", "  "]
    docs = []
    for i in range(400):
        lines = [rnd.choice(pool) if rnd.random() < 0.4 else words(1000 + 50 * i + j, 5) for j in range(rnd.randrange(1, 12))]
        docs.append((i, "\n".join(rnd.choice(["", " ", "\t"]) + (x.upper() if rnd.random() < 0.2 else x) + rnd.choice(["", "\r"]) for x in lines)))
    docs += [(i, "The one line that a third of all documents hold\n" + words(i, 6)) for i in range(400, 700)]
    assert run(spark, docs) == brute(docs)


def test_defined_cases(spark):
    line = "this line is long enough to count"
    docs = [(1, line), (2, line + "\n" + line), (2, line), (3, None), (4, ""), (5, "\n"), (6, line + "\nx"), (None, line), (7, "y " * 100_000 + "\n" + line), (7, "y " * 100_000 + "\n" + line)]
    assert run(spark, docs) == brute(docs)


def test_two_documents_keep_their_line(spark):
    docs = [(1, "a line of two documents, long"), (2, "a line of two documents, long"), (2, "a line of two documents, long")]
    assert run(spark, docs) == brute(docs) and all(r[2] == 0 for r in brute(docs))


def test_shuffled_bitmaps_give_the_same(spark):
    docs = frame(spark, [(i, "the same boilerplate line here\nown line number " + str(i) * 20) for i in range(20)]).select("doc_id", "text")
    maps = L.keep_bitmaps(docs)
    a, b = (L.with_bitmaps(docs, maps, mb) for mb in (64, -1))
    assert sorted(r["doc_id"] for r in a.filter("__keep IS NOT NULL").collect()) == sorted(r["doc_id"] for r in b.filter("__keep IS NOT NULL").collect()) == list(range(19))


def test_empty(spark):
    assert run(spark, []) == []
    assert frame(spark, [], DOC).count() == 0
