import numpy as np
import pyarrow as pa

from tidemark.llm import components as C
from tidemark.llm import neardup as N

from .util import DOC, check_clashing, clashing, edited, frame, words


def classes(df):
    return {(r["doc_id"], r["class_id"]) for r in df.collect()}


def test_groups_copies_and_near_copies_only(spark):
    base = [words(i, 300) for i in range(6)]
    rows, want = [], {}
    for i, t in enumerate(base):
        rows.append((100 * i, t))
        want[100 * i] = 100 * i
        for j in range(1, 6):
            rows.append((100 * i + j, edited(t, j + 10, 0.006)))
            want[100 * i + j] = 100 * i
    rows += [(7, base[0]), (1000, words(77, 300) + " " + " ".join(base[0].split()[:60])), (1001, words(78, 80))]
    want |= {7: 0, 1000: 1000, 1001: 1001}
    got = N.near_duplicates(frame(spark, rows))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == want


def test_star_group_is_found_through_its_hub(spark):
    center = words(5, 400)
    rows = [(0, center)] + [(i, edited(center, i, 0.017)) for i in range(1, 60)]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    similar = [i for i in range(1, 60) if plain(center, rows[i][1]) >= 0.83]
    assert similar and all(got[i] == 0 for i in similar)


def test_pairs_in_crowded_buckets(spark):
    """Texts with a long passage in common fill the buckets without being similar; the pairs among them that are similar are found."""
    passage = words(1, 340)
    rows = []
    for i in range(150):
        own = words(1000 + i, 60)
        rows += [(2 * i, f"{passage} {own}"), (2 * i + 1, f"{passage} {' '.join(own.split()[:40])} {words(5000 + i, 20)}")]
    assert plain(rows[0][1], rows[2][1]) < 0.78 and plain(rows[0][1], rows[1][1]) > 0.83
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def plain(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_defined_cases(spark):
    rows = [(5, None), (3, ""), (4, None), (6, "a b"), (7, "A, b!"), (8, "a c"), (9, "..."), (10, "!!!"), (11, "a b"), (11, "a b"), (None, "a b"), (12, "word " * 5000), (13, "word " * 5000)]
    got = sorted(((r["doc_id"], r["class_id"]) for r in N.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (3, 3), (6, 6), (7, 6), (11, 6), (11, 6), (None, 6), (8, 8), (9, 9), (10, 10), (12, 12), (13, 12)], key=str)


def test_keep_one(spark):
    rows = [(5, None), (4, None), (6, "a b"), (11, "a b"), (20, "x y z"), (20, "x y z"), (None, "only null id"), (None, "only null id")]
    src = frame(spark, rows)
    left = N.keep_one(src)
    assert left.columns == src.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect() if r["text"]) == [("20", "x y z"), ("6", "a b"), ("None", "only null id")]
    assert {r["doc_id"] for r in left.collect() if r["text"] is None} == {4}


def test_repeated_and_null_ids_with_other_texts(spark):
    rows = [(1, "a b c"), (1, "d e f"), (None, "g h i"), (None, "j k l"), (2, "m n o"), (2, "p q r"), (3, "m n o"), (3, "m n o"), (None, "d e f")]
    left = N.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("1", "a b c"), ("1", "d e f"), ("2", "m n o"), ("2", "p q r"), ("None", "g h i"), ("None", "j k l")]
    assert len({r["root"] for r in N.near_duplicates(frame(spark, rows)).collect()}) == 6


def test_empty(spark):
    assert N.near_duplicates(frame(spark, [], DOC)).count() == 0
    assert N.keep_one(frame(spark, [], DOC)).count() == 0


def test_samples_agree_as_often_as_the_weighted_jaccard_says():
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rnd.uniform(1, 3, 400).astype(np.float32)
    a, b = np.arange(300), np.arange(100, 400)
    wb = w.copy()
    wb[150:200] *= 1.5
    want = np.minimum(w[100:300], wb[100:300]).sum() / (w[:100].sum() + np.maximum(w[100:300], wb[100:300]).sum() + wb[300:].sum())
    x = N.weighted_samples(h[a], w[a], np.array([0, 300]), 2000)[0]
    y = N.weighted_samples(h[b], wb[b], np.array([0, 300]), 2000)[0]
    assert abs((x == y).mean() - want) < 0.04


def test_weighted_jaccard_equals_sets():
    a, b = words(1, 200), edited(words(1, 200), 4, 0.02)
    flat = np.ones((2, N.WIDTH), np.float32)
    got = N.weighted_jaccard(pa.array([a, a, None, ""]), pa.array([b, a, "x", ""]), flat)
    assert abs(got[0] - plain(a, b)) < 1e-6 and got[1] == 1 and got[2] == 0 and got[3] == 0


def test_components(spark):
    n = 40
    path = [(i, i + 1) for i in range(n)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}
    roots = C.components(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"))
    more = C.absorb(roots, spark.createDataFrame([(2, 3), (9, 8)], "a long, b long"))
    assert {r["node"]: r["root"] for r in more.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_beyond_broadcast_limits(spark, monkeypatch):
    base = [words(i, 120) for i in range(4)]
    rows = [(10 * i + j, edited(t, j, 0.004 * j)) for i, t in enumerate(base) for j in range(3)]
    small = classes(N.near_duplicates(frame(spark, rows)))
    monkeypatch.setattr(N, "MAX_PICKED", 0)
    monkeypatch.setattr(C, "MAX_LABELS", 0)
    assert classes(N.near_duplicates(frame(spark, rows))) == small
    assert N.keep_one(frame(spark, rows)).count() == len({c for _, c in small})


def test_clashing_columns_keep_their_values(spark):
    src = clashing(spark.createDataFrame([(1, "a b"), (2, "a b"), (None, "c d"), (None, "c d"), (3, "c d e")], "doc_id long, text string"))
    left = N.keep_one(src)
    check_clashing(left, src)
    assert left.count() == 3


def test_every_similar_pair_is_in_one_class(spark):
    """Brute force over all pairs with the operator's own weights: chains of edits, some pairs above the similarity and some below."""
    rows = []
    for g in range(8):
        text = words(g, 150)
        for j in range(10):
            rows.append((100 * g + j, text))
            text = edited(text, 1000 * g + j, 0.004 * (1 + g % 4))
    src = frame(spark, rows)
    idf = N.idf_table(N.shingle_sketch(src.select("doc_id", "text")), len(rows))
    class_of = {r["doc_id"]: r["root"] for r in N.near_duplicates(src).collect()}
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :]]
    sims = N.weighted_jaccard(pa.array([x[1] for x, _ in pairs]), pa.array([y[1] for _, y in pairs]), idf)
    similar = [(x[0], y[0]) for (x, y), s in zip(pairs, sims, strict=True) if s >= N.SIMILARITY]
    assert len(similar) > 100 and all(class_of[a] == class_of[b] for a, b in similar)
    # and no class without a chain of such pairs
    links = C.components(spark.createDataFrame(similar, "a long, b long")).collect()
    joined = {r["node"]: r["root"] for r in links}
    assert len(set(class_of.values())) == len({joined.get(i, i) for i, _ in rows})


def test_one_of_rows_equal_in_id_and_text_is_chosen_by_their_columns(spark):
    """The order in which rows come does not matter."""
    text = words(77, 40)
    rows = [(1, text, f"s{i}", i) for i in range(12)]
    got = {tuple(N.keep_one(frame(spark, rows[i:] + rows[:i]).repartition(3)).select("doc_id", "source", "row").collect()[0]) for i in range(0, 12, 5)}
    assert len(got) == 1
