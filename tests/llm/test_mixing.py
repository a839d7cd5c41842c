import random
from collections import defaultdict

from tidemark.llm import mixing as M

from .util import DOC, check_clashing, clashing, frame, words


def sizes(n, seed=1):
    rnd = random.Random(seed)
    return [int(min(5000, rnd.lognormvariate(4.5, 1))) + 1 for _ in range(n)]


def brute_targets(source_size):
    order = sorted(source_size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(source_size.values()), {}, set(order)
    while open_:
        rest = total - sum(target.values())
        weight = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / weight >= 3 * source_size[s]}
        if not over:
            return target | {s: rest * w[s] / weight for s in open_}
        target |= {s: 3.0 * source_size[s] for s in over}
        open_ -= over
    return target


def test_targets(spark):
    for table in ({"a": 100, "b": 1, "c": 5, None: 40, "é": 900}, {"x": 7}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 1000, "d": 2, "e": 3, "f": 0}):
        df = spark.createDataFrame([(k, v) for k, v in table.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
        want = brute_targets(table)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in table), (got, want)


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(2)
    rows, longest = [], defaultdict(int)
    for i, n in enumerate(sizes(1500)):
        s = rnd.choice(["hot"] * 5 + ["b", "c", "d", None])
        rows.append((i, "w " * n, s))
        longest[s] = max(longest[s], n)
    src = frame(spark, rows)
    got = M.mix_digest(src).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    taken, target, by = defaultdict(int), {}, {r[0]: r for r in rows}
    for r in got:
        assert r["size"] == len(by[r["doc_id"]][1].split()) and r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        taken[by[r["doc_id"]][2]] += r["taken"]
        target[by[r["doc_id"]][2]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 0.5 * longest[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]
    again = M.mix_digest(src.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    mixed = M.mix(src)
    assert mixed.columns == src.columns
    times = {r["doc_id"]: r["taken"] // r["size"] for r in got}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}


def test_expectation_is_kept(spark):
    units = [(f"s{k}", 10 * k + i, i, float(u), 0.3) for k in range(300) for i, u in enumerate((10, 10, 20, 40))]
    got = M.round_copies(spark.createDataFrame(units, "source string, d long, r long, u double, p double"), chunk=3).collect()
    assert len(got) == len(units) and {r["t"] for r in got} <= {0, 1}
    words_in = defaultdict(float)
    for r in got:
        words_in[r["source"]] += r["t"] * (10, 10, 20, 40)[r["d"] % 10]
    assert all(abs(v - 24) <= 20 for v in words_in.values())
    assert abs(sum(words_in.values()) / 300 - 24) < 3


def test_defined_cases(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, words(1, 50), "a"), (4, "z", "b"), (4, "q", "b")]
    got = M.mix_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert len({r["taken"] for r in got if r["doc_id"] == 3}) == 1
    assert M.mix_digest(frame(spark, [], DOC)).count() == 0
    zero = M.mix_digest(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in zero)


def test_beyond_broadcast_limits(spark, monkeypatch):
    src = frame(spark, [(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes(60))])
    small = sorted((r["doc_id"], r["taken"]) for r in M.mix_digest(src).collect())
    monkeypatch.setattr(M, "MAX_SOURCES", 0)
    monkeypatch.setattr(M, "MAX_PLAN", 0)
    assert sorted((r["doc_id"], r["taken"]) for r in M.mix_digest(src).collect()) == small
    assert M.mix(src).count() == sum(t // max(1, len(("w " * n).split())) for (_, t), n in zip(small, sizes(60), strict=True))


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes(40))] + [(None, "x y z", None)]
    src = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check_clashing(M.mix(src), src)


def test_sources_in_many_runs(spark, monkeypatch):
    table = {f"s{i:04d}": (i * 7919) % 500 for i in range(300)} | {None: 40}
    df = spark.createDataFrame([(k, v) for k, v in table.items()], "source string, source_size long")
    want = brute_targets(table)
    for limit in (10**6, 30):
        monkeypatch.setattr(M, "MAX_RUN", limit)
        got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_a_very_long_text(spark):
    got = M.mix_digest(frame(spark, [(1, "w " * 300_000, "a"), (2, "w", "a"), (3, "w w", "b")])).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 300_000, 2: 1, 3: 2} and all(r["taken"] <= 3 * r["size"] for r in got)
