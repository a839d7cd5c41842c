import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolve as R
from tidemark.operators import rules, similar


def greedy(rows, edges):
    """The sequential loop: (id, ord, eligible, in_history)."""
    kept, dup = set(), set()
    for i, _, eligible, old in sorted(rows, key=lambda r: r[1]):
        if old or any(a in kept for a, b in edges if b == i):
            dup.add(i)
        elif eligible:
            kept.add(i)
    return kept, dup


def settled(spark, rows, edges):
    e = spark.createDataFrame(edges, "earlier long, later long")
    got = R.resolve_greedy(spark.createDataFrame(rows, "id long, ord long, eligible boolean, in_history boolean"), *R.edge_keys(e)).collect()
    return {r["id"] for r in got if r["kept"]}, {r["id"] for r in got if r["is_dup"]}


def test_chains(spark):
    a, b, c = (1, 1, True, False), (2, 2, True, False), (3, 3, True, False)
    edges = [(1, 2), (2, 3)]
    assert settled(spark, [a, b, c], edges) == ({1, 3}, {2})
    assert settled(spark, [(1, 1, False, False), b, c], edges) == ({2}, {3})
    assert settled(spark, [(1, 1, True, True), b, c], edges) == ({2}, {1, 3})


def test_equals_the_loop_on_random_graphs(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, i, rnd.random() < 0.8, rnd.random() < 0.1) for i in range(60)]
        edges = [(i, j) for i in range(60) for j in range(i + 1, 60) if rnd.random() < 0.05]
        assert settled(spark, rows, edges) == greedy(rows, edges)


def test_classify_order(spark):
    rows = [(1, 1, True, True, True, True, False), (2, 2, False, True, True, True, False), (3, 3, False, False, True, True, False), (4, 4, False, False, False, True, True), (5, 5, False, False, False, False, True), (6, 6, False, False, False, False, False), (7, 7, False, False, True, False, False)]
    df = spark.createDataFrame(rows, "id long, ord long, page_missing boolean, in_history boolean, too_short boolean, policy boolean, draft_failed boolean")
    members, watchers = R.edge_keys(spark.createDataFrame([(6, 7)], "earlier long, later long"))
    done = R.classify(df, lambda rows: R.resolve_greedy(rows, members, watchers))
    assert {r["id"]: r["status"] for r in done.collect()} == {1: "failed", 2: "duplicate", 3: "too_short", 4: "policy", 5: "failed", 6: "published", 7: "duplicate"}
    assert R.run_stats(done).first().asDict() == {"total_candidates": 7, "published": 1, "skipped_duplicate": 2, "skipped_policy": 1, "skipped_too_short": 1, "failed": 2}


def test_title_dups(spark):
    rows = [(1, 1, "A b", False), (2, 2, "a B", True), (3, 3, "AB", True), (4, 4, "", True), (5, 5, None, True)]
    got = {r["id"]: r["is_dup"] for r in R.title_dups(spark.createDataFrame(rows, "id long, ord long, title string, eligible boolean")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}


def mutate(s, rnd, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], [s[i], "q"], ["z"]])
    return "".join(s)


def test_gram_candidates_lose_nothing(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 60))) for _ in range(80)]
    left, right = base + ["x"], [mutate(s, rnd, rnd.randrange(4)) for s in base] + ["x"]
    got = {(r["sa"], r["sb"]) for r in similar.gram_candidates(*(spark.createDataFrame([(s,) for s in side], "s string") for side in (left, right))).collect()}
    want = {(a, b) for a in left for b in right if a and b and SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert want and want <= got
    assert len(got) < len(left) * len(right) / 4


def test_similar_and_exists(spark):
    body = "the quick brown fox jumps over the lazy dog again and again until it is tired of it " * 2
    hist = spark.createDataFrame([(1, "http://Old.com/a/", "A title of some length here", body), (2, "http://old.com/b", "未命名", "zzz")], "id long, source_url string, title string, extracted_text string")
    new = spark.createDataFrame(
        [(10, "http://old.com/a", "other", "x"), (11, "n", "A title of some length, here", "y"), (12, "n", "unlike", body), (13, "n", "未命名", "w"), (14, "n", None, None)],
        "id long, url string, title string, text string",
    )
    got = {r["id"]: (r["is_dup"], r["reason"], r["matched_id"]) for r in similar.exists_duplicate(new, hist).collect()}
    assert got == {10: (True, "url", 1), 11: (True, "title", 1), 12: (True, "body", 1), 13: (False, None, None), 14: (False, None, None)}
    assert {r["new_id"] for r in similar.similar_titles(new, hist, compat=True).collect()} == {11, 13}
    lossless = similar.similar_bodies(new, hist.select("id", F.col("extracted_text").alias("text")), mode="grams")
    assert {r["new_id"] for r in lossless.collect()} == {12}
    assert similar.known_urls(new, hist).count() == 1 and similar.append_new(new, hist).count() == 4


def test_equal_and_similar_rows(spark):
    long = "a body of text that goes on for a while and says nothing in particular number one"
    rows = [(1, "u1", "First title of all, long", long), (2, "u1/", "x", "short"), (3, "u3", "First title of all, longe", "other"), (4, "u4", "y", long.upper()), (5, "u5", "z", "unrelated")]
    df = spark.createDataFrame(rows, "id long, url string, title string, text string")
    state = df.select("id", F.col("id").alias("ord"), F.lit(True).alias("eligible"), F.lit(False).alias("in_history"))
    got = {r["id"]: r["is_dup"] for r in similar.Duplicates(df).resolve(state).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def chinese(rnd, n):
    return "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))


def test_resolution_in_rounds_equals_the_loop(spark, monkeypatch):
    """With few texts met at a time: groups of similar titles, some not eligible, and a large group of similar bodies that costs few comparisons."""
    monkeypatch.setattr(similar, "FIRST", 2)
    monkeypatch.setattr(similar, "GROWTH", 2)
    rnd = random.Random(8)
    base = [chinese(rnd, 40) for _ in range(6)]
    body = chinese(rnd, 400)
    rows = [(i, f"u{i}", mutate(rnd.choice(base), rnd, rnd.randrange(5)), chinese(rnd, 30)) for i in range(60)]
    rows += [(100 + i, f"v{i}", chinese(rnd, 12), mutate(body, rnd, 8)) for i in range(120)]
    rows = [(i, u, t, b) for i, u, t, b in rows]
    able = {r[0]: rnd.random() < 0.8 for r in rows}
    norm = lambda x: "".join(c for c in x.lower() if c.isalnum())
    alike = lambda x, y: x == y or SequenceMatcher(None, x, y).ratio() >= 0.9
    edges = [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if alike(norm(x[2]), norm(y[2])) or (x[0] >= 100 <= y[0] and alike(x[3], y[3]))]
    df = spark.createDataFrame(rows, "id long, url string, title string, text string")
    same = similar.Duplicates(df)
    state = spark.createDataFrame([(i, i, able[i], False) for i in able], "id long, ord long, eligible boolean, in_history boolean")
    got = same.resolve(state).collect()
    assert ({r["id"] for r in got if r["kept"]}, {r["id"] for r in got if r["is_dup"]}) == greedy([(i, i, able[i], False) for i in able], edges)
    assert same.near[1].tested.filter("ha != hb").count() < 120 * 10


def test_first_matches_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(similar, "FIRST", 1)
    monkeypatch.setattr(similar, "GROWTH", 2)
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefghij") for _ in range(30)) for _ in range(8)]
    hist = [(i, mutate(rnd.choice(base), rnd, rnd.randrange(6))) for i in range(60)]
    new = [(i, mutate(rnd.choice(base), rnd, rnd.randrange(4))) for i in range(60)]
    frames = [spark.createDataFrame(x, "id long, title string") for x in (new, hist)]
    got = {r["new_id"]: (r["matched_id"], round(r["ratio"], 6)) for r in similar.similar_titles(*frames).collect()}
    want = {}
    for i, t in new:
        for j, h in hist:
            ratio = SequenceMatcher(None, h, t).ratio()
            if ratio >= 0.9 and i not in want:
                want[i] = (j, round(ratio, 6))
    assert got == want and len(want) > 20


def scripts(rnd):
    """A writer of random text for each of three scripts: words of Latin letters, Chinese, and words of Cyrillic ones."""
    def of(letters):
        common = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(600)]
        return lambda n: "".join(rnd.choice(common) for _ in range(n))[:n]

    return [of("etaoinshrdlucmfwypvbgkjqxz"), lambda n: chinese(rnd, n), of("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё")]


@pytest.mark.parametrize("sizes", [(60, 80, 100, 110, 150, 200), (300, 700, 1500, 3000)])
def test_bodies_equal_all_pairs_at_the_ratio(spark, sizes):
    """From 60 to 3,000 characters, three scripts; edits all over, in one place, insertions and deletions, about the bound: exactly the pairs of brute force."""
    rnd = random.Random(sizes[0])
    hist, new = [], []
    for write in scripts(rnd):
        for size in sizes:
            for k in range(24 if size <= 300 else 8):
                t = write(size)
                n = round(size * rnd.choice([0.02, 0.06, 0.08, 0.095, 0.1, 0.105]))
                spots = set(rnd.sample(range(size), n) if k % 4 != 3 else range(size // 2, size // 2 + n))
                edit = {0: lambda c, w=write: w(1), 1: lambda c, w=write: c + w(1), 2: lambda c: "", 3: lambda c, w=write: w(1)}[k % 4]
                hist.append((len(hist), t))
                new.append((len(new), "".join(edit(c) if i in spots else c for i, c in enumerate(t))))
    true = {i for (i, a), (_, b) in zip(hist, new, strict=True) if SequenceMatcher(None, a, b).ratio() >= 0.9}
    got = {(r["new_id"], r["matched_id"]) for r in similar.similar_bodies(*(spark.createDataFrame(x, "id long, text string") for x in (new, hist))).collect()}
    assert got == {(i, i) for i in true} and len(true) > 0.25 * len(new), (len(got), len(true))


def compared(spark, monkeypatch, run, *frames):
    """Pairs that are compared in a similarity join."""
    made, true = [], similar._tested
    monkeypatch.setattr(similar, "_tested", lambda pairs, *more: (made.append(pairs.count()), true(pairs, *more))[1])
    run(*frames).count()
    monkeypatch.setattr(similar, "_tested", true)
    return sum(made)


@pytest.mark.parametrize("n", [400, 4000])
def test_common_phrases_cost_a_few_comparisons_each(spark, monkeypatch, n):
    rnd = random.Random(n)
    latin = scripts(rnd)[0]
    phrase, block = latin(15), latin(800)
    titles = [(i, phrase + "".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(30))) for i in range(n)]
    frames = [spark.createDataFrame(titles[k::2], "id long, title string") for k in (0, 1)]
    # Of 28 runs of its own a title has in common with others what letters have by chance, and each is looked up in TITLE_LIMIT titles at most.
    assert compared(spark, monkeypatch, similar.similar_titles, *frames) < 40 * n
    bodies = [(i, block + latin(900)) for i in range(n)]
    frames = [spark.createDataFrame(bodies[k::2], "id long, text string") for k in (0, 1)]
    assert compared(spark, monkeypatch, similar.similar_bodies, *frames) < 5 * n


def test_overlapping_strings_equal_all_pairs(spark):
    rnd = random.Random(12)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
    texts = sorted({mutate(rnd.choice(base), rnd, rnd.randrange(6)) for _ in range(250)} | {"a", "aa", "aaa", "ab", "abc", "abcabcabc", "aaaaaaaaaa"})

    def grams(s):
        return Counter(s[i : i + 3] for i in range(len(s) - 2))

    want = set()
    for x in texts:
        for y in texts:
            n = max(len(x), len(y))
            shared = sum((grams(x) & grams(y)).values())
            if x != y and shared and min(len(x), len(y)) >= 0.818 * n and shared >= math.ceil(0.25 * (len(x) + len(y)) - 2 - 1e-9):
                want.add((x, y, shared))
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    assert {tuple(r) for r in similar.overlapping_strings(df, df).collect()} == want and len(want) > 300


def test_rules(spark):
    table = spark.createDataFrame([("p", "pair", "a", "red"), ("p", "pair", "b", "Blue"), ("w", "any", None, "green"), ("h", "host", None, "bad.example")], "rule_id string, kind string, group string, term string")
    rows = [(1, "Red sky", "", "http://x/"), (2, "red and BLUE", "", "http://x/"), (3, "", "GREEN", "http://a.bad.example/"), (4, None, None, None)]
    got = {r["id"]: r["rule_ids"] for r in rules.rule_filter(spark.createDataFrame(rows, "id long, title string, text string, url string"), table).collect()}
    assert got == {1: [], 2: ["p"], 3: ["h", "w"], 4: []}


def test_short_titles_meet_in_blocks_without_keys(spark, monkeypatch):
    """Titles of few syllables, which share most of their runs: several blocks, pairs of one side only, no keys, and the result of all pairs."""
    rnd = random.Random(21)
    monkeypatch.setattr(similar, "MIN_BLOCK", 40)
    monkeypatch.setattr(similar, "title_keys", None)
    base = ["".join(rnd.choice(("tion", "ment", "elle", "que", "les", "en")) for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    hist = [(i, mutate(s, rnd, rnd.randrange(5))) for i, s in enumerate(base)]
    new = [(i, mutate(s, rnd, rnd.randrange(5))) for i, s in enumerate(base)] + [(60, base[3]), (61, "")]
    a, b = (spark.createDataFrame(x, "id long, title string") for x in (new, hist))
    want = {}
    for i, t in new:
        for j, h in hist:
            if t and h and SequenceMatcher(None, h, t).ratio() >= 0.9:
                want.setdefault(i, j)
    assert {r["new_id"]: r["matched_id"] for r in similar.similar_titles(a, b).collect()} == want and len(want) > 20
    one, two = (x.select(F.col("title").alias("s")) for x in (a, b))
    close = {(r["sa"], r["sb"]) for r in similar.gram_candidates(two, one).collect()}
    assert {(h, t) for _, h in hist for _, t in new if t and h and SequenceMatcher(None, h, t).ratio() >= 0.9} <= close
    assert similar.overlapping_strings(one, two).count() > 20


def test_jaccard_of_sets_below_and_above_the_bound_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BRIEF", 40)
    rnd = random.Random(22)
    base = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice((5, 8, 30, 41, 46, 50, 90)))) for _ in range(60)]
    hist = [(i, mutate(s, rnd, rnd.randrange(3))) for i, s in enumerate(base)]
    new = [(i, mutate(s, rnd, rnd.randrange(3))) for i, s in enumerate(base)]
    runs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    want = {}
    for i, t in new:
        for j, h in hist:
            if t and h and len(runs(t) & runs(h)) / len(runs(t) | runs(h)) >= 0.8:
                want.setdefault(i, j)
    products, true = [], similar.block_pairs
    monkeypatch.setattr(similar, "block_pairs", lambda *x: products.append(1) or true(*x))
    got = {r["new_id"]: r["matched_id"] for r in similar.similar_titles(*(spark.createDataFrame(x, "id long, title string") for x in (new, hist)), 0.8, mode="jaccard").collect()}
    assert got == want and len(want) > 20 and products


def test_short_titles_of_a_run_meet_in_blocks_without_keys(spark, monkeypatch):
    """Titles of few syllables, up to and beyond a word of bits, and a group of near copies: the loop's outcome, few pairs that are not similar, few comparisons a text."""
    rnd = random.Random(31)
    for name, value in (("MIN_BLOCK", 40), ("FIRST", 2), ("GROWTH", 2), ("title_keys", None)):
        monkeypatch.setattr(similar, name, value)
    base = ["".join(rnd.choice(("tion", "ment", "elle", "que", "les", "en")) for _ in range(rnd.choice((3, 5, 8, 14, 24)))) for _ in range(30)]
    titles = [mutate(rnd.choice(base), rnd, rnd.randrange(4)) + "source" for _ in range(90)] + [f"thesamearticleofthesamedayno{i:03d}" for i in range(80)]
    df = spark.createDataFrame([(i, f"u{i}", t, "") for i, t in enumerate(titles)], "id long, url string, title string, text string")
    rows = [(i, i, rnd.random() < 0.9, False) for i in range(len(titles))]
    ratio = lambda i, j: SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.9 or titles[i] == titles[j]
    edges = [(i, j) for j in range(len(titles)) for i in range(j) if ratio(i, j)]
    same = similar.Duplicates(df)
    got = same.resolve(spark.createDataFrame(rows, "id long, ord long, eligible boolean, in_history boolean")).collect()
    assert ({r["id"] for r in got if r["kept"]}, {r["id"] for r in got if r["is_dup"]}) == greedy(rows, edges)
    assert len({len(t) > similar.WORD for t in titles}) == 2 and same.near[0].tested.count() < 80 * 79 / 4


def test_common_subsequence_bounds_the_ratio():
    rnd = random.Random(32)

    def apart(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return len(a) + len(b) - 2 * row[-1]

    for k in range(60):
        a = "".join(rnd.choice("abcdefgh中é𝒳") for _ in range(rnd.choice((0, 1, 20, 70, 250))))
        b = mutate(a, rnd, rnd.randrange(1 + len(a) // 4)) if a else "x"
        b = b if k % 5 else b[len(b) // 3 :] + b[: len(b) // 3]
        d = apart(a, b)
        assert [similar._within(a, b, m) for m in (d - 1, d, d + 1) if m >= 0] == [m >= d for m in (d - 1, d, d + 1) if m >= 0]


def test_jaccard_of_large_sets_meets_in_blocks_and_is_tested_in_rounds(spark, monkeypatch):
    """Long texts of few syllables, all about the bound, and a group of near copies: the result of all pairs; runs are not shuffled, members of the group are tested a few times each."""
    monkeypatch.setattr(similar, "MIN_BLOCK", 40)
    monkeypatch.setattr(similar, "FIRST", 2)
    rnd = random.Random(23)
    base = ["".join(rnd.choice(("tion", "ment", "elle", "que", "les", "en", "a", "o", "ss")) for _ in range(rnd.choice((90, 200, 400)))) for _ in range(30)]
    hist = [(i, mutate(s, rnd, rnd.randrange(25))) for i, s in enumerate(base)] + [(100 + i, mutate(base[0], rnd, 2)) for i in range(60)]
    new = [(i, mutate(s, rnd, rnd.randrange(25))) for i, s in enumerate(base)] + [(100 + i, mutate(base[0], rnd, 2)) for i in range(60)]
    runs = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    sets = [(i, runs(h)) for i, h in hist]
    want = {}
    for i, t in new:
        t = runs(t)
        for j, h in sets:
            if len(t & h) / len(t | h) >= 0.8:
                want.setdefault(i, (j, round(len(t & h) / len(t | h), 9)))
    made, true = [], similar._jaccard_tested
    monkeypatch.setattr(similar, "_jaccard_tested", lambda pairs, *more: (made.append(pairs.count()), true(pairs, *more))[1])
    got = {r["new_id"]: (r["matched_id"], round(r["ratio"], 9)) for r in similar.similar_bodies(*(spark.createDataFrame(x, "id long, text string") for x in (new, hist)), 0.8, mode="jaccard").collect()}
    assert got == want and 60 < len(want) < 90
    assert sum(made) < 61 * 61 / 4 and not hasattr(similar, "_prefix_pairs")


def test_block_ratio_is_the_library_s():
    rnd = random.Random(21)
    for n in (1, 30, 190, 200, 210, 500, 900):
        for letters in ("ab", "etaoinshrdluxqzk", "etaoinshrdlu" * 9 + "xqzk", "".join(map(chr, range(0x4E00, 0x4E00 + 900)))):
            for _ in range(6):
                a = "".join(rnd.choice(letters) for _ in range(n))
                b = mutate(a, rnd, rnd.randrange(n // 5 + 1)) or "x"
                true = SequenceMatcher(None, a, b).ratio()
                assert similar.block_ratio(a, b, 0.0) == true
                assert similar.block_ratio(a, b, 0.9) == true if true >= 0.9 else similar.block_ratio(a, b, 0.9) < 0.9


def test_bodies_that_share_a_passage_are_not_compared_and_no_similar_pair_is_lost(spark):
    """What meets under crowded keys: texts with one passage in common are told from similar ones, up to the ratio's bound, by the runs they show."""
    rnd = random.Random(22)
    for write in scripts(rnd):
        passage, texts, near = write(60), [], set()
        for size in (70, 300, 1200, 2800):
            for kind in range(4):
                base = passage + write(size)
                n = int(len(base) * 0.095)
                spots = set(rnd.sample(range(len(base)), n))
                edit = {0: lambda c, w=write: w(1), 1: lambda c, w=write: c + w(1), 2: lambda c: "", 3: lambda c, w=write: rnd.choice(["", c + w(1)])}[kind]
                near.add((len(texts), len(texts) + 1))
                texts += [base, "".join(edit(c) if i in spots else c for i, c in enumerate(base))]
        texts += [passage + write(2500) for _ in range(20)]
        rows = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(texts)], "h long, s string, n int")
        every = rows.select(F.col("h").alias("ha")).crossJoin(rows.select(F.col("h").alias("hb"))).filter("ha < hb")
        got = {(r["ha"], r["hb"]) for r in similar.likely_pairs(every, similar.shown_runs(rows)).collect()}
        assert near <= got
        if ord(passage[0]) >= 0x4E00:  # the other writers have a few hundred words, which long texts share
            assert not any(len(texts[a]) > 1000 < len(texts[b]) for a, b in got - near)


def test_what_blocks_can_cover_loses_no_ratio_and_leaves_few_near_copies(spark):
    """Near copies of common letters fall below the ratio, as blocks begin at rare characters only: these are told without the ratio, those that reach it are kept."""
    rnd = random.Random(31)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    for rare in (0.01, 0.05, 0.3):
        base = "".join(rnd.choice(words) if rnd.random() > rare else rnd.choice("xqzkjv") for _ in range(300))
        for edits in (2, 10, 20, 40, 80):
            for _ in range(6):
                a, b = mutate(base, rnd, edits), mutate(base, rnd, edits)
                a, b = rnd.choice([(a, b), (a[60:], b), (a, b[60:]), (a, a[:500] + b[500:])])
                for threshold in (0.5, 0.8, 0.9):
                    assert similar._covered(a, b, threshold) or SequenceMatcher(None, a, b).ratio() < threshold
    near = [mutate("".join(rnd.choice(words) for _ in range(300)) + "q", rnd, 80) for _ in range(1)]
    near += [mutate(near[0], rnd, 80) for _ in range(40)]
    assert not any(similar._covered(a, b, 0.9) for a in near for b in near if a != b) and similar._within(near[0], near[1], len(near[0]) // 5)


def test_pairs_of_crowded_keys_are_bounded_where_they_meet(spark, monkeypatch):
    """Copies about the ratio and texts with a passage in common, in three scripts and many sizes, under one key and in several tasks: no pair that reaches the ratio is lost, a passage alone does not pass."""
    monkeypatch.setattr(similar, "MAX_ASKING", 7)
    rnd = random.Random(32)
    for write in scripts(rnd):
        passage, texts = write(60), ["", "ab", "abc"]
        for size in (3, 20, 70, 198, 210, 300, 1200, 2800):
            base = passage + write(size)
            for rate in (0.01, 0.03, 0.06, 0.2):
                texts.append("".join(rnd.choice(["", c + write(1), write(1)]) if rnd.random() < rate else c for c in base))
        single = len(texts)
        texts += [passage + "".join(rnd.sample(write(900), 900)) for _ in range(12)]
        rows = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(texts)], "h long, s string, n int")
        sides = [rows.select(F.col("h").alias(x), F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("key")) for x in ("ha", "hb")]
        met = similar.bounded_pairs(*sides, similar.text_bounds(rows), 0.9).collect()
        got = {(r["ha"], r["hb"]) for r in met}
        true = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and a and b and SequenceMatcher(None, a, b).ratio() >= 0.9}
        assert true <= got and len(got) == len(met) and len(true) > 10
        if ord(passage[0]) < 0x4E00:  # Chinese has a character in each place that blocks can begin with
            assert not any(i >= single and j >= single for i, j in got)


def test_bodies_are_compared_whole(spark):
    """Texts that begin alike and go on differently are not similar, by either measure, and near copies of many lengths are found, as by brute force; an article's duplicates are told by its beginning."""
    rnd = random.Random(33)
    start, hist, new = chinese(rnd, 3_000), [], []
    for n in (2_400, 2_900, 3_100, 5_900, 6_100, 7_400, 12_500):
        base = chinese(rnd, n)
        hist.append((len(hist), base))
        made = [mutate(base, rnd, n // k) for k in (30, 50, 70)] + [base[: int(0.83 * n)], base[: int(0.79 * n)]]
        new += [(100 + len(new) + i, t) for i, t in enumerate(made)]
    hist.append((50, start + chinese(rnd, 4_000)))
    new.append((999, start + chinese(rnd, 4_000)))
    frames = [spark.createDataFrame(x, "id long, text string") for x in (new, hist)]
    runs = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j) for i, t in new for j, h in hist if share(runs(t), runs(h)) >= 0.8}
    got = similar.similar_bodies(*frames, 0.8, mode="jaccard").collect()
    assert {(r["new_id"], r["matched_id"]) for r in got} == want and len(got) == len(want) and 10 < len(want) < len(new) - 5
    want = {(i, j) for i, t in new for j, h in hist if 0.8 < len(t) / len(h) < 1.25 and SequenceMatcher(None, h, t).ratio() >= 0.9}
    assert {(r["new_id"], r["matched_id"]) for r in similar.similar_bodies(*frames).collect()} == want and (999, 50) not in want and len(want) > 5
    known = spark.createDataFrame([(i, "h", f"h{i}", t) for i, t in hist], "id long, source_url string, title string, extracted_text string")
    asked = spark.createDataFrame([(999, "n", "n", new[-1][1])], "id long, url string, title string, text string")
    assert similar.exists_duplicate(asked, known).first()["matched_id"] == 50


def test_blocks_multiply_like_lengths_only(monkeypatch):
    """A block's strips meet the lengths that can be similar to theirs, middle ones by half the counters; the pairs are those of brute force."""
    monkeypatch.setattr(similar, "STRIP", 16)
    rnd, made, true = random.Random(34), [], similar.np.hstack
    monkeypatch.setattr(similar.np, "hstack", lambda parts: (made.append(parts[0].shape), true(parts))[1])
    sets = [sorted(rnd.sample(range(3000), n)) for n in (3, 6, 10, 14, 20, 30, 47, 60, 90, 140) for _ in range(16)]
    sets += [sorted(set(x[: len(x) - 1]) | {3001}) for x in sets]
    table = similar.pa.table({"h": list(range(len(sets))), "n": [float(len(x)) for x in sets], "side": similar.pa.array([3] * len(sets), similar.pa.int32()), "g": similar.pa.array([[t % similar.COUNTERS for t in x] for x in sets], similar.pa.list_(similar.pa.int32()))})
    got = {tuple(r.values()) for r in similar._products(4 / 9, 0.0, 0.8, False)(table, table).to_pylist()}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and share(set(a), set(b)) >= 0.8}
    assert want <= got and len(got) < 2 * len(want) and len(want) >= 200
    assert sum(made[k][0] * made[k + 1][0] for k in range(0, len(made), 2)) < len(sets) ** 2 / 3 and {k[1] for k in made} == {similar.COUNTERS, similar.COUNTERS // 2}
