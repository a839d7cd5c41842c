import re
from collections import defaultdict

from tidemark.llm import rule_ledger as R

from .util import DOC, frame, words

TEXTS = [None, "", " \n\t", "one", "# a#b %|<>&", "a b c d e a b c d e f", "x\nx\n\nx \n y\ny", words(1, 30, 5), ("lorem ipsum dolor sit amet\n" * 300), "É è 😀 " * 10, words(2, 30_000), "abc\x0bdef\x1cghi\u00a0j", "UPPER CASE TEXT " * 5]


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_measurements_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "x y")]
    got = R.judge(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        b = brute(t)
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, (i, t)
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations(spark):
    led = R.ledger(R.measure(frame(spark, [(i, t) for i, t in enumerate(TEXTS)]))).cache()
    bits = [r["fail_bits"] for r in led.collect()]
    names = list(R.RULES)
    for policy in (R.BASE, R.STRICT, R.Policy("one", ("symbols",))):
        assert [r["kept"] for r in R.apply_policy(led, policy).collect()] == [not b & policy.mask() for b in bits]
        for r in R.ablations(led, policy).collect():
            bit = 1 << names.index(r["rule"])
            assert r["n_fail"] == sum(bool(b & bit) for b in bits)
            assert r["n_alone"] == sum(b & policy.mask() == bit for b in bits)
            assert r["n_kept_without"] == sum(not b & (policy.mask() & ~bit) for b in bits)


def test_empty(spark):
    assert R.judge(frame(spark, [], DOC)).count() == 0
