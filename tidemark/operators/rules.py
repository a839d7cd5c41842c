"""Caller-supplied rules over host and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.patterns import Patterns, evaluate
from ..functions.urls import url_host
from ..runtime import in_blocks, materialize

#: Terms of rules that are looked for in one walk over a text.
MAX_TERMS = 100_000
KINDS = ("host", "any", "pair")


def rule_filter(df: DataFrame, rules: DataFrame, title: str = "title", text: str = "text", url: str = "url") -> DataFrame:
    """``df`` with ``flagged`` and the sorted ``rule_ids`` that hold.

    ``rules`` is ``(rule_id, kind, group, term)``: ``host`` holds if the host contains any of its terms, ``any`` if the lower-cased
    title and text contain any, ``pair`` if they contain one of group ``a`` and one of group ``b``. No rules ship with this library.

    All terms are found in one walk over a text, in blocks of rules of about ``MAX_TERMS`` terms. Null terms are in no text, empty ones in every text.
    """
    spark = df.sparkSession
    known = materialize(rules.select("rule_id", "kind", "group", "term").distinct(), "rules")
    odd = known.filter(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).limit(1).collect()
    if odd:
        raise ValueError(f"unknown kind of rule: {odd[0]['kind']}")
    low = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))
    # A rule's terms lie in one block; a block holds MAX_TERMS rows or so.
    held = [_holding(spark, block.collect()) for block in in_blocks(known, "rule_id", MAX_TERMS)]
    ids = [evaluate(patterns, [url_host(url), F.col("__body")], rule, "array<string>") for patterns, rule in held]
    out = df.withColumn("__body", low).withColumn("rule_ids", F.array_sort(F.array_distinct(F.flatten(F.array(*ids)))))
    return out.withColumn("flagged", F.size("rule_ids") > 0).drop("__body")


def _holding(spark, rows: list[Row]) -> tuple[list[Patterns], object]:
    """The terms for hosts and for texts, and the function from the places found in each to the rules that hold."""
    hosts = [(r["rule_id"], r["term"]) for r in rows if r["kind"] == "host" and r["term"] is not None]
    texts = [(r["rule_id"], r["kind"], r["group"], r["term"].lower()) for r in rows if r["kind"] != "host" and r["term"] is not None]

    def rule(on_host: set[int], in_text: set[int]) -> list[str]:
        out = {hosts[i][0] for i in on_host}
        sides: dict[str, set[str]] = {}
        for i in in_text:
            rule_id, kind, group, _ = texts[i]
            if kind == "any":
                out.add(rule_id)
            else:
                sides.setdefault(rule_id, set()).add(group)
        return sorted(out | {r for r, groups in sides.items() if groups >= {"a", "b"}})

    return [Patterns(spark, [t for _, t in hosts]), Patterns(spark, [t for *_, t in texts])], rule
