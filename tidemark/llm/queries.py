"""One query per operator, on its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html_main, lexical, line_dedup, mixing, neardup, quality, repeats, rule_ledger, tokens, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT item_id, array_to_string(ws[i:i + 9], ' ') AS s, least(10, len(ws)) AS n
      FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT doc_id, i, n, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), ' ') AS s10 FROM u CROSS JOIN (SELECT 10 AS n)),
h AS (SELECT DISTINCT l.doc_id, l.i, w.n, w.item_id FROM l JOIN w ON w.n = 10 AND w.s = l.s10
      UNION SELECT DISTINCT l.doc_id, l.i, w.n, w.item_id FROM l JOIN w ON w.n < 10 AND starts_with(l.s10 || ' ', w.s || ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "root")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(turns.unionByName(planted))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(text, '~', '~0'), '<|', '~1') AS et,
         replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2') AS er,
         lag(role) OVER w AS pr, row_number() OVER w AS rn
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(et) + CASE WHEN rn > 1 AND pr = role THEN length('<|im_next|>')
                             ELSE length('<|im_start|>') + length(er) + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grade_ratings(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).drop("row")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_to_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), weights).drop("bad_probability")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of op7 that are no model: host, path, and the rule that fits with its verdict."""
    base = url_filter.split_url(table(spark, sf_dir, "pages").select("page_id", "url"))
    return base.withColumn("r", url_filter.best_rule(url_filter.RULES)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


URL_RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict AS rule_verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rule_ledger.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT r, i, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x || ' ' || lead(word, 4) OVER x AS s
      FROM u WINDOW x AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM p WHERE s IS NOT NULL),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
             + CASE WHEN n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * word_chars < 22 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_upper > 50 * n_letters THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) > 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy rejects, rejects alone, and what would be kept without it."""
    ledger = rule_ledger.ledger(rule_ledger.measure(table(spark, sf_dir, "documents")))
    return rule_ledger.ablations(ledger, rule_ledger.STRICT)


ABLATIONS_SQL = (
    "WITH f AS ("
    + OP8_SQL.strip()
    + """),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeat_words', 2), ('symbols', 4), ('dup_lines', 8), ('long_words', 16), ('short_words', 32), ('upper_case', 64))
SELECT rule, count(*) FILTER (fail_bits & bit > 0) AS n_fail, count(*) FILTER (fail_bits = bit) AS n_alone, count(*) FILTER (fail_bits & (127 - bit) = 0) AS n_kept_without
FROM f CROSS JOIN r GROUP BY rule
"""
)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of op9 that are not random: each source's size and target."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size"))
    return mixing.source_targets(sizes).select("source", "source_size", F.round("target", 6).alias("target"))


#: A source stays at its cap once it is above, so after as many rounds as there are sources nothing changes; each round shares what is left by weight.
MIX_TARGETS_SQL = r"""
WITH RECURSIVE s AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM documents GROUP BY source
), w AS (
  SELECT source, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM s
), t AS (
  SELECT 0 AS k, source, n, weight, false AS cut, NULL::DOUBLE AS target FROM w
  UNION ALL
  SELECT k + 1, source, n, weight, cut OR share >= 3 * n, CASE WHEN cut OR share >= 3 * n THEN 3.0 * n ELSE share END
  FROM (SELECT *, weight * (sum(n) OVER () - coalesce(sum(3.0 * n) FILTER (cut) OVER (), 0)) / nullif(sum(weight) FILTER (NOT cut) OVER (), 0) AS share FROM t)
  WHERE k < (SELECT count(*) FROM s) + 1
)
SELECT source, n AS source_size, round(target, 6) AS target FROM t WHERE k = (SELECT max(k) FROM t)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h.top IS NOT NULL AND doc_id <> h.top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h.top IS NULL OR doc_id = h.top), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
"""



def op11_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS words FROM d WHERE len(ws) > 0),
u AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d WHERE len(ws) > 0),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u GROUP BY r, doc_id, n, term),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM c WHERE term IN (SELECT term FROM b) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM f CROSS JOIN g),
s AS (SELECT b.item_id, c.r, c.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
      FROM b JOIN c USING (term) JOIN w USING (term) CROSS JOIN g GROUP BY b.item_id, c.r, c.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS lang_n FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM u GROUP BY lang, source, term),
v AS (SELECT lang, count(*)::BIGINT AS kept, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
a AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, v.kept, v.lang_total
      FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM a GROUP BY lang, source),
p AS (SELECT a.lang, a.source, a.term, a.n, 1 + (1000000000 * (a.n + 5)) // (t.total + 5 * a.kept) AS p, 1 + (1000000000 * (a.lang_n + 5)) // (a.lang_total + 5 * a.kept) AS q
      FROM a JOIN t ON t.lang = a.lang AND t.source = a.source),
x AS (SELECT s.lang, s.source, o.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM s JOIN s o ON o.lang = s.lang AND o.source <> s.source
      LEFT JOIN (SELECT p.lang, p.source, o.source AS item, sum(abs(p.p - o.p)) AS value FROM p JOIN p o ON o.lang = p.lang AND o.term = p.term AND o.source <> p.source GROUP BY 1, 2, 3) f
      ON f.lang = s.lang AND f.source = s.source AND f.item = o.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM x
UNION ALL
SELECT lang, source, 'term', term, value, rank::INT FROM (
  SELECT lang, source, term, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q) WHERE rank <= 50
"""

QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_html_main_text": op4_html_main_text,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_ids": op6_token_ids,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_dedup": op10_line_dedup,
    "op11_repeat_dedup": op11_repeat_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_divergence_audit": op13_divergence_audit,
    "url_rules": url_rules,
    "quality_ablations": quality_ablations,
    "mix_targets": mix_targets,
}
ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_chat_format": OP3_SQL, "op8_quality_rules": OP8_SQL, "op10_line_dedup": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_divergence_audit": OP13_SQL, "url_rules": URL_RULES_SQL, "quality_ablations": ABLATIONS_SQL, "mix_targets": MIX_TARGETS_SQL}
