"""What the articles of the history are found by, kept beside the history: a batch is compared with candidates, not with all its texts.

Each article leaves a hash of its URL, title and body, and the keys that these are found by. Keys grow as the history does: a key that holds enough texts takes no more, later
texts go under longer ones (titles: one run more, bodies: a longer run). What is stored never moves, so a batch only adds its part. A search looks under all keys, short and long, that
a text could have been stored by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import norm_url
from ..runtime import materialize
from . import similar as S

#: Batch of a compacted part, and of articles that have none.
BASE = -1
#: Partitions of the history that are named in a filter; if candidates lie in more, all are read.
MAX_PARTS = 1000

_SCHEMAS = {
    "urls": "h long, id string, of long, batch_id long",
    "titles": "h long, id string, of long, batch_id long",
    "bodies": "h long, id string, of long, batch_id long",
    "title_keys": "key long, h long, n int, spots int, crowded boolean, batch_id long",
    "body_keys": "key long, h long, n int, spots int, crowded boolean, batch_id long",
    "title_marks": "key long, batch_id long",
    "body_marks": "key long, level int, batch_id long",
    "title_runs": "token long, freq long",
    "ready": "n long",
}


class HistoryIndex:
    """The index at ``path``. Its parts are partitioned by batch: writing a batch again replaces its part. That is for the last batch, when it is tried
    again; after another one changes, :meth:`compact`.

    A title or body that several articles have is found by the keys of the first that came. Ids of articles are strings.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, path.rstrip("/")

    # --- storage

    def _fs(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _generations(self) -> list[int]:
        fs, at = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x[4:]) for x in names if x.startswith("gen-"))

    def generation(self) -> int | None:
        """The last complete generation; a compaction that was cut short is none."""
        whole = [g for g in self._generations() if self._exists(f"{self.root}/gen-{g}/ready/_SUCCESS")]
        return whole[-1] if whole else None

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _read(self, gen: int | None, name: str, without: int | None = None) -> DataFrame:
        path = f"{self.root}/gen-{gen}/{name}"
        if gen is None or not self._exists(path):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        df = self.spark.read.schema(_SCHEMAS[name]).parquet(path)
        return df if without is None else df.filter(F.col("batch_id") != without)

    def _write(self, gen: int, name: str, df: DataFrame, batch_id: int) -> None:
        df = df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.root}/gen-{gen}/{name}")

    # --- keys

    def _under(self, stored: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of ``stored`` under ``keys`` (key), which are read from files: so Spark knows their size and sends a batch's keys to the index, as long as they are small."""
        return stored.join(keys.select("key").distinct(), "key", "left_semi")

    def _lists(self, gen: int | None, texts: DataFrame) -> DataFrame:
        """Runs of titles in the order of this generation, which is fixed until the next: those that it did not know come first."""
        tokens = materialize(S._trigrams(texts), "index-runs")
        mine = tokens.select("token").distinct()
        known = self._read(gen, "title_runs").join(mine, "token", "left_semi")
        return S.title_lists(tokens, mine.join(known, "token", "left").select("token", F.coalesce("freq", F.lit(0)).alias("freq")))

    def _counts(self, stored: DataFrame, keyed: DataFrame) -> DataFrame:
        """``(key, many)``: texts under the keys of ``keyed``, those stored and the new ones."""
        new = keyed.groupBy("key").agg(F.count("*").alias("new"))
        old = self._under(stored, keyed).groupBy("key").agg(F.count("*").alias("old"))
        return materialize(new.join(old, "key", "left").select("key", (F.col("new") + F.coalesce("old", F.lit(0))).alias("many")), "index-counts")

    def _title_entries(self, gen: int, texts: DataFrame, without: int) -> tuple[DataFrame, DataFrame]:
        """Keys that new titles are stored by ``(key, h, n)``, and those that got longer ones ``(key)``."""
        if not texts.limit(1).count():
            return self._read(None, "title_keys").drop("batch_id"), self._read(None, "title_marks").drop("batch_id")
        stored = self._read(gen, "title_keys", without)
        short, level = S.title_roots(self._lists(gen, texts))
        done, marks = [short], []
        for depth in range(1, S.DEEPEST):
            level = level if depth == 1 else materialize(level, "index-level")
            crowd = self._counts(stored, level).filter(F.col("many") > S.TITLE_LIMIT)
            longer = materialize(S.title_refined(level.join(crowd, "key"), depth), "index-longer")
            later = self._counts(stored, longer).select("key", F.col("many").cast("double").alias("k"))
            cost = longer.select("from", "many", "key").distinct().join(later, "key").groupBy("from", "many").agg(F.sum(F.col("k") * F.col("k")).alias("cost"))
            gain = materialize(cost.filter("2 * cost < many * many").select(F.col("from").alias("key")), "index-gains")
            done.append(level.join(gain, "key", "left_anti").select("h", "n", "key"))
            level = longer.join(gain.withColumnRenamed("key", "from"), "from", "left_semi").select("h", "n", "ws", "p", "at", "key")
            if not gain.limit(1).count():
                break
            marks.append(gain)
        else:
            done.append(level.select("h", "n", "key"))
        marked = reduce(DataFrame.unionByName, marks).distinct() if marks else self.spark.createDataFrame([], "key long")
        return reduce(DataFrame.unionByName, done).distinct().select("key", "h", "n", F.lit(1).alias("spots"), F.lit(False).alias("crowded")), marked

    def _title_probes(self, gen: int | None, texts: DataFrame, without: int | None) -> DataFrame:
        short, level = S.title_roots(self._lists(gen, texts))
        marks, probes = self._read(gen, "title_marks", without), [short]
        for depth in range(1, S.DEEPEST):
            level = level if depth == 1 else materialize(level, "index-level")
            probes.append(level.select("h", "n", "key"))
            more = materialize(self._under(marks.select("key"), level).distinct(), "index-marked")
            if not more.limit(1).count():
                break
            level = S.title_refined(level.join(more, "key"), depth).select("h", "n", "ws", "p", "at", "key")
        else:
            probes.append(level.select("h", "n", "key"))
        return reduce(DataFrame.unionByName, probes).distinct().withColumn("spots", F.lit(1)).withColumn("alike", F.lit(True))

    @staticmethod
    def _body_spots(texts: DataFrame) -> DataFrame:
        spots = materialize(texts.select("h", "n", "s").mapInArrow(S._spots, S.SPOT_ROWS), "index-spots")
        return spots.select("h", "n", "spots", F.array(*[f"g{i}" for i in range(len(S.LENGTHS))]).alias("g"))

    def _body_entries(self, gen: int, texts: DataFrame, without: int) -> tuple[DataFrame, DataFrame]:
        """Keys that new bodies are stored by: at each place the shortest run that not too many texts have, and the least of those that are crowded at their
        longest, as in :func:`similar.body_keys`; and the crowded runs of the middle and the longest length ``(key, level)``, by which a search tells what is like many."""
        if not texts.limit(1).count():
            return self._read(None, "body_keys").drop("batch_id"), self._read(None, "body_marks").drop("batch_id")
        stored = self._read(gen, "body_keys", without)
        open_, done, marks, often = self._body_spots(texts), [], [], None
        for level in range(len(S.LENGTHS)):
            keyed = open_.withColumn("key", F.get("g", F.lit(level)))
            hot = self._counts(stored, keyed.select("h", "key").distinct()).filter(F.col("many") > S.LIMIT).select("key")
            done.append(keyed.join(hot, "key", "left_anti").select("key", "h", "n", "spots"))
            open_ = materialize(keyed.join(hot, "key", "left_semi"), "index-open")
            if level == S.MIDDLE:
                often = open_.groupBy("h").agg(F.count("*").alias("middle"))
            if level in (S.MIDDLE, len(S.LENGTHS) - 1):
                marks.append(hot.withColumn("level", F.lit(level)))
        alike = S.alike_texts(open_.select("h", "n", "spots", "key").distinct(), often)
        crowded = alike.select(F.explode("keys").alias("key"), "h", "n", "spots", F.lit(True).alias("crowded"))
        return reduce(DataFrame.unionByName, done).distinct().withColumn("crowded", F.lit(False)).unionByName(crowded), reduce(DataFrame.unionByName, marks)

    def _body_probes(self, gen: int | None, texts: DataFrame, without: int | None) -> DataFrame:
        """``(h, n, spots, key, alike)``: all runs of a text; ``alike`` if as a whole it is like many of the history, as those under crowded keys are."""
        spots, last = self._body_spots(texts), len(S.LENGTHS) - 1
        places = spots.select("h", "n", "spots", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.get("g", F.lit(x)).alias("key")) for x in (S.MIDDLE, last)])).alias("x"))
        places = materialize(places.select("h", "n", "spots", "x.*"), "index-places")
        marks = materialize(self._under(self._read(gen, "body_marks", without).drop("batch_id"), places).distinct(), "index-body-marks")
        marked = materialize(places.join(marks, ["key", "level"], "left_semi"), "index-marked")
        often = marked.filter(F.col("level") == S.MIDDLE).groupBy("h").agg(F.count("*").alias("middle"))
        alike = S.alike_texts(marked.filter(F.col("level") == last).select("h", "n", "spots", "key").distinct(), often)
        probes = spots.select("h", "n", "spots", F.explode("g").alias("key")).distinct()
        return probes.join(alike.select("h", F.lit(True).alias("alike")), "h", "left").withColumn("alike", F.coalesce("alike", F.lit(False)))

    # --- what changes the index

    @staticmethod
    def _keyed(rows: DataFrame) -> DataFrame:
        of = F.coalesce(F.col("batch_id"), F.lit(BASE)).cast("long").alias("of")
        return materialize(rows.select("id", of, norm_url("source_url").alias("u"), S.title_text("title").alias("t"), S.body_text("extracted_text").alias("b")), "index-rows")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add history rows ``(id, source_url, title, extracted_text, batch_id)`` as the part ``batch_id``, or replace that part. The part of URLs is written
        last: a batch that has none there is not in the index."""
        gen = self.generation()
        if gen is None:
            raise ValueError("no index: compact() makes one")
        self._add(gen, self._keyed(rows), batch_id)

    def _add(self, gen: int, keyed: DataFrame, batch_id: int) -> None:
        new = lambda name, kind: S._distinct_texts(keyed.select(F.col(kind).alias("s"))).join(self._read(gen, name, batch_id).select("h"), "h", "left_anti")
        keys, marks = self._title_entries(gen, materialize(new("titles", "t"), "index-new"), batch_id)
        keys, marks = materialize(keys, "index-entries"), materialize(marks, "index-marks")
        bodies, hot = self._body_entries(gen, materialize(new("bodies", "b"), "index-new"), batch_id)
        bodies, hot = materialize(bodies, "index-entries"), materialize(hot, "index-body-marks")
        for name, part in (("title_keys", keys), ("title_marks", marks), ("body_keys", bodies), ("body_marks", hot)):
            self._write(gen, name, part, batch_id)
        for name, kind in (("titles", "t"), ("bodies", "b"), ("urls", "u")):
            some = F.col(kind).isNotNull() if kind == "u" else F.length(kind) > 0
            self._write(gen, name, keyed.filter(some).select(F.xxhash64(kind).alias("h"), F.col("id").cast("string").alias("id"), "of"), batch_id)

    def compact(self, history: DataFrame) -> None:
        """Make the index anew from the whole history, as one part and with its runs in the order of their frequencies; the generation before goes once this one is complete."""
        before = self._generations()
        gen = before[-1] + 1 if before else 0
        keyed = self._keyed(history)
        runs = S._trigrams(S._distinct_texts(keyed.select(F.col("t").alias("s"))))
        runs.groupBy("token").agg(F.count("*").alias("freq")).write.parquet(f"{self.root}/gen-{gen}/title_runs")
        self._add(gen, keyed, BASE)
        self.spark.range(1).toDF("n").write.parquet(f"{self.root}/gen-{gen}/ready")
        for old in before:
            fs, at = self._fs(f"{self.root}/gen-{old}")
            fs.delete(at, True)

    def sync(self, history: DataFrame) -> None:
        """Add the batches of the history that the index lacks; without an index make one."""
        gen = self.generation()
        if gen is None:
            return self.compact(history)
        of = F.coalesce(F.col("batch_id"), F.lit(BASE)).cast("long").alias("of")
        known = self._read(gen, "urls").select("of").distinct()
        for (batch,) in history.filter("source_url IS NOT NULL").select(of).distinct().join(known, "of", "left_anti").orderBy("of").collect():
            if batch == BASE:
                return self.compact(history)
            self.add(history.filter(F.col("batch_id") == batch), batch)
        return None

    # --- search

    def _first(self, gen: int | None, name: str, asked: DataFrame, without: int | None) -> DataFrame:
        """``(h, hist_id, of)``: the smallest id that has the text, for texts ``(h)``."""
        asked = asked.select("h").distinct()
        one = self._read(gen, name, without).join(asked, "h", "left_semi").groupBy("h").agg(F.min(F.struct("id", "of")).alias("m"))
        return one.select("h", F.col("m.id").alias("hist_id"), F.col("m.of").alias("of"))

    def _strings(self, first: DataFrame, history: DataFrame, text: Column) -> DataFrame:
        """``(h, s, n)`` of the articles ``first`` (hist_id, of), read from their partitions of the history."""
        parts = [r["of"] for r in first.select("of").distinct().limit(MAX_PARTS + 1).collect()]
        if len(parts) <= MAX_PARTS:
            named = F.col("batch_id").isin([p for p in parts if p != BASE])
            history = history.filter(named | F.col("batch_id").isNull() | (F.col("batch_id") == BASE) if BASE in parts else named)
        ids = first.select(F.col("hist_id").alias("id")).distinct()
        return history.join(ids, "id", "left_semi").select(text.alias("s")).filter("length(s) > 0").select(F.xxhash64("s").alias("h"), "s", F.length("s").alias("n"))

    def _similar(self, gen: int | None, names: tuple[str, str], asked: DataFrame, history: DataFrame, text: Column, without: int | None) -> DataFrame:
        """``(new_id, matched_id)`` for texts ``(new_id, s)``: the smallest id of the history that is similar."""
        asked = asked.filter("length(s) > 0").withColumn("hb", F.xxhash64("s"))
        texts = S._distinct_texts(asked.select("s"))
        if not texts.limit(1).count():
            return asked.select("new_id", F.lit(None).cast("string").alias("matched_id"))
        probes = self._title_probes(gen, texts, without) if names[0] == "titles" else self._body_probes(gen, texts, without)
        probes = materialize(probes, "index-probes")
        lists = materialize(self._under(self._read(gen, names[1], without).drop("batch_id"), probes), "index-lists")
        many = lists.groupBy("key").agg((F.count("*") > S.TITLE_CROWD).alias("many")).filter("many")
        lists = lists.join(many, "key", "left").withColumn("crowded", F.col("crowded") | F.coalesce("many", F.lit(False))).drop("many")
        first = materialize(self._first(gen, names[0], lists.select("h"), without), "index-first")
        of_pairs = first.select(F.col("h").alias("ha"), "hist_id", "of")

        def test(pairs: DataFrame) -> DataFrame:
            pairs = materialize(pairs.select("ha", "hb").filter("ha != hb").join(of_pairs, "ha"), "index-pairs")
            both = texts.unionByName(self._strings(pairs, history, text)).dropDuplicates(["h"])
            return S._tested(pairs, materialize(both, "index-texts"), 0.9).select("ha", "hb", "hist_id", "ratio")

        equal = self._first(gen, names[0], texts, without).select(F.col("h").alias("hb"), F.col("hist_id").alias("matched_id"), F.lit(1.0).alias("ratio"))
        some = test(S._pairs(lists, probes.withColumn("crowded", F.lit(False)))).select("hb", F.col("hist_id").alias("matched_id"), "ratio")
        known = equal.unionByName(some).groupBy("hb").agg(F.min(F.struct("matched_id", "ratio")).alias("m")).select("hb", "m.matched_id", "m.ratio")
        # Crowded keys, by length as well: met in the order of ids until a text's first match is certain.
        hot = lists.filter("crowded").join(first, "h").select(F.col("h").alias("ha"), "hist_id", "key", S._band(F.col("n")).alias("band"))
        bands = F.explode(F.array(*[S._band(F.col("n")) + i for i in (-1, 0, 1)])).alias("band")
        asking = probes.filter("alike").join(lists.filter("crowded").select("key").distinct(), "key", "left_semi").select(F.col("h").alias("hb"), "key", bands)
        banded = F.xxhash64("key", "band").alias("key")
        asking, hot = materialize(asking.select("hb", banded), "index-asking"), materialize(hot.select("ha", "hist_id", banded), "index-hot")
        # What meets there is bounded first; of the history only texts under crowded keys that are asked for are read.
        hot = hot.join(asking.select("key").distinct(), "key", "left_semi")
        ours = texts.join(asking.select(F.col("hb").alias("h")).distinct(), "h", "left_semi")
        old = self._strings(of_pairs.join(hot.select("ha").distinct(), "ha", "left_semi"), history, text)
        bounds = S.text_bounds(ours.unionByName(old).dropDuplicates(["h"])) if asking.limit(1).count() else None
        meet = lambda shown, open_: S.bounded_pairs(shown, open_, bounds, 0.9)
        best = S.first_matches(asking, hot, test, materialize(known, "index-known"), meet)
        return asked.join(best, "hb").select("new_id", "matched_id")

    def lookup(self, new: DataFrame, history: DataFrame, without: int | None = None) -> DataFrame:
        """As :func:`similar.exists_duplicate`, from the index; of ``history`` only the candidates' texts are used, and the partitions that hold them scanned. Rows of batch ``without`` do not count.

        Titles lose no pair at ratio 0.9; bodies are found as :func:`similar.body_keys` finds them. Null and empty texts match nothing.
        """
        gen = self.generation()
        keyed = materialize(new.select(F.col("id").alias("new_id"), norm_url("url").alias("u"), S.title_text("title").alias("t"), S.body_text("text").alias("b")), "index-new-rows")
        urls = keyed.filter("u IS NOT NULL").select("new_id", F.xxhash64("u").alias("h"))
        urls = urls.join(self._first(gen, "urls", urls, without), "h").select("new_id", F.col("hist_id").alias("matched_id"))
        history = history if without is None else history.filter((F.col("batch_id") != without) | F.col("batch_id").isNull())
        titles = self._similar(gen, ("titles", "title_keys"), keyed.select("new_id", F.col("t").alias("s")), history, S.title_text("title"), without)
        bodies = self._similar(gen, ("bodies", "body_keys"), keyed.select("new_id", F.col("b").alias("s")), history, S.body_text("extracted_text"), without)
        return S.first_reason(new, urls, titles, bodies)
