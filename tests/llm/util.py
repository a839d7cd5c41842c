"""Small frames with the cases every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOC = "doc_id long, text string, source string, row long, __row string, n_hit int, copies string"


def frame(spark, rows, schema=DOC):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def words(seed, n, vocabulary=4000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}x" for _ in range(n))


def edited(text, seed, share):
    rnd = random.Random(seed)
    return " ".join(f"e{rnd.randrange(10**9)}" if rnd.random() < share else w for w in text.split(" "))


#: Names that the operators use inside, and names that need quotes.
CLASH = ["__row", "__node", "__copies", "__r_doc_id", "row", "node", "copies", "doc", "mine", "keep", "again", "n_rows", "ROW", "a.b", "x`y", "window_id", "key"]


def clashing(df):
    """``df`` with columns of such names (but for those that differ in case only), each holding its own name and the id."""
    from pyspark.sql import functions as F

    for name in CLASH:
        if name.lower() not in {c.lower() for c in df.columns}:
            df = df.withColumn(name, F.concat_ws(":", F.lit(name), F.col("doc_id").cast("string")))
    return df


def check_clashing(got, src):
    """Same columns, and every clashing column still holds what it held."""
    assert got.columns == src.columns
    for r in got.collect():
        d = dict(zip(got.columns, r, strict=True))
        for name in CLASH:
            if name in d:
                assert d[name] == (name if d["doc_id"] is None else f"{name}:{d['doc_id']}")
