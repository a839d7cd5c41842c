import corpus_pipeline as P
from tidemark.llm import tokens

from .util import check_clashing, clashing, edited, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages(spark, tmp_path):
    clean = [(i, words(i, 80 + i % 50), "en", f"s{i % 3}", 1) for i in range(90)]
    toxic = [(200 + i, " ".join(w + (" scumidiot" if k % 9 == 0 else "") for k, w in enumerate(words(300 + i, 60).split())), "en", "s0", 1) for i in range(40)]
    near = [(400 + i, edited(clean[i][1], i, 0.004), "en", "s1", 1) for i in range(5)]
    item = words(999, 30)
    leaked = [(500, words(501, 40) + " " + " ".join(item.split()[3:20]), "en", "s2", 1)]
    odd = [(600, None, None, None, None), (601, "", "en", None, 0)]
    write(spark, str(tmp_path), clean + toxic + near + leaked + odd, [(d[0], 1, 0) for d in clean] + [(d[0], 1, 1) for d in toxic], [(1, item), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "source_mixing", "token_ids"]
    one = P.materialize(P.quality_stage(spark, docs, str(tmp_path)), "t1")
    assert one.columns == docs.columns and ids(one) == [d[0] for d in clean + near + leaked + odd]
    two = P.materialize(P.near_dedup_stage(spark, one, str(tmp_path)), "t2")
    assert two.columns == docs.columns and ids(two) == [d[0] for d in clean + leaked] + [600, 601]
    three = P.materialize(P.decontamination_stage(spark, two, str(tmp_path)), "t3")
    assert three.columns == docs.columns and ids(three) == [d[0] for d in clean] + [600, 601]
    four = P.materialize(P.mixing_stage(spark, three, str(tmp_path)), "t4")
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    five = P.token_stage(spark, four, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in five) == ids(four)
    text = {r["doc_id"]: r["text"] for r in four.collect()}
    assert all(r["n_tokens"] == len(tokens.encode([text[r["doc_id"]]], tokens.default_tokenizer())[0]) // 2 + 1 for r in five)


def test_empty_tables_repeats_and_clashing_columns(spark, tmp_path):
    odd = [(1, "a b c d e f", "en", "s", 1), (1, "other words here", "en", "s", 1), (2, "a b c d e f", "en", None, 1), (None, "x y", None, "s", None), (3, None, "en", "s", 0), (3, None, "en", "s", 0)]
    write(spark, f"{tmp_path}/odd", odd, [], [])
    src = clashing(spark.read.parquet(f"{tmp_path}/odd/documents.parquet"))
    docs = src
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, f"{tmp_path}/odd"), "odd")
        check_clashing(docs, src)
    two = P.near_dedup_stage(spark, src, f"{tmp_path}/odd").collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in two) == sorted(map(str, [(1, "a b c d e f"), (1, "other words here"), (None, "x y"), (3, None)]))
    assert P.token_stage(spark, docs, f"{tmp_path}/odd").count() == docs.count()
    write(spark, f"{tmp_path}/none", [], [], [])
    assert P.run(spark, f"{tmp_path}/none").count() == 0
