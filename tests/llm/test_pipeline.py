"""The pipeline's stages against plain versions of their decisions."""

import hashlib


import corpus_pipeline as P
from stradale.llm import pieces, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in P.STAGES[:-1]:
        out = P.stored(spark, stage(spark, seen, SF), f"test-{name}")
        assert out.columns == docs.columns and out.count() <= seen.count()
        seen = out
    texts = seen.toPandas()
    raw = docs.toPandas().set_index("doc_id").text
    lib = pieces.opened().library
    got = P.STAGES[-1][1](spark, seen, SF).toPandas().set_index("doc_id")
    for i, t, n in zip(texts.doc_id, texts.text, texts.n_chars):
        assert t == secrets.redact(raw[i], secrets.scan(raw[i])[4]) and n == len(t)
        ids = lib.encode(t)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    whole = P.run(spark, SF).toPandas()
    assert sorted(whole.doc_id) == sorted(texts.doc_id) and set(whole.ids_sha256) == set(got.ids_sha256)


def test_odd_documents(spark):
    rows = [(0, None, "en", "s", 0), (1, "", "en", None, 0), (2, "12 34", None, "s", 5), (3, "the and of it is a document of words", "en", "s", 36), (4, "the and of it is a document of words", "en", "s", 36), (4, "the and of it is a document of words", "en", "s", 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").crossJoin(spark.createDataFrame([("x",)], "score string"))
    seen = docs
    for _, stage in P.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
    assert [r["doc_id"] for r in seen.collect()] == [3]
    empty = docs.where("false")
    for _, stage in P.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0


def test_rows_without_keys_and_repeated_keys(spark):
    a, b = "the and of it is a document of many words " * 3, "quite another text that has nothing to do with it " * 3
    docs = spark.createDataFrame([(1, a), (1, a), (3, a), (None, a), (None, b), (5, b), (7, "x"), (None, None)], "doc_id long, text string")
    got = P.dedup_stage(spark, docs, SF).collect()
    assert sorted(str(r["text"]) for r in got) == sorted(str(t) for t in (a, b, "x", None))
    ids = spark.createDataFrame([(3, a), (2, a), (9, b)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.dedup_stage(spark, ids, SF).collect()) == [2, 9]


def test_without_labels_no_language_is_rejected(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert P.language_stage(spark, docs, SF).count() == 2


def test_pipeline_has_the_dealt_stages():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"] and P.ORACLE_SQL is None
