"""Corpus pipeline: language, near-duplicates, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it as written to
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stradale.llm import decontam, dedup, language, pieces, secrets
from stradale.llm.common import kept, rewrite_texts, ship, stored, table

#: A text that its best language codes in more bits a byte than raw bytes take is of no known language.
MAX_BITS = 8.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: not `und`, and coded in fewer bits than raw bytes.

    Without any labelled text no language is known, so nothing can be rejected and all documents stay.
    """
    ship(spark)
    model = language.fit(docs)
    if not model.langs:
        return docs
    sent = spark.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predict
        return lambda texts: [k != "und" and bits <= MAX_BITS for k, _, bits in predict(texts)]

    return rewrite_texts(docs, "text", make)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Where doc_ids are null or repeat, rows have numbers of their own (they are stored with them first),
    and the row with the smallest number stays: rows of one doc_id with different texts are different documents.
    """
    key, rows = "doc_id", docs
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").limit(1).count():
        key = "_row"
        while key in docs.columns:
            key += "_"
        rows = stored(spark, docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    dropped = stored(spark, dedup.classes(rows, key=key).where("not kept").select(key), "dropped")
    return rows.join(dropped, key, "left_anti").select(*docs.columns)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the new text."""

    def make():
        from stradale.llm.secrets import redact, scan

        return lambda texts: [redact(t, scan(t)[4]) for t in texts]

    return rewrite_texts(docs, "text", make).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the decoded text."""
    return pieces.piece_digests(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontam_stage),
    ("secrets", secret_stage),
    ("pieces", pieces_stage),
]

#: Trained models, alignments and tokenizers are beyond SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; a stage's own tables are deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
