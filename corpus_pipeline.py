"""A corpus made ready for training: filtered, deduplicated, redacted and packed.

Each stage takes the session, the documents that its predecessor kept and the folder of
the tables. All but the last return the columns of the documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricspark.llm import exact_dedup, packing, pii, quality, set_join
from metricspark.llm.bpe import tokenizer_path
from metricspark.llm.common import bucket, labelled_sample, one_of_each, own, remove, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the pairwise ranking rejects; an empty or null text is scored like others."""
    labels = table(spark, sf_dir, "labels")
    sample = labelled_sample(labels, bucket(F.col("doc_id"), 4) != 2, "quality", max_rows=20_000)
    return quality.accepted(docs, quality.fit(docs, sample))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest, then that of least id.

    Null counts as an empty text, and empty texts are equal; a null id comes last. Rows
    that repeat an id and its text are one document, and one of them stays. An id that is
    used for several texts stands for as many documents. No rows give none.
    """
    gone = exact_dedup.dedup(docs).filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")
    )
    text = F.coalesce("text", F.lit(""))
    normal = F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (normal == gone["gone_text"])
    return one_of_each(docs.join(gone, same, "left_anti"), [F.col("doc_id"), normal], -F.length(text))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts stays, that of least id.

    A null or empty text, one without words and a row with a null id are linked with
    nothing and stay. Rows that repeat an id and its text are one document, and one of
    them stays; of an id's several texts only linked ones go. No rows give none.
    """
    gone = set_join.jaccard_join(docs).filter(~F.col("kept")).select("doc_id", F.col("text_key").alias("gone_text"))
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["gone_text"])
    left = docs.join(gone, same, "left_anti").select(own(*docs.columns))
    return one_of_each(left, [F.col("doc_id"), F.col("text")])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are; no rows give none.
    """
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document, with its ids.

    Null and empty texts are examples of one id, the end. Rows that repeat an id, or have
    none, are examples of their own. No rows give none.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("ngram_join", ngram_join),
    ("pii", personal_data),
    ("packing", pack),
]
#: Learned scores, shingle hashes and tokens have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again, and removed once the next is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
