"""From documents to token ids: toxicity, near duplicates, benchmark passages, personal data, byte-level BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Defined cases, each in its stage: a null text is the empty text, stays null until the last stage, and is empty there; a
null doc_id counts as the empty id for the toxicity folds, and its rows stay as they are among near duplicates; rows that
repeat doc_id and text are one document after the near-duplicate stage; of equally near documents the smallest doc_id
stays; columns that documents doesn't have by default are kept by all stages but the last, whatever they are named;
empty tables of documents, labels or benchmark items pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontam, neardup, pii, toxicity
from millrace.llm.common import read_table, scratch, written
from millrace.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.fitted(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id."""
    ship_package(spark)
    return neardup.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    ship_package(spark)
    return pii.redact(docs, pii.fitted(docs))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): the token ids, and the text decoded from them."""
    ship_package(spark)
    coded = byte_bpe.encode(docs.select("doc_id", "text", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.decode("decoded", "utf-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("byte_bpe", encode_and_decode),
]

#: The stages' models and sketches are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stages write for themselves, and for the next one, is deleted when it is read."""
    docs = read_table(spark, sf_dir, "documents")
    with scratch() as lasting:
        for name, stage in STAGES[:-1]:
            with scratch() as kept:
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
                kept.append(docs)
        lasting.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
