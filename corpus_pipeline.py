"""Corpus pipeline: from ``documents`` to token ids, each stage an operator of ``tablesmith.llm``.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's input. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablesmith.llm import bpe, langid, mixing, pii, simhash
from tablesmith.llm.common import stored
from tablesmith.session import ship_package

VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lang stays as it was given."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the digests and the token ids of every row."""
    return bpe.encode(docs, VOCABULARY, ["doc_id", "source"])


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("PII", personal_data),
          ("mixing to target weights", mixture), ("BPE", tokens)]

#: language models, fingerprints and BPE are beyond SQL; tests/llm compares the stages with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
