"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage is written as Parquet to the shared folder and read back, so a lost executor costs one stage at most. All but the
last return the columns of ``documents``. SQL cannot express the first stages (a trained classifier, 64-bit SimHash), so
``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` checks the result by brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm.bpe import encode_digests
from strideflow.llm.common import read_table
from strideflow.llm.decontaminate import decontaminate
from strideflow.llm.pii import redact
from strideflow.llm.simhash import one_of_each
from strideflow.llm.toxicity import without_toxic
from strideflow.session import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by placeholders; all documents stay."""
    kind = docs.schema["n_chars"].dataType
    return redact(docs).withColumn("n_chars", F.length("text").cast(kind))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return encode_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
