"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, mixing.

Every stage works on all that the one before kept. All but the last return the columns of documents;
the last adds copy_no, the number of the copy of a document that the mix takes more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidgraph.llm.decontam import clean
from braidgraph.llm.mixing import mixed
from braidgraph.llm.near_dup import deduplicated
from braidgraph.llm.pii import redact
from braidgraph.llm.quality import quality_filter
from braidgraph.llm.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents outside the compression bands, or failing the plain rules, go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of every class of near duplicates the document with the least id stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that overlap a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: spans of personal data are replaced by their kind; n_chars follows the new text."""
    return redact(docs, length_col="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as often as its source's target takes it."""
    return mixed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: Compression ratios, signatures and the learnt classifier have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
