"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, host_reputation, mixing, pii, quality, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .host_reputation import query

    return query(spark, sf_dir)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import train_and_score

    rows = train_and_score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import copies

    rows = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.selectExpr("doc_id", "mix_size AS size", "mix_source_size AS source_size", "mix_target AS target", "mix_size * mix_copies AS taken")


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_report

    return span_report(table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op6_weak_supervision_pii, for their SQL."""
    return op6_weak_supervision_pii(spark, sf_dir).drop("spans")


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op7_compression_bands, for their SQL."""
    return op7_compression_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_records

    return capture_records(table(spark, sf_dir, "pages"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import main_text

    return main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": op1_dart_minhash,
    "op2_host_reputation": op2_host_reputation,
    "op3_token_counts": op3_token_counts,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_source_mix": op5_source_mix,
    "op6_weak_supervision_pii": op6_weak_supervision_pii,
    "pii_base_spans": pii_base_spans,
    "op7_compression_bands": op7_compression_bands,
    "quality_base_counts": quality_base_counts,
    "op8_capture_index": op8_capture_index,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_wrappers": op10_wrappers,
}

ORACLES: dict[str, str] = {"op2_host_reputation": host_reputation.ORACLE, "op5_source_mix": mixing.ORACLE, "pii_base_spans": pii.BASE_ORACLE, "quality_base_counts": quality.BASE_ORACLE, "op8_capture_index": warc.ORACLE, "op9_spaced_seeds": decontam.ORACLE}
