"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, cascade, collinear, fm_index, license_scan, metric_join, packing, page_diff, site_lines, suffix_dedup

_vocabularies: dict[tuple[str, str], bpe.Vocabulary] = {}


def vocabulary(spark: SparkSession, path: str = bpe.VOCABULARY) -> bpe.Vocabulary:
    """One for each session and file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _vocabularies:
        _vocabularies[key] = bpe.Vocabulary(spark, bpe.load_ranks(path))
    return _vocabularies[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collinear.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.drop_boilerplate(_table(spark, sf_dir, "documents"), count_col="dropped").select("doc_id", "source", "text", "dropped")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.groups(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(spark))
    return rows.select("doc_id", "ids", "n_tokens", "exact")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge(_table(spark, sf_dir, "documents")).select("doc_id", F.col("keep"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(_table(spark, sf_dir, "pages"), past_equal=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_line_dedup,
        op3_ngram_jaccard,
        op4_decontamination,
        op5_license_scan,
        op6_sharding,
        op7_suffix_array_dedup,
        op8_byte_bpe,
        op9_quality_rules,
        op10_html_extraction,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": site_lines.ORACLE_SQL, "op9_quality_rules": cascade.ORACLE_SQL}
