"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, fingerprint, html_extract, jaccard_join, lang_id, license_scan, secret_scan, spm, substring_dedup, url_filter
from corpusloom.sources.tables import spread, table

#: The merge-type model that the registered queries use; the operators take any path.
SPM_MODEL = os.environ.get("CORPUSLOOM_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_pages(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(_documents(spark, sf_dir), SPM_MODEL)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_documents(spark, sf_dir))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_pages(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_fingerprint, op4_decontamination, op5_substring_dedup, op6_license_scan, op7_sentencepiece, op8_jaccard_join, op9_language_id, op10_html_extract)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op2_secret_scan": secret_scan.SQL,
    "op4_decontamination": decontam.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_license_scan": license_scan.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
}
