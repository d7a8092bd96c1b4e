"""A corpus pipeline: five stages over the documents table, each calling one operator.

A stage takes all that its predecessor kept, is written as Parquet, and is read again as
the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, jaccard_join, lang_id, secret_scan, spm
from corpusloom.llm.queries import SPM_MODEL
from corpusloom.sources.tables import spread, table
from corpusloom.workspace import Workspace


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and its length in n_chars where it differs from the old one."""
    changed = docs.withColumns({"text": text} if "n_chars" not in docs.columns else {"text": text, "n_chars": F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))})
    return changed.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, with a null text, or unlike every language's prototype go; the others stay as they are. Prototypes come from docs.lang; if no row has a lang, all documents go."""
    return lang_id.keep_accepted(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id; so do documents without a partner, and rows with a null doc_id or text. Of rows that repeat a doc_id one stays."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts; every document stays, clean ones (null and empty too) as they are."""
    automata = decontam.build(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(docs, decontam.clean_column(F.col("text"), automata))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [SECRET]; every document stays, clean ones (null and empty too) as they are."""
    return _with_text(docs, secret_scan.redacted_column(F.col("text")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, checked against the library and by decoding: (doc_id, n_tokens, ids, agrees, round_trip). A null text has null in all but doc_id, an empty one no tokens."""
    return spm.encode_documents(docs, SPM_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: SQL has no means for the first stage's vectors nor for the last one's agenda; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. An empty documents table gives none."""
    work = Workspace(spark)
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
