"""Counts over words: unigram log probabilities and telling terms of groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import kernels
from corpusloom.functions import text as T
from corpusloom.workspace import Workspace


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, e in kernels.runs(batch.column(1)):
            part = batch.slice(s, e - s)
            lists = pc.split_pattern(part.column(1), " ")
            each = pa.table([part.column(0).take(pc.list_parent_indices(lists)), lists.flatten()], ["group", "word"])
            yield from each.group_by(["group", "word"]).aggregate([([], "count_all")]).rename_columns(["group", "word", "n"]).combine_chunks().to_batches()


def word_counts(docs: DataFrame, group: str) -> DataFrame:
    """(group, word, n) of the words of folded texts. Words are counted within Arrow batches first, so what is shuffled is distinct words."""
    seen = docs.select(F.col(group).cast("string").alias("group"), T.folded(F.col("text")).alias("text")).where("text <> ''")
    return seen.mapInArrow(_count, "group string, word string, n bigint").groupBy("group", "word").agg(F.sum("n").alias("n"))


def unigrams(docs: DataFrame, most: int = 120_000) -> DataFrame:
    """The `most` commonest words with their counts and natural logarithms of their shares of all words."""
    counts = word_counts(docs.select("text", F.lit("").alias("group")), "group").select("word", "n")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "word").limit(most).crossJoin(F.broadcast(total)).select("word", "n", F.round(F.ln(F.col("n") / F.col("total")), 6).alias("log_p"))


def captions(docs: DataFrame, group: str = "dataset", terms: int = 12, shortest: int = 3) -> DataFrame:
    """The `terms` most telling words of each group, by count x ln(1 + N / (1 + groups that have the word)): (group, rank, word, score)."""
    counts = word_counts(docs, group).where(F.length("word") >= shortest).withColumnRenamed("n", "tf")
    counts = Workspace(docs.sparkSession).save(counts, "counts")  # read three times, so that texts are read once
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    n = counts.select("group").distinct().agg(F.count("*").alias("groups"))
    scored = counts.join(df, "word").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.ln(1 + F.col("groups") / (1 + F.col("df"))), 6))
    order = Window.partitionBy("group").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms).select("group", "rank", "word", "score")
