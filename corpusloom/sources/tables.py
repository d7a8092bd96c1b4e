"""Tables as documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.patterns import canonical_role


#: A table of fewer bytes of files may lie in one row group, which one task reads; its rows are then dealt out to all cores.
SMALL_BYTES = 64 << 20
#: Bytes of files whose rows make a task, where each byte takes long; beyond so many tasks these grow.
TASK_BYTES, MOST_TASKS = 8 << 20, 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _size(rows: DataFrame) -> int:
    """Bytes of the files that the rows come from, as the plan has it; very large where it has none."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows in tasks of TASK_BYTES, whatever the sizes of files and row groups, for steps that cost much more than the shuffle. Small tables are left to spread()."""
    size = _size(rows)
    return rows.repartition(min(MOST_TASKS, -(-size // TASK_BYTES))) if SMALL_BYTES < size < 1 << 50 else rows


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores if the files are small: at most SMALL_BYTES are shuffled. Larger tables have row groups enough and stay where they are."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if _size(rows) <= SMALL_BYTES else rows


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, dataset, text) of the documents table; doc_id is the corpus order."""
    return spread(table(spark, folder, "documents").select("doc_id", F.col("source").alias("dataset"), "text"))


def joined(turns: Column, keep) -> Column:
    """The contents of the turns that keep() accepts, one to a line."""
    return F.array_join(F.transform(F.filter(turns, keep), lambda t: t["content"]), "\n")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, dataset, turns, text, prompt, answer) of the conversations table: one row for each conversation, its turns in order. One shuffle, on conv_id."""
    rows = table(spark, folder, "conversations")
    return with_turns(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("raw_role"), F.coalesce("text", F.lit("")).alias("content")))).alias("raw")))


def with_turns(rows: DataFrame) -> DataFrame:
    """Adds turns (role, content, raw_role), text, prompt and answer to rows with `raw`, an array of (…, raw_role, content)."""
    turns = F.transform("raw", lambda t: F.struct(canonical_role(t["raw_role"]).alias("role"), t["content"].alias("content"), F.when(canonical_role(t["raw_role"]) != t["raw_role"], t["raw_role"]).alias("raw_role")))
    out = rows.withColumn("turns", turns).drop("raw")
    return out.withColumns(
        {
            "dataset": F.lit("conversations"),
            "text": joined(F.col("turns"), lambda t: F.lit(True)),
            "prompt": joined(F.col("turns"), lambda t: t["role"] != "assistant"),
            "answer": joined(F.col("turns"), lambda t: t["role"] == "assistant"),
        }
    )
