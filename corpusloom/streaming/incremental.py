"""Streams: windowed counts of events with a watermark, and exact duplicates of arriving documents.

A stream is run over what is there and its result read back from the written table, so
that it can be queried as a table. State and results lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.workspace import Workspace

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _folder(spark: SparkSession) -> str:
    """A folder for one run's state and results; it goes when the driver's Python ends."""
    return Workspace(spark).root


def _stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if not _is_folder(spark, f"{folder}/{name}.parquet") else "*.parquet").parquet(folder if not _is_folder(spark, f"{folder}/{name}.parquet") else f"{folder}/{name}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _settled(stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there, and read its table."""
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{work}/table").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/table")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type; what comes later than `late` is dropped. Works on streams and on tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def windowed_counts(spark: SparkSession, folder: str, width: str = "1 day") -> DataFrame:
    """windowed() of the whole events table, streamed in update mode, so that windows which the watermark has passed leave the state. Each batch's changes are a folder of their own, written again if the batch is; the last change of a window counts."""
    work = _folder(spark)
    stream = windowed(_stream(spark, folder, "events", EVENTS), width)
    spark.createDataFrame([], stream.schema).write.parquet(f"{work}/table/batch=-1")

    def store(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/table/batch={k}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").foreachBatch(store).trigger(availableNow=True).start()
    run.awaitTermination()
    changes = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{work}/table")
    last = changes.groupBy("window_start", "event_type").agg(F.max_by(F.struct("events", "total"), "batch").alias("last"))
    return last.select("window_start", "event_type", "last.events", "last.total")


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct texts a stream of documents has. State is a 16-byte hash per distinct text and grows with them: documents have no event time by which a watermark could let it go."""
    docs = _stream(spark, folder, "documents", DOCUMENTS).where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    kept = _settled(docs.dropDuplicates(["h"]).select("h"), _folder(spark))
    return kept.agg(F.count("*").alias("distinct_texts"))
