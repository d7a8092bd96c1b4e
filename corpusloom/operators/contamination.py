"""Benchmark contamination: items most of whose 8-grams one record holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import kernels
from corpusloom.functions import text as T
from corpusloom.workspace import Workspace

GRAM, COVERAGE, RATE = 8, 0.5, 0.02
#: Rows of the index that may be sent to every task; a larger one is joined by shuffle.
SEND_ROWS = 2_000_000


def item_text(*fields) -> "F.Column":
    """A benchmark row's fields joined by line breaks, blank ones dropped."""
    return F.array_join(F.filter(F.array(*fields), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n")


def _grams(docs: DataFrame, keys: dict[str, str], gram: int) -> DataFrame:
    """keys, and a row for each distinct gram of the text, as a 64-bit hash, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in kernels.runs(batch.column(len(keys))):
                text, value, have = kernels.distinct_runs(*kernels.spaced(batch.column(len(keys)).slice(s, e - s)), gram)
                at = pa.array(text + s)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(value.view(np.int64)), pa.array(np.bincount(text, minlength=e - s)[text])], [*keys, "gram", "grams"])

    seen = docs.where("text IS NOT NULL").select(*keys, T.folded(F.col("text")).alias("text"))
    return seen.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in {**keys, "gram": "bigint", "grams": "bigint"}.items()))


def index(items: DataFrame, gram: int = GRAM) -> DataFrame:
    """(benchmark, item_id, gram, grams) with a row for each distinct gram of an item, as a hash; grams is their number."""
    return _grams(items, {"benchmark": "string", "item_id": "bigint"}, gram)


class _Index:
    """An index of bounded size that goes to every task: sorted grams, and the items that each belongs to."""

    def __init__(self, rows: pa.Table):
        value = rows.column("gram").to_numpy()
        order = np.argsort(value, kind="stable")
        self.gram, self.entry = value[order], order
        self.items = rows.select(["benchmark", "item_id", "grams"]).combine_chunks()
        one = self.items.group_by(["benchmark", "item_id", "grams"]).aggregate([])
        number = {key: k for k, key in enumerate(zip(*(one.column(c).to_pylist() for c in one.column_names)))}
        self.own = np.array([number[key] for key in zip(*(self.items.column(c).to_pylist() for c in one.column_names))], np.int64)
        self.names = one.combine_chunks()

    def shared(self, text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, grams in common) of distinct grams of texts."""
        value = value.view(np.int64)
        lo, hi = np.searchsorted(self.gram, value, "left"), np.searchsorted(self.gram, value, "right")
        met = np.flatnonzero(hi > lo)
        count = hi[met] - lo[met]
        item = self.own[self.entry[kernels.ranges(lo[met], count)]]
        both, n = np.unique(np.repeat(text[met], count) * np.int64(max(len(self.names), 1)) + item, return_counts=True)
        return both // max(len(self.names), 1), both % max(len(self.names), 1), n


SHARED = "benchmark string, item_id bigint, grams bigint, doc_id bigint, shared bigint"


def _lookup(held, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for s, e in kernels.runs(batch.column(1)):
                text, value, _ = kernels.distinct_runs(*kernels.spaced(batch.column(1).slice(s, e - s)), gram)
                text, item, n = own.shared(text, value)
                if len(text):
                    names = own.names.take(pa.array(item))
                    yield pa.RecordBatch.from_arrays([*(names.column(c).combine_chunks() for c in ("benchmark", "item_id", "grams")), batch.column(0).take(pa.array(text + s)), pa.array(n)], ["benchmark", "item_id", "grams", "doc_id", "shared"])

    return run


def witnesses(docs: DataFrame, items: DataFrame, gram: int = GRAM, send_rows: int = SEND_ROWS) -> DataFrame:
    """For each item the record that holds the most of its grams, the first of equals: (benchmark, item_id, doc_id, shared, grams, coverage).

    An index of at most send_rows rows goes to every task, where grams are looked up as the
    texts are read; a larger one is joined by shuffle, with the same result.
    """
    spark = docs.sparkSession
    own = Workspace(spark).save(index(items, gram), "index")
    if own.count() <= send_rows:
        held = spark.sparkContext.broadcast(_Index(own.toArrow()))
        seen = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), T.folded(F.col("text")).alias("text"))
        shared = seen.mapInArrow(_lookup(held, gram), SHARED)
    else:
        shared = _grams(docs, {"doc_id": "bigint"}, gram).drop("grams").join(own, "gram").groupBy("benchmark", "item_id", "grams", "doc_id").agg(F.count("*").alias("shared"))
    best = shared.groupBy("benchmark", "item_id", "grams").agg(F.max_by(F.struct("doc_id", "shared"), F.struct("shared", -F.col("doc_id"))).alias("b"))
    return best.select("benchmark", "item_id", "b.doc_id", "b.shared", "grams", F.round(F.col("b.shared") / F.col("grams"), 6).alias("coverage"))


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, rate: float = RATE) -> DataFrame:
    """By benchmark: items, those covered over `coverage` by one record, their share, and whether it is over `rate`."""
    found = witnesses(docs, items).where(F.col("shared") / F.col("grams") > coverage).groupBy("benchmark").agg(F.count("*").alias("n"))
    size = items.where(F.size(T.words(F.col("text"))) > 0).groupBy("benchmark").agg(F.count_distinct("item_id").alias("items"))
    out = size.join(found, "benchmark", "left").select("benchmark", "items", F.coalesce("n", F.lit(0)).alias("contaminated"))
    return out.select("benchmark", "items", "contaminated", F.round(F.col("contaminated") / F.col("items"), 6).alias("rate"), (F.col("contaminated") / F.col("items") > rate).alias("flagged"))
