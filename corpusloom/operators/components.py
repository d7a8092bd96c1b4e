"""Connected components: a bounded number of edges on the driver, more by large-star and small-star rounds, each written and read again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.workspace import Workspace

#: Rounds grow with the logarithm of the graph's size; this many would mean a fault.
MOST_ROUNDS = 50
#: Distinct edges that are sent to the driver, 16 bytes each; more are never collected.
FEW = 250_000


def least_in_reach(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that edges (a, b) connect each with, by hops and halving."""
    root = np.arange(n)
    before = None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
    return root


def _round(edges: DataFrame, large: bool) -> DataFrame:
    pairs = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))) if large else edges
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    met = pairs.join(least, "hi")
    if large:
        return met.where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
    out = met.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
    return out.where("hi > lo").distinct()


def components(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """(key, cluster) for both ends of every pair (a, b) of bigints: cluster is the least key in reach. Loops, repeated pairs and nulls add nothing; no pairs give no rows. The result is the same whatever `few` is."""
    spark = pairs.sparkSession
    work = Workspace(spark)
    edges = work.save(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges-0")
    if edges.count() <= few:
        held = edges.toArrow()
        work.close()
        keys, at = np.unique(np.concatenate([held.column("hi").to_numpy(), held.column("lo").to_numpy()]), return_inverse=True)
        root = least_in_reach(*np.split(at.reshape(-1), 2), len(keys))
        return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.int64()), "cluster": pa.array(keys[root], pa.int64())}, pa.schema([("key", pa.int64()), ("cluster", pa.int64())])))
    before = None
    for k in range(1, MOST_ROUNDS):
        fresh = work.save(_round(_round(edges, True), False), f"edges-{k}")
        work.drop(f"edges-{k - 1}")
        edges = fresh
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            roots = edges.select(F.col("lo").alias("key"), F.col("lo").alias("cluster")).distinct()
            return edges.select(F.col("hi").alias("key"), F.col("lo").alias("cluster")).unionByName(roots)
        before = now
    raise RuntimeError("the components did not settle")
