"""The map of embedding space: regions by centroid, coverage, densities, comparison.

vectors have (vec_id, dataset, embedding); centroids (region, category, vec, size). Cosines
are of unit vectors. Sums of regions are small; vectors are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.groups import bounds, by_group, meeting, part_of

OFF = -1
CUTOFF = 0.278
#: Bytes of centroids that may be sent to every task; more are joined in lots.
SEND_BYTES = 64 << 20
#: Larger buckets of vectors are cut into parts of about so many; of a part so many rows at once are compared with others.
BUCKET_PART, STRIPE = 8192, 256


def unit(v: Column) -> Column:
    """The vector at length 1; as it is if its length is 0."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, label: str = "label", categories: int = 3, parents: DataFrame | None = None) -> DataFrame:
    """One region per label: the mean of its unit vectors at length 1, its size, and its category by parents (region, category); without such a table, label modulo `categories`."""
    parts = vectors.where(F.col(label).isNotNull()).select(F.col(label).alias("region"), F.posexplode(unit(F.col("embedding"))).alias("d", "x"))
    means = parts.groupBy("region", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    rows = means.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"), F.max("n").alias("size"))
    if parents is not None:
        return rows.join(parents.select("region", "category"), "region", "left").select("region", "category", unit(F.col("v.x")).alias("vec"), "size")
    return rows.select("region", F.concat(F.lit("cat"), F.pmod("region", F.lit(categories)).cast("string")).alias("category"), unit(F.col("v.x")).alias("vec"), "size")


class _Map:
    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.region)
        self.regions = np.array([r.region for r in rows], np.int64)
        self.categories = [r.category for r in rows]
        self.matrix = np.array([r.vec for r in rows], np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def nearest(embedding: Column, cells: DataFrame, k: int = 1, temperature: float = 0.08) -> Column:
    """The k nearest regions of each vector: an array of (region, score, weight), the best first and of equals (to 9 places) the least region; weight is the softmax of score / temperature over the k. The centroids go to every task as one matrix; they must fit SEND_BYTES."""
    if 8 * (cells.agg(F.sum(F.size("vec"))).first()[0] or 0) > SEND_BYTES:
        raise ValueError("the map is too large to send to every task: use nearest_by_join")
    own = _Map(cells.select("region", "category", "vec").collect())

    @F.arrow_udf("array<struct<region:bigint,score:double,weight:double>>")
    def find(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.struct([("region", pa.int64()), ("score", pa.float64()), ("weight", pa.float64())])))
        score = np.round(_matrix(column) @ own.matrix.T, 9)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(score, order, axis=1)
        weight = np.exp((best - best[:, :1]) / temperature)
        weight /= weight.sum(axis=1, keepdims=True)
        pairs = pa.StructArray.from_arrays([pa.array(own.regions[order].ravel()), pa.array(best.ravel()), pa.array(weight.ravel())], ["region", "score", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pairs)

    return find(embedding)


def nearest_by_join(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """(vec_id, region, score) of the nearest region, by a product of both tables: for maps too large to send."""
    met = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).crossJoin(cells.select("region", "vec"))
    scored = met.select("vec_id", "region", F.round(dot("v", "vec"), 9).alias("score"))
    best = scored.groupBy("vec_id").agg(F.max(F.struct("score", (-F.col("region")).alias("k"))).alias("b"))
    return best.select("vec_id", (-F.col("b.k")).alias("region"), "b.score")


def assign(vectors: DataFrame, cells: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(vec_id, dataset, nearest, score, region): region is the nearest one, or -1 below the cutoff."""
    best = F.element_at(nearest(F.col("embedding"), cells), 1)
    return vectors.select("vec_id", "dataset", best.alias("b")).select("vec_id", "dataset", F.col("b.region").alias("nearest"), F.round("b.score", 6).alias("score"), F.when(F.col("b.score") < cutoff, OFF).otherwise(F.col("b.region")).alias("region"))


def soft_assign(vectors: DataFrame, cells: DataFrame, k: int = 5, least: float = 0.15) -> DataFrame:
    """By region: the mass of all vectors' weights over their k nearest regions, and how many vectors give it more than `least`."""
    parts = vectors.select(F.explode(nearest(F.col("embedding"), cells, k)).alias("w"))
    return parts.groupBy(F.col("w.region").alias("region")).agg(F.round(F.sum("w.weight"), 4).alias("mass"), F.count_if(F.col("w.weight") > least).alias("strong"))


def coverage(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """What a set of vectors covers: (records, placed, off, regions, entropy, concentration, top_share, effective). effective is the sum over its regions of min(1, share / the map's share)."""
    n = placed.agg(F.count("*").alias("records"), F.count_if(F.col("region") == OFF).alias("off"))
    counts = placed.where(F.col("region") != OFF).groupBy("region").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    shares = counts.join(cells.select("region", "size"), "region", "right").select("region", F.coalesce("n", F.lit(0)).alias("n"), "size")
    shares = shares.select("n", (F.try_divide(F.col("n"), F.sum("n").over(whole))).alias("p"), (F.col("size") / F.sum("size").over(whole)).alias("q"))
    seen = shares.agg(F.count_if(F.col("n") > 0).alias("regions"), F.sum(F.when(F.col("n") > 0, -F.col("p") * F.ln("p"))).alias("h"), F.max("p").alias("top"), F.sum(F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("p") / F.col("q")))).alias("e"), F.count("*").alias("cells"))
    return n.crossJoin(seen).select("records", (F.col("records") - F.col("off")).alias("placed"), "off", "regions", F.round("h", 6).alias("entropy"), F.round(F.try_divide("h", F.ln(F.col("cells"))), 6).alias("concentration"), F.round("top", 6).alias("top_share"), F.round("e", 6).alias("effective"))


def density(placed: DataFrame, cells: DataFrame, least_due: float = 5.0, default: float = 2.0, most: float = 1e7) -> DataFrame:
    """By region: vectors seen and due by the map's sizes, and their ratio shrunk towards 1, (seen + a) / (due + a); a by the method of moments over regions with enough due."""
    counts = placed.where(F.col("region") != OFF).groupBy("region").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    rows = cells.select("region", "category", "size").join(counts, "region", "left").select("region", "category", F.coalesce("n", F.lit(0)).alias("seen"), "size")
    due = rows.withColumn("due", F.sum("seen").over(whole) * F.col("size") / F.sum("size").over(whole))
    enough = F.col("due") >= least_due
    ratio = F.when(enough, F.col("seen") / F.col("due"))
    m = due.agg(F.var_pop(ratio).alias("v"), F.avg(F.when(enough, 1 / F.col("due"))).alias("noise"), F.count(ratio).alias("k"))
    spread = F.col("v") - F.col("noise")
    a = F.when(F.col("k") < 2, default).when(spread <= 1 / most, most).otherwise(1 / spread)
    return due.crossJoin(F.broadcast(m.select(a.alias("a")))).select("region", "category", "seen", F.round("due", 6).alias("due"), F.round((F.col("seen") + F.col("a")) / (F.col("due") + F.col("a")), 6).alias("density"))


def gaps(placed: DataFrame, cells: DataFrame, share: float = 0.005) -> DataFrame:
    """Categories with at most `share` of the placed vectors, and their empty regions."""
    counts = placed.where(F.col("region") != OFF).groupBy("region").agg(F.count("*").alias("n"))
    rows = cells.join(counts, "region", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"), F.count_if(F.col("n").isNull()).alias("empty_regions"), F.sum("size").alias("size"))
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({"p": F.coalesce(F.try_divide("seen", F.sum("seen").over(whole)), F.lit(0.0)), "map_share": F.round(F.col("size") / F.sum("size").over(whole), 6)})
    return rows.where((F.col("p") <= share) | (F.col("empty_regions") > 0)).select("category", "seen", "empty_regions", F.round("p", 6).alias("share"), "map_share")


def dataset_similarity(placed: DataFrame, least: int = 20, most: int = 5) -> DataFrame:
    """The `most` most alike pairs of datasets with at least `least` placed vectors, by the cosine of their region counts."""
    counts = placed.where(F.col("region") != OFF).groupBy("dataset", "region").agg(F.count("*").alias("n"))
    norms = counts.groupBy("dataset").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.sum("n").alias("total")).where(F.col("total") >= least)
    c = counts.join(norms, "dataset").select("dataset", "region", "n", "norm")
    a, b = (c.select(F.col("dataset").alias(x), "region", F.col("n").alias(f"n_{x}"), F.col("norm").alias(f"m_{x}")) for x in ("a", "b"))
    met = a.join(b, "region").where("a < b").groupBy("a", "b").agg((F.sum(F.col("n_a") * F.col("n_b")) / (F.max("m_a") * F.max("m_b"))).alias("c"))
    return met.select("a", "b", F.round("c", 6).alias("cosine")).orderBy(F.desc("cosine"), "a", "b").limit(most)


def cohesion(placed: DataFrame, vectors: DataFrame, least: int = 20) -> DataFrame:
    """By region with at least `least` vectors: the mean cosine of all its pairs, (|sum|^2 - n) / (n (n - 1)), by per-dimension sums and not by pairs."""
    met = placed.where(F.col("region") != OFF).select("vec_id", "region").join(vectors.select("vec_id", unit(F.col("embedding")).alias("v")), "vec_id")
    sums = met.select("region", F.posexplode("v").alias("d", "x")).groupBy("region", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy("region").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).where(F.col("n") >= least)
    return out.select("region", "n", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))), 6).alias("cohesion"))


def examples(placed: DataFrame, k: int = 2) -> DataFrame:
    """The k nearest vectors of each region."""
    order = Window.partitionBy("region").orderBy(F.desc("score"), "vec_id")
    return placed.where(F.col("region") != OFF).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("region", "vec_id", "score")


def _signs(bits: int) -> Column:
    """The signs of the first `bits` dimensions as a number; null where one is null."""
    return F.aggregate(F.transform(F.slice("embedding", 1, bits), lambda x: (x > 0).cast("int")), F.lit(0), lambda s, x: s * 2 + x)


def _alike(cosine: float):
    """For rows (bucket, x, y, part, vec_id, embedding): pairs (a < b, cosine) that may reach `cosine` when rounded, a stripe of rows at a time."""

    def met(ids: np.ndarray, v: np.ndarray, part: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        left = np.arange(len(ids)) if part is None else np.flatnonzero(part == part.min())
        right = left if part is None else np.flatnonzero(part != part.min())
        across = np.ascontiguousarray(v[right].T)
        for s in range(0, len(left), STRIPE):
            own = left[s : s + STRIPE]
            first = s if part is None else 0  # pairs with rows before are done
            c = v[own] @ across[:, first:]
            i, j = np.nonzero(~(c < cosine - 1e-6))  # NaN is above all numbers
            if part is None:
                later = j > i
                i, j = i[later], j[later]
            if len(i):
                a, b = ids[own[i]], ids[right[first + j]]
                other = a != b
                yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (np.minimum(a, b), np.maximum(a, b), c[i, j])], ["a", "b", "cosine"])

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, part, ids = (table.column(k).to_numpy() for k in ("x", "y", "part", "vec_id"))
        vectors = table.column("embedding").combine_chunks()
        long = pc.list_value_length(vectors).to_numpy()
        for s, e in zip(*bounds(table, 3)):
            for dimensions in np.unique(long[s:e]):  # vectors of other lengths have no cosine
                at = s + np.flatnonzero(long[s:e] == dimensions)
                both = part[at] if x[s] != y[s] else None
                if both is None or (both != both[0]).any():
                    yield from met(ids[at], _matrix(vectors.take(pa.array(at))), both)

    return each


def semantic_pairs(vectors: DataFrame, bits: int = 12, cosine: float = 0.95) -> DataFrame:
    """Pairs (a < b, cosine) of vectors with the same signs in the first `bits` dimensions and a cosine that reaches `cosine`. All pairs of a bucket are looked at, by products of matrices: large buckets are cut into parts, every two of which meet in a group of their own."""
    rows = vectors.where(~F.exists("embedding", lambda x: x.isNull())).select(F.col("vec_id").cast("bigint"), _signs(bits).alias("bucket"), "embedding").where("vec_id IS NOT NULL AND bucket IS NOT NULL")
    size = rows.groupBy("bucket").agg(F.count("*").alias("vectors")).where("vectors > 1")
    member = rows.join(F.broadcast(size), "bucket").select("bucket", "vec_id", "embedding", *part_of(F.col("vectors"), "vec_id", BUCKET_PART))
    met = member.select("bucket", F.explode(meeting(F.col("parts"), F.col("part"))).alias("t"), "part", "vec_id", "embedding").select("bucket", "t.x", "t.y", "part", "vec_id", "embedding")
    pairs = met.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(by_group(3, _alike(cosine)), "a bigint, b bigint, cosine double")
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine")).where(F.col("cosine") >= cosine)


def semantic_keepers(vectors: DataFrame, bits: int = 12, cosine: float = 0.95) -> DataFrame:
    """(vec_id) that a greedy pass keeps: in each bucket of equal signs, by vec_id, what is not that like one kept before."""

    def greedy(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = _matrix(table.column("embedding").combine_chunks())
        kept = np.zeros(len(v), bool)
        held = np.empty_like(v)
        n = 0
        for s in range(0, len(v), STRIPE):
            own = v[s : s + STRIPE]
            free = np.ones(len(own), bool)
            for k in range(0, n, BUCKET_PART):  # against those kept before the stripe
                rest = np.flatnonzero(free)
                free[rest] = (own[rest] @ held[k : min(k + BUCKET_PART, n)].T < cosine).all(axis=1)
            near = ~(own @ own.T < cosine)
            for i in np.flatnonzero(free):
                kept[s + i] = free[i] = not near[i, :i][free[:i]].any()
            held[n : n + free.sum()] = own[free]
            n += int(free.sum())
        return pa.table({"vec_id": table.column("vec_id").filter(pa.array(kept))})

    return vectors.select("vec_id", "embedding", _signs(bits).alias("bucket")).groupBy("bucket").applyInArrow(greedy, "vec_id bigint")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sets of placed vectors over the union of their regions: (region, n_a, n_b, status)."""
    x, y = (p.where(F.col("region") != OFF).groupBy("region").agg(F.count("*").alias(n)) for p, n in ((a, "n_a"), (b, "n_b")))
    both = x.join(y, "region", "full_outer").select("region", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return both.withColumn("status", F.when(F.col("n_b") == 0, "a_only").when(F.col("n_a") == 0, "b_only").otherwise("shared"))


def off_summary(placed: DataFrame, cutoff: float = CUTOFF, near: float = 0.05) -> DataFrame:
    """Vectors off the map by dataset: number, share, median and tenth-percentile score, and the share of near misses."""
    off = F.col("region") == OFF
    out = placed.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(off).alias("off"), F.percentile(F.when(off, F.col("score")), 0.5).alias("m"), F.percentile(F.when(off, F.col("score")), 0.1).alias("p"), F.count_if(off & (F.col("score") >= cutoff - near)).alias("near"))
    return out.select("dataset", "total", "off", F.round(F.col("off") / F.col("total"), 6).alias("off_share"), F.round("m", 6).alias("median_score"), F.round("p", 6).alias("p10_score"), F.col("near").alias("near_misses"))


def cutoff_of(placed: DataFrame, share: float = 0.02) -> DataFrame:
    """The score below which `share` of the vectors lie: a cutoff for a map made of them."""
    return placed.agg(F.round(F.percentile("score", share), 6).alias("cutoff"))


def purity(placed: DataFrame, label: str = "label") -> DataFrame:
    """How well regions agree with a label: (macro, micro, nmi), by the region's commonest label and by mutual information over the mean of both entropies."""
    c = placed.where(F.col("region") != OFF).groupBy("region", label).agg(F.count("*").alias("n"))
    by_r, by_l, every = Window.partitionBy("region"), Window.partitionBy(label), Window.partitionBy(F.lit(1))
    c = c.withColumns({"r": F.sum("n").over(by_r), "l": F.sum("n").over(by_l), "t": F.sum("n").over(every), "top": F.max("n").over(by_r)})
    p = F.col("n") / F.col("t")
    mi = F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("r") * F.col("l")))).alias("mi")
    hr = F.sum(-p * F.ln(F.col("r") / F.col("t"))).alias("hr")
    hl = F.sum(-p * F.ln(F.col("l") / F.col("t"))).alias("hl")
    s = c.agg(mi, hr, hl)
    regions = c.select("region", "top", "r").distinct().agg(F.avg(F.col("top") / F.col("r")).alias("macro"), (F.sum("top") / F.sum("r")).alias("micro"))
    return regions.crossJoin(s).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), F.round(F.try_divide(2 * F.col("mi"), F.col("hr") + F.col("hl")), 6).alias("nmi"))


def category_counts(placed: DataFrame, cells: DataFrame, label: str = "label") -> DataFrame:
    """(category, label, n): how often each label falls into each category."""
    return placed.join(cells.select("region", "category"), "region").groupBy("category", label).agg(F.count("*").alias("n"))


def crosswalk(one: DataFrame, other: DataFrame) -> DataFrame:
    """Between two assignments of the same vectors: (region, best, shared, jaccard, containment), best being the other's region with the greatest Jaccard similarity, the least of equals."""
    c = one.select("vec_id", F.col("region").alias("x")).join(other.select("vec_id", F.col("region").alias("y")), "vec_id").groupBy("x", "y").agg(F.count("*").alias("n"))
    c = c.withColumns({"nx": F.sum("n").over(Window.partitionBy("x")), "ny": F.sum("n").over(Window.partitionBy("y"))})
    j = F.col("n") / (F.col("nx") + F.col("ny") - F.col("n"))
    best = c.groupBy("x").agg(F.max(F.struct(j.alias("j"), (-F.col("y")).alias("k"), "n", "nx")).alias("b"))
    return best.select(F.col("x").alias("region"), (-F.col("b.k")).alias("best"), F.col("b.n").alias("shared"), F.round("b.j", 6).alias("jaccard"), F.round(F.col("b.n") / F.col("b.nx"), 6).alias("containment"))


def normalised(vectors: DataFrame, drop: int = 2) -> DataFrame:
    """vectors less their mean and without their `drop` main directions, at length 1. Mean and second moments are sums over all vectors, added up per partition; the directions come from the small matrix of the dimensions."""

    def moments(batches):
        total = None
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                own = [np.array([len(v)]), v.sum(axis=0), (v.T @ v).ravel()]
                total = own if total is None else [x + y for x, y in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(total[0][0])]), pa.array([total[1]], pa.list_(pa.float64())), pa.array([total[2]], pa.list_(pa.float64()))], ["n", "s", "q"])

    n, s, q = 0, 0.0, 0.0
    for row in vectors.select("embedding").mapInArrow(moments, "n bigint, s array<double>, q array<double>").toLocalIterator():
        n, s, q = n + row.n, s + np.array(row.s), q + np.array(row.q)
    if not n:
        return vectors
    mean = s / n
    _, directions = np.linalg.eigh(q.reshape(len(mean), -1) / n - np.outer(mean, mean))
    main = directions[:, len(mean) - drop :]

    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        v = _matrix(column) - mean
        v -= (v @ main) @ main.T
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v /= np.where(norm > 0, norm, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))

    return vectors.withColumn("embedding", project("embedding"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 7) -> DataFrame:
    """centroids by k-means on unit vectors (cosine), for building a map."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(unit(F.col("embedding"))).alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(rows)
    sizes = {r.prediction: r["count"] for r in model.transform(rows).groupBy("prediction").count().collect()}
    made = [(i, f"cat{i % 3}", [float(x) for x in c], sizes.get(i, 0)) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(made, "region int, category string, vec array<double>, size bigint")
