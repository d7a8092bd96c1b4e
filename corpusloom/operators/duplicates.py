"""Exact duplicates, near duplicates by MinHash and banding, and overlap between datasets."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import kernels
from corpusloom.functions import text as T
from corpusloom.operators.components import components
from corpusloom.operators.groups import PART, bounds, by_group, meeting, part_of
from corpusloom.sources.tables import dealt
from corpusloom.workspace import Workspace

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Preset:
    """Bands, rows in each, and the least share of equal lanes."""

    bands: int
    rows: int
    threshold: float

    @property
    def lanes(self) -> int:
        return self.bands * self.rows


PRESETS = {"strict": Preset(8, 13, 0.85), "fineweb": Preset(14, 8, 0.75), "hf-neardedup": Preset(32, 8, 0.70)}
#: Words in a shingle; shortest text.
SHINGLE, SHORTEST = 5, 40
#: Bytes of text that are signed together, few enough for the cache.
SIGN_BYTES = 1 << 18


def coefficients(lanes: int, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of each lane's hash (a x + b) mod (2^31 - 1)."""
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(lanes)]


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """By dataset of the first copy: redundant copies, groups, the largest group, tokens in the copies, and the copies beyond them that differ in white space or case only. Two hash aggregations, the second over what the first left."""
    seen = docs.where(T.stripped(F.coalesce("text", F.lit(""))) != "").select("doc_id", "dataset", F.md5("text").alias("h"), F.md5(F.lower(T.one_spaced(F.col("text")))).alias("w"), F.length("text").alias("chars"))
    first = F.min_by("dataset", "doc_id").alias("dataset")
    exact = seen.groupBy("h").agg(F.count("*").alias("n"), first, F.max("chars").alias("chars"), F.min("doc_id").alias("doc_id"), F.first("w").alias("w"))
    loose = exact.groupBy("w").agg(F.count("*").alias("forms"), first)
    a = exact.groupBy("dataset").agg(F.sum("n").alias("first_seen"), F.sum(F.col("n") - 1).alias("copies"), F.count_if(F.col("n") > 1).alias("clusters"), F.max("n").alias("largest"), F.floor(F.sum((F.col("n") - 1) * F.col("chars")) / T.CHARS_PER_TOKEN).cast("bigint").alias("wasted_tokens"))
    b = loose.groupBy("dataset").agg(F.sum(F.col("forms") - 1).alias("loose_copies"))
    return a.join(b, "dataset", "left").select("dataset", "first_seen", "copies", "clusters", "largest", "wasted_tokens", F.coalesce("loose_copies", F.lit(0)).alias("loose_copies"))


def sign(texts: pa.Array, preset: Preset, shingle: int) -> np.ndarray:
    """Signatures of texts whose words single spaces separate, none of them empty: the least value of every lane over the hashes of the shingles."""
    data, offsets = kernels.buffers(texts)
    start, stop, at = kernels.spaced_runs(data, offsets, shingle)
    p = np.uint64(PRIME)
    flat = (kernels.md5_heads(data, start, stop) >> np.uint64(4)) % p
    out = np.empty((len(texts), preset.lanes), np.int32)
    v, high, low, less = (np.empty(len(flat), kind) for kind in (np.uint64, np.uint64, np.uint32, np.uint32))
    for k, (a, b) in enumerate(coefficients(preset.lanes)):
        np.multiply(flat, np.uint64(a), out=v)
        v += np.uint64(b)
        np.right_shift(v, np.uint64(31), out=high)
        v &= p
        v += high  # modulo 2^31 - 1 but for one p, as a x + b < p^2
        low[:] = v
        np.subtract(low, np.uint32(PRIME), out=less)
        np.minimum(low, less, out=low)
        out[:, k] = np.minimum.reduceat(low, at[:-1])
    return out


def _rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    raw = np.ascontiguousarray(matrix)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, width * len(raw) + 1, width, dtype=np.int32)), pa.py_buffer(raw)])


def _sign(preset: Preset, shingle: int):
    """(doc_id, dataset, exact, words) to SIGNED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in kernels.runs(batch.column(3), SIGN_BYTES):
                part = batch.slice(s, e - s)
                signature = sign(part.column(3), preset, shingle)
                key = [md5(x.tobytes()).digest() for x in signature]
                lanes = signature.astype(np.uint64).reshape(len(key), preset.bands, preset.rows)
                band = np.broadcast_to(np.arange(preset.bands, dtype=np.uint64), lanes.shape[:2])
                for r in range(preset.rows):
                    band = kernels.mix(band * np.uint64(0xD6E8FEB86659FD93) + lanes[:, :, r])
                lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, preset.bands, dtype=np.int32), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(key, pa.binary()), lists, _rows(signature)], ["doc_id", "dataset", "exact", "key", "bands", "signature"])

    return run


SIGNED = "doc_id bigint, dataset string, exact bigint, key binary, bands array<bigint>, signature binary"


class Near:
    """Near duplicates of docs: what is signed, who represents whom, and which representatives are alike. Signatures are made once and saved.

    Documents with equal signatures are a class, represented by the least doc_id; classes,
    not their members, meet in bands. A band of any size is compared whole, in parts.
    """

    def __init__(self, docs: DataFrame, preset: Preset = PRESETS["fineweb"], shingle: int = SHINGLE):
        self.preset = preset
        self.work = work = Workspace(docs.sparkSession)
        seen = dealt(docs).where(F.length("text") >= SHORTEST).select("doc_id", "dataset", T.hash60(T.one_spaced(F.lower("text"))).alias("exact"), T.folded(F.col("text")).alias("words")).where("words <> ''")
        #: (doc_id, dataset, exact, key, bands, signature) of texts of 40 characters and more that have a word; exact is the hash of the text without regard to case and white space, key that of the signature.
        self.signed = work.save(seen.mapInArrow(_sign(preset, shingle), SIGNED), "signed")
        least = F.min_by(F.struct("doc_id", "bands", "signature"), "doc_id").alias("k")
        self.classes = work.save(self.signed.groupBy("key").agg(least).select("key", F.col("k.doc_id").alias("rep"), "k.bands", "k.signature"), "classes")
        self.pairs = work.save(self._pairs(), "pairs")

    def _pairs(self) -> DataFrame:
        bands = self.classes.select("rep", F.explode("bands").alias("band"))
        size = bands.groupBy("band").agg(F.count("*").alias("docs")).where("docs > 1")
        member = bands.join(size, "band").select("rep", "band", *part_of(F.col("docs"), "rep", PART))
        rows = member.join(self.classes.select("rep", "signature"), "rep").select("band", F.explode(meeting(F.col("parts"), F.col("part"))).alias("t"), "part", "rep", "signature")
        rows = rows.select("band", "t.x", "t.y", "part", "rep", "signature").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
        return rows.mapInArrow(by_group(3, _compare(self.preset)), "a bigint, b bigint, jaccard double").distinct()

    def members(self) -> DataFrame:
        """Rows (doc_id, representative) of all signed documents."""
        return self.signed.join(self.classes.select("key", F.col("rep").alias("representative")), "key").select("doc_id", "representative")

    def _owned(self, columns: list[str]) -> DataFrame:
        """Signed documents with the cluster that their class is connected with, its own where it has no partner."""
        own = components(self.pairs).withColumnsRenamed({"key": "rep"})
        cluster = self.classes.select("key", "rep").join(own, "rep", "left").select("key", "rep", F.coalesce("cluster", "rep").alias("cluster"))
        return self.signed.select("key", *columns).join(cluster, "key")

    def clusters(self) -> DataFrame:
        """Clusters of near duplicates with two distinct texts and more: (cluster, members, distinct_texts). Exact copies don't count as near duplicates."""
        return self._owned(["exact"]).groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("exact").alias("distinct_texts")).where("distinct_texts > 1")

    def summary(self) -> DataFrame:
        """(total, clusters, near_duplicates, largest): signed records, and what clusters() counts beyond one text each."""
        found = self.clusters().agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("distinct_texts") - 1), F.lit(0)).alias("near_duplicates"), F.coalesce(F.max("distinct_texts"), F.lit(0)).alias("largest"))
        return self.signed.agg(F.count("*").alias("total")).crossJoin(found)

    def overlap(self, most: int = 60) -> DataFrame:
        """The worst `most` directed overlaps between datasets: (source, target, matched, of, fraction), matched being the source's records with a near duplicate in the target."""
        each = self.signed.select("key", "dataset").join(self.classes.select("key", "rep"), "key").groupBy("rep", "dataset").agg(F.count("*").alias("n"))
        both = self.pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("to")), F.struct(F.col("b").alias("rep"), F.col("a").alias("to")))).alias("e")).select("e.*")
        seen = both.join(each.select(F.col("rep").alias("to"), F.col("dataset").alias("target")), "to").select("rep", "target").unionByName(each.select("rep", F.col("dataset").alias("target"))).distinct()
        sizes = each.groupBy(F.col("dataset").alias("source")).agg(F.sum("n").alias("of"))
        met = each.withColumnRenamed("dataset", "source").join(seen, "rep").where("source <> target").groupBy("source", "target").agg(F.sum("n").alias("matched")).join(sizes, "source")
        return met.select("source", "target", "matched", "of", F.round(F.col("matched") / F.col("of"), 6).alias("fraction")).orderBy(F.desc("fraction"), "source", "target").limit(most)


def _compare(preset: Preset):
    """For rows (band, x, y, part, rep, signature): pairs (a < b, jaccard) that agree in enough lanes."""

    def one(ids: np.ndarray, own: np.ndarray, part: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        a, b, shares = [], [], []
        for k in range(len(ids) - 1):
            share = (own[k + 1 :] == own[k]).sum(axis=1) / float(preset.lanes)
            near = np.flatnonzero((share >= preset.threshold) & (True if part is None else part[k + 1 :] != part[k]))
            if len(near):
                a.append(np.minimum(ids[k + 1 + near], ids[k]))
                b.append(np.maximum(ids[k + 1 + near], ids[k]))
                shares.append(share[near])
        return a, b, shares

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, part, x, y = (table.column(c).to_numpy() for c in ("rep", "part", "x", "y"))
        own = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.int32).reshape(len(ids), -1)
        for s, e in zip(*bounds(table, 3)):
            a, b, shares = one(ids[s:e], own[s:e], part[s:e] if x[s] != y[s] else None)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b, shares)], ["a", "b", "jaccard"])

    return each
