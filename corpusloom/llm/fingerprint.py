"""Document fingerprints: a digest of a text's improbable features, and its comparison.

A feature is a window of 64 bytes. Its entropy, in steps, has a frequency over the whole
corpus; the rarer its step, the better its rank, and windows without variety have none. In
every run of 64 consecutive features the one with the best rank (the leftmost of equals)
scores, and features that score often enough are selected. Each selected feature sets five
bits of a Bloom filter of 2,048 bits; when a filter has its fill, the next is chained on.
Two digests are compared filter by filter: the bits in common, less those that chance
would give, as a share of the most there could be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import arrow_map, buffers, mix
from corpusloom.workspace import Workspace

WINDOW = 64
#: Entropy in steps: 0 for one byte value only, STEPS for 64 different ones.
STEPS = 1000
#: Windows of lower entropy (in steps) carry too little to tell texts apart.
LEAST_ENTROPY = 100
#: Runs of consecutive features whose best scores, and the score that selects.
RUN, POPULAR = 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Filters of fewer features are not compared: chance would weigh too much.
LEAST_FEATURES = 6
#: Bytes of the reference digests that may be sent to every task; beyond, they are joined by shuffle.
SEND_BYTES = 16 << 20
#: Bytes of digests in one lot of such a join.
LOT_BYTES = 1 << 20

_SCALE = 1 << 20
_LOG = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_LOG)  # what one more of a byte adds
_NONE = np.int64(1) << 40


def entropy(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the texts laid end to end with gaps of 2 x 64 zero bytes: the padded bytes, and each window's entropy in steps, -1 where it isn't within one text."""
    gap = 2 * WINDOW
    sizes = np.diff(offsets)
    n = len(sizes)
    begin = offsets[:-1] + gap * np.arange(1, n + 1)
    padded = np.zeros(int(offsets[-1]) + gap * (n + 1), np.uint8)
    where = np.repeat(begin - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    padded[where] = data
    before = np.zeros(len(padded), np.uint8)  # equal bytes among the 63 before, and after
    after = np.zeros(len(padded), np.uint8)
    for lag in range(1, WINDOW):
        same = (padded[lag:] == padded[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    gain = _STEP[before]
    loss = _STEP[after]
    total = np.cumsum(gain)
    total[WINDOW:] -= np.cumsum(loss[:-WINDOW])
    # total[i] is the sum of c log c over the window that ends at i; the first windows lie in the first gap.
    bits = 6 * _SCALE - total // WINDOW
    step = (bits * STEPS) // (6 * _SCALE)
    out = np.full(len(padded), -1, np.int32)
    have = np.maximum(sizes - WINDOW + 1, 0)
    starts = np.repeat(begin - (np.cumsum(have) - have), have) + np.arange(int(have.sum()))
    out[starts] = step[starts + WINDOW - 1]
    return padded, out


def _histogram(part: pa.RecordBatch) -> pa.RecordBatch:
    _, step = entropy(*buffers(part.column(1)))
    counts = np.bincount(step[step >= LEAST_ENTROPY], minlength=STEPS + 1)
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["step", "n"])


def _ranks_of(counts: dict[int, int]) -> np.ndarray:
    """Rank of every entropy step, 0 the rarest; a step that has no rank is never selected."""
    ranks = np.full(STEPS + 2, _NONE)
    for k, (_, step) in enumerate(sorted((n, s) for s, n in counts.items())):
        ranks[step] = k
    return ranks


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """The ranks of all entropy steps by their frequency over all windows of all texts; of equally frequent ones the lower entropy first."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counts = rows.mapInArrow(arrow_map(_histogram), "step int, n bigint").groupBy("step").agg(F.sum("n").alias("n"))
    return _ranks_of({r.step: r.n for r in counts.collect()})


def select(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected features, in order."""
    padded, step = entropy(data, offsets)
    rank = ranks[step]  # -1 takes the last, which has no rank
    key = rank << np.int64(22) | (np.arange(len(rank), dtype=np.int64) & ((1 << 22) - 1)) if len(rank) < 1 << 22 else rank * np.int64(len(rank)) + np.arange(len(rank))
    best, have = key, 1
    while have < RUN:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    place = best & ((1 << 22) - 1) if len(rank) < 1 << 22 else best % len(rank)
    score = np.bincount(place, minlength=len(rank))
    chosen = np.flatnonzero((score >= POPULAR) & (rank < _NONE))
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    hashes = np.empty(len(chosen), np.uint64)
    for s in range(0, len(chosen), 1 << 14):
        words = np.ascontiguousarray(view[chosen[s : s + (1 << 14)]]).view(np.uint64)
        h = np.zeros(len(words), np.uint64)
        for k in range(WINDOW // 8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
        hashes[s : s + (1 << 14)] = h
    begin = offsets[:-1] + 2 * WINDOW * np.arange(1, len(offsets))
    return np.searchsorted(begin, chosen, "right") - 1, hashes


def filters(doc: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chained filters: bits (filters, 2048 / 8), features in each, and first[i]:first[i + 1] for text i. A feature that a text repeats counts once."""
    order = np.lexsort((np.arange(len(doc)), hashes, doc))
    fresh = np.ones(len(doc), bool)
    d, h = doc[order], hashes[order]
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    keep = np.sort(order[fresh])
    doc, hashes = doc[keep], hashes[keep]
    per = np.bincount(doc, minlength=texts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    chain = -(-per // PER_FILTER)
    first = np.concatenate([[0], np.cumsum(chain)])
    own = first[doc] + nth // PER_FILTER
    bits = np.zeros((int(first[-1]), BITS), bool)
    for k in range(HASHES):
        bits[own, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), np.bincount(own, minlength=int(first[-1])), first


_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def compare_filters(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Scores 0 to 1 of all pairs of filters (of a by of b)."""
    bits_a, bits_b = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    common = bits_a @ bits_b.T
    ones_a, ones_b = bits_a.sum(axis=1)[:, None], bits_b.sum(axis=1)[None, :]
    most = np.minimum(ones_a, ones_b)
    chance = ones_a * ones_b / BITS
    cut = chance + 0.3 * (most - chance)  # below, chance is likely
    score = np.where((common > cut) & (most > cut), (common - cut) / np.maximum(most - cut, 1e-9), 0)
    return np.where((na[:, None] >= LEAST_FEATURES) & (nb[None, :] >= LEAST_FEATURES), score, 0)


def compare(one: bytes, other: bytes) -> float | None:
    """Similarity 0 to 1 of two digests: each filter of the one with fewer takes its best partner in the other, and these are averaged. None if either has no filter with enough features."""
    a, na = unpack(one)
    b, nb = unpack(other)
    if len(na) > len(nb):
        a, na, b, nb = b, nb, a, na
    some = na >= LEAST_FEATURES
    if not some.any() or not (nb >= LEAST_FEATURES).any():
        return None
    return float(compare_filters(a[some], na[some], b, nb).max(axis=1).mean())


def pack(bits: np.ndarray, counts: np.ndarray) -> bytes:
    """A digest: the number of features of each filter in two bytes, then its 256 bytes."""
    return b"".join(int(n).to_bytes(2, "little") + row.tobytes() for n, row in zip(counts, bits))


def unpack(digest: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(digest, np.uint8).reshape(-1, BITS // 8 + 2)
    return rows[:, 2:], rows[:, 0].astype(np.int64) | rows[:, 1].astype(np.int64) << 8


def _digest(ranks: np.ndarray):
    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(part.column(1))
        doc, hashes = select(data, offsets, ranks)
        bits, counts, first = filters(doc, hashes, part.num_rows)
        digests = [pack(bits[s:e], counts[s:e]) for s, e in zip(first[:-1], first[1:])]
        total = np.add.reduceat(np.append(counts, 0), np.minimum(first[:-1], len(counts))) * (np.diff(first) > 0)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(total.astype(np.int64)), pa.array(np.diff(first)), pa.array(digests, pa.binary())], ["id", "n_features", "n_filters", "digest"])

    return arrow_map(fn)


def digests(docs: DataFrame, ranks: np.ndarray, key: str = "doc_id") -> DataFrame:
    """One row (id, n_features, n_filters, digest) for every row of docs; key names the column of ids.

    A null, empty or short text (fewer than 64 bytes) has no feature and an empty digest, and
    so may one without variety. Ids may be null; repeated rows give repeated digests. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_digest(ranks), "id bigint, n_features bigint, n_filters bigint, digest binary")


class References:
    """Digests to compare with, by id."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        made = [(k, *unpack(d)) for k, d in sorted(rows)]
        made = [(k, bits[n >= LEAST_FEATURES], n[n >= LEAST_FEATURES]) for k, bits, n in made if (n >= LEAST_FEATURES).any()]
        self.names = np.array([k for k, _, _ in made], np.int64)
        self.size = np.array([len(n) for _, _, n in made], np.int64)
        self.head = np.cumsum(self.size) - self.size
        self.bits = np.concatenate([b for _, b, _ in made]) if made else np.zeros((0, BITS // 8), np.uint8)
        self.counts = np.concatenate([n for _, _, n in made]) if made else np.zeros(0, np.int64)

    def best(self, digest: bytes) -> tuple[int | None, float | None]:
        """The reference most like the digest, the least id of equals, and its score by compare(); no id if no score is over 0, no score if there is nothing to compare."""
        bits, n = unpack(digest)
        own = n >= LEAST_FEATURES
        if not own.any() or not len(self.names):
            return None, None
        total = len(n)
        grid = np.concatenate([compare_filters(bits[s : s + 64], n[s : s + 64], self.bits, self.counts) for s in range(0, total, 64)])
        if not grid.any():
            return None, 0.0
        # The side with fewer filters looks for its best partners.
        down = np.maximum.reduceat(grid[own], self.head, axis=1).mean(axis=0)
        up = np.add.reduceat(grid.max(axis=0), self.head) / self.size
        scores = np.where(total > self.size, up, down)
        k = int(scores.argmax())
        return (int(self.names[k]), float(scores[k])) if scores[k] > 0 else (None, 0.0)


def _against(held):
    """Add to each digest the best of the references and its score. held: a broadcast of References."""

    def run(batches):
        for batch in batches:
            found = [held.value.best(d) for d in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names, "best_id", "score"])

    return run


def _by_lot(batches):
    """(row, digest, ids, digests of a lot) to (row, best_id, score)."""
    last, own = None, None
    for batch in batches:
        row, digest, ids, lot = batch.columns
        best = []
        for k in range(batch.num_rows):
            names = ids[k].as_py()
            if names != last:
                last, own = names, References(list(zip(names, lot[k].as_py())))
            best.append(own.best(digest[k].as_py()))
        yield pa.RecordBatch.from_arrays([row, pa.array([k for k, _ in best], pa.int64()), pa.array([s for _, s in best], pa.float64())], ["row", "best_id", "score"])


def fingerprints(docs: DataFrame, references: DataFrame, reference_key: str, send_bytes: int = SEND_BYTES) -> DataFrame:
    """Each row's digest, and the reference text whose digest is most like it: (doc_id, n_features, n_filters, digest, best_id, score).

    Ranks come from all texts of docs. Score is compare()'s; of equal scores the least
    reference id counts; best_id is null if no reference has a score over 0, and score too if
    there is nothing to compare. References without an id or without enough features take no
    part; repeated ones count once. If the references' digests take more than send_bytes,
    they are not sent to the tasks but joined in lots by shuffle, with the same result.
    Nulls, empty and long texts, repeated rows and extra columns are as in digests().
    """
    ranks = entropy_ranks(docs)
    own = digests(docs, ranks)
    known = digests(references.where(F.col(reference_key).isNotNull()), ranks, reference_key).where("n_features > 0").select("id", "digest").distinct()
    work = Workspace(docs.sparkSession)
    known = work.save(known, "references")
    bytes_ = known.agg(F.sum(F.length("digest"))).first()[0] or 0
    if bytes_ <= send_bytes:
        held = docs.sparkSession.sparkContext.broadcast(References([(r.id, bytes(r.digest)) for r in known.collect()]))
        return own.mapInArrow(_against(held), "id bigint, n_features bigint, n_filters bigint, digest binary, best_id bigint, score double").withColumnRenamed("id", "doc_id")
    own = work.save(own.withColumn("row", F.monotonically_increasing_id()), "digests")
    lots = work.save(known.groupBy(F.pmod(F.xxhash64("id"), F.lit(-(-bytes_ // LOT_BYTES))).alias("lot")).agg(F.array_sort(F.collect_list(F.struct("id", "digest"))).alias("each")).select(F.col("each.id").alias("ids"), F.col("each.digest").alias("lot")), "lots")
    scored = own.select("row", "digest").crossJoin(lots).mapInArrow(_by_lot, "row bigint, best_id bigint, score double")
    best = scored.groupBy("row").agg(F.max_by("best_id", F.struct("score", -F.col("best_id"))).alias("best_id"), F.max("score").alias("score"))
    return own.join(best, "row", "left").select(F.col("id").alias("doc_id"), "n_features", "n_filters", "digest", "best_id", "score")
