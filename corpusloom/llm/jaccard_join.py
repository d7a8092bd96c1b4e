"""N-gram Jaccard join: all links between documents whose sets of word n-grams overlap enough.

Three steps. Copies: documents with one and the same set of n-grams are a class, of which one
representative goes on, with the number of its copies. Routing: the grams are put in order of
the number of documents that hold them, rarest first. Two sets of n grams or more that reach
the threshold T share one of the first n - ceil(T n) + 1 of either, so all that share such a
gram are a band, and those of a band are linked whose bitmaps do not rule the threshold out.
Linked documents are a block. Search: in each block every document is a query to a
T-occurrence search over the block's inverted lists (DivideSkip), which finds all documents of
the block that reach the required overlap.

Every step is exact: order, bands and bitmaps only leave out pairs that cannot reach the
threshold. (Grams are compared by 64 bits of hash.)

Bands and blocks of any size are cut into parts of a bounded number of documents, and every
two parts meet in a task of their own, so no task holds a whole hot band or block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import ranges
from corpusloom.llm.kernels import Words, arrow_map, chunks, grams, mix
from corpusloom.operators.components import components, least_in_reach
from corpusloom.operators.groups import bounds, by_group, meeting, part_of
from corpusloom.workspace import Workspace

N = 3
THRESHOLD = 0.6
#: Grams are counted in so many buckets, each in one task, by 32 more bits of their hash: what these confuse only looks more frequent.
BUCKETS = 512
#: Bytes of text, and rows, whose grams go to the buckets together.
PACK, PACK_ROWS = 4 << 20, 1 << 16
#: Bytes of a document's bitmap: a power of two, at least one for each gram, within these limits. Shorter ones rule out less.
BITMAP = (8, 8192)
#: Larger bands and blocks are cut into parts of about so many, and every two parts meet in a task of their own.
PART_DOCS = 2048
#: Cost of a binary probe against a merge step, by which DivideSkip chooses the long lists.
MU = 0.0085

#: Two sums over a set of grams tell whether it is the same as another.
_SEEDS = mix(np.array([3, 5], np.uint64))


def bitmaps(g: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of non-empty gram sets, one after the other, and the n + 1 offsets of their bytes. A gram sets the bit of its lowest bits of hash."""
    size = np.diff(offsets)
    width = np.clip(1 << np.ceil(np.log2(size)).astype(np.int64), *BITMAP)
    at = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(8 * int(at[-1]), bool)
    bits[np.repeat(8 * at[:-1], size) + (g & np.repeat((8 * width - 1).astype(np.uint64), size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), at


def _sketch(n: int):
    def fn(part: pa.RecordBatch) -> pa.RecordBatch | None:
        g, offsets = grams(Words(part.column(1)), n)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return None
        data, at = bitmaps(g, np.append(offsets[some], len(g)))
        bits = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        one, two = (np.add.reduceat(mix(g ^ seed), offsets[some]) for seed in _SEEDS)
        held = pa.array(some)
        return pa.RecordBatch.from_arrays([part.column(0).take(held), part.column(2).take(held), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(offsets)[some].astype(np.int32)), bits], ["doc_id", "h", "one", "two", "n", "bits"])

    return arrow_map(fn)


#: Rows between the steps that count grams: those of one chunk of documents in one bucket, or (bucket < 0) the chunk's documents.
_PACKED = "chunk bigint, bucket int, x binary, y binary, z binary"


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v if k < 2 else v.tobytes() for v in column], kind) for k, (column, kind) in enumerate(zip(zip(*rows), kinds))], ["chunk", "bucket", "x", "y", "z"])


def _of(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of packed rows, and where each row's begin."""
    values = [np.frombuffer(v, kind) for v in table.column(name).to_pylist()]
    return np.concatenate(values), np.concatenate([[0], np.cumsum(list(map(len, values)))])


def _pack(n: int):
    """For rows (doc_id, text, h): a packed row for each chunk of documents (doc_id, h, number of grams), and for each of its buckets (place of the document in the chunk, 32 bits of gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in range(0, batch.num_rows, PACK_ROWS):
                for part in chunks(batch.slice(s, PACK_ROWS), 1, PACK):
                    sets = [grams(Words(p.column(1)), n) for p in chunks(part)]
                    g, size = np.concatenate([x for x, _ in sets]), np.concatenate([np.diff(at) for _, at in sets])
                    if not len(g):
                        continue
                    bucket = (g >> np.uint64(55)).astype(np.int16)
                    by = np.argsort(bucket, kind="stable")
                    doc = np.repeat(np.arange(len(size), dtype=np.uint16), size)[by]
                    low = (g[by] >> np.uint64(23)).astype(np.uint32)
                    cut = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
                    none = np.zeros(0, np.uint8)
                    rows = [(chunk, -1 - chunk % BUCKETS, part.column(0).to_numpy(), part.column(2).to_numpy(), size.astype(np.int32))]
                    rows += [(chunk, k, doc[a:b], low[a:b], none) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b]
                    yield _packed(rows)
                    chunk += 1

    return run


def _count(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For packed rows that begin with their bucket and are sorted by it: the same with those grams only that another document has too, and in z a measure of how many have them."""
    for s, e in zip(*bounds(table, 1)):
        own = table.slice(s, e - s)
        if own.column("bucket")[0].as_py() < 0:
            yield from own.select(["chunk", "bucket", "x", "y", "z"]).to_batches()
            continue
        low, at = _of(own, "y", np.uint32)
        doc, _ = _of(own, "x", np.uint16)
        ordered = np.sort(low)
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        count = np.diff(head)
        shared, count = ordered[head[:-1]][count > 1], count[count > 1]
        if not len(shared):
            continue
        spot = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
        hit = np.flatnonzero(shared[spot] == low)
        often = np.minimum(8 * np.log2(count), 255).astype(np.uint8)[spot[hit]]
        cut = np.searchsorted(hit, at)
        doc, low = doc[hit], low[hit]
        rows = [(c, k, doc[a:b], low[a:b], often[a:b]) for c, k, a, b in zip(own.column("chunk").to_pylist(), own.column("bucket").to_pylist(), cut[:-1].tolist(), cut[1:].tolist()) if a < b]
        yield _packed(rows)


def _prefixes(threshold: float):
    """For the rows of _count sorted by chunk: (doc_id, h, bands), the grams of a document one of which any partner shares. Documents without such grams have no row."""

    def fn(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for s, e in zip(*bounds(table, 1)):
            own = table.slice(s, e - s)
            bucket = own.column("bucket").to_numpy()
            head, body = own.slice(int(np.flatnonzero(bucket < 0)[0]), 1), own.take(pa.array(np.flatnonzero(bucket >= 0)))
            if not body.num_rows:
                continue
            size = _of(head, "z", np.int32)[0]
            doc, at = _of(body, "x", np.uint16)
            gram = np.repeat(body.column("bucket").to_numpy().astype(np.int64), np.diff(at)) << 32 | _of(body, "y", np.uint32)[0]
            often = _of(body, "z", np.uint8)[0]
            # A set's grams that no other has come first in its order, so of those that are shared so many are left.
            have = np.bincount(doc, minlength=len(size))
            least = np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)
            take = np.where(size > 0, np.maximum(have - least + 1, 0), 0)
            keep = take[doc] > 0
            doc, gram, often = doc[keep], gram[keep], often[keep]
            by = np.lexsort((gram, often, doc))
            first = np.searchsorted(doc[by], np.arange(len(size)))
            some = np.flatnonzero(take)
            if not len(some):
                continue
            bands = gram[by][ranges(first[some], take[some])]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(take[some])]).astype(np.int32), pa.array(bands))
            yield pa.RecordBatch.from_arrays([pa.array(_of(head, k, np.int64)[0][some]) for k in ("x", "y")] + [lists], ["doc_id", "h", "bands"])

    return by_group(1, fn)


class Bitmaps:
    """Bitmaps and sizes of gram sets, for upper bounds of their similarity."""

    def __init__(self, bits: pa.Array | pa.ChunkedArray, size: np.ndarray):
        rows = bits.to_pylist()
        self.words = np.frombuffer(b"".join(rows), np.uint64)
        self.width = np.fromiter(map(len, rows), np.int64, len(rows)) // 8
        self.at = np.cumsum(self.width) - self.width
        self.size = size.astype(np.int64)

    def may_reach(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the pairs (i, j) may have at least this similarity. A bit that only one of two sets has set stands for at least one gram that only it has."""
        i, j = np.broadcast_arrays(i, j)
        a, b = self.size[i], self.size[j]
        out = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        left = np.flatnonzero(out)
        widths = self.width[i[left]] << 32 | self.width[j[left]]
        for pair in np.unique(widths).tolist():
            every = left[widths == pair]
            narrow = min(pair >> 32, pair & 0xFFFFFFFF)
            step = max(1, (1 << 20) // max(pair >> 32, pair & 0xFFFFFFFF))
            for s in range(0, len(every), step):
                k = every[s : s + step]
                x, y = self._rows(i[k], narrow), self._rows(j[k], narrow)
                most = np.minimum(a[k] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), b[k] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                out[k] = most >= threshold * (a[k] + b[k] - most) - 1e-9
        return out

    def _rows(self, i: np.ndarray, narrow: int) -> np.ndarray:
        """A matrix of bitmaps of one width, folded to a narrower one."""
        width = int(self.width[i[0]])
        rows = self.words[self.at[i][:, None] + np.arange(width)]
        return np.bitwise_or.reduce(rows.reshape(len(i), width // narrow, narrow), axis=1) if width > narrow else rows


def _alike(sketch: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the others agree with the sketch (or row by row, with as many) in at least this share of lanes, after correction for chance."""
    share = ((sketch == others).sum(axis=-1, dtype=np.int16) / others.shape[-1] - 1 / 256) / (1 - 1 / 256)
    return share >= least


def band_links(sketches: np.ndarray, least: float, alike=_alike) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all members of a band which are connected through sketches that are alike.

    Every member is compared with all that nothing has reached yet, so a band of documents that
    are alike costs linear time, and one of documents that are not costs quadratic time.
    """
    rest = np.arange(len(sketches))
    to, of = [], []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        k = queue.pop()
        near = np.concatenate([alike(sketches[k], sketches[rest[s : s + 8192]], least) for s in range(0, len(rest), 8192)] or [np.zeros(0, bool)])
        found = rest[near]
        if len(found):
            to.append(np.full(len(found), k))
            of.append(found)
            queue += found.tolist()
            rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *to]), np.concatenate([none, *of])


def _links(threshold: float):
    """For rows (band, x, y, doc_id, n, bits) sorted by the first three: the links (a, b) of each of these groups."""

    def link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc_id").to_numpy()
        sets = Bitmaps(table.column("bits"), table.column("n").to_numpy())
        first, end = bounds(table, 3)
        same = np.ones(len(ids) - 1, bool)
        same[first[1:] - 1] = False
        near = np.zeros(len(ids), bool)
        next_to = np.flatnonzero(same)
        near[next_to] = sets.may_reach(next_to, next_to + 1, threshold)
        i, j = [np.flatnonzero(near)], [np.flatnonzero(near) + 1]
        # Where all neighbours agree, the chain connects the band; two that do not are no pair.
        for s, e in zip(first, end):
            if e - s > 2 and not near[s : e - 1].all():
                x, y = band_links(np.arange(s, e), threshold, sets.may_reach)
                i.append(x + s)
                j.append(y + s)
        a, b = ids[np.concatenate(i)], ids[np.concatenate(j)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_group(3, link)


def divide_skip(g: np.ndarray, offsets: np.ndarray, threshold: float, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of sets in g[offsets[i]:offsets[i + 1]] with Jaccard similarity >= threshold, as arrays (i, j, similarity).

    Sets are sorted by size, and each is a query to the sets before it that are not too small.
    The overlap that any answer must reach is T = ceil(threshold * size); the longest L lists
    are set aside, the others merged, what occurs T - L times in them is looked up in the
    long ones by binary search, and at last the bound of the pair's own sizes decides.
    With parts, only pairs whose sets lie in different parts count.
    """
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    doc = rank[np.repeat(np.arange(len(size)), size)]
    by = np.lexsort((doc, g))
    values, ids = g[by], doc[by]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    number = np.cumsum(np.concatenate([[True], values[1:] != values[:-1]])) - 1 if len(values) else head
    tail = np.append(head[1:], len(values))
    probe = number * np.int64(len(size) + 1) + ids  # (list, document), sorted
    lists = np.empty(len(g), np.int64)
    lists[by] = number
    place = np.empty(len(g), np.int64)  # where a set itself stands in the list
    place[by] = np.arange(len(g))
    sizes = size[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r, q in enumerate(order):
        n = int(size[q])
        own = slice(offsets[q], offsets[q + 1])
        start, stop = head[lists[own]], place[own]  # in each list, the documents before this one
        length = stop - start
        least = max(1, math.ceil(threshold * n - 1e-9))
        floor = int(np.searchsorted(sizes, least))  # smaller sets cannot reach the threshold
        if floor >= r or (length > 0).sum() < least:
            continue
        longest = int(length.max())
        aside = min(least - 1, int(least / (MU * math.log2(longest + 1) * 10 + 1)))
        if aside:
            split = np.argpartition(length, len(length) - aside)
            short, long_ = split[: len(length) - aside], split[len(length) - aside :]
        else:
            short, long_ = np.arange(len(length)), np.zeros(0, np.int64)
        total = int(length[short].sum())
        if not total:
            continue
        ends = np.cumsum(length[short])
        at = np.arange(total) + np.repeat(start[short] - (ends - length[short]), length[short])
        merged = np.sort(ids[at])
        edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1], [True]]))
        cand, count = merged[edge[:-1]], np.diff(edge)
        keep = (count >= least - len(long_)) & (cand >= floor)
        cand, count = cand[keep], count[keep]
        if len(cand) and len(long_):
            # Documents still in question leave after each group of probes that they could no longer make up for.
            number_of = lists[own][long_]
            for k in range(0, len(number_of), 32):
                group = number_of[k : k + 32]
                keys = (group[:, None] * np.int64(len(size) + 1) + cand[None, :]).ravel()
                spot = np.minimum(np.searchsorted(probe, keys), len(probe) - 1)
                count = count + (probe[spot] == keys).reshape(len(group), -1).sum(axis=0)
                keep = count >= least - max(0, len(number_of) - k - 32)
                cand, count = cand[keep], count[keep]
                if not len(cand):
                    break
        if len(cand):
            both = count / (n + sizes[cand] - count)
            good = both >= threshold - 1e-12
            other = order[cand[good]]
            if len(other):
                found.append((np.full(len(other), q), other, both[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, s = (np.concatenate(x) for x in zip(*found))
    if parts is not None:
        cross = parts[i] != parts[j]
        i, j, s = i[cross], j[cross], s[cross]
    return i, j, s


def _search(n: int, threshold: float, pairs: bool):
    """For rows (block, x, y, part, doc_id, copies, text) sorted by the first three: pairs, or each linked document with one of its class and its links."""

    def block(table: pa.Table) -> pa.RecordBatch | None:
        ids = table.column("doc_id").to_numpy()
        _, once = np.unique(ids, return_index=True)  # a repeated row is the same document
        ids, part, copies = ids[once], table.column("part").to_numpy()[once], table.column("copies").to_numpy()[once]
        across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        text = table.column("text").take(pa.array(once))
        sets, offsets = [], [0]
        for k in range(0, len(ids), 512):
            g, at = grams(Words(text.slice(k, 512).combine_chunks()), n)
            sets.append(g)
            offsets += (at[1:] + offsets[-1]).tolist()
        i, j, s = divide_skip(np.concatenate(sets), np.array(offsets), threshold, part if across else None)
        if not len(i):
            return None
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(s)], ["doc_a", "doc_b", "jaccard"])
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = least_in_reach(i, j, len(ids))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for s, e in zip(*bounds(table, 3)):
            out = block(table.slice(s, e - s))
            if out is not None:
                yield out

    return by_group(3, each)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h): h tells apart texts that share a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).where("doc_id IS NOT NULL AND text IS NOT NULL")


class _Join:
    """One run: who is whose copy, and what the search finds among the representatives."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, pairs: bool):
        self.work = work = Workspace(docs.sparkSession)
        self.threshold = threshold
        text = _texts(docs)
        self.sketches = work.save(text.mapInArrow(_sketch(n), "doc_id bigint, h bigint, one bigint, two bigint, n int, bits binary"), "sketches")
        least = F.min(F.struct("h", "one", "two")).alias("k")
        #: One row for each doc_id with words, whatever repeats.
        self.members = self.sketches.groupBy("doc_id").agg(least).select("doc_id", "k.*")
        self.classes = work.save(self.members.groupBy("one", "two").agg(F.min(F.struct("doc_id", "h")).alias("k"), F.count("*").alias("copies")).select("one", "two", "k.*", "copies"), "classes")
        member = self._blocks(text, n)
        size = member.groupBy("block").agg(F.count("*").alias("docs"))
        member = member.join(size, "block").join(self.classes, "doc_id").select("doc_id", "h", "copies", "block", *part_of(F.col("docs"), "doc_id", PART_DOCS))
        rows = text.hint("merge").join(member, ["doc_id", "h"]).select("block", F.explode(meeting(F.col("parts"), F.col("part"))).alias("t"), "part", "doc_id", "copies", "text")
        rows = rows.select("block", "t.x", "t.y", "part", "doc_id", "copies", "text").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")
        self.found = rows.mapInArrow(_search(n, threshold, pairs), "doc_a bigint, doc_b bigint, jaccard double" if pairs else "a bigint, b bigint, links bigint")

    def _prefixes(self, text: DataFrame, n: int) -> DataFrame:
        """Rows (doc_id, h, bands) of all texts that may have a partner."""
        packed = text.mapInArrow(_pack(n), _PACKED).select("bucket", "chunk", "x", "y", "z").repartition("bucket").sortWithinPartitions("bucket")
        shared = packed.mapInArrow(by_group(1, _count), _PACKED).repartition("chunk").sortWithinPartitions("chunk")
        return self.work.save(shared.mapInArrow(_prefixes(self.threshold), "doc_id bigint, h bigint, bands array<bigint>"), "prefixes")

    def _blocks(self, text: DataFrame, n: int) -> DataFrame:
        """Rows (doc_id, block) of the representatives that may have a partner."""
        own = self._prefixes(text, n).join(self.classes.select("doc_id", "h"), ["doc_id", "h"])
        bands = own.select("doc_id", F.explode("bands").alias("band")).repartition("band")
        # Bands of the same members count once.
        size = bands.groupBy("band").agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc_id")).alias("of"), F.sum(F.col("doc_id").cast("decimal(38,0)")).alias("total")).where("docs > 1")
        kept = size.groupBy("docs", "of", "total").agg(F.min("band").alias("band")).select("band", "docs")
        member = bands.join(kept, "band").select("doc_id", "band", *part_of(F.col("docs"), "doc_id", PART_DOCS))
        rows = member.join(self.sketches.join(self.classes.select("doc_id", "h"), ["doc_id", "h"]).select("doc_id", "n", "bits"), "doc_id")
        rows = rows.select("band", F.explode(meeting(F.col("parts"), F.col("part"))).alias("t"), "doc_id", "n", "bits").select("band", "t.x", "t.y", "doc_id", "n", "bits")
        links = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_links(self.threshold), "a bigint, b bigint")
        return self.work.save(components(links).select(F.col("key").alias("doc_id"), F.col("cluster").alias("block")), "blocks")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (doc_a < doc_b, jaccard) of class representatives whose sets of word n-grams have Jaccard similarity >= threshold.

    A class is all documents with the same set, its representative the one of least doc_id;
    members() gives the classes. Words are runs of letters, numbers and underscores in lower
    case; a text of fewer than n words has one gram, its words. Rows whose doc_id or text is
    null, and texts without words (empty ones too), have no partner. Rows that share a doc_id
    count as one document, the one with words whose text has the least hash. Ties are all
    kept; there is no cap on partners. Other columns of docs are ignored, whatever their
    names. An empty table gives no rows.
    """
    return _Join(docs, n, threshold, True).found


def members(docs: DataFrame, n: int = N) -> DataFrame:
    """Rows (doc_id, representative) of all documents with words, as in jaccard_pairs."""
    sketches = Workspace(docs.sparkSession).save(_texts(docs).mapInArrow(_sketch(n), "doc_id bigint, h bigint, one bigint, two bigint, n int, bits binary").drop("n", "bits"), "members")
    own = sketches.groupBy("doc_id").agg(F.min(F.struct("h", "one", "two")).alias("k")).select("doc_id", "k.*")
    return own.join(own.groupBy("one", "two").agg(F.min("doc_id").alias("representative")), ["one", "two"]).select("doc_id", "representative")


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, class_id, n_links) for every document that has a partner.

    n_links is the number of other documents whose set of word n-grams has Jaccard similarity
    >= threshold with its own, copies among them; classes are connected through such links,
    class_id is the least doc_id of the class. A document without a partner is in no class
    and has no row. Nulls, empty texts, repeated ids, ties and other columns are as in
    jaccard_pairs; there is no cap on links. An empty table gives no rows.
    """
    run = _Join(docs, n, threshold, False)
    found = run.work.save(run.found, "found")
    group = components(found.select("a", "b")).select(F.col("key").alias("doc_id"), F.col("cluster").alias("group_id"))
    links = found.groupBy(F.col("a").alias("doc_id")).agg(F.sum("links").alias("links"))
    known = run.classes.join(links, "doc_id", "left").join(group, "doc_id", "left").where("copies > 1 OR links > 0")
    known = known.select("one", "two", F.coalesce("group_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"))
    return run.members.join(known, ["one", "two"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class of jaccard_classes the document with the least doc_id stays.

    All columns of docs are kept. Of rows that repeat a doc_id one stays, the least by hash of
    its text. Rows whose doc_id is null, and texts that are null or hold no words, stay.
    """
    gone = jaccard_classes(docs, n, threshold).where("doc_id <> class_id").select("doc_id")
    named = docs.where("doc_id IS NOT NULL").hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("row")
    one = named.groupBy("doc_id").agg(row).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return one.unionByName(docs.where("doc_id IS NULL"))


#: The same in SQL, for the default settings.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 2, 1))) AS pos FROM docs WHERE len(words) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(words[pos + 1:pos + 3], ' ') AS gram FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT doc_a, doc_b FROM shared s JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
  WHERE s.n / (x.n + y.n - s.n) >= 0.6),
edges AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT x, x AS root FROM edges UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.x WHERE r.root < e.y)
SELECT doc_id, class_id, n_links
FROM (SELECT x AS doc_id, min(root) AS class_id FROM reach GROUP BY x) JOIN (SELECT x AS doc_id, count(*) AS n_links FROM edges GROUP BY x) USING (doc_id)
"""
