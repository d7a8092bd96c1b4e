"""Substring dedup: passages of k words and more that occur more than once in the corpus.

Every window of k words has a minimiser, the least hash of its runs of m words. Equal
windows have equal minimisers, so windows can be counted bucket by bucket. Consecutive
windows that share a minimiser travel as one packed string of word fingerprints (a
super-k-mer, r + k - 1 words for r windows) to the minimiser's bucket. There the windows
are sorted, equal neighbours are compared word by word, and counted. One shuffle of the
packed strings and one of the repeated ranges, whatever the number of copies.

A hot bucket (a passage with very many copies, or a frequent run of words as minimiser)
would be one task's. Buckets are counted first, and the windows of a hot one go by their own
hash, with partial counts before the shuffle.

A word travels as 32 bits of its hash. Two windows count as equal only if all k
fingerprints are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.kernels import buffers, mix, ranges, rolling, runs
from corpusloom.llm.kernels import Words, arrow_map, original_spans, sliding_min
from corpusloom.workspace import Workspace

WINDOW = 50
MINIMISER = 5
#: Windows that a task sorts together, in whole buckets.
SORT_WINDOWS = 1 << 20
#: Super-k-mers beyond which a bucket is hot.
HOT = 1 << 16


def _pack(k: int, m: int):
    """(doc_id, text) to super-k-mers (bucket, doc_id, start, packed); start is the number of the first word."""

    def fn(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(part.column(1))
        count = np.diff(words.first)
        least = sliding_min(rolling(words.hash, m), k - m + 1)
        have = np.maximum(count - k + 1, 0)
        if not have.sum():
            return None
        window = ranges(words.first[:-1], have)
        doc = np.repeat(np.arange(len(count)), have)
        bucket = least[window]
        new = np.ones(len(window), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        run = np.diff(np.append(head, len(window)))
        length = run + k - 1
        ids = (words.hash >> np.uint64(32)).astype(np.uint32)
        packed = ids[ranges(window[head], length)]
        at = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[head].view(np.int64)),
                part.column(0).take(pa.array(doc[head])),
                pa.array((window[head] - words.first[doc[head]]).astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(at), pa.py_buffer(packed)]),
            ],
            ["bucket", "doc_id", "start", "packed"],
        )

    return arrow_map(fn)


def _sizes(k: int, m: int):
    """(doc_id, text) to (bucket, n), n being the super-k-mers of a run of texts."""
    pack = _pack(k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pack(batches):
            bucket, n = np.unique(part.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    return run


def _windows(k: int):
    """Super-k-mers to their windows (a, b, doc_id, pos), a and b being two hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                _, doc, start, packed = batch.slice(s, 4096).columns
                raw, at = buffers(packed)
                ids = raw.view(np.uint32)
                length = np.diff(at) // 4
                have = length - k + 1
                place = ranges(at[:-1] // 4, have)
                owner = np.repeat(np.arange(len(have)), have)
                pos = start.to_numpy().astype(np.int64)[owner] + place - (at[:-1] // 4)[owner]
                keys = (pa.array(rolling(x, k)[place].view(np.int64)) for x in (ids, mix(ids.astype(np.uint64) + np.uint64(1))))
                yield pa.RecordBatch.from_arrays([*keys, doc.take(pa.array(owner)), pa.array(pos)], ["a", "b", "doc_id", "pos"])

    return run


def _hot_ranges(packed: DataFrame, k: int) -> DataFrame:
    """The same as _count gives, for hot buckets: a row for each repeated window."""
    each = packed.mapInArrow(_windows(k), "a bigint, b bigint, doc_id bigint, pos bigint")
    known = each.groupBy("a", "b").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "pos")).alias("head")).where("n_copies > 1")
    return each.join(known, ["a", "b"]).select("doc_id", F.col("pos").alias("lo"), F.col("pos").alias("hi"), (F.struct("doc_id", "pos") == F.col("head")).alias("is_first"), "n_copies")


def _same(ids: np.ndarray, at: np.ndarray, order: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """For sorted windows, whether each equals the one before, word by word."""
    same = np.zeros(len(order), bool)
    maybe = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    view = np.lib.stride_tricks.sliding_window_view(ids, k)
    for s in range(0, len(maybe), 1 << 15):
        x = maybe[s : s + (1 << 15)]
        same[x] = (view[at[order[x]]] == view[at[order[x - 1]]]).all(axis=1)
    if not same[maybe].all():
        # Different windows with one hash: bring equal ones together by their words.
        for value in np.unique(key[order[maybe[~same[maybe]]]]):
            where = np.flatnonzero(key[order] == value)
            seen: dict[bytes, list[int]] = {}
            for w in order[where]:
                seen.setdefault(view[at[w]].tobytes(), []).append(w)
            order[where] = np.concatenate([np.array(x) for x in seen.values()])
            flags = np.concatenate([np.arange(len(x)) > 0 for x in seen.values()])
            same[where] = flags
    return same


def count_windows(doc_id: np.ndarray, start: np.ndarray, ids: np.ndarray, length: np.ndarray, k: int) -> pa.RecordBatch | None:
    """Ranges of repeated windows in the super-k-mers of whole buckets: rows (doc_id, lo, hi, is_first, n_copies), hi being the last window."""
    order = np.lexsort((start, doc_id))
    doc_id, start = doc_id[order], start[order]
    begin = np.cumsum(length) - length
    begin, length = begin[order], length[order]
    run = length - k + 1
    at = ranges(begin, run)  # where a window's words are
    key = rolling(ids, k)[at]
    owner = np.repeat(np.arange(len(run)), run)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(run) - run, run)
    place = start[owner] + offset
    sort = np.argsort(key, kind="stable")  # stable: within equal windows by (doc_id, start)
    same = _same(ids, at, sort, key, k)
    group = np.cumsum(~same) - 1
    copies = np.bincount(group)
    head = sort[np.flatnonzero(~same)][group]
    n = np.empty(len(at), np.int64)
    first = np.empty(len(at), bool)
    n[sort] = copies[group]
    first[sort] = (doc_id[owner[head]] == doc_id[owner[sort]]) & (place[head] == place[sort])
    some = np.flatnonzero(n > 1)
    if not len(some):
        return None
    new = np.ones(len(some), bool)
    new[1:] = (some[1:] != some[:-1] + 1) | (owner[some[1:]] != owner[some[:-1]]) | (first[some[1:]] != first[some[:-1]])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(some)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id[owner[some[s]]]), pa.array(place[some[s]].astype(np.int64)), pa.array(place[some[e]].astype(np.int64)), pa.array(first[some[s]]), pa.array(np.maximum.reduceat(n[some], s))],
        ["doc_id", "lo", "hi", "is_first", "n_copies"],
    )


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows, last = 0, None

        def flush() -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held)
            raw, at = buffers(table.column("packed").cast(pa.large_binary()))  # may be more than 2 GB
            ids = np.ascontiguousarray(raw).view(np.uint32)
            return count_windows(table.column("doc_id").to_numpy(), table.column("start").to_numpy().astype(np.int64), ids, np.diff(at) // 4, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            size = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset : batch.column(3).offset + len(bucket) + 1] // 4
            begin = 0
            for c in cut[:-1]:
                if held or c > begin:
                    pending = windows + int(size[c] - size[begin])
                    if pending >= SORT_WINDOWS and bucket[c] != (bucket[c - 1] if c > begin else last):
                        if c > begin:
                            held.append(batch.slice(begin, c - begin))
                        out = flush()
                        held, windows, begin = [], 0, int(c)
                        if out is not None:
                            yield out
            held.append(batch.slice(begin))
            windows += int(size[-1] - size[begin])
            last = bucket[-1]
        if held:
            out = flush()
            if out is not None:
                yield out

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """All passages of k or more words that occur more than once: rows (doc_id, start_word, end_word, is_first, n_copies).

    Words are runs of letters, numbers and underscores in lower case, numbered from 0 in each
    text; end_word is the number after the last. is_first marks what holds the first
    occurrences of its windows (least doc_id, then least place), the other rows are copies;
    spans of either kind that touch or overlap are one. n_copies is the largest count among
    the span's windows. A text may repeat itself. Rows whose doc_id or text is null are left
    out; texts of fewer than k words have no window; rows that share a doc_id count as
    separate occurrences at the same place, all of them first if one is. Other columns are
    ignored. An empty table gives no rows. Buckets of more than `hot` super-k-mers are
    counted window by window, by 128 bits of hash, with the same result.
    """
    rows = _rows(docs)
    packed = rows.mapInArrow(_pack(k, m), "bucket bigint, doc_id bigint, start int, packed binary")
    large = Workspace(docs.sparkSession).save(rows.mapInArrow(_sizes(k, m), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("bucket"), "hot")
    some = not large.isEmpty()
    sent = (packed.join(large, "bucket", "left_anti") if some else packed).repartition("bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(_count(k), "doc_id bigint, lo bigint, hi bigint, is_first boolean, n_copies bigint")
    if some:
        found = found.unionByName(_hot_ranges(packed.join(large, "bucket", "left_semi"), k))
    # Ranges of windows from different buckets meet again by document.
    by = Window.partitionBy("doc_id", "is_first").orderBy("lo", "hi")
    seen = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)) + k
    island = found.withColumn("fresh", F.when(F.col("lo") <= seen, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("doc_id", "is_first", "island").agg(F.min("lo").alias("start_word"), (F.max("hi") + k).alias("end_word"), F.max("n_copies").alias("n_copies"))
    return spans.select("doc_id", "start_word", "end_word", "is_first", "n_copies")


def _cut(column: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of spans (start_word, end_word, is_first), but for those that spans with is_first hold too."""
    words = Words(column)
    first, last = original_spans(column, words)
    owner = spans.flatten()
    text = np.repeat(np.arange(len(column)), np.diff(np.asarray(spans.offsets)))
    start, end = (owner.field(k).to_numpy() + words.first[text] for k in ("start_word", "end_word"))
    keep_of = owner.field("is_first").to_numpy(zero_copy_only=False)
    covered = [np.zeros(len(words.hash) + 1, np.int64) for _ in range(2)]
    for kind in (0, 1):
        np.add.at(covered[kind], start[keep_of == kind], 1)
        np.add.at(covered[kind], end[keep_of == kind], -1)
    gone = (np.cumsum(covered[0]) > 0) & (np.cumsum(covered[1]) == 0)
    data, at = buffers(column)
    drop = np.zeros(len(data) + 1, np.int64)
    goes = np.flatnonzero(gone[:-1])
    np.add.at(drop, first[goes], 1)
    # What lies between two words that go goes with them, within a text.
    follow = np.isin(goes + 1, goes) & ~np.isin(goes + 1, words.first)
    np.add.at(drop, np.where(follow, first[np.minimum(goes + 1, len(first) - 1)], last[goes]), -1)
    keep = np.cumsum(drop[:-1]) == 0
    total = np.concatenate([[0], np.cumsum(keep)])[at]
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(total), pa.py_buffer(np.ascontiguousarray(data[keep]))]).cast(pa.string())


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """docs without the copies of repeated_spans: of every passage the first occurrence stays.

    Words go from the first byte of the first to the last byte of the last; those that a first
    occurrence in the same text needs stay. All rows and columns stay; null texts, rows with a
    null doc_id and texts without copies are unchanged. Rows that share a doc_id have the same
    spans removed, which is well defined only where their texts are equal; others keep theirs.
    """
    spans = repeated_spans(docs, k, m).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word", "is_first"))).alias("spans")).where(F.exists("spans", lambda s: ~s["is_first"]))
    several = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((F.count_distinct("text") > 1).alias("unlike")).where("unlike").select("id")
    spans = spans.join(several, F.col("doc_id") == F.col("id"), "left_anti").select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))

    @F.arrow_udf("string")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.concat_arrays([*(_cut(column.slice(s, e - s), spans.slice(s, e - s)) for s, e in runs(column)), pa.array([], pa.string())])

    joined = docs.join(spans, F.col("doc_id").cast("bigint") == F.col("__id"), "left")
    some = joined.where("__spans IS NOT NULL AND text IS NOT NULL").withColumn("text", cut(F.col("text").cast("string"), F.col("__spans")))
    return some.unionByName(joined.where("__spans IS NULL OR text IS NULL")).select(*docs.columns)


#: The same in SQL, for the default window.
SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT doc_id, unnest(range(0, len(words) - 49)) AS pos, words FROM docs WHERE len(words) >= 50),
hashed AS (SELECT doc_id, pos, md5(array_to_string(words[pos + 1:pos + 50], ' ')) AS h FROM windows),
marked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) = 1 AS is_first, count(*) OVER (PARTITION BY h) AS n FROM hashed),
repeated AS (SELECT * FROM marked WHERE n > 1),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_first ORDER BY pos) AS island FROM (
    SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, is_first ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM repeated))
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 50 AS BIGINT) AS end_word, is_first, CAST(max(n) AS BIGINT) AS n_copies
FROM islands GROUP BY doc_id, is_first, island
"""
