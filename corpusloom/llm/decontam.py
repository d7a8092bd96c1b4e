"""Benchmark decontamination: spans of training text that occur in test items are found and removed.

The normalised items are compiled into a generalised suffix automaton over word numbers.
Each text streams through it word by word; the automaton keeps the longest match that ends
at the word. A match is removed if it is too long, or covers too much of an item:

* length limit: `max_words` consecutive words of one item;
* coverage limit: `coverage` of an item's words, but at least `min_words` of them.

So an item of n words has one least length, min(max_words, max(min_words, ceil(coverage * n))).
Words that no item has reset the automaton; runs of known words that are shorter than every
item's least length cannot match and are passed over without a step in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import Words, buffers, original_spans

MAX_WORDS = 10
COVERAGE = 0.5
MIN_WORDS = 5
#: Items are split among automata of about this many words, so that none is too large to send.
AUTOMATON_WORDS = 300_000


def least_length(n: int, max_words: int = MAX_WORDS, coverage: float = COVERAGE, min_words: int = MIN_WORDS) -> int:
    return min(max_words, max(min_words, math.ceil(coverage * n - 1e-9)))


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences. least[s]: the smallest least length among the items that state s occurs in."""

    def __init__(self, items: Iterable[np.ndarray], limits: Iterable[int]):
        items = list(items)
        self.vocabulary = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
        self.width = max(1, len(self.vocabulary))
        self.next: dict[int, int] = {}
        self.link, self.length, self.least = [-1], [0], [1 << 30]
        out: list[dict[int, int]] = [{}]
        for item, limit in zip(items, limits):
            last = 0
            for word in np.searchsorted(self.vocabulary, item).tolist():
                last = self._extend(out, last, word)
                self.least[last] = min(self.least[last], limit)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])
        self.next = {s * self.width + word: to for s, own in enumerate(out) for word, to in own.items()}
        self.floor = self.least[0] if len(self.length) > 1 else 1 << 30

    def _state(self, out: list[dict[int, int]], length: int, link: int, own: dict[int, int], least: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        out.append(own)
        return len(out) - 1

    def _split(self, out: list[dict[int, int]], p: int, q: int, word: int) -> int:
        clone = self._state(out, self.length[p] + 1, self.link[q], dict(out[q]), self.least[q])
        while p >= 0 and out[p].get(word) == q:
            out[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, out: list[dict[int, int]], last: int, word: int) -> int:
        q = out[last].get(word)
        if q is not None:  # another item came here before
            return q if self.length[q] == self.length[last] + 1 else self._split(out, last, q, word)
        new, p = self._state(out, self.length[last] + 1, 0, {}, 1 << 30), last
        while p >= 0 and word not in out[p]:
            out[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = out[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(out, p, q, word)
        return new

    def matches(self, words: list[int]) -> list[tuple[int, int]]:
        """Spans (first word, word after the last) that reach some item's least length: of each end the longest."""
        found = []
        step, link, length, least, width, floor = self.next.get, self.link, self.length, self.least, self.width, self.floor
        state = size = 0
        for i, word in enumerate(words):
            to = step(state * width + word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step(state * width + word)
            if to is None:
                continue
            state = to
            size += 1
            if size >= floor:
                s, n = state, size
                while n >= floor:
                    if n >= least[s]:
                        found.append((i + 1 - n, i + 1))
                        break
                    s = link[s]
                    n = length[s]
        return found

    def mark(self, words: Words, covered: np.ndarray) -> None:
        """Set covered at the words of all matches."""
        if not len(self.vocabulary):
            return
        spot = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == words.hash
        new = np.zeros(len(known) + 1, bool)  # runs end with a text
        new[words.first] = True
        before = np.concatenate([[False], known[:-1]])
        start = np.flatnonzero(known & (~before | new[:-1]))
        after = np.concatenate([known[1:], [False]])
        stop = np.flatnonzero(known & (~after | new[1:])) + 1
        long_ = stop - start >= self.floor
        for s, e in zip(start[long_].tolist(), stop[long_].tolist()):
            for a, b in self.matches(spot[s:e].tolist()):
                covered[s + a : s + b] = True


def build(benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, min_words: int = MIN_WORDS) -> list:
    """Broadcast automata of the items' texts. Items without text or of fewer than min_words words are left out; repeated items count once."""
    automata, items, size = [], [], 0
    context = benchmark.sparkSession.sparkContext

    def close() -> None:
        limits = [least_length(len(x), max_words, coverage, min_words) for x in items]
        automata.append(context.broadcast(SuffixAutomaton(items, limits)))

    for row in benchmark.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct().toLocalIterator():
        item = Words(pa.array([row.text])).hash
        if len(item) < min_words:
            continue
        if items and size + len(item) > AUTOMATON_WORDS:
            close()
            items, size = [], 0
        items.append(item)
        size += len(item)
    close()
    return automata


def _covered(column: pa.Array, automata: list) -> tuple[Words, np.ndarray]:
    words = Words(column)
    covered = np.zeros(len(words.hash), bool)
    for a in automata:
        a.value.mark(words, covered)
    return words, covered


def _islands(words: Words, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of consecutive covered words within a text, as word numbers of the whole run."""
    new = np.zeros(len(covered) + 1, bool)
    new[words.first] = True
    before = np.concatenate([[False], covered[:-1]])
    after = np.concatenate([covered[1:], [False]])
    return np.flatnonzero(covered & (~before | new[:-1])), np.flatnonzero(covered & (~after | new[1:])) + 1


def _pieces(column: pa.Array, limit: int = 1 << 20):
    _, at = buffers(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield column.slice(start, end - start)
        start = end


def span_column(text: Column, automata: list) -> Column:
    """The spans (start_word, end_word) to remove from each text, in order; none for null."""

    @F.arrow_udf("array<struct<start_word:bigint,end_word:bigint>>")
    def spans(column: pa.Array) -> pa.Array:
        at, starts, ends = [0], [], []
        for part in _pieces(column):
            words, covered = _covered(part, automata)
            start, stop = _islands(words, covered)
            owner = np.searchsorted(words.first, start, "right") - 1
            starts.append(start - words.first[owner])
            ends.append(stop - words.first[owner])
            at += (np.cumsum(np.bincount(owner, minlength=len(part))) + at[-1]).tolist()
        pair = pa.StructArray.from_arrays([pa.array(np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)]).astype(np.int64))], ["start_word", "end_word"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pair)

    return spans(text.cast("string"))


def clean_column(text: Column, automata: list) -> Column:
    """Each text without the spans to remove, from the first byte of the first word to the last of the last. Null stays null; a text without such spans stays as it is."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for part in _pieces(column):
            words, covered = _covered(part, automata)
            if not covered.any():
                out.append(part.cast(pa.string()))
                continue
            start, stop = _islands(words, covered)
            data, at = buffers(part)
            first, last = original_spans(part, words)
            drop = np.zeros(len(data) + 1, np.int32)
            np.add.at(drop, first[start], 1)
            np.add.at(drop, last[stop - 1], -1)
            keep = np.cumsum(drop[:-1]) == 0
            length = np.add.reduceat(np.append(keep, False), np.minimum(at[:-1], len(keep))) * (np.diff(at) > 0)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            valid = pa.array(part.is_valid().to_numpy(zero_copy_only=False))
            rebuilt = pa.Array.from_buffers(pa.string(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
            out.append(pa.compute.if_else(valid, rebuilt, pa.scalar(None, pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return clean(text.cast("string"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """The spans to remove: rows (doc_id, start_word, end_word); clean documents have none.

    Words are runs of letters, numbers and underscores in lower case, numbered from 0;
    end_word is the number after the last. Spans that touch or overlap are one. A doc_id may
    be null; a null text has no spans, nor has an empty one. Each row is judged by itself, so
    repeated rows give repeated spans. Items that are null or shorter than min_words match
    nothing. Other columns are ignored. An empty table on either side gives no rows.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), span_column(F.col("text"), build(benchmark, max_words, coverage, min_words)).alias("spans"))
    return found.where(F.size("spans") > 0).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start_word", "s.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the spans of contaminated_spans cut from their text. All rows and columns stay; clean texts, null and empty ones too, are unchanged."""
    return docs.withColumn("text", clean_column(F.col("text"), build(benchmark, max_words, coverage, min_words)))


#: The same in SQL, for the default limits.
SQL = r"""
WITH items AS (
  SELECT words, CAST(least(10, greatest(5, ceil(0.5 * len(words)))) AS BIGINT) AS need FROM (
    SELECT list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
    FROM benchmark WHERE text IS NOT NULL) WHERE len(words) >= 5),
item_grams AS (
  SELECT DISTINCT need, array_to_string(words[pos + 1:pos + need], ' ') AS gram FROM (
    SELECT need, words, unnest(range(0, len(words) - need + 1)) AS pos FROM items WHERE len(words) >= need)),
docs AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL),
places AS (
  SELECT doc_id, need, words, unnest(range(0, len(words) - need + 1)) AS pos
  FROM docs, (SELECT DISTINCT need FROM items) WHERE len(words) >= need),
hits AS (
  SELECT doc_id, pos, p.need FROM places p JOIN item_grams g ON p.need = g.need AND array_to_string(p.words[pos + 1:pos + p.need], ' ') = g.gram),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + need)) AS pos FROM hits),
islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM covered)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + 1 AS BIGINT) AS end_word FROM islands GROUP BY doc_id, island
"""
