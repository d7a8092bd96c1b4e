"""Array kernels over Arrow text columns, shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of a whole run of rows at once, so that the
cost of Python is per batch and not per character, word or document.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.functions.kernels import CHUNK_BYTES, buffers, mix, powers, ranges, rolling


@lru_cache(1)
def _word_table() -> np.ndarray:
    """For each code point, whether it is a letter, a number or the underscore."""
    table = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        table[c] = c == 95 or unicodedata.category(chr(c))[0] in "LN"
    for s in range(0, sys.maxunicode + 1, 1 << 14):  # all at once would be 200 MB of objects in each worker
        points = np.array([c for c in range(s, s + (1 << 14)) if not 0xD800 <= c < 0xE000], np.int64)
        lower = np.array([ord(x) for x in pc.utf8_lower(pa.array([chr(c) for c in points], pa.string())).to_pylist()], np.int64)
        table[points] |= table[lower]  # a letter that only Arrow's newer tables know
    return table


def chunks(batch: pa.RecordBatch, text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def classes(data: np.ndarray) -> np.ndarray:
    """For each byte of valid UTF-8, whether the character that it belongs to is part of a word."""
    table = _word_table()
    word = np.zeros(256, bool)
    word[:128] = table[:128]
    out = word[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        wide = data.astype(np.uint32) if len(high) * 8 > len(data) else None
        padded = np.concatenate([wide if wide is not None else data, np.zeros(3, data.dtype)])
        lead = padded[high].astype(np.uint32)
        b1, b2, b3 = (padded[high + k].astype(np.uint32) & 63 for k in (1, 2, 3))
        two, three = lead < 0xE0, (lead >= 0xE0) & (lead < 0xF0)
        point = np.where(two, (lead & 31) << 6 | b1, np.where(three, (lead & 15) << 12 | b1 << 6 | b2, (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        yes = table[np.minimum(point, sys.maxunicode)]
        out[high] = yes
        for k, of in ((1, lead >= 0xC0), (2, lead >= 0xE0), (3, lead >= 0xF0)):
            at = high[of] + k
            inside = at < len(data)
            out[at[inside]] = yes[of][inside]
    return out


class Words:
    """The words of a run of texts, in order: hash (uint64), first byte, byte after the last, and first[i]:first[i + 1] for text i."""

    __slots__ = ("first", "hash", "start", "stop")

    def __init__(self, column: pa.Array):
        data, offsets = buffers(pc.utf8_lower(column))
        n = len(data)
        inside = classes(data)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[offsets[:-1][offsets[:-1] < n]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.stop = np.flatnonzero(inside & ~after) + 1
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.stop] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, offsets)


def original_spans(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' first and last bytes in the texts as they are. Lower case may be of another length; then the words are found anew."""
    data, offsets = buffers(column)
    inside = classes(data)
    n = len(data)
    before = np.concatenate([[False], inside[:-1]]) if n else np.zeros(0, bool)
    after = np.concatenate([inside[1:], [False]]) if n else np.zeros(0, bool)
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if len(start) != len(words.start) or (np.searchsorted(start, offsets) != words.first).any():
        raise ValueError("lower case changed the words")
    return start, stop


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, and offsets by text. A text of 1 to n - 1 words has one gram: all its words."""
    count = np.diff(words.first)
    every = rolling(words.hash, n)
    have = np.maximum(count - n + 1, 0)
    g = every[ranges(words.first[:-1], have)]
    doc = np.repeat(np.arange(len(count)), have)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([mix(np.array([int(rolling(words.hash[words.first[i] : words.first[i + 1]], int(count[i]))[0]) ^ int(count[i])], np.uint64))[0] for i in short], np.uint64)
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[fresh], doc[fresh]
    return g, np.searchsorted(doc, np.arange(len(count) + 1))


def arrow_map(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int = 1, limit: int = CHUNK_BYTES):
    """A function for mapInArrow that calls fn on runs of rows of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run
