"""Array kernels over Arrow text columns: words, runs of words and their hashes, a whole batch at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel looks at together; a longer text is taken whole, alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASES = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64)
_powers_known = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base and of its inverse, modulo 2**64, in two rows."""
    global _powers_known
    if _powers_known.shape[1] < n:
        size = max(n, 2 * _powers_known.shape[1], CHUNK_BYTES + 1)
        steps = np.repeat(_BASES[:, None], size, axis=1)
        steps[:, 0] = 1
        _powers_known = np.multiply.accumulate(steps, axis=1)
    return _powers_known[:, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit word over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets of its rows in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive runs of rows with about `limit` bytes of text each."""
    _, offsets = buffers(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values; the result has len(x) - n + 1 items, or none."""
    m = max(len(x) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    factor = 0xD6E8FEB86659FD93
    for k in range(n if m else 0):
        out += x[k : k + m] * np.uint64(factor)
        factor = factor * 0xA0761D6478BD642F & (1 << 64) - 1 | 1
    return mix(out)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0] + 1, ... of every range, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(int(length.sum()), dtype=np.int64) + np.repeat(start - (ends - length), length)


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, words being what single spaces separate, and first[i]:first[i + 1] for those of text i."""
    data, offsets = buffers(column)
    n = len(data)
    word = data != 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[stop] - total[start]) * down[start]), np.searchsorted(start, offsets)


def distinct_runs(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of n words of each text, by text, and each text's number of runs. Fewer than n words are one run; none give none."""
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, 0)
    every = rolling(words, n)
    text, value = np.repeat(np.arange(len(count)), have), every[ranges(first[:-1], have)]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.array([int(rolling(words[first[i] : first[i + 1]], int(count[i]))[0]) ^ int(count[i]) for i in short], np.uint64)
        text, value = np.concatenate([text, short]), np.concatenate([value, mix(own)])
        have = have.copy()
        have[short] = 1
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh], have


def repeated_share(column: pa.Array, n: int) -> np.ndarray:
    """Share of runs of n words that repeat another one of the text; 0 for fewer than 2n words. Null is as empty."""
    out = []
    for s, e in runs(column):
        words, first = spaced(column.slice(s, e - s))
        text, _, have = distinct_runs(words, first, n)
        different = np.bincount(text, minlength=e - s)
        out.append(np.where(np.diff(first) >= 2 * n, 1 - different / np.maximum(have, 1), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


_MD5_ADD = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
_MD5_TURN = [np.uint32(s) for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turns * 4]
_MD5_WORD = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_MD5_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that are hashed together, so that their state stays in the cache; messages of more blocks of 64 bytes are hashed one by one.
_MD5_LOT, _MD5_BLOCKS = 16384, 4
#: By number of blocks, for each length: what of a message's bytes is kept, and the bit that follows them.
_MD5_KEPT = {n: np.where(np.arange(64 * n) < np.arange(64 * n)[:, None], 255, 0).astype(np.uint8) for n in range(1, _MD5_BLOCKS + 1)}
_MD5_END = {n: np.diag(np.full(64 * n, 0x80, np.uint8)) for n in range(1, _MD5_BLOCKS + 1)}


def _md5_round(state: list[np.ndarray], words: np.ndarray) -> None:
    """One block of many messages: words has 16 rows, state four."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _MD5_ADD[k]
        f += words[_MD5_WORD[k]]
        np.left_shift(f, _MD5_TURN[k], out=t)
        f >>= np.uint32(32) - _MD5_TURN[k]
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    for x, y in zip(state, (a, b, c, d)):
        x += y


def md5_heads(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first 8 bytes, as big-endian numbers, of the MD5 of every data[start:stop]."""
    out = np.empty(len(start), np.uint64)
    length = stop - start
    blocks = (length + 8) // 64 + 1
    padded = np.concatenate([data, np.zeros(64 * _MD5_BLOCKS, np.uint8)])
    for n in range(1, _MD5_BLOCKS + 1):
        every = np.flatnonzero(blocks == n)
        views = np.lib.stride_tricks.sliding_window_view(padded, 64 * n)
        for k in range(0, len(every), _MD5_LOT):
            lot = every[k : k + _MD5_LOT]
            own = views[start[lot]]
            own &= _MD5_KEPT[n][length[lot]]
            own |= _MD5_END[n][length[lot]]
            words = np.ascontiguousarray(own.view("<u4").T)
            words[-2] = length[lot] * 8
            state = [np.full(len(lot), x, np.uint32) for x in _MD5_FIRST]
            for b in range(n):
                _md5_round(state, words[16 * b : 16 * b + 16])
            out[lot] = state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()
    for k in np.flatnonzero(blocks > _MD5_BLOCKS):
        out[k] = int.from_bytes(md5(data[start[k] : stop[k]]).digest()[:8])
    return out


def spaced_runs(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) in bytes of every run of n words, words being what single spaces separate, and first[i]:first[i + 1] for those of text i. Fewer than n words are one run; no text may be empty."""
    gaps = np.flatnonzero(data == 32)
    starts, stops = np.sort(np.concatenate([offsets[:-1], gaps + 1])), np.sort(np.concatenate([gaps, offsets[1:]]))
    word = np.searchsorted(starts, offsets)
    have = np.maximum(np.diff(word) - n + 1, 1)
    at = ranges(word[:-1], have)
    return starts[at], stops[np.minimum(at + n, np.repeat(word[1:], have)) - 1], np.concatenate([[0], np.cumsum(have)])
