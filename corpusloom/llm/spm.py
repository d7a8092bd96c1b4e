"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (a space becomes U+2581, and one is put in front) and starts as a row of
characters. An agenda holds the adjacent pairs of symbols whose union is a piece, ordered
by the piece's score, then from left to right; the best pair is merged and its new
neighbours join the agenda, until it is empty. What is no piece then goes as bytes.

A piece of such a vocabulary has U+2581 only at its start. A merge therefore never crosses
from a character to a following U+2581, so a text falls into segments (a run of U+2581 and
the characters after it) that are encoded one by one, and each distinct segment of a batch
once. Segments of equal length are merged together: their agendas are the rows of one
matrix of priorities, and a round takes the best of every row. Long segments, and those with
characters that the vocabulary lacks, have a heap each.

In every Arrow batch each whole text is encoded by the sentencepiece library too, and the
two rows of numbers are compared.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.kernels import buffers, ranges, runs

SPACE = "▁"
#: Longer segments have an agenda of their own.
LONG = 48
#: Bytes of text whose distinct segments are encoded together, and of text that is compared together.
BATCH, COMPARED = 2 << 20, 1 << 19

_NEVER = np.int32(2**31 - 1)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; 32-bit floats are left as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        yield key >> 3, data[at : at + n]
        at += n


class Vocabulary:
    """The pieces, scores and options of a model file of the merge type."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], np.float32)[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the merge type")
        if normal.get(1, b"identity") not in (b"identity", b"") or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models without normalisation are read: identity, spaces kept and escaped in front")
        self.dummy = bool(normal.get(3, 1))
        self.number = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        steps = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.number.values()}, reverse=True))}
        self.order = {p: steps[self.scores[i]] for p, i in self.number.items()}  # the better the score, the lower
        if any(SPACE in p.lstrip(SPACE) for p in self.number) or USER in self.kinds:
            raise ValueError("pieces that hold a space after a character are not handled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.bytes) not in (0, 256):
            raise ValueError("some byte pieces are missing")

        # Symbols are the pieces by number, and after them the characters within pieces that are none themselves.
        symbols = dict(self.number)
        for p in self.number:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.symbol_of = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, k in symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = k
        pairs = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], self.order[p], i) for p, i in self.number.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair = np.array([k for k, _, _ in pairs] + [1 << 62], np.int64)
        self.priority = np.array([o for _, o, _ in pairs] + [_NEVER], np.int32)
        self.union = np.array([i for _, _, i in pairs] + [0], np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priorities of pairs, _NEVER for those that are no piece, and the pieces."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.priority[at], _NEVER), self.union[at]

    def segments(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of many escaped segments, given as code points and lengths, and how many each has."""
        begin = np.cumsum(sizes) - sizes
        symbol = self.symbol_of[points]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # segments, and a matrix of their numbers
        left = sizes > 0

        def text(k: int) -> str:
            return points[begin[k] : begin[k] + sizes[k]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")

        for n in np.unique(sizes[left & (sizes <= LONG)]).tolist():
            every = np.flatnonzero(sizes == n)
            for s in range(0, len(every), 1 << 15):
                self._merge(every[s : s + (1 << 15)], symbol[begin[every[s : s + (1 << 15)], None] + np.arange(n)], text, found)
        for rows, _ in found:
            left[rows] = False
        for k in np.flatnonzero(left).tolist():
            found.append((np.array([k]), np.array([self.segment(text(k))], np.int32)))
        count = np.zeros(len(sizes), np.int64)
        for rows, numbers in found:
            count[rows] = numbers.shape[1]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for rows, numbers in found:
            out[start[rows][:, None] + np.arange(numbers.shape[1])] = numbers
        return out, count

    def _merge(self, rows: np.ndarray, symbols: np.ndarray, text: Callable[[int], str], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Merge the rows of a matrix of symbols, one pair of each in a round, into found. Characters that the vocabulary lacks are -1, in no pair; rows with a character that only longer pieces have are left."""
        keep = (symbols < len(self.pieces)).all(axis=1)
        rows, symbols = rows[keep], symbols[keep]
        agenda, union = self._look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            best = agenda.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            more = agenda[each, best] != _NEVER if width > 1 else np.zeros(len(rows), bool)
            if not more.all():
                done, numbers = rows[~more], symbols[~more]
                whole = (numbers >= 0).all(axis=1)
                found.append((done[whole], numbers[whole]))
                for k in np.flatnonzero(~whole).tolist():
                    lacking = iter([c for c in text(done[k]) if self.symbol_of[ord(c)] < 0])
                    found.append((done[k : k + 1], np.array([[i for x in numbers[k].tolist() for i in ((x,) if x >= 0 else self._raw(next(lacking)))]], np.int32)))
                rows, symbols, agenda, union, best = rows[more], symbols[more], agenda[more], union[more], best[more]
                each = each[: len(rows)]
            if not len(rows):
                return
            symbols[each, best] = union[each, best]
            # One column goes from each row: what stands after the merged pair moves up.
            symbols = symbols[np.arange(width) != best[:, None] + 1].reshape(len(rows), width - 1)
            gone = np.arange(width - 1) != best[:, None]
            agenda, union = agenda[gone].reshape(len(rows), width - 2), union[gone].reshape(len(rows), width - 2)
            for at, some in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = np.flatnonzero(some), at[some]
                agenda[r, c], union[r, c] = self._look_up(symbols[r, c], symbols[r, c + 1])

    def segment(self, text: str) -> list[int]:
        """The numbers of an escaped segment's pieces, by an agenda of adjacent pairs."""
        symbols = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        find = self.order.get
        # An entry is the pair's priority and the place of its left symbol in one number.
        agenda = [p << 32 | k for k in range(n - 1) if (p := find(symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            a = entry & 0xFFFFFFFF
            own, b = symbols[a], right[a]
            if not own or b < 0 or find(piece := own + symbols[b]) != entry >> 32:
                continue  # one side has been merged since
            symbols[a], symbols[b] = piece, ""
            c = right[a] = right[b]
            if c >= 0:
                left[c] = a
                if (p := find(piece + symbols[c])) is not None:
                    heapq.heappush(agenda, p << 32 | a)
            c = left[a]
            if c >= 0 and (p := find(symbols[c] + piece)) is not None:
                heapq.heappush(agenda, p << 32 | c)
        out: list[int] = []
        for s in symbols:
            if not s:
                continue
            if s in self.number:
                out.append(self.number[s])
            else:
                out += self._raw(s)
        return out

    def _raw(self, character: str) -> list[int]:
        """The numbers of what is no piece: its bytes, if the model has them."""
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]


class Codec:
    """Encoder and decoder of one model, with the library."""

    def __init__(self, model: bytes, checked: bool = True):
        self.vocabulary = Vocabulary(model)
        self.library = None
        if checked:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        v = self.vocabulary
        shown = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum(list(map(len, shown)))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts, and the offsets of each text's; null is as empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        none, front = (pa.scalar(x, pa.large_string()) for x in ("", " " if self.vocabulary.dummy else ""))
        flat = pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(front, pc.replace_substring(column, SPACE, " "), none))
        data, offsets = buffers(flat)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        # A segment begins with a text, and with a space after what is none.
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        begin[offsets] = True
        at = np.flatnonzero(begin)
        segments = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own, _ = buffers(segments.dictionary)
        points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
        numbers, size = self.vocabulary.segments(np.where(points == 32, np.uint32(ord(SPACE)), points), pc.utf8_length(segments.dictionary).to_numpy().astype(np.int64))
        index = segments.indices.to_numpy()
        ids = numbers[ranges((np.cumsum(size) - size)[index], size[index])]
        return ids, np.concatenate([[0], np.cumsum(size[index])])[np.searchsorted(at, offsets)]

    def agree(self, column: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether the library gives the same numbers for each whole text."""
        out: list[bool] = []
        for first, end in runs(column, COMPARED):
            theirs = self.library.encode([t or "" for t in column.slice(first, end - first).to_pylist()], num_threads=1)
            out += [x == ids[s:e].tolist() for x, s, e in zip(theirs, offsets[first:end].tolist(), offsets[first + 1 : end + 1].tolist())]
        return out

    def _bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that numbers stand for, without the space in front, and their offsets by text."""
        size = np.diff(self.shown_at)[ids]
        data = self.shown[ranges(self.shown_at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        if not self.vocabulary.dummy:
            return data, at
        some = at[:-1] < at[1:]
        lead = np.zeros(len(at) - 1, bool)
        lead[some] = data[at[:-1][some]] == 32
        keep = np.ones(len(data), bool)
        keep[at[:-1][lead]] = False
        return data[keep], at - np.concatenate([[0], np.cumsum(lead)])

    def round_trip(self, column: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the numbers stand for the text again."""
        parts = [self._same(column.slice(s, e - s), ids[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]) for s, e in runs(column, COMPARED)]
        return np.concatenate([np.zeros(0, bool), *parts])

    def _same(self, column: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, at = self._bytes(ids, offsets)
        text, own = buffers(column)
        same = np.diff(at) == np.diff(own)
        some = np.flatnonzero(same & (np.diff(own) > 0))
        size = np.diff(own)[some]
        if len(some):
            equal = data[ranges(at[some], size)] == text[ranges(own[some], size)]
            same[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return same

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of numbers. Bytes that are no valid UTF-8 become U+FFFD."""
        return self._bytes(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


@lru_cache(4)
def codec(model: bytes, checked: bool = True) -> Codec:
    return Codec(model, checked)


def _sent(path: str):
    """The model file's bytes, read on the driver and sent to the tasks; executors need no path."""
    session = SparkSession.active()
    with open(path, "rb") as f:
        return session.sparkContext.broadcast(f.read())


def encode_column(text: Column, path: str, checked: bool = True) -> Column:
    """A struct (ids, agrees, round_trip) for each text; null for null. agrees: the library gives the same numbers (null if unchecked); round_trip: the numbers decode to the text."""

    held = _sent(path)

    @F.arrow_udf("struct<ids:array<int>,agrees:boolean,round_trip:boolean>")
    def encode(column: pa.Array) -> pa.Array:
        own = codec(held.value, checked)
        valid = column.is_valid()
        parts = []
        for start, end in runs(column, BATCH):
            part = column.slice(start, end - start)
            ids, cuts = own.encode(part)
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
            agrees = own.agree(part, ids, cuts) if checked else [None] * len(part)
            parts.append(pa.StructArray.from_arrays([lists, pa.array(agrees, pa.bool_()), pa.array(own.round_trip(part, ids, cuts))], ["ids", "agrees", "round_trip"], mask=pc.invert(valid.slice(start, end - start))))
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("agrees", pa.bool_()), ("round_trip", pa.bool_())])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encode(text.cast("string"))


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of numbers; null for null. A number outside the vocabulary raises an error."""

    held = _sent(path)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        own = codec(held.value, False)
        return pa.array([None if x is None else own.decode(x) for x in column.to_pylist()], pa.string())

    return decode(ids.cast("array<int>"))


def encode_documents(docs: DataFrame, path: str, checked: bool = True) -> DataFrame:
    """One row (doc_id, n_tokens, ids, agrees, round_trip) for every row of docs.

    An empty text has no numbers. For a null text n_tokens, ids, agrees and round_trip are
    null. doc_id may be null; repeated rows are encoded each by itself; other columns are
    ignored. An empty table gives no rows.
    """
    coded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), encode_column(F.col("text"), path, checked).alias("e"))
    return coded.select("doc_id", F.when(F.col("e.ids").isNotNull(), F.size("e.ids")).cast("bigint").alias("n_tokens"), "e.ids", "e.agrees", "e.round_trip")
