"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters,
rho(rho(a)) * rho(b) * c with rho a rotation by one place, and a text's vector bundles
those of its trigrams by sum. A language's prototype bundles the vectors of labelled
texts; a text is compared with every prototype by cosine.

A batch is encoded as one product: trigram counts (texts, trigrams) by trigram vectors
(trigrams, dimensions), a block of trigrams at a time.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.kernels import buffers, mix, runs
from corpusloom.llm.kernels import arrow_map

DIMENSIONS = 1024
#: Labelled texts per language that a prototype is made from, the least by hash of their id.
TRAIN_PER_LANGUAGE = 500
#: Languages that have a prototype, the most frequent by labelled rows.
MOST_LANGUAGES = 1000
#: A text is rejected if no prototype's cosine reaches this: four standard deviations of a random vector's cosine.
MIN_COSINE = 4 / DIMENSIONS**0.5
#: With fewer trigrams less is asked, as a short text's own cosine grows with the root of their number.
FULL_TRIGRAMS = 40
#: Trigrams whose vectors are made together.
BLOCK = 4096


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """Each code point's symbol: 0 for what is not a letter. Beyond 65,535 letters symbols are shared."""
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = c if c < 65536 else c % 65535 + 1
    return table


def _vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """The letters' vectors of +1 and -1, the same in every process."""
    with np.errstate(over="ignore"):
        seed = mix(symbols.astype(np.uint64) + np.uint64(0x51ED270B35AC9A11))
        bits = mix(seed[:, None] + np.arange(dimensions // 64, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count), sorted by text; a trigram is three symbols of 16 bits. What is not a letter counts as one space; a text begins and ends with a space."""
    data, offsets = buffers(pc.utf8_lower(column))
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    first = b[at]
    point = first.astype(np.uint32)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        spot = at[wide]
        x, y, z, w = first[wide].astype(np.uint32), *(b[spot + k].astype(np.uint32) & 63 for k in (1, 2, 3))
        point[wide] = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))
    symbol = _letter_table()[np.minimum(point, sys.maxunicode)]
    texts = len(offsets) - 1
    begin = np.searchsorted(at, offsets)
    # A space before each text and after the last one; then runs of spaces become one.
    symbol = np.insert(symbol, begin, 0)
    begin = begin + np.arange(texts + 1)
    doc = np.repeat(np.arange(texts + 1), np.diff(np.append(begin, len(symbol))))
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0)
    symbol, doc = symbol[keep].astype(np.uint64), doc[keep].astype(np.uint64)
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # The space that ends a text also begins the next one, so no trigram but those around it spans two texts.
    middle = symbol[1:-1] != 0
    key = (doc[1:-1] << np.uint64(48) | symbol[:-2] << np.uint64(32) | symbol[1:-1] << np.uint64(16) | symbol[2:])[middle]
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[head] >> np.uint64(48)).astype(np.int64), key[head] & np.uint64((1 << 48) - 1), np.diff(np.append(head, len(key)))


def encode(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' vectors (texts, dimensions), and how many trigrams each has."""
    doc, code, count = trigrams(column)
    total = np.bincount(doc, count, len(column))
    out = np.zeros((len(column), dimensions), np.float32)
    every, number = np.unique(code, return_inverse=True)
    order = np.argsort(number, kind="stable")
    doc, number, count = doc[order], number[order], count[order]
    for s in range(0, len(every), BLOCK):
        block = every[s : s + BLOCK]
        a, b, c = (((block >> np.uint64(k)) & np.uint64(0xFFFF)) for k in (32, 16, 0))
        used, spot = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        letters = _vectors(used, dimensions)
        i, j, k = np.split(spot, 3)
        vectors = np.roll(letters, 2, axis=1)[i]
        vectors *= np.roll(letters, 1, axis=1)[j]
        vectors *= letters[k]
        lo, hi = np.searchsorted(number, (s, s + len(block)))
        counts = np.zeros((len(column), len(block)), np.float32)
        counts[doc[lo:hi], number[lo:hi] - s] = count[lo:hi]
        out += counts @ vectors.astype(np.float32)
    return out, total


class Prototypes:
    """Languages and their unit vectors."""

    def __init__(self, languages: list[str], vectors: np.ndarray):
        self.languages, self.vectors = languages, vectors

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the best prototype's number (the first of equals), its cosine, and the share of the limit that it must reach; -1 and NaN without letters or prototypes."""
        best, cosine, share = np.full(len(column), -1), np.full(len(column), np.nan), np.ones(len(column))
        if not self.languages:
            return best, cosine, share
        v, total = encode(column, self.vectors.shape[1])
        v = v.astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        some = norm > 0
        cos = v[some] @ self.vectors.T / norm[some, None]
        best[some], cosine[some] = cos.argmax(axis=1), cos.max(axis=1)
        return best, cosine, np.sqrt(np.minimum(total / FULL_TRIGRAMS, 1))


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, dimensions: int = DIMENSIONS, most_languages: int = MOST_LANGUAGES) -> Prototypes:
    """Prototypes of the languages in docs.lang, each from at most per_language texts (least hash of doc_id).

    At most most_languages have one, those with the most labelled rows (of equals the first
    by name), so what is sent to the tasks and kept on the driver is bounded by these two
    parameters. Rows with a null doc_id, text or lang don't take part, nor do they count.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").join(F.broadcast(frequent), "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang").distinct()
    # Bounded by the two parameters: 8 MB of ids by default.
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")

    def bundle(part: pa.RecordBatch) -> pa.RecordBatch:
        v = encode(part.column(1), dimensions)[0].astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        unit = np.rint(v / np.maximum(norm, 1)[:, None] * 1e6).astype(np.int64)  # whole numbers: any order of summing gives the same
        names = np.array(part.column(2).to_pylist())
        each = sorted(set(names.tolist()))
        return pa.RecordBatch.from_arrays([pa.array(each), pa.array([unit[names == x].sum(axis=0) for x in each], pa.list_(pa.int64()))], ["lang", "sum"])

    sums: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(arrow_map(bundle), "lang string, sum array<bigint>").toLocalIterator():
        sums[row.lang] = sums.get(row.lang, 0) + np.array(row["sum"], np.int64)
    languages = sorted(k for k, v in sums.items() if v.any())
    vectors = np.array([sums[k] / np.sqrt((sums[k].astype(np.float64) ** 2).sum()) for k in languages]).reshape(len(languages), dimensions)
    return Prototypes(languages, vectors)


def language_column(text: Column, prototypes: Prototypes, min_cosine: float = MIN_COSINE) -> Column:
    """A struct (lang, cosine, accepted): the nearest prototype, its cosine, and whether that reaches min_cosine, or less by the root of its trigrams' number over FULL_TRIGRAMS where it has fewer. Without a letter, and for null, lang and cosine are null and accepted is false."""
    held = prototypes

    @F.arrow_udf("struct<lang:string,cosine:double,accepted:boolean>")
    def judge(column: pa.Array) -> pa.Array:
        found = [held.judge(column.slice(s, e - s)) for s, e in runs(column)]
        b, c, share = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((int, float, float), zip(*found) if found else ((), (), ())))
        names = pa.array([*held.languages, None], pa.string()).take(pa.array(np.where(b < 0, len(held.languages), b)))
        return pa.StructArray.from_arrays([names, pa.array(c, mask=b < 0), pa.array((b >= 0) & (c >= min_cosine * share))], ["lang", "cosine", "accepted"])

    return judge(text.cast("string"))


def identify(docs: DataFrame, prototypes: Prototypes | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row (doc_id, detected, cosine, accepted) for every row of docs; prototypes are trained on docs.lang if none are given.

    A null or empty text, one without letters, and every text if there are no prototypes, has
    detected and cosine null and accepted false. doc_id may be null; repeated rows are judged
    each by itself. Of equal cosines the first language by name counts. Other columns are
    ignored. An empty table gives no rows.
    """
    prototypes = prototypes or train(docs)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), language_column(F.col("text"), prototypes, min_cosine).alias("l")).select("doc_id", F.col("l.lang").alias("detected"), "l.cosine", "l.accepted")


def keep_accepted(docs: DataFrame, prototypes: Prototypes | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """The rows of docs that identify accepts, with all their columns."""
    return docs.where(language_column(F.col("text"), prototypes or train(docs), min_cosine).getField("accepted"))
