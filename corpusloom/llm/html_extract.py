"""HTML extraction: the contiguous region of a page that scores best is its content.

A page is a row of tokens: words, and tags by name. A word scores positive and a tag
negative; the region with the greatest sum is found in one linear scan of prefix sums.
The scores are log odds of a token inside against outside the content, learned from
labelled pages, that is pages which mark their content by one `article` or `main` element.
They are whole thousandths, so that sums are exact and ties well defined.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.kernels import arrow_map

#: Labelled pages that the scores are learned from at most: those of the least hashes of page_id.
TRAIN_PAGES = 2000
#: A word scores at least this, a tag at most its negative, in thousandths.
LEAST_SCORE = 100
#: Bytes of pages in one Arrow batch's work.
BATCH = 4 << 20

_NAMES = frozenset(
    "a abbr address area article aside audio b base blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q s samp script search section select "
    "small source span strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())

#: Comments, declarations, elements whose content is no text, and tags, which end at the next `>` however far it is. What is no tag is text, even a lone `<`.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*+>|<[!?/][^>]*+>",
    re.S | re.I,
)


def _ended(page: str) -> str:
    """The page without the `<` that no `>` follows, so that none is sought twice: a page of `<` alone takes linear time. Places stay the same; an unended comment stays."""
    last = page.rfind(">") + 1
    comment = page.find("<!--", last)
    comment = len(page) if comment < 0 else comment
    return page[:last] + page[last:comment].replace("<", " ") + page[comment:]


WORD, COMMENT = "word", "!"
#: Scores where no page is labelled, and of tags that no labelled page has.
DEFAULT = {WORD: 300, COMMENT: -3000}
UNSEEN = -1500
#: Pages whose labels can be trusted have exactly one of these.
_LABELS = ("article", "main")


def tokens(page: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """The page's tokens: (name, words, start, end). A run of text is one token `word` with its number of words; a closing tag has `/` before its name, an unknown one is `other`."""
    names: list[str] = []
    words: list[int] = []
    starts: list[int] = []
    ends: list[int] = []
    done = 0

    def text(to: int) -> None:
        if n := len(page[done:to].split()):
            names.append(WORD)
            words.append(n)
            starts.append(done)
            ends.append(to)

    for m in _TAG.finditer(_ended(page)):
        s = m.start()
        if s > done:
            text(s)
        raw, slash, name = m.groups()
        if name:
            name = name.lower()
            name = slash + (name if name in _NAMES else "other")
        else:
            name = raw.lower() if raw else COMMENT
        names.append(name)
        words.append(0)
        starts.append(s)
        done = m.end()
        ends.append(done)
    if done < len(page):
        text(len(page))
    return names, words, starts, ends


def labelled(names: list[str]) -> tuple[int, int] | None:
    """Between which tokens a page marks its content, if it has exactly one element that does so, closed."""
    for label in _LABELS:
        if names.count(label) == 1 and names.count("/" + label) == 1:
            s, e = names.index(label), names.index("/" + label)
            return (s + 1, e) if s < e else None
    return None


def _count(part: pa.RecordBatch) -> pa.RecordBatch | None:
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for page in part.column(1).to_pylist():
        names, words, _, _ = tokens(page)
        span = labelled(names)
        if span is None:
            continue
        for k, (name, n) in enumerate(zip(names, words)):
            to = inside if span[0] <= k < span[1] else outside
            to[name] = to.get(name, 0) + (n or 1)
    every = sorted({*inside, *outside})
    if not every:
        return None
    return pa.RecordBatch.from_arrays([pa.array(every), pa.array([inside.get(x, 0) for x in every], pa.int64()), pa.array([outside.get(x, 0) for x in every], pa.int64())], ["token", "inside", "outside"])


def scores(inside: dict[str, int], outside: dict[str, int]) -> dict[str, int]:
    """Log odds in thousandths, words positive and tags negative. The labels themselves score as a div would: pages without them must come out alike."""
    every = {*inside, *outside}
    if not every:
        return dict(DEFAULT)
    total_in, total_out = sum(inside.values()) + len(every), sum(outside.values()) + len(every)
    out = {}
    for x in every:
        odds = round(1000 * (math.log((inside.get(x, 0) + 1) / total_in) - math.log((outside.get(x, 0) + 1) / total_out)))
        out[x] = max(LEAST_SCORE, odds) if x == WORD else min(-LEAST_SCORE, odds)
    for label in _LABELS:
        for x in (label, "/" + label):
            out[x] = out.get(x.replace(label, "div"), UNSEEN)
    out.setdefault(WORD, DEFAULT[WORD])
    return out


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> dict[str, int]:
    """Scores learned from at most max_pages labelled pages, those of least hash of page_id; the defaults if there are none.

    Only pages with exactly one opening and one closing tag of a label count toward the limit,
    so labelled pages are found however rare they are. Rows with a null page_id or html don't
    take part; of hashes equal to the last one that counts all do.
    """
    key = F.xxhash64(F.col("page_id").cast("bigint"))

    def only(label: str):
        return (F.regexp_count("html", F.lit(rf"(?i)<{label}\b")) == 1) & (F.regexp_count("html", F.lit(rf"(?i)</{label}\b")) == 1)

    named = pages.where(F.col("page_id").isNotNull()).select(key.alias("h"), F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    known = named.where(F.col("html").rlike(f"(?i)<(?:{'|'.join(_LABELS)})\\b")).where(only(_LABELS[0]) | only(_LABELS[1]))
    cut = known.select("h").orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    if cut is None:
        return dict(DEFAULT)
    found = known.where(F.col("h") <= cut).select("page_id", "html").mapInArrow(arrow_map(_count, limit=BATCH), "token string, inside bigint, outside bigint").groupBy("token").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return scores({r.token: r.i for r in found}, {r.token: r.o for r in found})


def best_region(values: np.ndarray) -> tuple[int, int]:
    """(first, end) of the contiguous run of greatest sum: of equals the one that ends first, then the longest. (0, 0) if no sum is positive."""
    if not len(values):
        return 0, 0
    total = np.concatenate([[0], np.cumsum(values)])
    low = np.minimum.accumulate(total[:-1])
    gain = total[1:] - low
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(total[: end + 1] == low[end])[0]), end + 1


def extract(page: str, weights: dict[str, int]) -> tuple[str, int, int, int]:
    """(text, words, start, end) of the best region; start and end are places in the page. Blocks become lines, other tags vanish, references are resolved, white space is collapsed."""
    names, words, starts, ends = tokens(page)
    word = weights[WORD]
    get = weights.get
    values = np.array([n * word if n else get(x, UNSEEN) for x, n in zip(names, words)], np.int64)
    s, e = best_region(values)
    while s < e and not words[s]:
        s += 1
    if s >= e:
        return "", 0, 0, 0
    parts: list[str] = []
    for k in range(s, e):
        if words[k]:
            parts.append(html.unescape(page[starts[k] : ends[k]]).replace("\n", " "))
        elif names[k].lstrip("/") in _BLOCK:
            parts.append("\n")
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    text = "\n".join(x for x in lines if x)
    return text, len(text.split()), starts[s], ends[e - 1]


def _extract(weights: dict[str, int]):
    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [(None, 0, None, None) if p is None else extract(p, weights) for p in part.column(1).to_pylist()]
        text, n, start, end = zip(*out)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["page_id", "text", "n_words", "start_at", "end_at"])

    return arrow_map(fn, limit=BATCH)


def extract_pages(pages: DataFrame, weights: dict[str, int] | None = None, max_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row (page_id, text, n_words, start_at, end_at) for every row of pages; the region is html[start_at:end_at] in characters.

    Scores are learned from the table's labelled pages if none are given. A null html has a
    null text, start and end and no words; an empty one, or one without words, has an empty
    text at 0. Of regions with equal sums the one that ends first counts, then the longest.
    page_id may be null; repeated rows are extracted each by itself; pages of any length are
    scanned whole; other columns are not read. An empty table gives no rows.
    """
    weights = weights or train(pages, max_pages)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(weights), "page_id bigint, text string, n_words bigint, start_at bigint, end_at bigint")

