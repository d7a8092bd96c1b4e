"""Plain text from files of a known or a guessed format, and chunks of it."""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SHORTEST_STRING, LEAST_WORDS, MOST_ITEMS = 24, 4, 50
SHORTEST_RESULT = 80
_ID = re.compile(r"^[0-9a-fA-F\-_:./+]+$")


def textish(value: str) -> bool:
    """Whether a string is prose rather than a number or an identifier."""
    return len(value) >= SHORTEST_STRING and len(value.split()) >= LEAST_WORDS and not _ID.match(value)


def strings_in(value) -> list[str]:
    """The prose in a JSON value, in order; of a list the first MOST_ITEMS items."""
    if isinstance(value, str):
        return [value] if textish(value) else []
    if isinstance(value, dict):
        return [x for v in value.values() for x in strings_in(v)]
    if isinstance(value, list):
        return [x for v in value[:MOST_ITEMS] for x in strings_in(v)]
    return []


def from_json(text: str) -> str:
    out = []
    try:
        out = strings_in(json.loads(text))
    except ValueError:
        for line in text.split("\n"):
            try:
                out += strings_in(json.loads(line))
            except ValueError:
                continue
    return "\n".join(out)


def from_delimited(text: str, separator: str = ",", rows: int = 200, probe: int = 40) -> str:
    """The cells of columns that hold prose: in their first `probe` rows at least a third, at most five."""
    table = list(csv.reader(io.StringIO(text), delimiter=separator))[: rows + 1]
    if not table:
        return ""
    width = max(map(len, table))
    body = table[1:]
    head = body[:probe]
    need = max(1, min(5, len(head) // 3))
    kept = [c for c in range(width) if sum(c < len(r) and textish(r[c]) for r in head) >= need]
    return "\n".join(r[c] for r in body for c in kept if c < len(r) and r[c].strip())


def json_text(text: Column) -> Column:
    """The prose in JSON documents or lines."""

    @F.arrow_udf("string")
    def walk(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else from_json(t) for t in column.to_pylist()], pa.string())

    return walk(text)


def delimited_text(text: Column, separator: str = ",") -> Column:
    """The prose in delimited tables."""

    @F.arrow_udf("string")
    def walk(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else from_delimited(t, separator) for t in column.to_pylist()], pa.string())

    return walk(text)


def extracted(name: Column, content: Column) -> Column:
    """A file's plain text by its format; null where fewer than 80 characters remain."""
    kind = T.detected_format(name, content)
    out = (
        F.when(kind == "html", T.html_stripped(content)).when(kind == "markdown", T.markdown_stripped(content)).when(kind == "code", T.code_comments(content))
        .when(kind.isin("json", "jsonl"), json_text(F.when(kind.isin("json", "jsonl"), content))).when(kind == "csv", delimited_text(F.when(kind == "csv", content))).when(kind == "tsv", delimited_text(F.when(kind == "tsv", content), "\t")).otherwise(content)
    )
    return F.when(F.length(T.stripped(out)) >= SHORTEST_RESULT, out)


def chunk(text: str, whole: int = 500, target: int = 350, least_words: int = 40, least_chars: int = 80) -> list[str]:
    """A text of up to `whole` words is one chunk; a longer one is packed from paragraphs, and from sentences where a paragraph is too long, to about `target` words. Chunks of few words and characters go."""
    if len(text.split()) <= whole:
        parts = [text.strip()]
    else:
        pieces: list[str] = []
        for p in re.split(r"\n\s*\n", text):
            pieces += [p] if len(p.split()) <= target else re.split(r"(?<=[.!?])\s+", p)
        parts, held, n = [], [], 0
        for p in pieces:
            size = len(p.split())
            if held and n + size > target:
                parts.append("\n".join(held).strip())
                held, n = [], 0
            held.append(p)
            n += size
        if held:
            parts.append("\n".join(held).strip())
    return [p for p in parts if p and (len(p.split()) >= least_words or len(p) >= least_chars)]


def chunks(text: Column) -> Column:
    """The chunks of each text; null for null."""

    @F.arrow_udf("array<string>")
    def cut(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunk(t) for t in column.to_pylist()], pa.list_(pa.string()))

    return cut(text)
