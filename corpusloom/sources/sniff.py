"""Records hidden in text files: JSON objects on lines, in fences, or one after another."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SPANS, LEAST_PARSED, LEAST_COVERED = 2, 0.6, 0.5
_DECODER = json.JSONDecoder()


def spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, parses) of the outermost brace-balanced spans, strings and escapes minded."""
    out = []
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if depth and quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            continue
        if c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    ok = isinstance(_DECODER.decode(text[start : i + 1]), dict)
                except ValueError:
                    ok = False
                out.append((start, i + 1, ok))
    return out


def framing(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(kind, spans of records): prose, fenced, line-delimited or blank-separated. Text is records if there are two spans and more, 60 % parse, and they hold half of what isn't white space."""
    if text.count("{") < LEAST_SPANS:
        return "prose", []
    found = spans(text)
    good = [(s, e) for s, e, ok in found if ok]
    size = len("".join(text.split()))
    covered = sum(len("".join(text[s:e].split())) for s, e in good)
    if len(found) < LEAST_SPANS or len(good) < LEAST_PARSED * len(found) or covered < LEAST_COVERED * size:
        return "prose", []
    if "```" in text:
        return "fenced", good
    between = [text[a[1] : b[0]] for a, b in zip(good, good[1:])]
    return ("blank-separated" if any(x.count("\n") > 1 for x in between) else "line-delimited"), good


def scaffolding(text: str, shortest: int = 12, most: int = 5) -> list[str]:
    """What stands between the records of a text that holds records: up to `most` distinct strings of `shortest` characters and more."""
    _, good = framing(text)
    edges = [0, *[x for s in good for x in s], len(text)] if good else []
    parts = (" ".join(text[a:b].split()) for a, b in zip(edges[::2], edges[1::2]))
    return list(dict.fromkeys(p for p in parts if len(p) >= shortest))[:most]


def records_in(text: Column) -> Column:
    """A text file's records as JSON texts: those that it holds, else one with the whole text."""

    @F.arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            good = framing(t)[1] if t else []
            out.append(None if t is None else [t[s:e] for s, e in good] if good else [json.dumps({"text": t}, ensure_ascii=False)])
        return pa.array(out, pa.list_(pa.string()))

    return split(text)


def framing_column(text: Column) -> Column:
    """(kind, records, scaffolding) of each text."""

    @F.arrow_udf("struct<kind:string,records:bigint,scaffolding:array<string>>")
    def look(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            kind, good = framing(t or "")
            rows.append({"kind": kind, "records": len(good), "scaffolding": scaffolding(t or "")})
        return pa.array(rows, pa.struct([("kind", pa.string()), ("records", pa.int64()), ("scaffolding", pa.list_(pa.string()))]))

    return look(text)


def text_files_with_records(texts):
    """By dataset: text files, and those that hold records. texts have (dataset, text)."""
    seen = texts.select("dataset", framing_column(F.col("text")).alias("f"))
    return seen.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(F.col("f.kind") != "prose").alias("with_records"), F.count_if(F.size("f.scaffolding") > 0).alias("with_scaffolding"))


def scaffolding_strings(texts):
    """(dataset, text, files): the distinct strings that stand between records of generated files."""
    seen = texts.select("dataset", F.explode(framing_column(F.col("text"))["scaffolding"]).alias("text"))
    return seen.groupBy("dataset", "text").agg(F.count("*").alias("files"))
