"""Folders of files as records: (dataset, file, place, record, error), whatever the format.

The files are listed once, on the driver or from a binaryFile listing; what is in them is
read by Spark, format by format, so that files are split and read in parallel.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.records import canonical_headers

SKIPPED_FOLDERS = frozenset(".git .hg .svn __pycache__ node_modules .venv venv .cache .ipynb_checkpoints".split())
CARDS = frozenset(("readme.md", "dataset_card.md", "license", "license.txt", "license.md"))
COMPRESSED = {".gz": "gzip", ".bz2": "bz2", ".xz": "xz", ".zst": "zstd"}
FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".txt": "text", ".md": "text", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".orc": "orc", ".arrow": "arrow", ".feather": "arrow", ".ipc": "arrow"}
SHARD = re.compile(r"^(.*?)[._-]\d+(?:[._-]of[._-]\d+)?$")
SCHEMA = "dataset string, file string, place bigint, record string, error string"


@dataclass(frozen=True)
class File:
    path: str
    relative: str
    size: int
    format: str
    compression: str | None
    dataset: str


def classified(name: str) -> tuple[str | None, str | None]:
    """(format, compression) by a file's name; a compression's ending is looked through."""
    stem, ending = os.path.splitext(name.lower())
    packed = COMPRESSED.get(ending)
    if packed:
        ending = os.path.splitext(stem)[1]
    return FORMATS.get(ending), packed


def stem(name: str) -> str:
    """A file's name without the endings of format and compression."""
    base, ending = os.path.splitext(name)
    if ending.lower() in COMPRESSED:
        base, ending = os.path.splitext(base)
    return base if ending.lower() in FORMATS else base + ending


def discover(root: str, family: int = 3) -> list[File]:
    """The data files under root, by path. The folder names the dataset, for files at the top their stem; `family` and more files whose names differ by a shard number are one dataset. Empty files and cards are left out."""
    found: list[tuple[str, str, int, str, str | None]] = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(x for x in inner if x not in SKIPPED_FOLDERS and not x.startswith("."))
        for name in sorted(names):
            path = os.path.join(folder, name)
            kind, packed = classified(name)
            if kind and name.lower() not in CARDS and not name.startswith((".", "_")) and os.path.getsize(path):
                found.append((path, os.path.relpath(path, root), os.path.getsize(path), kind, packed))
    shards: dict[tuple[str, str], int] = {}

    def folded(relative: str) -> str | None:
        m = SHARD.match(stem(os.path.basename(relative)))
        return m[1] if m and m[1] else None

    for _, relative, *_ in found:
        if s := folded(relative):
            key = (os.path.dirname(relative), s)
            shards[key] = shards.get(key, 0) + 1
    out = []
    for path, relative, size, kind, packed in found:
        parent = os.path.dirname(relative)
        s = folded(relative)
        own = s if s and shards[parent, s] >= family else stem(os.path.basename(relative))
        out.append(File(path, relative, size, kind, packed, parent.replace(os.sep, "/") or own))
    return out


def card(text: str) -> dict[str, str]:
    """license, language and task_categories of a card's front matter; lists are joined by commas."""
    m = re.match(r"\s*---\s*\n(.*?)\n---", text, re.S)
    out: dict[str, str] = {}
    last = None
    for line in m[1].split("\n") if m else ():
        if pair := re.match(r"^([A-Za-z_]+):\s*(.*)$", line):
            last = pair[1].lower()
            out[last] = pair[2].strip().strip("[]\"'")
        elif last and (item := re.match(r"^\s*-\s+(.*)$", line)):
            out[last] = ",".join(x for x in (out[last], item[1].strip().strip("\"'")) if x)
    return {k: v for k, v in out.items() if k in ("license", "language", "task_categories") and v}


def delimiter(head: str) -> str:
    """The commonest of , ; tab and | in the first line that isn't blank; a comma if there is none."""
    line = next((x for x in head.split("\n") if x.strip()), "")
    return max(",;\t|", key=line.count) if any(c in line for c in ",;\t|") else ","


def _named(df: DataFrame, files: list[File]) -> DataFrame:
    """Adds dataset and file by the path that a row was read from. The listing is joined, by a shuffle if it is large."""
    spark = df.sparkSession
    listing = spark.createDataFrame([(f.path, f.relative, f.dataset) for f in files], "path string, file string, dataset string")
    plain = F.regexp_replace(F.url_decode(F.col("_path")), "^file:/+", "/")
    return df.join(listing, plain == F.col("path")).drop("_path", "path")


def _lines(spark: SparkSession, files: list[File]) -> DataFrame:
    """Text lines with the number of each. A line's number in its file comes from its block's start and its order in the block: unique and ascending, blank lines count."""
    rows = spark.read.text([f.path for f in files]).select(F.col("value"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("place", F.col("block") * 1_000_000 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)))
    return _named(rows, files)


def _jsonl(spark: SparkSession, files: list[File]) -> DataFrame:
    rows = _lines(spark, files).where(F.trim("value") != "")
    good = F.json_object_keys("value").isNotNull()
    return rows.select("dataset", "file", "place", F.when(good, F.col("value")).alias("record"), F.when(~good, F.substring("value", 1, 2000)).alias("error"))


def _whole(spark: SparkSession, files: list[File]) -> DataFrame:
    return _named(spark.read.text([f.path for f in files], wholetext=True).select("value", F.col("_metadata.file_path").alias("_path")), files)


def _json(spark: SparkSession, files: list[File]) -> DataFrame:
    """An array gives its items, an object of arrays the items of each, another object itself; what is no JSON is read as lines."""
    rows = _whole(spark, files).withColumn("v", F.ltrim("value"))
    listed = F.from_json("v", "array<string>")
    splits = F.from_json("v", "map<string,string>")
    of_splits = F.flatten(F.transform(F.map_values(splits), lambda x: F.from_json(x, "array<string>")))
    every_list = F.forall(F.map_values(splits), lambda x: x.startswith("[")) & (F.size(splits) > 0)
    by_line = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    items = F.when(F.col("v").startswith("[") & listed.isNotNull(), listed).when(F.json_object_keys("v").isNotNull() & every_list, of_splits).when(F.try_parse_json("v").isNotNull() & F.col("v").startswith("{"), F.array("value")).otherwise(by_line)
    each = rows.select("dataset", "file", F.posexplode(items).alias("place", "value"))
    good = F.json_object_keys("value").isNotNull()
    return each.select("dataset", "file", F.col("place").cast("bigint").alias("place"), F.when(good, F.col("value")).alias("record"), F.when(~good, F.substring("value", 1, 2000)).alias("error"))


def _text(spark: SparkSession, files: list[File]) -> DataFrame:
    from corpusloom.sources.sniff import records_in

    rows = _whole(spark, files).select("dataset", "file", F.posexplode(records_in(F.col("value"))).alias("place", "record"))
    return rows.select("dataset", "file", F.col("place").cast("bigint").alias("place"), "record", F.lit(None).cast("string").alias("error"))


def _as_records(df: DataFrame, names: dict[str, str] | None = None) -> Column:
    """Each row as a JSON text, under other names if given."""
    names = names or {c: c for c in df.columns}
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns if c in names]), {"ignoreNullFields": "true"})


def _csv(spark: SparkSession, files: list[File]) -> list[DataFrame]:
    """Files of one header and delimiter are read together."""
    groups: dict[tuple[str, tuple[str, ...]], list[File]] = {}
    for f in files:
        with open(f.path, encoding="utf-8", errors="replace") as handle:
            head = handle.read(1 << 16)
        d = delimiter(head)
        line = next((x for x in head.split("\n") if x.strip()), "")
        groups.setdefault((d, tuple(x.strip().strip('"') for x in line.split(d))), []).append(f)
    out = []
    for (d, header), own in groups.items():
        rows = spark.read.csv([f.path for f in own], header=True, sep=d, multiLine=True, escape='"')
        named = canonical_headers(list(rows.columns))
        record = _as_records(rows, named)
        rows = _named(rows.select(record.alias("record"), F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("place")), own)
        out.append(rows.select("dataset", "file", "place", "record", F.lit(None).cast("string").alias("error")))
    return out


def _columnar(spark: SparkSession, files: list[File], kind: str) -> list[DataFrame]:
    """Each dataset by itself, as schemas differ between datasets."""
    out = []
    for dataset in sorted({f.dataset for f in files}):
        own = [f for f in files if f.dataset == dataset]
        reader = spark.read.option("mergeSchema", "true")
        rows = reader.parquet(*[f.path for f in own]) if kind == "parquet" else reader.orc([f.path for f in own])
        rows = _named(rows.select(_as_records(rows).alias("record"), F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("place")), own)
        out.append(rows.select("dataset", "file", "place", "record", F.lit(None).cast("string").alias("error")))
    return out


def _unpacked(data: bytes, how: str) -> bytes:
    import bz2
    import gzip
    import lzma

    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {"gzip": gzip, "bz2": bz2, "xz": lzma}[how].decompress(data)


def _records_of(text: str, kind: str) -> list[tuple[str | None, str | None]]:
    """(record, error) of a file's unpacked text, as the readers of plain files have them."""
    import csv
    import io
    import json

    from corpusloom.sources.sniff import framing

    written = lambda x: json.dumps(x, ensure_ascii=False)
    if kind == "text":
        found = framing(text)[1]
        return [(text[s:e], None) for s, e in found] or [(written({"text": text}), None)]
    if kind == "csv":
        rows = csv.reader(io.StringIO(text), delimiter=delimiter(text[: 1 << 16]))
        header = next(rows, [])
        names = list(canonical_headers(header).values())
        return [(written({k: v for k, v in zip(names, row) if v}), None) for row in rows if row]
    if kind == "json" or text.lstrip().startswith("["):
        try:
            whole = json.loads(text)
        except ValueError:
            pass
        else:
            if isinstance(whole, dict) and whole and all(isinstance(v, list) for v in whole.values()):
                whole = [x for v in whole.values() for x in v]
            return [(written(x), None) if isinstance(x, dict) else (None, written(x)[:2000]) for x in (whole if isinstance(whole, list) else [whole])]
    out: list[tuple[str | None, str | None]] = []
    for line in filter(str.strip, text.split("\n")):
        try:
            good = isinstance(json.loads(line), dict)
        except ValueError:
            good = False
        out.append((line, None) if good else (None, line[:2000]))
    return out


def _binary(listing: list[File]):
    """(path, content) to records, for what Spark has no source for: Arrow files, and whatever is packed by xz or zstd."""
    by = {f.path: f for f in listing}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = by[re.sub("^file:/+", "/", path)]
                rows: list[tuple[str | None, str | None]] = []
                try:
                    if f.format == "arrow":
                        try:
                            table = pa.ipc.open_file(data).read_all()
                        except pa.ArrowInvalid:
                            table = pa.ipc.open_stream(data).read_all()
                        rows = [(json.dumps(r, ensure_ascii=False, default=str), None) for r in table.to_pylist()]
                    elif f.format in ("parquet", "orc"):
                        rows = [(None, f"{f.relative}: unpack this file first; its format has its own compression")]
                    else:
                        text = _unpacked(data, f.compression).decode("utf-8", "replace")
                        rows = _records_of(text, f.format)
                except Exception as e:  # a file that can't be read is a record of its error, not the end of the scan
                    rows = [(None, f"{f.relative}: {e}"[:2000])]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([f.dataset] * n), pa.array([f.relative] * n), pa.array(range(n), pa.int64()), pa.array([r for r, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], ["dataset", "file", "place", "record", "error"])

    return run


def read_files(spark: SparkSession, files: list[File], limit_per_file: int | None = None) -> DataFrame:
    """All records of the files: (dataset, file, place, record, error). record is a JSON object's text; what can't be read has an error instead. With a limit, the first records of each file by place."""
    parts: list[DataFrame] = []
    plain = [f for f in files if (f.compression is None or f.compression in ("gzip", "bz2") and f.format != "csv") and f.format != "arrow" and not (f.compression and f.format in ("parquet", "orc"))]
    for kind, read in (("jsonl", _jsonl), ("json", _json), ("text", _text)):
        if own := [f for f in plain if f.format == kind]:
            if kind == "jsonl":
                arrays = [f for f in own if not f.compression and _head(f.path).startswith("[")]
                own = [f for f in own if f not in arrays]
                if arrays:
                    parts.append(_json(spark, arrays))
            if own:
                parts.append(read(spark, own))
    if own := [f for f in plain if f.format == "csv"]:
        parts += _csv(spark, own)
    for kind in ("parquet", "orc"):
        if own := [f for f in plain if f.format == kind]:
            parts += _columnar(spark, own, kind)
    if rest := [f for f in files if f not in plain]:
        raw = spark.read.format("binaryFile").load([f.path for f in rest]).select("path", "content")
        parts.append(raw.mapInArrow(_binary(rest), SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if limit_per_file is not None:
        from pyspark.sql import Window

        out = out.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("place"))).where(F.col("n") <= limit_per_file).drop("n")
    return out


def cards(root: str) -> list[tuple[str, str, str]]:
    """(folder, license, language) of the dataset cards under root."""
    out = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(x for x in inner if x not in SKIPPED_FOLDERS and not x.startswith("."))
        for name in sorted(names):
            if name.lower() in ("readme.md", "dataset_card.md"):
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    own = card(f.read())
                where = os.path.relpath(folder, root).replace(os.sep, "/")
                out.append(("" if where == "." else where, own.get("license", ""), own.get("language", "")))
    return out


def licences(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, license) of every dataset under root: its own folder's card counts, else that of the nearest folder above."""
    known = {folder: text for folder, text, _ in cards(root)}
    rows = []
    for dataset in sorted({f.dataset for f in discover(root)}):
        parts = dataset.split("/")
        above = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
        rows.append((dataset, next((known[a] for a in above if known.get(a)), None)))
    return spark.createDataFrame(rows, "dataset string, license string")


def _head(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read(4096).lstrip()


def read_folder(spark: SparkSession, root: str, limit_per_file: int | None = None) -> DataFrame:
    """All records under a folder."""
    return read_files(spark, discover(root), limit_per_file)
