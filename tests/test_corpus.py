"""Near duplicates, contamination, the map, sources, and the driver's contract."""

import json
import random
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import atlas, components, contamination, duplicates
from corpusloom.sources import extract, readers, records, sniff, tables


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(f"word{draw.randrange(3000)}" for _ in range(n))


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(5, 5)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in {k for p in pairs if p[0] != p[1] for k in p}}
    table = spark.createDataFrame(pairs, "a bigint, b bigint")
    for few in (components.FEW, 0):
        assert {r.key: r.cluster for r in components.components(table, few).collect()} == want
    assert components.components(table.limit(0)).count() == 0


def test_near_duplicates_and_overlap(spark):
    shared = [prose(k, 60) for k in range(20)]
    rows = [("small", t) for t in shared] + [("large", t + " tail") for t in shared] + [("large", prose(1000 + k, 60)) for k in range(180)] + [("other", shared[0])]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, dataset string, text string")
    near = duplicates.Near(table)
    s = near.summary().first()
    assert (s.total, s.clusters, s.near_duplicates, s.largest) == (221, 20, 20, 2)
    over = {(r.source, r.target): r.fraction for r in near.overlap().collect()}
    assert over["small", "large"] > 0.9 and over["large", "small"] < 0.2 and over["other", "small"] == 1


def test_near_duplicates_of_any_number(spark, monkeypatch):
    """Copies are one class; a band of any size is compared whole, in parts of whatever size."""
    base = prose(1, 200).split()
    texts = [" ".join(base)] * 250 + [" ".join([*base[:-1], f"end{k}"]) for k in range(40)]
    table = spark.createDataFrame([(k, "d", t) for k, t in enumerate(texts)], "doc_id bigint, dataset string, text string")
    near = duplicates.Near(table)
    assert near.members().where("representative = 0").count() >= 250
    reps = [r.representative for r in near.members().select("representative").distinct().collect()]
    found = sorted(near.pairs.collect())
    assert len(found) >= 0.95 * len(reps) * (len(reps) - 1) / 2 and len(reps) > 5
    s = near.summary().first()
    assert (s.clusters, s.near_duplicates, s.largest) == (1, 40, 41)
    monkeypatch.setattr(duplicates, "PART", 3)
    assert sorted(duplicates.Near(table).pairs.collect()) == found


def test_contamination(spark):
    items = spark.createDataFrame([("b", k, prose(k, 30)) for k in range(10)], "benchmark string, item_id bigint, text string")
    table = spark.createDataFrame([(0, prose(50, 20) + " " + prose(0, 30)), (1, " ".join(prose(1, 30).split()[:12])), (2, None)], "doc_id bigint, text string")
    r = contamination.contamination(table, items).first()
    assert (r.items, r.contaminated, r.flagged) == (10, 1, True)
    assert sorted(contamination.witnesses(table, items).collect()) == sorted(contamination.witnesses(table, items, send_rows=0).collect())


def test_atlas(spark):
    axes = [[float(i == j) for i in range(4)] for j in range(4)]
    rows = [(k, "s", axes[k % 3], k % 3) for k in range(60)] + [(60, "s", [-1.0, -1.0, -1.0, 0.0], 0), (61, "s", [0.0] * 4, 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, dataset string, embedding array<float>, label int")
    cells = atlas.centroids(vectors.where("vec_id < 60"))
    placed = atlas.assign(vectors, cells)
    c = atlas.coverage(placed, cells).first()
    assert (c.records, c.placed, c.off, c.regions) == (62, 60, 2, 3) and abs(c.effective - 3) < 1e-5
    assert {r.cohesion for r in atlas.cohesion(placed, vectors).collect()} == {1.0}
    assert {r.status for r in atlas.compare(placed, placed).collect()} == {"shared"}
    by_join = {r.vec_id: r.region for r in atlas.nearest_by_join(vectors, cells).collect()}
    assert by_join == {r.vec_id: r.nearest for r in placed.collect()}
    assert atlas.semantic_keepers(vectors.where("vec_id < 60"), 2).count() == 3
    assert atlas.normalised(vectors.where("vec_id < 60")).count() == 60 and atlas.cluster(vectors.where("vec_id < 60"), 3).count() == 3


def test_layouts(spark):
    rows = [{"instruction": "a", "output": "b"}] * 60 + [{"prompt": "a", "completion": "b"}] * 20 + [{"messages": [{"role": "human", "content": [{"text": "x"}, {"text": "y"}]}]}]
    table = spark.createDataFrame([("d", k, json.dumps(r)) for k, r in enumerate(rows)] + [("d", 99, "{broken"), ("logs", 0, json.dumps({"type": "a", "timestamp": 1, "sessionId": 2}))], "dataset string, place bigint, record string")
    votes = {(r.dataset, r.layout): r for r in records.induce(table).collect()}
    assert votes["d", "alpaca"].is_main and votes["d", "alpaca"].mixed and votes["d", "error"].records == 1
    assert [r.dataset for r in records.not_training_data(table).collect()] == ["logs"]
    d = {r.place: r for r in records.to_documents(table.where("dataset = 'd'")).collect()}
    assert (d[0].prompt, d[0].answer, d[99].text) == ("a", "b", None) and d[80].turns[0].content == "x\n\ny" and d[80].turns[0].role == "user" and d[80].coerced


def test_folder(spark, tmp_path):
    import bz2
    import lzma

    import pyarrow as pa
    import zstandard

    (tmp_path / "mix").mkdir()
    line = json.dumps({"text": "hello"})
    (tmp_path / "mix/a.jsonl").write_text(f"{line}\n\n{{broken\n{line}\n")
    (tmp_path / "mix/b.json").write_text(json.dumps([{"text": "1"}, {"text": "2"}]))
    (tmp_path / "mix/c.jsonl.bz2").write_bytes(bz2.compress(line.encode()))
    (tmp_path / "mix/d.jsonl.xz").write_bytes(lzma.compress(line.encode()))
    (tmp_path / "mix/e.jsonl.zst").write_bytes(zstandard.compress(line.encode()))
    (tmp_path / "mix/f.csv").write_text("Soru;Cevap\nwhat;that\n")
    (tmp_path / "mix/g.txt").write_text("Only prose.")
    with pa.ipc.new_file(str(tmp_path / "mix/h.arrow"), pa.schema([("text", pa.string())])) as w:
        w.write_table(pa.table({"text": ["x", "y"]}))
    for k in range(3):
        (tmp_path / f"shard_000{k}.jsonl").write_text(line)
    (tmp_path / "README.md").write_text("---\nlicense: mit\nlanguage:\n- en\n- tr\n---\n")
    spark.createDataFrame([("p", 1)], "text string, n int").write.parquet(str(tmp_path / "pq"))
    got: dict[str, list] = {}
    for r in readers.read_folder(spark, str(tmp_path)).collect():
        got.setdefault(r.file.split("/")[-1] if "pq" not in r.file else "pq", []).append((r.dataset, r.record, r.error))
    assert len(got["a.jsonl"]) == 3 and sum(e is not None for _, _, e in got["a.jsonl"]) == 1
    assert {k: len(v) for k, v in got.items()} == {"a.jsonl": 3, "b.json": 2, "c.jsonl.bz2": 1, "d.jsonl.xz": 1, "e.jsonl.zst": 1, "f.csv": 1, "g.txt": 1, "h.arrow": 2, "pq": 1, "shard_0000.jsonl": 1, "shard_0001.jsonl": 1, "shard_0002.jsonl": 1}
    assert json.loads(got["f.csv"][0][1]) == {"question": "what", "answer": "that"} and got["shard_0000.jsonl"][0][0] == "shard"
    assert readers.card((tmp_path / "README.md").read_text()) == {"license": "mit", "language": "en,tr"}


def test_sniffing_and_extraction():
    two = '{"a": 1, "b": "text { here"}'
    assert sniff.framing(f"{two}\n{two}")[0] == "line-delimited" and sniff.framing(f"```json\n{two}\n```\n```json\n{two}\n```")[0] == "fenced"
    assert sniff.framing("Some prose with one snippet {\"a\": 1} in it.")[0] == "prose"
    assert sniff.scaffolding(f"Here are the records:\n{two}\n{two}") == ["Here are the records:"]
    assert extract.from_json(json.dumps({"a": "this is a rather long text", "id": "0123456789abcdef0123456789"})) == "this is a rather long text"
    assert extract.from_delimited("id,body\n1,this is a rather long text\n") == "this is a rather long text"
    assert len(extract.chunk("\n\n".join(prose(k, 200) for k in range(5)))) == 5 and extract.chunk("few words") == []


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_semantic_pairs_in_parts(spark, monkeypatch):
    """Buckets cut into parts, and these into stripes, lose no pair and give none twice."""
    monkeypatch.setattr(atlas, "BUCKET_PART", 20)
    monkeypatch.setattr(atlas, "STRIPE", 7)
    draw = random.Random(3)
    rows = [(k, [draw.gauss(0, 1) for _ in range(6)]) for k in range(150)] + [(150, [0.0] * 6), (151, None), (152, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (153, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    v = {k: np.array(x) / (np.linalg.norm(x) or 1) for k, x in rows[:151]}
    near = lambda a, b: ((v[a][:2] > 0) == (v[b][:2] > 0)).all() and v[a] @ v[b] >= 0.8
    want = [(a, b) for a in v for b in v if a < b and near(a, b)]
    assert sorted((r.a, r.b) for r in atlas.semantic_pairs(table, 2, 0.8).collect()) == want
    kept: list[int] = []
    for k in v:
        kept += [k] if not any(near(j, k) for j in kept) else []
    assert sorted(r.vec_id for r in atlas.semantic_keepers(table.where("vec_id < 151"), 2, 0.8).collect()) == kept


def test_signatures_by_definition():
    """Vectors of MD5 and lanes against hashlib and whole numbers, for messages of one block to many."""
    preset, draw = duplicates.PRESETS["fineweb"], random.Random(5)
    texts = [" ".join("ñ" * draw.randrange(1, 2 + 30 * (k % 9)) for _ in range(draw.randrange(1, 30))) for k in range(60)] + ["a", "a b c d e", "x" * 55, "x" * 56, "x" * 247, "x" * 248, "y" * 1000]
    got = duplicates.sign(pa.array(["skipped", *texts])[1:], preset, 5)
    for row, t in zip(got.tolist(), texts):
        w = t.split(" ")
        x = {int(md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:15], 16) % duplicates.PRIME for i in range(max(len(w) - 4, 1))}
        assert row == [min((a * v + b) % duplicates.PRIME for v in x) for a, b in duplicates.coefficients(preset.lanes)]


def test_large_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    """One row group is not one task of signing."""
    monkeypatch.setattr(tables, "SMALL_BYTES", 1 << 10)
    monkeypatch.setattr(tables, "TASK_BYTES", 20 << 10)
    spark.createDataFrame([(k, "d", prose(k, 200)) for k in range(200)], "doc_id bigint, dataset string, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    near = duplicates.Near(spark.read.parquet(f"{tmp_path}/t"))
    assert near.signed.count() == 200 and len(near.signed.inputFiles()) > 4
