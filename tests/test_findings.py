"""The catalog, findings, fingerprints, reports and the command line."""

import json

import pytest

from corpusloom import __main__ as cli
from corpusloom.plans import findings, report
from corpusloom.sources import readers, records


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    (at / "chat").mkdir()
    talk = lambda k, role="user", say="a longer answer than three": {"messages": [{"role": role, "content": f"question number {k} about things"}, {"role": "assistant", "content": f"{say} {k}"}]}
    lines = [talk(k) for k in range(30)] + [talk(99, "human")] * 3 + [{"messages": [{"role": "user", "content": "write to jane.roe@example.com"}, {"role": "assistant", "content": 42}]}]
    (at / "chat/a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    (at / "chat/README.md").write_text("---\nlicense: mit\n---\n")
    (at / "qa").mkdir()
    aside = "this is text under a key that no layout of this record reads at all"
    (at / "qa/b.jsonl").write_text("\n".join(json.dumps({"instruction": f"do {k}", "output": f"done as you asked {k}", "context": aside}) for k in range(20)))
    return str(at)


@pytest.fixture(scope="module")
def scan(spark, folder):
    return cli.scan_of(spark, folder, {"target": "sft", "mute": ["T1-NDUP-001", "T1-OVERLAP-001"]})


def test_resolution(scan):
    active, skipped = findings.REGISTRY.resolve(scan)
    ids = {c.check_id for c in active}
    assert scan.profile == "sft" and "T0-QUAL-001" not in ids and {"T0-ENC-001", "T1-PII-001"} <= ids
    why = {s.check_id: s.reason for s in skipped}
    assert why == {"T1-NDUP-001": "muted", "T1-OVERLAP-001": "muted", "T1-CONTAM-001": "needs items"}
    with pytest.raises(ValueError):
        findings.REGISTRY.add("T0-ENC-001", "", "info", "", None)


def test_findings(scan):
    found = report.ranked(scan)
    by = {f["check_id"]: f for f in found}
    assert (by["T0-DUP-001"]["count"], by["T0-DUP-001"]["by_dataset"]) == (2, {"chat": 2})
    assert (by["T0-SCHEMA-003"]["count"], by["T0-SCHEMA-004"]["count"], by["T0-SCHEMA-005"]["count"]) == (1, 1, 20)
    assert by["T0-ROLE-002"]["count"] == 3 and by["T0-ROLE-002"]["is_blocking"] and by["T0-ROLE-002"]["would_block_under"] == ["sft"]
    assert by["T1-PII-001"]["count"] == 1 and by["T1-LIC-001"]["by_dataset"] == {"qa": 1}
    assert by["T0-SCHEMA-004"]["would_block_under"] == []  # only what is of blocking severity blocks
    assert [f["is_blocking"] for f in found] == sorted((f["is_blocking"] for f in found), reverse=True)
    assert "jane.roe" not in json.dumps(found)
    assert report.verdict(found).startswith("Blocked") and report.verdict([]) == "Nothing was found that needs mending."


def test_fingerprints(scan):
    one = report.fingerprint(scan)
    shape = one["facets"]["shape"]["measures"]
    assert (shape["records"], shape["datasets"]) == (55, 2) and one["facets"]["redundancy"]["measures"]["T0-DUP-001 count"] == 2
    assert report.compare(one, json.loads(json.dumps(one))) == []
    other = json.loads(json.dumps(one))
    other["facets"]["redundancy"]["measures"]["T0-DUP-001 count"] = 3.0
    assert report.compare(one, other) == [{"facet": "redundancy", "measure": "T0-DUP-001 count", "one": 2.0, "other": 3.0, "change": 0.5}]
    with pytest.raises(ValueError):
        report.compare(one, one | {"version": "0"})


def test_reports():
    found = [{"check_id": "T9-X-001", "title": "A <b>", "severity": "blocking", "is_blocking": True, "count": 2, "total": 4, "rate": 0.5, "by_dataset": {"a|b‮": 2}, "fix": "Mend & go", "would_block_under": ["sft"]}]
    print_ = {"fingerprint_id": "cl_1", "facets": {"shape": {"grade": "descriptive", "measures": {"records": 4.0}}}}
    text = report.markdown(found, print_, [findings.Skipped("T9-Y-001", "Y", "muted")])
    assert "50.00%" in text and "a·b· 2" in text and "T9-Y-001 Y: muted" in text and "records 4" in text
    assert "A &lt;b&gt;" in report.page(found, print_) and "Mend &amp; go" in report.page(found, print_)
    assert report.triage(found).split("\n")[1].startswith("!! T9-X-001")
    assert findings.without_evidence({"a": [{"record": 1, "b": 2}], "evidence": 3}) == {"a": [{"b": 2}]}


def test_command_line(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["scan", folder, "--out", str(out), "--target", "sft", "--tier", "0", "--no-evidence"], spark) == cli.BLOCKED
    rows = [json.loads(x) for x in (out / "findings.jsonl").read_text().splitlines()]
    assert {r["check_id"] for r in rows} >= {"T0-ROLE-002", "T0-DUP-001"} and not any(r["check_id"].startswith("T1") for r in rows)
    assert sorted(p.name for p in out.iterdir()) == ["findings.jsonl", "fingerprint.json", "report.html", "report.md"]
    assert cli.main(["compare", str(out / "fingerprint.json"), str(out / "fingerprint.json")]) == cli.OK
    assert cli.main(["scan", str(tmp_path / "absent")]) == cli.EMPTY
    assert cli.main(["checks", "T0-ENC-001"]) == cli.OK and cli.main(["checks", "T0-NONE-001"]) == cli.USAGE
    assert "Damaged encoding" in capsys.readouterr().out
    with pytest.raises(SystemExit) as end:
        cli.main(["scan", folder, "--target", "other"])
    assert end.value.code == cli.USAGE


def test_content_types(spark):
    each = [("text", "42", False), ("text", "{not json", False), ("number", 42, True), ("object", {"a": 1}, True), ("blocks", [{"type": "text", "text": "x"}], False), ("image", [{"type": "image", "url": "u"}], True), ("texts", ["a", "b"], False), ("none", None, False)]
    table = spark.createDataFrame([(n, k, json.dumps({"messages": [{"role": "user", "content": c}]})) for k, (n, c, _) in enumerate(each)], "dataset string, place bigint, record string")
    got = {r.place: r.coerced for r in records.to_documents(table).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(each)}
    assert records.canonical_headers(["Question", " queries", "Body", "text"]) == {"Question": "question", " queries": "queries", "Body": "text", "text": "text"}


def test_compressed_files(spark, tmp_path):
    import gzip
    import lzma

    import zstandard

    (tmp_path / "a.csv.xz").write_bytes(lzma.compress(b"Question,Answer\n\"one, two\",\"three\nfour\"\n"))
    (tmp_path / "b.json.zst").write_bytes(zstandard.compress(json.dumps([{"text": "x"}, {"text": "y"}], indent=1).encode()))
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"text;id\nhello;1\n"))
    (tmp_path / "d.json.xz").write_bytes(lzma.compress(json.dumps({"train": [{"text": "t"}], "test": [{"text": "u"}]}).encode()))
    (tmp_path / "e.txt.xz").write_bytes(lzma.compress(b'{"text": "p"}\n{"text": "q"}\n'))
    (tmp_path / "f.jsonl.xz").write_bytes(lzma.compress(b"\x00 not json\n"))
    got: dict[str, list] = {}
    for r in readers.read_folder(spark, str(tmp_path)).orderBy("file", "place").collect():
        got.setdefault(r.file, []).append(json.loads(r.record) if r.record else None)
    assert got == {
        "a.csv.xz": [{"question": "one, two", "answer": "three\nfour"}], "b.json.zst": [{"text": "x"}, {"text": "y"}], "c.csv.gz": [{"text": "hello", "id": "1"}],
        "d.json.xz": [{"text": "t"}, {"text": "u"}], "e.txt.xz": [{"text": "p"}, {"text": "q"}], "f.jsonl.xz": [None],
    }
