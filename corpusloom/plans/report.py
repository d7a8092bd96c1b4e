"""A scan's fingerprint, the comparison of two, and reports to read."""

from __future__ import annotations

import html
import json
from hashlib import md5

from pyspark.sql import functions as F

from corpusloom.operators import records
from corpusloom.plans.findings import BLOCKING, REGISTRY, WARNING, Scan, findings, rank

VERSION = "2"

#: Facets, what a change in them means, and the checks that speak to them.
FACETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "shape": ("descriptive", ("T0-TRUNC-001",)),
    "redundancy": ("conditional", ("T0-DUP-001", "T1-NDUP-001", "T1-DUP-002", "T1-OVERLAP-001")),
    "quality": ("conditional", ("T0-QUAL-001", "T0-QUAL-002", "T0-QUAL-003", "T0-ENC-001", "T0-DEGEN-001", "T1-IDENT-001", "T1-STYLE-001")),
    "structure": ("conditional", ("T0-SCHEMA-001", "T0-SCHEMA-002", "T0-SCHEMA-003", "T0-SCHEMA-004", "T0-SCHEMA-005", "T0-ROLE-001", "T0-ROLE-002", "T0-TMPL-001", "T0-MASK-001", "T0-TRUNC-002", "T0-REASON-001")),
    "coverage": ("depends on the goal", ("T1-ATLAS-001", "T1-ATLAS-002")),
    "language": ("depends on the goal", ("T1-LANG-001", "T1-LANG-002", "T1-LANG-003")),
    "compliance": ("risk", ("T1-PII-001", "T1-LIC-001")),
    "contamination": ("lower is better", ("T1-CONTAM-001",)),
}


def measures(scan: Scan):
    """Rows (facet, measure, value): sizes, and each finding's count and rate. What a check found nothing of is 0."""
    sizes = records.totals(scan.docs).agg(F.count("*").alias("datasets"), *[F.sum(c).cast("bigint").alias(c) for c in ("records", "chars", "words", "tokens")])
    entry = lambda facet, name, value: F.struct(F.lit(facet).alias("facet"), F.lit(name).alias("measure"), value.cast("double").alias("value"))
    shape = sizes.select(F.explode(F.array(*[entry("shape", c, F.coalesce(c, F.lit(0))) for c in sizes.columns])).alias("e")).select("e.*")
    facet_of = F.create_map(*[x for name, (_, ids) in FACETS.items() for c in ids for x in (F.lit(c), F.lit(name))])
    active = scan.spark.createDataFrame([(c.check_id,) for c in REGISTRY.resolve(scan)[0]], "check_id string")
    found = active.join(findings(scan).select("check_id", "count", "rate"), "check_id", "left")
    pair = lambda name, c: F.struct(F.concat("check_id", F.lit(f" {name}")).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("value"))
    each = found.select(F.element_at(facet_of, F.col("check_id")).alias("facet"), F.explode(F.array(pair("count", "count"), pair("rate", "rate"))).alias("e")).select("facet", "e.*")
    return shape.unionByName(each)


def fingerprint(scan: Scan) -> dict:
    """The document that stands for a corpus: an id that changes with its records, the settings or the engine, and its measures by facet."""
    digest = records.content_digest(scan.docs).first()
    settings = {"profile": scan.profile, "template": scan.template, "seq_len": scan.seq_len, "tier": scan.tier, "muted": sorted(scan.muted)}
    own = md5(json.dumps([VERSION, settings, digest.records, digest.digest]).encode()).hexdigest()
    facets: dict[str, dict] = {name: {"grade": grade, "measures": {}} for name, (grade, _) in FACETS.items()}
    for r in measures(scan).collect():  # a few rows for each check
        facets[r.facet]["measures"][r.measure] = r.value
    return {"fingerprint_id": f"cl_{own[:20]}", "version": VERSION, "settings": settings, "content_digest": digest.digest, "facets": facets}


def compare(one: dict, other: dict) -> list[dict]:
    """Measures in which two fingerprints differ: (facet, measure, one, other, change), change relative to the first. Of other versions nothing is comparable."""
    if one["version"] != other["version"]:
        raise ValueError("fingerprints of different versions can't be compared")
    out = []
    for name in FACETS:
        a, b = (f["facets"].get(name, {}).get("measures", {}) for f in (one, other))
        for key in sorted(set(a) | set(b)):
            x, y = a.get(key), b.get(key)
            if x != y:
                out.append({"facet": name, "measure": key, "one": x, "other": y, "change": round((y - x) / x, 6) if x and y is not None else None})
    return out


def verdict(found: list[dict]) -> str:
    """One line on what the findings mean."""
    stops = sum(f["is_blocking"] for f in found)
    would = sum(f["severity"] == BLOCKING and not f["is_blocking"] for f in found)
    warns = sum(f["severity"] == WARNING for f in found)
    if stops:
        return f"Blocked: {stops} finding{'s' * (stops > 1)} must be mended first."
    if would:
        return f"Not blocked as no target is declared for it; {would} finding{'s' * (would > 1)} would block."
    return f"{warns} warning{'s' * (warns != 1)}." if warns else "Nothing was found that needs mending."


def ranked(scan: Scan) -> list[dict]:
    """The findings in the order to read them, as dictionaries; there are no more than checks."""
    return [r.asDict(True) for r in rank(findings(scan)).drop("rank_tier").collect()]


def markdown(found: list[dict], print_: dict, skipped: list) -> str:
    """A report to read: verdict, findings with their datasets, measures, and what didn't run."""
    lines = ["# Corpus report", "", verdict(found), "", f"Fingerprint `{print_['fingerprint_id']}`.", ""]
    if found:
        lines += ["| check | what | severity | count | share | datasets |", "|-|-|-|-|-|-|"]
        for f in found:
            top = sorted((f["by_dataset"] or {}).items(), key=lambda x: (-x[1], x[0]))
            named = ", ".join(f"{_plain(k)} {n}" for k, n in top[:5]) + (f" and {len(top) - 5} more" if len(top) > 5 else "")
            lines.append(f"| {f['check_id']} | {f['title']} | {f['severity']}{' (blocks)' if f['is_blocking'] else ''} | {f['count']} | {f['rate']:.2%} | {named} |")
        lines += ["", "## What to do", "", *[f"* {f['check_id']}: {f['fix']}" for f in found], ""]
    lines += ["## Measures", ""]
    for name, facet in print_["facets"].items():
        if facet["measures"]:
            lines += [f"**{name}** ({facet['grade']}): " + ", ".join(f"{k} {v:g}" for k, v in sorted(facet["measures"].items())), ""]
    if skipped:
        lines += ["## Not run", "", *[f"* {s.check_id} {s.title}: {s.reason}" for s in skipped], ""]
    return "\n".join(lines)


def _plain(name: str) -> str:
    """A dataset's name without what would break a table or a terminal."""
    return "".join(c if c.isprintable() and c not in "|`<>" else "·" for c in name)


def page(found: list[dict], print_: dict) -> str:
    """The findings as one HTML page without scripts or links."""
    cells = lambda f: "".join(f"<td>{html.escape(str(x))}</td>" for x in (f["check_id"], f["title"], f["severity"], f["count"], f"{f['rate']:.2%}", f["fix"]))
    rows = "".join(f"<tr class='{f['severity']}'>{cells(f)}</tr>" for f in found)
    style = "body{font:15px sans-serif;margin:2em}td,th{padding:.3em .8em;text-align:left}.blocking{background:#fdd}.warning{background:#ffd}"
    return f"<!doctype html><meta charset='utf-8'><title>Corpus report</title><style>{style}</style><h1>{html.escape(verdict(found))}</h1><p>{html.escape(print_['fingerprint_id'])}</p><table><tr><th>check<th>what<th>severity<th>count<th>share<th>what to do</tr>{rows}</table>"


def triage(found: list[dict], width: int = 100) -> str:
    """The findings for a terminal, a line each."""
    mark = {BLOCKING: "!!", WARNING: " !"}
    return "\n".join([verdict(found), *[f"{mark.get(f['severity'], '  ')} {f['check_id']:<14}{f['rate']:>8.2%}  {f['title']}"[:width] for f in found]])
