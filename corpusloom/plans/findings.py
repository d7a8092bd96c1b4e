"""The catalog of checks, which of them a scan runs, and their findings as rows of one type."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import atlas, budget, contamination, duplicates, records
from corpusloom.sources import records as layouts
from corpusloom.workspace import Workspace

SFT, CORPUS, PREFERENCE, UNKNOWN = "sft", "corpus", "preference", "unknown"
EVERY = (SFT, CORPUS, PREFERENCE, UNKNOWN)
BLOCKING, WARNING, INFO = "blocking", "warning", "info"

FINDING = "check_id string, title string, severity string, count bigint, total bigint, rate double, by_dataset map<string,bigint>, fix string, would_block_under array<string>, is_blocking boolean"


@dataclass
class Scan:
    """What a scan looks at, and how. Whatever is None can't be checked.

    docs: (doc_id, dataset, text). convs: conversations as sources.tables has them. raw:
    (dataset, place, record) as JSON. cards: (dataset, license). items: (benchmark, item_id,
    text). vectors and cells: embeddings and the map's regions, as operators.atlas has them.
    A target is a profile that findings may block.
    """

    docs: DataFrame
    convs: DataFrame | None = None
    raw: DataFrame | None = None
    cards: DataFrame | None = None
    items: DataFrame | None = None
    vectors: DataFrame | None = None
    cells: DataFrame | None = None
    profile: str = UNKNOWN
    target: str | None = None
    template: str | None = None
    seq_len: int | None = 2048
    tier: int = 1
    muted: tuple[str, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @cached_property
    def near(self) -> duplicates.Near:
        return duplicates.Near(self.docs)

    @cached_property
    def normalised(self) -> DataFrame:
        """raw as documents, written once."""
        return Workspace(self.spark).save(layouts.to_documents(self.raw), "normalised")

    @cached_property
    def placed(self) -> DataFrame:
        return Workspace(self.spark).save(atlas.assign(self.vectors, self.cells), "placed")

    def has(self, need: str) -> bool:
        if need == "several datasets":
            return len(self.docs.select("dataset").distinct().limit(2).collect()) > 1
        return getattr(self, need) is not None


@dataclass(frozen=True)
class Check:
    """measure gives (dataset, count, total), by dataset or for the whole, and may give a severity of its own."""

    check_id: str
    title: str
    severity: str
    fix: str
    measure: Callable[[Scan], DataFrame]
    profiles: tuple[str, ...] = EVERY
    blocks: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    #: What total and rate must reach for a finding.
    least_total: int = 0
    least_rate: float = 0.0

    @property
    def tier(self) -> int:
        return int(self.check_id[1])

    def finding(self, scan: Scan) -> DataFrame:
        """One row of FINDING, or none."""
        seen = self.measure(scan)
        own = F.when(F.bool_or(F.col("severity") == BLOCKING), BLOCKING).otherwise(F.max("severity")) if "severity" in seen.columns else F.lit(self.severity)
        every = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("count") > 0, F.struct("dataset", "count")))))
        out = seen.agg(F.sum("count").cast("bigint").alias("n"), F.sum("total").cast("bigint").alias("of"), every.alias("by_dataset"), own.alias("severity"))
        rate = F.when(F.col("of") > 0, F.round(F.col("n") / F.col("of"), 6)).otherwise(0.0)
        blocks = F.when(F.col("severity") == BLOCKING, F.array(*map(F.lit, self.blocks))).otherwise(F.array()).cast("array<string>")
        out = out.where((F.col("n") > 0) & (F.col("of") >= self.least_total)).select(
            F.lit(self.check_id).alias("check_id"), F.lit(self.title).alias("title"), "severity", F.col("n").alias("count"), F.col("of").alias("total"), rate.alias("rate"), "by_dataset", F.lit(self.fix).alias("fix"), blocks.alias("would_block_under")
        ).where(F.col("rate") >= self.least_rate)
        return out.withColumn("is_blocking", F.array_contains("would_block_under", scan.target) if scan.target else F.lit(False))


@dataclass(frozen=True)
class Skipped:
    check_id: str
    title: str
    reason: str


@dataclass
class Registry:
    """Checks by their id."""

    checks: dict[str, Check] = field(default_factory=dict)

    def add(self, *args, **named) -> None:
        check = Check(*args, **named)
        if check.check_id in self.checks:
            raise ValueError(f"{check.check_id} is there twice")
        self.checks[check.check_id] = check

    def resolve(self, scan: Scan) -> tuple[list[Check], list[Skipped]]:
        """What runs, and what doesn't with the reason, by id. Checks for other profiles than the scan's are neither."""
        active: list[Check] = []
        skipped: list[Skipped] = []
        for _, check in sorted(self.checks.items()):
            absent = next((n for n in check.needs if not scan.has(n)), None) if check.tier <= scan.tier and check.check_id not in scan.muted else None
            reason = "muted" if check.check_id in scan.muted else f"tier {check.tier} is not enabled" if check.tier > scan.tier else None
            if reason is None and scan.profile != UNKNOWN and scan.profile not in check.profiles:
                continue
            reason = reason or (f"needs {absent}" if absent else None)
            if reason:
                skipped.append(Skipped(check.check_id, check.title, reason))
            else:
                active.append(check)
        return active, skipped


REGISTRY = Registry()
_CHAT = (SFT, PREFERENCE)
_SAID = (SFT, PREFERENCE, UNKNOWN)


def _by(rows: DataFrame, count: Column | str, total: Column | str = "total", dataset: Column | str = "dataset", *more: Column) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(column(dataset).alias("dataset"), column(count).cast("bigint").alias("count"), column(total).cast("bigint").alias("total"), *more)


_add = REGISTRY.add


def _personal(scan: Scan) -> DataFrame:
    found = records._personal(scan.docs, records.P.PERSONAL).select("doc_id", "dataset").distinct().groupBy("dataset").agg(F.count("*").alias("n"))
    every = scan.docs.groupBy("dataset").agg(F.count("*").alias("total"))
    return _by(every.join(found, "dataset", "left"), F.coalesce("n", F.lit(0)))


def _identity(scan: Scan) -> DataFrame:
    return _by(records.identity_refusal(scan.convs), F.col("identity") + F.col("refusal"), "total", "dataset", F.when(F.col("identity") > 0, BLOCKING).otherwise(INFO).alias("severity"))


def _layout_votes(scan: Scan, fault: Column) -> DataFrame:
    """Datasets with a fault, of all."""
    return _by(layouts.induce(scan.raw).where("is_main"), fault.cast("int"), F.lit(1))


def _shape(column: str) -> Callable[[Scan], DataFrame]:
    return lambda scan: _by(records.line_shape_quality(scan.docs), column)


def _language(scan: Scan) -> DataFrame:
    return _by(records.language_composition(scan.docs), F.when(F.col("lang") == "unknown", F.col("records")).otherwise(0), "records")


def _contaminated(scan: Scan) -> DataFrame:
    return _by(contamination.contamination(scan.docs, scan.items), "contaminated", "items", "benchmark", F.when(F.col("flagged"), BLOCKING).otherwise(WARNING).alias("severity"))


def _templates(scan: Scan) -> DataFrame:
    found = records.template_drift(scan.docs, scan.template)
    return _by(found.crossJoin(scan.docs.agg(F.count("*").alias("total"))), "records", "total", "family", F.when(F.col("blocking"), BLOCKING).otherwise(WARNING).alias("severity")).withColumn("total", F.when(F.row_number().over(records.Window.orderBy("dataset")) == 1, F.col("total")).otherwise(0))


def _few_regions(scan: Scan, least: int = 300, effective: float = 10, top: float = 0.25) -> DataFrame:
    """The regions that are held, of all, where the corpus keeps to few."""
    c = atlas.coverage(scan.placed, scan.cells).where((F.col("placed") >= least) & ((F.col("effective") <= effective) | (F.col("top_share") >= top)))
    return _by(c.crossJoin(scan.cells.agg(F.count("*").alias("cells"))), "regions", "cells", F.lit("all"))


def _alike_regions(scan: Scan, least: int = 300, share: float = 0.2, cohesion: float = 0.75) -> DataFrame:
    """Records of large regions whose members are much alike."""
    n = scan.placed.agg(F.count_if(F.col("region") != -1).alias("placed")).where(F.col("placed") >= least)
    large = atlas.cohesion(scan.placed, scan.vectors).crossJoin(n).where((F.col("n") >= share * F.col("placed")) & (F.col("cohesion") >= cohesion))
    first = F.row_number().over(records.Window.orderBy("region")) == 1
    return _by(large, "n", F.when(first, F.col("placed")).otherwise(0), F.col("region").cast("string"))


def _truncated(scan: Scan) -> DataFrame:
    return _by(budget.truncation(scan.docs, scan.seq_len), "truncated")


_add("T0-SCHEMA-001", "Records that look like logs", BLOCKING, "Point the scan at training data, or convert the logs first.", lambda s: _layout_votes(s, F.col("log_share") >= 0.5), EVERY, (SFT, CORPUS, PREFERENCE), ("raw",))
_add("T0-SCHEMA-002", "Datasets that mix layouts", WARNING, "Bring each dataset into one layout.", lambda s: _layout_votes(s, F.col("mixed")), EVERY, (SFT,), ("raw",))
_add("T0-SCHEMA-003", "Records that can't be parsed", WARNING, "Repair or drop the lines.", lambda s: _by(layouts.unparseable(s.raw), "errors"), EVERY, (SFT, CORPUS), ("raw",))
_add("T0-SCHEMA-004", "Message content that is no text", WARNING, "Write contents as strings.", lambda s: _by(layouts.coerced_content(s.normalised), "coerced"), _CHAT, (SFT,), ("raw",))
_add("T0-SCHEMA-005", "Texts under keys that no layout reads", WARNING, "Rename the keys, or fold their texts into a key that is read.", lambda s: _by(layouts.unread_records(s.raw), "unread"), _CHAT, (SFT,), ("raw",))
_add("T0-ROLE-001", "Conversations of unsound structure", BLOCKING, "Merge turns of one role, drop empty ones, end on the assistant.", lambda s: _by(records.role_structure(s.convs), "affected", "total", F.lit("conversations")), _CHAT, (SFT,), ("convs",))
_add("T0-ROLE-002", "Role names that need mapping", BLOCKING, "Rename roles to user, assistant, system and tool.", lambda s: _by(s.convs.select("dataset", F.exists("turns", lambda t: t["raw_role"].isNotNull()).cast("int").alias("n")).groupBy("dataset").agg(F.sum("n").alias("n"), F.count("*").alias("total")), "n"), _CHAT, (SFT,), ("convs",))
_add("T0-REASON-001", "Some responses reason and others don't", WARNING, "Train on one kind, or mark the kinds.", lambda s: _by(records.reasoning_mix(s.convs).where("flagged"), "minority", "total", F.lit("conversations")), _CHAT, (), ("convs",))
_add("T0-TRUNC-002", "Responses that pile up at one length", WARNING, "Generate again with a higher limit.", lambda s: _by(records.response_length_cap(s.convs).where("flagged"), "at_top", "total", F.lit("conversations")), _CHAT, (SFT,), ("convs",))
_add("T0-QUAL-001", "Documents whose lines seldom end a sentence", INFO, "Look at what the extraction left.", _shape("low_punct"), (CORPUS,), least_total=50)
_add("T0-QUAL-002", "Documents of short lines", INFO, "Look for lists and menus.", _shape("short_lines"), (CORPUS,), least_total=50)
_add("T0-QUAL-003", "Documents with repeated lines", INFO, "Remove repeated lines.", _shape("dup_lines"), (CORPUS,), least_total=50)
_add("T0-ENC-001", "Damaged encoding", WARNING, "Decode the source anew, and normalise to form C.", lambda s: _by(records.encoding_hygiene(s.docs), "affected"), EVERY, (SFT, CORPUS))
_add("T0-DUP-001", "Exact copies", WARNING, "Keep one of each.", lambda s: _by(duplicates.exact_duplicates(s.docs), "copies", "first_seen"))
_add("T0-DEGEN-001", "Degenerate answers", WARNING, "Drop trivial, looping and copied answers.", lambda s: _by(records.degeneracy(s.convs), F.col("trivial") + F.col("looping") + F.col("copies")), _SAID, (), ("convs",))
_add("T0-TMPL-001", "Texts that already carry a chat template", WARNING, "Strip the marks before a template is applied.", _templates, EVERY, (SFT,))
_add("T0-MASK-001", "Records without a trainable part", BLOCKING, "Add answers, or drop the records.", lambda s: _by(budget.mask_summary(s.convs), "untrainable", "total", F.lit("conversations")), _CHAT, (SFT,), ("convs",))
_add("T0-TRUNC-001", "Records longer than the sequence", WARNING, "Raise the length, or split the records.", _truncated, (SFT, CORPUS, PREFERENCE), (SFT,), ("seq_len",))
_add("T1-NDUP-001", "Near duplicates", WARNING, "Keep one of each cluster.", lambda s: _by(s.near.summary(), "near_duplicates", "total", F.lit("all")))
_add("T1-DUP-002", "Prompts with several answers", WARNING, "Keep one answer, or make preferences of them.", lambda s: _by(records.contradictory_prompts(s.convs), "contradictory", "prompts", F.lit("conversations")), (SFT,), (), ("convs",))
_add("T1-OVERLAP-001", "Datasets that share records", WARNING, "Drop one of two datasets that overlap.", lambda s: _by(s.near.overlap(1), "matched", "of", F.concat_ws(" in ", "source", "target")), EVERY, (), ("several datasets",))
_add("T1-CONTAM-001", "Benchmark items in the data", BLOCKING, "Remove the records that hold them.", _contaminated, EVERY, (SFT, CORPUS, PREFERENCE), ("items",))
_add("T1-ATLAS-001", "Few regions of the map", INFO, "Check that the corpus is meant to be narrow.", _few_regions, EVERY, (), ("vectors", "cells"))
_add("T1-ATLAS-002", "Large regions of records much alike", WARNING, "Look for templates and copies.", _alike_regions, EVERY, (), ("vectors", "cells"))
_add("T1-LANG-001", "Records of unknown language", INFO, "Look at what these are.", _language)
_add("T1-LANG-002", "Languages that few records of a dataset have", WARNING, "Check that they belong there.", lambda s: _by(records.language_outliers(s.docs), "records", F.when(F.row_number().over(records.Window.partitionBy("dataset").orderBy("lang")) == 1, F.col("total")).otherwise(0)))
_add("T1-LANG-003", "Texts in another script than their language's", INFO, "Check the language labels.", lambda s: _by(records.script_mismatches(s.docs), "mismatched", "total", "lang"))
_add("T1-PII-001", "Personal data and secrets", BLOCKING, "Redact or drop them.", _personal, EVERY, (SFT, CORPUS, PREFERENCE))
_add("T1-IDENT-001", "Answers that claim another identity, or refuse", WARNING, "Drop or rewrite them.", _identity, _SAID, (SFT,), ("convs",))
_add("T1-STYLE-001", "Stock phrases", INFO, "Vary how answers begin.", lambda s: _by(records.style_openers(s.convs), "openers"), _SAID, (), ("convs",), least_rate=0.15)
_add("T1-LIC-001", "Datasets without a licence", WARNING, "State the licence in the card.", lambda s: _by(s.cards, (F.coalesce(F.trim("license"), F.lit("")) == "").cast("int"), F.lit(1)), EVERY, (), ("cards",))


def findings(scan: Scan, registry: Registry = REGISTRY) -> DataFrame:
    """All findings of a scan, rows of FINDING, ordered by id. Each check is an aggregation and a job of its own, which gives one row at most; checks that find nothing have none."""
    active, _ = registry.resolve(scan)
    return scan.spark.createDataFrame([tuple(r) for c in active for r in c.finding(scan).collect()], FINDING)


def rank(found: DataFrame) -> DataFrame:
    """Findings in the order to read them: what blocks, what would block, warnings, the rest; larger shares first."""
    tier = F.when(F.col("is_blocking"), 0).when((F.col("severity") == BLOCKING) | (F.size("would_block_under") > 0), 1).when(F.col("severity") == WARNING, 2).otherwise(3)
    return found.withColumn("rank_tier", tier).orderBy("rank_tier", F.desc("rate"), "check_id")


def without_evidence(value: object, names: Iterable[str] = ("evidence", "record", "source_file", "excerpt")) -> object:
    """A finding or report without whatever quotes the data, at any depth."""
    if isinstance(value, dict):
        return {k: without_evidence(v, names) for k, v in value.items() if k not in names}
    return [without_evidence(v, names) for v in value] if isinstance(value, list) else value
