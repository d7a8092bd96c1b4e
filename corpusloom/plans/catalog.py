"""The registered queries: operators applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import atlas, budget, contamination, duplicates, records, vocabulary
from corpusloom.plans import findings, report
from corpusloom.sources import extract, sniff
from corpusloom.sources import records as layouts
from corpusloom.sources.tables import conversations, documents, spread, table
from corpusloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _over_documents(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: operator(documents(spark, folder))


def _over_conversations(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: operator(conversations(spark, folder))


for _f in (
    duplicates.exact_duplicates, records.encoding_hygiene, records.line_shape_quality, records.personal_data, records.personal_evidence, records.template_drift, records.language_composition,
    records.language_outliers, records.script_mismatches, records.totals, records.surface_measures, records.content_digest, records.bottom_k, records.stratified_sample,
    budget.stratified_budget, budget.packing, budget.truncation, vocabulary.unigrams, vocabulary.captions,
):
    _over_documents(_f.__name__, _f)

for _f in (records.degeneracy, records.identity_refusal, records.style_openers, records.reasoning_mix, records.role_structure, records.contradictory_prompts, records.response_length_cap, budget.mask_summary):
    _over_conversations(_f.__name__, _f)


def plain(docs: DataFrame) -> DataFrame:
    """Documents as records without prompt and answer."""
    return docs.withColumns({"prompt": F.lit(None).cast("string"), "answer": F.lit(None).cast("string")})


_over_documents("document_degeneracy", lambda d: records.degeneracy(plain(d)))
_over_documents("document_identity", lambda d: records.identity_refusal(plain(d)))


@query
def role_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return records.role_vocabulary(table(spark, folder, "conversations"))


@query
def licences_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets none of whose documents has a line that names a licence."""
    named = F.max(F.when(F.lower("text").contains("license"), "stated")).alias("license")
    return records.licences_missing(documents(spark, folder).groupBy("dataset").agg(named))


def _near(spark: SparkSession, folder: str) -> duplicates.Near:
    return duplicates.Near(documents(spark, folder))


@query
def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of class representatives; near_members gives the classes."""
    return _near(spark, folder).pairs.withColumn("jaccard", F.round("jaccard", 6))


@query
def near_members(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).members()


@query
def near_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).clusters()


@query
def near_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).summary()


@query
def dataset_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).overlap()


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.lit("benchmark").alias("benchmark"), "item_id", "text")


@query
def benchmark_witnesses(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.witnesses(documents(spark, folder), _items(spark, folder))


@query
def benchmark_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contamination(documents(spark, folder), _items(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.concat(F.lit("set"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("dataset"), "embedding", "label")


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vectors = _vectors(spark, folder)
    cells = atlas.centroids(vectors)
    return vectors, cells, atlas.assign(vectors, cells)


@query
def atlas_centroid_sizes(spark: SparkSession, folder: str) -> DataFrame:
    _, cells, _ = _placed(spark, folder)
    return cells.select("region", "category", "size", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("vec_sum"))


@query
def atlas_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder)[2]


@query
def atlas_soft_assign(spark: SparkSession, folder: str) -> DataFrame:
    vectors, cells, _ = _placed(spark, folder)
    return atlas.soft_assign(vectors, cells)


@query
def atlas_coverage(spark: SparkSession, folder: str) -> DataFrame:
    _, cells, placed = _placed(spark, folder)
    return atlas.coverage(placed, cells)


@query
def atlas_density(spark: SparkSession, folder: str) -> DataFrame:
    _, cells, placed = _placed(spark, folder)
    return atlas.density(placed, cells)


@query
def atlas_gaps(spark: SparkSession, folder: str) -> DataFrame:
    _, cells, placed = _placed(spark, folder)
    return atlas.gaps(placed, cells, 0.3)


@query
def atlas_dataset_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.dataset_similarity(_placed(spark, folder)[2])


@query
def atlas_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    vectors, _, placed = _placed(spark, folder)
    return atlas.cohesion(placed, vectors)


@query
def atlas_examples(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.examples(_placed(spark, folder)[2])


@query
def atlas_compare(spark: SparkSession, folder: str) -> DataFrame:
    _, _, placed = _placed(spark, folder)
    return atlas.compare(placed.where("dataset = 'set0'"), placed.where("dataset IN ('set1', 'set2')"))


@query
def atlas_off(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.off_summary(_placed(spark, folder)[2])


@query
def atlas_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.cutoff_of(_placed(spark, folder)[2])


@query
def atlas_purity(spark: SparkSession, folder: str) -> DataFrame:
    vectors, _, placed = _placed(spark, folder)
    return atlas.purity(placed.join(vectors.select("vec_id", "label"), "vec_id"))


@query
def atlas_category_counts(spark: SparkSession, folder: str) -> DataFrame:
    vectors, cells, placed = _placed(spark, folder)
    return atlas.category_counts(placed.join(vectors.select("vec_id", "label"), "vec_id"), cells)


@query
def atlas_crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    """The map's own regions against the labels."""
    vectors, _, placed = _placed(spark, folder)
    return atlas.crosswalk(placed, vectors.select("vec_id", F.col("label").alias("region")))


@query
def semantic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.semantic_pairs(_vectors(spark, folder), bits=4, cosine=0.5)


@query
def semantic_keepers(spark: SparkSession, folder: str) -> DataFrame:
    return atlas.semantic_keepers(_vectors(spark, folder), bits=4, cosine=0.5)


@query
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages")).select("page_id", T.html_stripped(F.col("html")).alias("text"))


@query
def markdown_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.markdown_stripped(F.col("text")).alias("text"))


@query
def formats(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and documents by the format that they are in."""
    every = table(spark, folder, "pages").select(F.lit("").alias("name"), F.col("html").alias("content")).unionByName(documents(spark, folder).select(F.lit("").alias("name"), F.col("text").alias("content")))
    return every.groupBy(T.detected_format(F.col("name"), F.col("content")).alias("format")).agg(F.count("*").alias("files"))


@query
def chunked(spark: SparkSession, folder: str) -> DataFrame:
    """By dataset: documents, chunks and their words."""
    c = documents(spark, folder).select("dataset", extract.chunks(F.col("text")).alias("c"))
    words = F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.size(T.plain_words(x)))
    return c.groupBy("dataset").agg(F.count("*").alias("documents"), F.sum(F.size("c")).cast("bigint").alias("chunks"), F.sum(words).cast("bigint").alias("words"))


def _props(spark: SparkSession, folder: str) -> DataFrame:
    """Events' properties and conversations' turns as JSON records of two datasets."""
    events = table(spark, folder, "events").select(F.lit("events").alias("dataset"), F.col("event_id").alias("place"), F.col("props").alias("record"))
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return events.unionByName(turns.select(F.lit("conversations"), F.col("conv_id"), messages).toDF("dataset", "place", "record"))


@query
def induced_layouts(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.induce(_props(spark, folder))


@query
def unparseable_records(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.unparseable(_props(spark, folder))


@query
def normalised_records(spark: SparkSession, folder: str) -> DataFrame:
    """By dataset and layout: records as documents, with turns and characters."""
    d = layouts.to_documents(_props(spark, folder))
    return d.groupBy("dataset", "layout").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.size("turns"), F.lit(0))).cast("bigint").alias("turns"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def _scan(spark: SparkSession, folder: str) -> findings.Scan:
    """The tables as one scan: documents, conversations, the benchmark, and as cards whether a dataset's documents name a licence."""
    docs = documents(spark, folder)
    named = docs.groupBy("dataset").agg(F.max(F.when(F.lower("text").contains("license"), "stated")).alias("license"))
    return findings.Scan(docs, conversations(spark, folder), None, named, _items(spark, folder))


@query
def finding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the whole catalog of checks finds."""
    rows = findings.findings(_scan(spark, folder))
    return rows.select("check_id", "severity", "count", "total", "rate", F.size("by_dataset").cast("bigint").alias("datasets"), F.array_join("would_block_under", ",").alias("would_block"))


@query
def atlas_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The two checks of the map. The embeddings are few at small scale, so each is taken for the records of one topic: its vector is there seven times."""
    vectors = _vectors(spark, folder)
    many = vectors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.col("vec_id") * 7 + k)).alias("vec_id"), "dataset", "embedding", "label")
    scan = findings.Scan(documents(spark, folder), vectors=many, cells=atlas.centroids(vectors), profile="unknown")
    rows = scan.spark.createDataFrame([tuple(r) for k in ("T1-ATLAS-001", "T1-ATLAS-002") for r in findings.REGISTRY.checks[k].finding(scan).collect()], findings.FINDING)
    return rows.select("check_id", "count", "total", "rate")


@query
def fingerprint_measures(spark: SparkSession, folder: str) -> DataFrame:
    return report.measures(_scan(spark, folder))


@query
def logs_among_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.not_training_data(_props(spark, folder))


@query
def coerced_content(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.coerced_content(layouts.to_documents(_props(spark, folder)))


@query
def unread_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as question and answer, with the whole first turn beside them under a key that no layout reads."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = lambda k: F.try_element_at("t", F.lit(k))["text"]
    raw = turns.select(F.lit("conversations").alias("dataset"), F.col("conv_id").alias("place"), F.to_json(F.struct(said(1).alias("instruction"), said(2).alias("output"), said(1).alias("aside"))).alias("record"))
    return layouts.unread_keys(raw)


@query
def text_files_with_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events' properties, twenty to a file, and documents as files of their own."""
    events = table(spark, folder, "events").groupBy(F.floor(F.col("event_id") / 20)).agg(F.array_join(F.sort_array(F.collect_list("props")), "\n").alias("text")).select(F.lit("events").alias("dataset"), "text")
    return sniff.text_files_with_records(events.unionByName(documents(spark, folder).select("dataset", "text")))


@query
def turn_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Turns by role and the role before, over a window of each conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, folder, "conversations").select("role", F.lag("role").over(order).alias("before")).groupBy(F.coalesce("before", F.lit("start")).alias("before"), "role").agg(F.count("*").alias("turns"))


@query
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.windowed_counts(spark, folder)


@query
def stream_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.exact_duplicates(spark, folder)
