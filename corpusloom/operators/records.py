"""Checks of single records: each is one aggregation over expressions, so one pass and one small shuffle.

docs have (doc_id, dataset, text), conversations what sources.tables.conversations gives.
Shares are of the records that a check looks at, not of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.functions.language import detect, script_mismatch
from corpusloom.operators.budget import share_of_sample


def _n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def encoding_hygiene(docs: DataFrame) -> DataFrame:
    """By dataset: records, and those with wrongly decoded text, control characters, or not in normal form C."""
    seen = docs.where("text IS NOT NULL").select("dataset", T.has_mojibake(F.col("text")).alias("m"), T.has_control(F.col("text")).alias("c"), (~T.is_nfc(F.col("text"))).alias("n"))
    return seen.groupBy("dataset").agg(F.count("*").alias("total"), _n(F.col("m"), "mojibake"), _n(F.col("c"), "control"), _n(F.col("n"), "not_nfc"), _n(F.col("m") | F.col("c") | F.col("n"), "affected"))


def line_shape_quality(docs: DataFrame, punct: float = 0.12, short: float = 0.67, dup: float = 0.01, least_docs: int = 50) -> DataFrame:
    """By dataset: documents of 200 characters and more, and those with too few lines that end a sentence, too many short lines, or too much text in repeated lines. flagged: some fail, of enough documents."""
    seen = docs.select("dataset", T.line_shape(F.col("text")).alias("s")).where("s IS NOT NULL")
    out = seen.groupBy("dataset").agg(F.count("*").alias("total"), _n(F.col("s.punct_share") < punct, "low_punct"), _n(F.col("s.short_share") > short, "short_lines"), _n(F.col("s.dup_share") > dup, "dup_lines"), F.round(F.avg("s.punct_share"), 6).alias("mean_punct"))
    return out.withColumn("flagged", (F.col("total") >= least_docs) & (F.col("low_punct") + F.col("short_lines") + F.col("dup_lines") > 0))


def degeneracy(records: DataFrame, trivial: int = 3, looping: float = 0.5, copied: float = 0.9) -> DataFrame:
    """By dataset: records whose answer is trivial, loops, or copies the prompt; the first that holds counts. records have prompt and answer; an answer of null is the whole text."""
    answer = F.coalesce("answer", "text")
    a, p = F.lower(T.one_spaced(answer)), F.lower(T.one_spaced(F.coalesce("prompt", F.lit(""))))
    copy = (F.length(a) > 40) & (p != "") & (p.contains(a) | a.contains(p)) & (F.least(F.length(a), F.length(p)) / F.greatest(F.length(a), F.length(p)) >= copied)
    kind = F.when(F.length(T.stripped(answer)) <= trivial, "trivial").when(T.repetition(answer) >= looping, "looping").when(copy, "copy")
    seen = records.where(F.coalesce(answer, F.lit("")) != "").select("dataset", kind.alias("kind"))
    return seen.groupBy("dataset").agg(F.count("*").alias("total"), _n(F.col("kind") == "trivial", "trivial"), _n(F.col("kind") == "looping", "looping"), _n(F.col("kind") == "copy", "copies"))


def _personal(docs: DataFrame, kinds: tuple[P.Personal, ...]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k.kind).alias("kind"), P.masked_value(k, F.col("text")).alias("masked")) for k in kinds])
    return docs.where("text IS NOT NULL").select("doc_id", "dataset", F.explode(F.filter(each, lambda e: e["masked"].isNotNull())).alias("e")).select("doc_id", "dataset", "e.kind", "e.masked")


def personal_data(docs: DataFrame, kinds: tuple[P.Personal, ...] = P.PERSONAL) -> DataFrame:
    """By kind of personal data: records with a valid match, and datasets that have them. Kinds without a match are left out."""
    return _personal(docs, kinds).groupBy("kind").agg(F.count("*").alias("records"), F.count_distinct("dataset").alias("datasets"), F.min("doc_id").alias("first_doc"))


def personal_evidence(docs: DataFrame, cap: int = 8, kinds: tuple[P.Personal, ...] = P.PERSONAL) -> DataFrame:
    """The first `cap` records of each kind in corpus order, with the first valid value masked. No value is shown."""
    order = Window.partitionBy("kind").orderBy("doc_id", "masked")
    return _personal(docs, kinds).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("kind", "doc_id", "masked")


def identity_refusal(records: DataFrame) -> DataFrame:
    """By dataset: records that claim another product's identity, and of the others those that refuse. What is looked at is the answer, else the text."""
    said = F.coalesce(F.when(F.col("answer") != "", F.col("answer")), F.col("text"))
    seen = records.where("text IS NOT NULL").select("dataset", P.any_hit(said, P.IDENTITY).alias("i"), P.any_hit(said, P.REFUSAL).alias("r"))
    return seen.groupBy("dataset").agg(F.count("*").alias("total"), _n(F.col("i"), "identity"), _n(~F.col("i") & F.col("r"), "refusal"), F.max("i").alias("blocking"))


def style_openers(records: DataFrame, rate: float = 0.15) -> DataFrame:
    """By dataset: responses, those that begin with a stock phrase or hold one, and whether their share reaches `rate`."""
    said = F.coalesce(F.when(F.col("answer") != "", F.col("answer")), F.col("text"))
    seen = records.where("text IS NOT NULL").select("dataset", P.any_hit(said, P.OPENERS).alias("o"))
    out = seen.groupBy("dataset").agg(F.count("*").alias("total"), _n(F.col("o"), "openers"))
    return out.withColumn("flagged", F.col("openers") / F.col("total") >= rate)


def reasoning_mix(records: DataFrame, least: int = 200, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Responses with and without a reasoning tag: share, the minority's number, and whether both are there to a degree that confuses."""
    seen = records.where("answer <> ''").select(F.col("answer").rlike(P.REASONING).alias("t"))
    out = seen.agg(F.count("*").alias("total"), _n(F.col("t"), "tagged"))
    share = F.when(F.col("total") > 0, F.col("tagged") / F.col("total")).otherwise(0.0)
    return out.select("total", "tagged", F.round(share, 6).alias("share"), F.least("tagged", F.col("total") - F.col("tagged")).alias("minority"), ((F.col("total") >= least) & share.between(low, high)).alias("flagged"))


def template_drift(docs: DataFrame, target: str | None = None) -> DataFrame:
    """Records that already carry a chat template's marks, by family; blocking where the family isn't the target's."""
    seen = docs.select(P.template_family(F.col("text")).alias("f")).where("f IS NOT NULL")
    out = seen.groupBy(F.col("f.family").alias("family")).agg(F.count("*").alias("records"))
    return out.withColumn("blocking", F.lit(False) if target is None else F.col("family") != target)


def role_structure(convs: DataFrame) -> DataFrame:
    """Conversations by fault: no assistant, the same role twice running (user or assistant), an empty turn, the last turn the user's. A record counts once under each, and once in `affected`."""
    t = F.col("turns")
    twice = F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: (F.try_element_at(t, i)["role"] == F.try_element_at(t, i + 1)["role"]) & F.try_element_at(t, i)["role"].isin("user", "assistant"))
    seen = convs.where(F.size("turns") > 0).select(
        (~F.exists(t, lambda x: x["role"] == "assistant")).alias("a"), F.coalesce(twice, F.lit(False)).alias("b"), F.exists(t, lambda x: T.stripped(x["content"]) == "").alias("c"), (F.element_at(t, -1)["role"] == "user").alias("d")
    )
    return seen.agg(F.count("*").alias("total"), _n(F.col("a"), "no_assistant"), _n(F.col("b"), "consecutive"), _n(F.col("c"), "empty_turn"), _n(F.col("d"), "ends_on_user"), _n(F.col("a") | F.col("b") | F.col("c") | F.col("d"), "affected"))


def role_vocabulary(turns: DataFrame) -> DataFrame:
    """Role names as they are and what they stand for, with their numbers of turns. turns have `role`."""
    return turns.groupBy(F.col("role").alias("raw_role")).agg(F.count("*").alias("turns")).select("raw_role", P.canonical_role(F.col("raw_role")).alias("role"), "turns", (P.canonical_role(F.col("raw_role")) != F.col("raw_role")).alias("renamed"))


def contradictory_prompts(convs: DataFrame, least: int = 20) -> DataFrame:
    """Prompts of `least` characters and more that have several different answers: prompts, distinct answers over all, the most for one prompt. Exact, whatever the number of prompts."""
    seen = convs.select(T.one_spaced(F.col("prompt")).alias("p"), T.one_spaced(F.col("answer")).alias("a")).where((F.length("p") >= least) & (F.col("a") != ""))
    each = seen.groupBy(F.md5("p").alias("p")).agg(F.count("*").alias("records"), F.count_distinct(F.md5("a")).alias("answers"))
    return each.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"), F.count("*").alias("prompts"), _n(F.col("answers") > 1, "contradictory"), F.coalesce(F.sum(F.when(F.col("answers") > 1, F.col("answers"))), F.lit(0)).alias("answers"), F.coalesce(F.max("answers"), F.lit(0)).alias("most"))


def response_length_cap(convs: DataFrame, least: int = 200, top: int = 200, width: int = 25, share: float = 0.05, factor: int = 3) -> DataFrame:
    """Whether answers pile up at the greatest length: (total, longest, at_top, tallest_below, flagged). The top bucket holds lengths over longest - width; ten buckets of that width lie below."""
    n = convs.where("answer <> ''").select(F.length("answer").cast("bigint").alias("n"))
    stats = n.agg(F.count("*").alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))
    placed = n.crossJoin(F.broadcast(stats)).select("total", "longest", F.when(F.col("n") > F.col("longest") - width, 0).otherwise(F.floor((F.col("longest") - width - F.col("n")) / width) + 1).alias("bucket"))
    counted = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    both = counted.agg(F.coalesce(F.sum(F.when(F.col("bucket") == 0, F.col("n"))), F.lit(0)).alias("at_top"), F.coalesce(F.max(F.when(F.col("bucket").between(1, 10), F.col("n"))), F.lit(0)).alias("tallest_below"))
    out = stats.crossJoin(both)
    pile = (F.col("total") >= least) & (F.col("longest") >= top) & (F.col("at_top") >= share * F.col("total")) & (F.col("at_top") >= factor * F.col("tallest_below"))
    return out.withColumn("flagged", pile)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, dataset, lang, confidence, script, chars) of every text."""
    return docs.where("text IS NOT NULL").select("doc_id", "dataset", F.length("text").alias("chars"), detect(F.col("text")).alias("d")).select("doc_id", "dataset", "d.*", "chars")


def language_composition(docs: DataFrame, shortest: int = 40) -> DataFrame:
    """Records by dataset and language, of texts of 40 characters and more."""
    return languages(docs).where(F.col("chars") >= shortest).groupBy("dataset", "lang").agg(F.count("*").alias("records"), F.round(F.avg("confidence"), 6).alias("confidence"))


def language_outliers(docs: DataFrame, confidence: float = 0.7, shortest: int = 40, least: int = 20, modal: float = 0.6, minority: float = 0.25) -> DataFrame:
    """Languages that few records of an otherwise uniform dataset have: (dataset, main_lang, lang, records, total)."""
    sure = languages(docs).where((F.col("chars") >= shortest) & (F.col("lang") != "unknown") & (F.col("confidence") >= confidence))
    counts = sure.groupBy("dataset", "lang").agg(F.count("*").alias("records"))
    own = Window.partitionBy("dataset")
    seen = counts.withColumns({"total": F.sum("records").over(own), "most": F.max("records").over(own), "main_lang": F.first("lang").over(own.orderBy(F.desc("records"), "lang"))})
    few = (F.col("total") >= least) & (F.col("most") / F.col("total") >= modal) & (F.col("records") / F.col("total") <= minority) & (F.col("lang") != F.col("main_lang"))
    return seen.where(few).select("dataset", "main_lang", "lang", "records", "total")


def script_mismatches(docs: DataFrame, shortest: int = 40) -> DataFrame:
    """By language: records of known language, and those written in a script that isn't its own."""
    known = languages(docs).where((F.col("chars") >= shortest) & (F.col("lang") != "unknown"))
    return known.groupBy("lang").agg(F.count("*").alias("total"), _n(script_mismatch(F.col("lang"), F.col("script")), "mismatched"))


def licences_missing(datasets: DataFrame) -> DataFrame:
    """Datasets without a licence. datasets have (dataset, license)."""
    return datasets.where(F.coalesce(F.trim("license"), F.lit("")) == "").select("dataset")


def totals(docs: DataFrame) -> DataFrame:
    """By dataset: records, characters, words and tokens by estimate."""
    t = F.coalesce("text", F.lit(""))
    return docs.groupBy("dataset").agg(F.count("*").alias("records"), F.sum(F.length(t)).cast("bigint").alias("chars"), F.sum(T.word_estimate(t)).cast("bigint").alias("words"), F.sum(T.token_estimate(t)).cast("bigint").alias("tokens"))


def surface_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, space_share, other_share, repetition) of every text."""
    return docs.where("text IS NOT NULL").select("doc_id", T.surface(F.col("text")).alias("s"), F.round(T.repetition(F.col("text")), 6).alias("repetition")).select("doc_id", F.round("s.space_share", 6).alias("space_share"), F.round("s.other_share", 6).alias("other_share"), "repetition")


def content_digest(docs: DataFrame) -> DataFrame:
    """A digest of all records that doesn't depend on their order: each one's 60-bit hash, summed modulo 10^18."""
    own = T.hash60(F.concat_ws("|", F.length("dataset"), "dataset", F.length("text"), "text"))
    return docs.agg(F.count("*").alias("records"), F.pmod(F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0)), F.lit(10**18).cast("decimal(38,0)")).cast("bigint").alias("digest"))


def bottom_k(docs: DataFrame, k: int = 200_000) -> DataFrame:
    """A sample of k records: the least hashes of their place. Needs no sort of the whole, and adding records moves few."""
    return docs.where(F.length("text") > 20).select("doc_id", "dataset", T.hash60(F.concat(F.col("dataset"), F.lit(":"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(k)


def stratified_sample(docs: DataFrame, k: int | None = None) -> DataFrame:
    """k records of each dataset (share_of_sample by default), the least hashes of their place."""
    k = k or share_of_sample(docs)
    hashed = docs.where(F.length("text") > 20).select("doc_id", "dataset", T.hash60(F.concat(F.col("dataset"), F.lit(":"), F.col("doc_id").cast("string"))).alias("h"))
    return hashed.withColumn("n", F.row_number().over(Window.partitionBy("dataset").orderBy("h", "doc_id"))).where(F.col("n") <= k).select("dataset", "doc_id")
