"""Token budget: totals, a stratified estimate with its margin, packing and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of each text by a tokenizer file of the `tokenizers` library, or by length where there is none."""
    if path is None:
        return T.token_estimate(text)
    import pyarrow as pa

    with open(path, "rb") as f:
        model = f.read()

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        own = Tokenizer.from_buffer(model)
        texts = column.to_pylist()
        sizes = [len(e.ids) for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        return pa.array([None if t is None else n for t, n in zip(texts, sizes)], pa.int64())

    return count(text)


#: Records in a sample over all datasets, and of each at least.
SAMPLE, LEAST_SAMPLE = 20_000, 200


def share_of_sample(docs: DataFrame) -> int:
    """How many records of each dataset a sample takes: SAMPLE over the datasets, LEAST_SAMPLE at least."""
    return max(LEAST_SAMPLE, SAMPLE // max(1, docs.select("dataset").distinct().count()))


def stratified_budget(docs: DataFrame, per_stratum: int | None = None, tokens: Column | None = None) -> DataFrame:
    """Total tokens by a ratio estimate in each dataset from at most per_stratum records (share_of_sample by default; the least hashes of their place): (chars, tokens, margin, per_char). margin is 1.96 standard errors, with the correction for finite strata."""
    tokens = T.token_estimate(F.col("text")) if tokens is None else tokens
    per_stratum = per_stratum or share_of_sample(docs)
    rows = docs.where(F.length("text") > 0).select("doc_id", "dataset", "text", T.hash60(F.concat(F.col("dataset"), F.lit(":"), F.col("doc_id").cast("string"))).alias("h"))
    strata = rows.groupBy("dataset").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("records"))
    chosen = rows.select("doc_id", "dataset", "h").withColumn("n", F.row_number().over(Window.partitionBy("dataset").orderBy("h", "doc_id"))).where(F.col("n") <= per_stratum).select("doc_id", "dataset")
    sample = rows.join(chosen, ["doc_id", "dataset"]).select("dataset", tokens.cast("double").alias("t"), F.length("text").cast("double").alias("c"))
    s = sample.groupBy("dataset").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("c")).alias("tc"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("n"))
    ratio = F.col("t") / F.col("c")
    residual = F.greatest(F.col("tt") - 2 * ratio * F.col("tc") + ratio * ratio * F.col("cc"), F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
    size = F.col("records")
    var = F.when(F.col("n") > 1, size * size * (1 - F.col("n") / size) * residual / F.col("n")).otherwise(0.0)
    each = s.join(strata, "dataset").select("chars", (F.col("chars") * ratio).alias("tokens"), var.alias("var"))
    out = each.agg(F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("chars"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"), F.coalesce(F.sum("var"), F.lit(0.0)).alias("var"))
    return out.select("chars", F.round("tokens", 3).alias("tokens"), F.round(1.96 * F.sqrt("var"), 3).alias("margin"), F.round(F.try_divide("tokens", "chars"), 9).alias("per_char"))


def packing(docs: DataFrame, seq_len: int = 2048) -> DataFrame:
    """Blocks of seq_len tokens that all records fill when packed end to end, and the tokens left over."""
    out = docs.where("text IS NOT NULL").agg(F.count("*").alias("records"), F.coalesce(F.sum(T.token_estimate(F.col("text"))), F.lit(0)).cast("bigint").alias("tokens"))
    return out.select("records", "tokens", F.floor(F.col("tokens") / seq_len).cast("bigint").alias("blocks"), F.pmod("tokens", F.lit(seq_len).cast("bigint")).alias("residual"))


def truncation(docs: DataFrame, seq_len: int = 2048) -> DataFrame:
    """By dataset: records longer than seq_len tokens, and the tokens lost."""
    seen = docs.where("text IS NOT NULL").select("dataset", T.token_estimate(F.col("text")).alias("n"))
    return seen.groupBy("dataset").agg(F.count("*").alias("total"), F.count_if(F.col("n") > seq_len).alias("truncated"), F.sum(F.greatest(F.col("n") - seq_len, F.lit(0))).cast("bigint").alias("tokens_lost"))


def answer_masks(convs: DataFrame, eos: str = "<|im_end|>") -> DataFrame:
    """Conversations rendered in the ChatML layout: (conv_id, rendered, chars, trainable, eos_trained), trainable being the characters of assistant turns with their end marks."""
    turn = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit(eos + "\n"))
    rendered = F.array_join(F.transform("turns", turn), "")
    own = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["content"]) + len(eos))
    return convs.select("conv_id", rendered.alias("rendered"), F.length(rendered).cast("bigint").alias("chars"), own.alias("trainable"))


def mask_summary(convs: DataFrame, seq_chars: int = 2048 * 4) -> DataFrame:
    """(total, untrainable, share, answer_lost): conversations without a trainable character, the trainable share of all, and those whose first assistant turn begins beyond seq_chars."""
    m = answer_masks(convs).withColumn("at", F.locate("<|im_start|>assistant\n", F.col("rendered")))
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("trainable") == 0).alias("untrainable"), F.round(F.try_divide(F.sum("trainable"), F.sum("chars")), 6).alias("share"), F.count_if((F.col("at") > seq_chars) & (F.col("trainable") > 0)).alias("answer_lost"))
