"""Checks of single records: what must fire, and what must stay silent."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import language
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.functions.language import detect, script_of
from corpusloom.operators import budget, duplicates, records, vocabulary
from corpusloom.sources.tables import with_turns


def docs(spark, texts, dataset="a"):
    return spark.createDataFrame([(k, dataset, t) for k, t in enumerate(texts)], "doc_id bigint, dataset string, text string")


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v


def convs(spark, each):
    rows = [(k, [{"turn": n, "raw_role": r, "content": c} for n, (r, c) in enumerate(turns)]) for k, turns in enumerate(each)]
    return with_turns(spark.createDataFrame(rows, "conv_id bigint, raw array<struct<turn:bigint,raw_role:string,content:string>>"))


def test_exact_duplicates(spark):
    same = "the same chat again and again"
    r = duplicates.exact_duplicates(docs(spark, [same] * 9 + [f"text number {k}" for k in range(20)] + ["The  same chat again and again", "", None, "  "])).first()
    assert (r.first_seen, r.copies, r.clusters, r.largest, r.loose_copies) == (30, 8, 1, 9, 1)


def test_encoding(spark):
    r = records.encoding_hygiene(docs(spark, ["plain", "cafÃ©", "a\x01b", unicodedata.normalize("NFD", "é à"), None])).first()
    assert (r.total, r.mojibake, r.control, r.not_nfc, r.affected) == (4, 1, 1, 1, 3)


def test_personal_data(spark):
    texts = ["write to someone@example.org", "IBAN GB82WEST12345698765432", "IBAN GB82WEST12345698765433", "id 10000000146", "id 12345678901", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "key sk-ant-" + "a" * 24]
    found = {r.kind: r.records for r in records.personal_data(docs(spark, texts)).collect()}
    assert found == {"email": 1, "iban": 1, "tckn": 1, "credit_card": 1, "anthropic_key": 1, "openai_key": 1}
    shown = " ".join(r.masked for r in records.personal_evidence(docs(spark, texts)).collect())
    assert "someone" not in shown and "10000000146" not in shown and "4111 1111" not in shown


def test_degeneracy(spark):
    ask = [("user", "please say something about rivers and their deltas in general terms")]
    each = [[*ask, ("assistant", "ok")]] * 10 + [[*ask, ("assistant", "again and again it goes on so " * 30)]] + [[*ask, ("assistant", ask[0][1])]] + [[*ask, ("assistant", " ".join(f"word{k}" for k in range(60)))]]
    r = records.degeneracy(convs(spark, each)).first()
    assert (r.total, r.trivial, r.looping, r.copies) == (13, 10, 1, 1)


def test_roles(spark):
    each = [[("human", "hi"), ("gpt", "hello")], [("user", "a"), ("user", "b"), ("assistant", "c")], [("user", "a")], [("user", "a"), ("assistant", " ")], [("user", "a"), ("assistant", "b"), ("user", "c")], [("system", "s"), ("system", "t"), ("assistant", "b")]]
    r = records.role_structure(convs(spark, each)).first()
    assert (r.total, r.no_assistant, r.consecutive, r.empty_turn, r.ends_on_user, r.affected) == (6, 1, 1, 1, 2, 4)


def test_prompts_lengths_and_masks(spark):
    ask = ("user", "what is the capital of that country?")
    r = records.contradictory_prompts(convs(spark, [[ask, ("assistant", x)] for x in ("one", "two", "one")] + [[("user", "short"), ("assistant", x)] for x in ("a", "b")])).first()
    assert (r.prompts, r.contradictory, r.answers, r.most) == (1, 1, 2, 2)
    capped = [[ask, ("assistant", "x" * 1000)]] * 60 + [[ask, ("assistant", "x" * (300 + k))] for k in range(200)]
    assert records.response_length_cap(convs(spark, capped)).first().flagged
    assert not records.response_length_cap(convs(spark, capped[60:])).first().flagged
    m = budget.mask_summary(convs(spark, [[ask], [ask, ("assistant", "yes")]])).first()
    assert (m.total, m.untrainable, m.answer_lost) == (2, 1, 0)


def test_style_and_reasoning(spark):
    said = lambda n: [[("user", "q"), ("assistant", "Certainly! Here it is." if k < n else "Here it is.")] for k in range(100)]
    assert not records.style_openers(convs(spark, said(3))).first().flagged and records.style_openers(convs(spark, said(60))).first().flagged
    mixed = [[("user", "q"), ("assistant", "<think>so</think> yes" if k % 2 else "yes")] for k in range(200)]
    r = records.reasoning_mix(convs(spark, mixed)).first()
    assert (r.tagged, r.minority, r.flagged) == (100, 100, True) and not records.reasoning_mix(convs(spark, mixed[:199])).first().flagged
    i = records.identity_refusal(convs(spark, [[("user", "q"), ("assistant", "As an AI language model, I cannot help")], [("user", "q"), ("assistant", "I can't help with that")], [("user", "q"), ("assistant", "fine")]])).first()
    assert (i.identity, i.refusal, i.blocking) == (1, 1, True)


def test_templates(spark):
    got = {r.family: r.records for r in records.template_drift(docs(spark, ["<|im_start|>user\nhi<|im_end|>", "<|im_start|>a<|im_sep|>b<|im_end|>", "[INST] x [/INST]", "only [INST]", "plain", None])).collect()}
    assert got == {"chatml": 1, "phi4": 1, "mistral": 1}


def test_language(spark):
    assert value(spark, "the cat and the dog of that house is to be found in it", detect).lang == "en"
    assert value(spark, "der Hund und die Katze, das ist nicht ein Haus für Äpfel, süß", detect).lang == "de"
    assert value(spark, "short", detect).lang == "unknown"
    assert [script_of(t) for t in ("plain", "привет мир", "漢字かな漢字", "123")] == ["Latin", "Cyrillic", "Han", "None"]


def test_text_functions(spark):
    assert value(spark, "Iğdır İZMİR, it's_a test", T.words) == ["ığdır", "izmir", "it", "s_a", "test"]
    assert value(spark, "a b\n\tc ", T.one_spaced) == "a b c"
    assert value(spark, "<b>x</b><script>1</script> <p>y", T.html_stripped) == "x y"
    assert value(spark, "# H\n**b** [l](u) ![i](u)", T.markdown_stripped).split() == ["H", "b", "l"]
    assert value(spark, "one two " * 30, T.repetition) > 0.9 and value(spark, "one two", T.repetition) == 0
    assert value(spark, "a\x00<b>" + "x" * 900, T.escaped).startswith("a␀&lt;b&gt;")
    assert value(spark, "Human", P.canonical_role) == "user"


def test_results_do_not_depend_on_partitions(spark):
    table = docs(spark, [f"the text number {k % 7} of some length, repeated here for good measure and so on" for k in range(50)])
    want = sorted(duplicates.exact_duplicates(table).collect())
    for n in (1, 4, 32):
        assert sorted(duplicates.exact_duplicates(table.repartition(n)).collect()) == want
    digest = records.content_digest(table).first()
    assert records.content_digest(table.repartition(9)).first() == digest


def test_null_empty_and_clashing(spark):
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "a", "", "y"), (2, "a", "some words here", None)], "doc_id bigint, dataset string, text string, h string")
    for f in (duplicates.exact_duplicates, records.encoding_hygiene, records.line_shape_quality, records.personal_data, records.language_composition, records.totals, records.surface_measures, budget.packing, budget.stratified_budget):
        f(odd).collect()
        f(odd.limit(0)).collect()


def test_captions_read_texts_once(spark):
    table = docs(spark, ["alpha beta gamma", "alpha delta delta"], "a").unionByName(docs(spark, ["alpha zeta"], "b"))
    found = vocabulary.captions(table)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.word for r in found.where("`group` = 'a'").orderBy("rank").collect()] == ["delta", "alpha", "beta", "gamma"]


def test_languages_of_a_batch_hold_one_text(monkeypatch):
    kept = {}
    monkeypatch.setattr(language.F, "arrow_udf", lambda kind: lambda f: kept.setdefault("look", f) and (lambda column: None))
    language.detect(None)
    column = pa.array(["слово и не на " * 5000] * 200 + [None])
    kept["look"](column[:1])  # tables are made once
    tracemalloc.start()
    try:
        found = kept["look"](column)
        assert tracemalloc.get_traced_memory()[1] < 10 << 20 < column.nbytes
        tracemalloc.reset_peak()
        assert script_of("ы" * 5_000_000 + "a" * 4_000_000) == "Cyrillic"
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
    assert found[0].as_py()["lang"] == "ru" and found[200].as_py() is None
