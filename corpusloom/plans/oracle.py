"""The same queries in SQL, for another engine to check them by."""

from __future__ import annotations

from corpusloom.functions import patterns as P
from corpusloom.functions.language import EXPECTED, PROFILES, SCRIPTS
from corpusloom.functions.text import CONTROL, HTML_DROPPED, MOJIBAKE, SPACE, TERMINAL, TURKISH
from corpusloom.operators.duplicates import PRESETS, PRIME, coefficients
from corpusloom.plans.report import FACETS

Q = lambda s: "'" + s.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {Q(SPACE + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {Q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(translate({x}, '{TURKISH[0]}', '{TURKISH[1]}')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"


def plain_words(x: str) -> str:
    return f"list_filter(string_split({ws(x)}, ' '), lambda w: w <> '')"


def gram_rows(source: str, key: str, n: int) -> str:
    """(key, gram) for every run of n words in rows (key, w) of `source`; fewer than n words are one run."""
    return f"SELECT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM {source} WHERE len(w) > 0)"


def hash60(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 15)) AS BIGINT)"


def repetition(source: str, key: str, text: str) -> str:
    """CTEs that end with repeated (key, repetition)."""
    return f"""split_ AS (SELECT {key}, {plain_words(text)} AS w FROM {source}),
runs AS ({gram_rows("(SELECT * FROM split_ WHERE len(w) >= 20)", key, 10)}),
repeated AS (SELECT {key}, 1 - count(DISTINCT gram) / count(*) AS repetition FROM runs GROUP BY {key})"""


def tokens(x: str) -> str:
    return f"greatest(1, CAST(floor(length({x}) / 3.6) AS BIGINT))"


DOCS = "docs AS (SELECT doc_id, source AS dataset, text FROM documents)"
TURNS = f"""turns AS (
  SELECT conv_id, turn, role AS raw_role, coalesce(text, '') AS content,
    CASE {" ".join(f"WHEN lower(trim(role)) = '{a}' THEN '{to}'" for a, to in P.ROLES.items())} ELSE 'unknown' END AS role FROM conversations),
convs AS (
  SELECT conv_id, 'conversations' AS dataset, string_agg(content, chr(10) ORDER BY turn) AS text,
    coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role <> 'assistant'), '') AS prompt,
    coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS answer,
    list({{'role': role, 'content': content}} ORDER BY turn) AS turns
  FROM turns GROUP BY conv_id)"""


def matches(x: str, e: str) -> str:
    return f"regexp_matches({x}, {Q(e)})"


def any_of(x: str, registry: dict[str, str]) -> str:
    return "(" + " OR ".join(matches(x, e) for e in registry.values()) + ")"


SQL: dict[str, str] = {}

SQL["exact_duplicates"] = f"""
WITH {DOCS},
seen AS (SELECT doc_id, dataset, md5(text) AS h, md5(lower({ws('text')})) AS w, length(text) AS chars FROM docs WHERE {strip("coalesce(text, '')")} <> ''),
exact AS (SELECT h, count(*) AS n, arg_min(dataset, doc_id) AS dataset, max(chars) AS chars, min(doc_id) AS doc_id, first(w) AS w FROM seen GROUP BY h),
loose AS (SELECT w, count(*) AS forms, arg_min(dataset, doc_id) AS dataset FROM exact GROUP BY w),
a AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS first_seen, CAST(sum(n - 1) AS BIGINT) AS copies, count_if(n > 1) AS clusters, max(n) AS largest, CAST(floor(sum((n - 1) * chars) / 3.6) AS BIGINT) AS wasted_tokens FROM exact GROUP BY dataset),
b AS (SELECT dataset, sum(forms - 1) AS l FROM loose GROUP BY dataset)
SELECT a.dataset, first_seen, copies, CAST(clusters AS BIGINT) AS clusters, largest, wasted_tokens, CAST(coalesce(l, 0) AS BIGINT) AS loose_copies FROM a LEFT JOIN b USING (dataset)"""

_m = " OR ".join(f"contains(text, '{m}')" for m in MOJIBAKE)
SQL["encoding_hygiene"] = f"""
WITH {DOCS}, seen AS (SELECT dataset, ({_m}) AS m, {matches('text', CONTROL)} AS c, nfc_normalize(text) <> text AS n FROM docs WHERE text IS NOT NULL)
SELECT dataset, count(*) AS total, CAST(count_if(m) AS BIGINT) AS mojibake, CAST(count_if(c) AS BIGINT) AS control, CAST(count_if(n) AS BIGINT) AS not_nfc, CAST(count_if(m OR c OR n) AS BIGINT) AS affected FROM seen GROUP BY dataset"""

SQL["line_shape_quality"] = f"""
WITH {DOCS},
l AS (SELECT dataset, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS own FROM docs WHERE length(text) >= 200),
s AS (SELECT dataset, len(list_filter(own, lambda x: contains({Q(TERMINAL)}, right(x, 1)))) / len(own) AS p, len(list_filter(own, lambda x: length(x) < 30)) / len(own) AS sh,
  (list_sum(list_transform(own, lambda x: length(x))) - list_sum(list_transform(list_distinct(own), lambda x: length(x)))) / list_sum(list_transform(own, lambda x: length(x))) AS d FROM l WHERE len(own) > 0),
g AS (SELECT dataset, count(*) AS total, CAST(count_if(p < 0.12) AS BIGINT) AS low_punct, CAST(count_if(sh > 0.67) AS BIGINT) AS short_lines, CAST(count_if(d > 0.01) AS BIGINT) AS dup_lines, round(avg(p), 6) AS mean_punct FROM s GROUP BY dataset)
SELECT *, total >= 50 AND low_punct + short_lines + dup_lines > 0 AS flagged FROM g"""


def _degeneracy(source: str, key: str, prompt: str, answer: str) -> str:
    return f"""
WITH {source},
x AS (SELECT {key} AS key, dataset, {answer} AS answer, {prompt} AS prompt FROM {'convs' if 'convs' in source else 'docs'}),
y AS (SELECT key, dataset, answer, lower({ws('answer')}) AS a, lower({ws("coalesce(prompt, '')")}) AS p FROM x WHERE coalesce(answer, '') <> ''),
{repetition('y', 'key', 'answer')},
k AS (SELECT dataset, CASE WHEN length({strip('answer')}) <= 3 THEN 'trivial' WHEN coalesce(repetition, 0) >= 0.5 THEN 'looping'
  WHEN length(a) > 40 AND p <> '' AND (contains(p, a) OR contains(a, p)) AND least(length(a), length(p)) / greatest(length(a), length(p)) >= 0.9 THEN 'copy' ELSE '' END AS kind FROM y LEFT JOIN repeated USING (key))
SELECT dataset, count(*) AS total, CAST(count_if(kind = 'trivial') AS BIGINT) AS trivial, CAST(count_if(kind = 'looping') AS BIGINT) AS looping, CAST(count_if(kind = 'copy') AS BIGINT) AS copies FROM k GROUP BY dataset"""


SQL["degeneracy"] = _degeneracy(TURNS, "conv_id", "prompt", "answer")
SQL["document_degeneracy"] = _degeneracy(DOCS, "doc_id", "NULL::VARCHAR", "text")

def _valid(kind: str | None) -> str:
    d = lambda k: f"CAST(substr(v, {k}, 1) AS INTEGER)"
    if kind == "tckn":
        odd, even = "+".join(map(d, (1, 3, 5, 7, 9))), "+".join(map(d, (2, 4, 6, 8)))
        return f"((7 * ({odd}) - ({even})) % 10 + 10) % 10 = {d(10)} AND (({odd}) + ({even}) + {d(10)}) % 10 = {d(11)}"
    if kind == "luhn":
        c = "regexp_replace(v, '[ -]', '', 'g')"
        total = f"list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN (length({c}) - i) % 2 = 0 THEN CAST({c}[i] AS INTEGER) WHEN CAST({c}[i] AS INTEGER) > 4 THEN 2 * CAST({c}[i] AS INTEGER) - 9 ELSE 2 * CAST({c}[i] AS INTEGER) END))"
        return f"length({c}) BETWEEN 13 AND 19 AND {total} % 10 = 0"
    if kind == "iban":
        turned = "(substr(v, 5) || substr(v, 1, 4))"
        number = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
        return f"list_reduce(list_transform(string_split({number}, ''), lambda c: CAST(c AS INTEGER)), lambda a, b: (a * 10 + b) % 97) = 1"
    return "true"


_MASK = {"full": "'[masked]'", "prefix6": "substr(v, 1, 6) || '…'", "tail4": "'…' || right(v, 4)", "local_domain": "substr(v, 1, 1) || '…@' || regexp_extract(v, '[^@]*$')"}
_PERSONAL = "\n  UNION ALL ".join(
    f"SELECT doc_id, dataset, '{k.kind}' AS kind, {_MASK[k.mask]} AS masked FROM (SELECT doc_id, dataset, list_filter(regexp_extract_all(text, {Q(k.expression)}), lambda v: {_valid(k.valid)})[1] AS v FROM docs WHERE text IS NOT NULL) WHERE v IS NOT NULL" for k in P.PERSONAL
)
SQL["personal_data"] = f"WITH {DOCS}, found AS (\n  {_PERSONAL})\nSELECT kind, count(*) AS records, count(DISTINCT dataset) AS datasets, min(doc_id) AS first_doc FROM found GROUP BY kind"
SQL["personal_evidence"] = f"WITH {DOCS}, found AS (\n  {_PERSONAL})\nSELECT kind, doc_id, masked FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, masked) AS n FROM found) WHERE n <= 8"

_said = "CASE WHEN answer <> '' THEN answer ELSE text END"
_identity = f"SELECT dataset, {any_of('said', P.IDENTITY)} AS i, {any_of('said', P.REFUSAL)} AS r"
_identity_of = "SELECT dataset, count(*) AS total, CAST(count_if(i) AS BIGINT) AS identity, CAST(count_if(NOT i AND r) AS BIGINT) AS refusal, bool_or(i) AS blocking FROM f GROUP BY dataset"
SQL["identity_refusal"] = f"WITH {TURNS}, f AS ({_identity} FROM (SELECT dataset, {_said} AS said FROM convs)) {_identity_of}"
SQL["document_identity"] = f"WITH {DOCS}, f AS ({_identity} FROM (SELECT dataset, text AS said FROM docs WHERE text IS NOT NULL)) {_identity_of}"
SQL["style_openers"] = f"WITH {TURNS}, f AS (SELECT dataset, {any_of('said', P.OPENERS)} AS o FROM (SELECT dataset, {_said} AS said FROM convs)) SELECT dataset, count(*) AS total, CAST(count_if(o) AS BIGINT) AS openers, count_if(o) / count(*) >= 0.15 AS flagged FROM f GROUP BY dataset"
SQL["reasoning_mix"] = f"""
WITH {TURNS}, f AS (SELECT count(*) AS total, CAST(count_if({matches('answer', P.REASONING)}) AS BIGINT) AS tagged FROM convs WHERE answer <> '')
SELECT total, tagged, round(CASE WHEN total > 0 THEN tagged / total ELSE 0.0 END, 6) AS share, least(tagged, total - tagged) AS minority, total >= 200 AND tagged / total BETWEEN 0.02 AND 0.98 AS flagged FROM f"""

_family = ", ".join(f"{{'n': {' + '.join(f'CAST(contains(text, {Q(m)}) AS INTEGER)' for m in marks)}, 'k': {-k}, 'family': '{name}'}}" for k, (name, marks) in enumerate(P.TEMPLATES.items()))
SQL["template_drift"] = f"WITH {DOCS}, f AS (SELECT list_max([{_family}]) AS b FROM docs) SELECT b.family AS family, count(*) AS records, false AS blocking FROM f WHERE b.n >= 2 GROUP BY 1"

SQL["role_structure"] = f"""
WITH {TURNS},
before AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b, {strip('content')} = '' AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM turns),
f AS (SELECT conv_id, NOT bool_or(role = 'assistant') AS a, bool_or(coalesce(role = b AND role IN ('user', 'assistant'), false)) AS b, bool_or(e) AS c, bool_or(last AND role = 'user') AS d FROM before GROUP BY conv_id)
SELECT count(*) AS total, CAST(count_if(a) AS BIGINT) AS no_assistant, CAST(count_if(b) AS BIGINT) AS consecutive, CAST(count_if(c) AS BIGINT) AS empty_turn, CAST(count_if(d) AS BIGINT) AS ends_on_user, CAST(count_if(a OR b OR c OR d) AS BIGINT) AS affected FROM f"""
SQL["role_vocabulary"] = f"WITH {TURNS} SELECT raw_role, role, count(*) AS turns, role <> raw_role AS renamed FROM turns GROUP BY raw_role, role"
SQL["turn_changes"] = "SELECT coalesce(b, 'start') AS before, role, count(*) AS turns FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY 1, 2"
SQL["contradictory_prompts"] = f"""
WITH {TURNS}, s AS (SELECT {ws('prompt')} AS p, {ws('answer')} AS a FROM convs), e AS (SELECT p, count(*) AS records, count(DISTINCT a) AS answers FROM s WHERE length(p) >= 20 AND a <> '' GROUP BY p)
SELECT CAST(coalesce(sum(records), 0) AS BIGINT) AS total, count(*) AS prompts, CAST(count_if(answers > 1) AS BIGINT) AS contradictory, CAST(coalesce(sum(answers) FILTER (answers > 1), 0) AS BIGINT) AS answers, coalesce(max(answers), 0) AS most FROM e"""
SQL["response_length_cap"] = f"""
WITH {TURNS}, n AS (SELECT length(answer) AS n FROM convs WHERE answer <> ''), s AS (SELECT count(*) AS total, coalesce(max(n), 0) AS longest FROM n),
b AS (SELECT CASE WHEN n > longest - 25 THEN 0 ELSE floor((longest - 25 - n) / 25) + 1 END AS b FROM n, s), c AS (SELECT b, count(*) AS n FROM b GROUP BY b),
t AS (SELECT coalesce(max(n) FILTER (b = 0), 0) AS at_top, coalesce(max(n) FILTER (b BETWEEN 1 AND 10), 0) AS tallest_below FROM c)
SELECT total, longest, at_top, tallest_below, total >= 200 AND longest >= 200 AND at_top >= 0.05 * total AND at_top >= 3 * tallest_below AS flagged FROM s, t"""
SQL["mask_summary"] = f"""
WITH {TURNS}, m AS (SELECT array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t.role || chr(10) || t.content || '<|im_end|>' || chr(10)), '') AS r,
  coalesce(list_sum(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: length(t.content) + 10)), 0) AS n FROM convs)
SELECT count(*) AS total, CAST(count_if(n = 0) AS BIGINT) AS untrainable, round(sum(n) / sum(length(r)), 6) AS share, CAST(count_if(strpos(r, '<|im_start|>assistant' || chr(10)) > 8192 AND n > 0) AS BIGINT) AS answer_lost FROM m"""

_head = strip("text")
_scripts = {n: f"length(regexp_replace(p, {Q(rf'[^{r}]|[^\p{{L}}]')}, '', 'g'))" for n, r in SCRIPTS.items()}
_other = f"length(regexp_replace(p, {Q(r'[^\p{L}]|[\x{10000}-\x{10ffff}]')}, '', 'g')) - ({' + '.join(_scripts.values())})"
_script = ", ".join(f"{{'n': CAST({e} AS BIGINT), 'k': {-k}, 'name': '{n}'}}" for k, (n, e) in enumerate([*_scripts.items(), ("Other", _other)]))


def _score(letters: str, common: str) -> str:
    share = f"len(list_distinct(regexp_extract_all(low, '[{letters}]'))) / {float(len(letters))}" if letters else "0.0"
    n = common.split()
    return f"CAST(0.4 AS DOUBLE) * ({share}) + CAST(0.6 AS DOUBLE) * (({' + '.join(f'CAST(contains(pad, {Q(f" {w} ")}) AS INTEGER)' for w in n)}) / {float(len(n))})"


_lang = ", ".join(f"{{'score': CAST({_score(*v)} AS DOUBLE), 'k': {-k}, 'lang': '{x}'}}" for k, (x, v) in enumerate(PROFILES.items()))
LANGS = f"""{DOCS},
heads AS (SELECT doc_id, dataset, length(text) AS chars, {_head} AS h FROM docs WHERE text IS NOT NULL),
lows AS (SELECT *, nfc_normalize(lower(h)) AS low, ' ' || nfc_normalize(lower(h)) || ' ' AS pad, h AS p FROM heads),
bests AS (SELECT doc_id, dataset, chars, h, list_max([{_lang}]) AS b, list_max([{_script}]) AS s FROM lows),
langs AS (SELECT doc_id, dataset, chars, CASE WHEN length(h) < 12 OR b.score <= 0.15 OR least(b.score, 0.75) < 0.30 THEN 'unknown' ELSE b.lang END AS lang,
  CASE WHEN length(h) < 12 THEN 0.0 WHEN b.score <= 0.15 THEN b.score ELSE least(b.score, 0.75) END AS confidence, CASE WHEN s.n > 0 THEN s.name ELSE 'None' END AS script FROM bests)"""
SQL["language_composition"] = f"WITH {LANGS} SELECT dataset, lang, count(*) AS records, round(avg(confidence), 6) AS confidence FROM langs WHERE chars >= 40 GROUP BY dataset, lang"
SQL["language_outliers"] = f"""
WITH {LANGS}, c AS (SELECT dataset, lang, count(*) AS records FROM langs WHERE chars >= 40 AND lang <> 'unknown' AND confidence >= 0.7 GROUP BY dataset, lang),
w AS (SELECT *, sum(records) OVER (PARTITION BY dataset) AS t, max(records) OVER (PARTITION BY dataset) AS m, first_value(lang) OVER (PARTITION BY dataset ORDER BY records DESC, lang) AS main_lang FROM c)
SELECT dataset, main_lang, lang, records, CAST(t AS BIGINT) AS total FROM w WHERE t >= 20 AND m / t >= 0.6 AND records / t <= 0.25 AND lang <> main_lang"""
_expected = " ".join(f"WHEN '{k}' THEN [{', '.join(Q(s) for s in v.split())}]" for k, v in EXPECTED.items())
SQL["script_mismatches"] = f"WITH {LANGS} SELECT lang, count(*) AS total, CAST(count_if(script NOT IN ('None', 'Other') AND NOT coalesce(list_contains(CASE lang {_expected} END, script), true)) AS BIGINT) AS mismatched FROM langs WHERE chars >= 40 AND lang <> 'unknown' GROUP BY lang"

SQL["licences_missing"] = f"WITH {DOCS} SELECT dataset FROM docs GROUP BY dataset HAVING NOT bool_or(coalesce(contains(lower(text), 'license'), false))"
SQL["totals"] = f"WITH {DOCS}, t AS (SELECT dataset, coalesce(text, '') AS t FROM docs) SELECT dataset, count(*) AS records, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END) AS BIGINT) AS words, CAST(sum({tokens('t')}) AS BIGINT) AS tokens FROM t GROUP BY dataset"
SQL["surface_measures"] = f"""
WITH {DOCS}, {repetition('docs', 'doc_id', 'text')},
c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, {Q(SPACE + '+')}, '', 'g')) AS s, length(text) - length(regexp_replace(text, '\\p{{L}}+', '', 'g')) AS l FROM docs WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE round(s / n, 6) END AS space_share, CASE WHEN n = 0 THEN 0.0 ELSE round((n - s - l) / n, 6) END AS other_share, coalesce(round(repetition, 6), 0.0) AS repetition FROM c LEFT JOIN repeated USING (doc_id)"""
SQL["content_digest"] = f"WITH {DOCS} SELECT count(*) AS records, CAST(sum(CAST({hash60('concat_ws(' + Q('|') + ', length(dataset), dataset, length(text), text)')} AS HUGEINT)) % 1000000000000000000 AS BIGINT) AS digest FROM docs"
_place = hash60("dataset || ':' || CAST(doc_id AS VARCHAR)")
SQL["bottom_k"] = f"WITH {DOCS} SELECT doc_id, dataset, {_place} AS h FROM docs WHERE length(text) > 20 ORDER BY h, doc_id LIMIT 200000"
SQL["stratified_sample"] = f"WITH {DOCS} SELECT dataset, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_place}, doc_id) AS n FROM docs WHERE length(text) > 20) WHERE n <= greatest(200, 20000 // (SELECT count(DISTINCT dataset) FROM docs))"
SQL["packing"] = f"WITH {DOCS}, t AS (SELECT count(*) AS records, CAST(coalesce(sum({tokens('text')}), 0) AS BIGINT) AS tokens FROM docs WHERE text IS NOT NULL) SELECT records, tokens, tokens // 2048 AS blocks, tokens % 2048 AS residual FROM t"
SQL["truncation"] = f"WITH {DOCS}, t AS (SELECT dataset, {tokens('text')} AS n FROM docs WHERE text IS NOT NULL) SELECT dataset, count(*) AS total, CAST(count_if(n > 2048) AS BIGINT) AS truncated, CAST(sum(greatest(n - 2048, 0)) AS BIGINT) AS tokens_lost FROM t GROUP BY dataset"
SQL["stratified_budget"] = f"""
WITH {DOCS}, r AS (SELECT dataset, length(text)::DOUBLE AS c, {tokens('text')}::DOUBLE AS t, row_number() OVER (PARTITION BY dataset ORDER BY {_place}, doc_id) AS n FROM docs WHERE length(text) > 0),
strata AS (SELECT dataset, sum(c) AS chars, count(*) AS records FROM r GROUP BY dataset),
s AS (SELECT dataset, sum(t) AS t, sum(c) AS c, sum(t * t) AS tt, sum(t * c) AS tc, sum(c * c) AS cc, count(*) AS n FROM r WHERE n <= greatest(200, 20000 // (SELECT count(DISTINCT dataset) FROM docs)) GROUP BY dataset),
e AS (SELECT chars, chars * t / c AS tokens, CASE WHEN n > 1 THEN records * records * (1 - n / records) * greatest(tt - 2 * t / c * tc + (t / c) * (t / c) * cc, 0) / greatest(n - 1, 1) / n ELSE 0 END AS var FROM s JOIN strata USING (dataset))
SELECT CAST(sum(chars) AS BIGINT) AS chars, round(sum(tokens), 3) AS tokens, round(1.96 * sqrt(sum(var)), 3) AS margin, round(sum(tokens) / sum(chars), 9) AS per_char FROM e"""
SQL["unigrams"] = f"WITH {DOCS}, w AS (SELECT unnest({words('text')}) AS word FROM docs), c AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, n, round(ln(n / (SELECT sum(n) FROM c)), 6) AS log_p FROM c ORDER BY n DESC, word LIMIT 120000"
SQL["captions"] = f"""
WITH {DOCS}, w AS (SELECT dataset AS "group", unnest({words('text')}) AS word FROM docs), tf AS (SELECT "group", word, count(*) AS tf FROM w WHERE length(word) >= 3 GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), s AS (SELECT "group", word, round(tf * ln(1 + (SELECT count(DISTINCT "group") FROM tf) / (1 + df)), 6) AS score FROM tf JOIN df USING (word))
SELECT "group", CAST(rank AS INTEGER) AS rank, word, score FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 12"""

_preset = PRESETS["fineweb"]
_lanes = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(coefficients(_preset.lanes)))
NEAR = f"""{DOCS},
kept AS (SELECT doc_id, dataset, {hash60(ws('lower(text)'))} AS exact, {words('text')} AS w FROM docs WHERE length(text) >= 40),
shingles AS (SELECT DISTINCT doc_id, {hash60('gram')} % {PRIME} AS x FROM ({gram_rows('kept', 'doc_id', 5)})),
lanes(lane, a, b) AS (VALUES {_lanes}),
least_ AS (SELECT doc_id, lane, min((CAST(a AS BIGINT) * x + b) % {PRIME}) AS m FROM shingles, lanes GROUP BY doc_id, lane),
signed AS (SELECT doc_id, dataset, exact, signature FROM (SELECT doc_id, list(m ORDER BY lane) AS signature FROM least_ GROUP BY doc_id) JOIN kept USING (doc_id)),
reps AS (SELECT signature, min(doc_id) AS rep FROM signed GROUP BY signature),
bands AS (SELECT rep, b, signature[b * {_preset.rows} + 1:b * {_preset.rows} + {_preset.rows}] AS band FROM reps, range({_preset.bands}) r(b)),
candidates AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM bands x JOIN bands y ON x.b = y.b AND x.band = y.band AND x.rep < y.rep),
pairs AS (SELECT a, b, jaccard FROM (SELECT a, b, list_sum(list_transform(list_zip(x.signature, y.signature), lambda z: CAST(z[1] = z[2] AS INTEGER))) / {float(_preset.lanes)} AS jaccard
  FROM candidates JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b) WHERE jaccard >= {_preset.threshold}),
every AS (SELECT a, b FROM pairs UNION ALL SELECT rep, rep FROM reps),
met AS (SELECT p.doc_id AS a, q.doc_id AS b FROM every JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b JOIN signed p ON p.signature = x.signature JOIN signed q ON q.signature = y.signature WHERE a <> b OR p.doc_id < q.doc_id)"""
CLUSTERS = f"""{NEAR},
edges AS (SELECT a AS x, b AS y FROM met UNION SELECT b, a FROM met),
reach AS (SELECT x, x AS root FROM edges UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.x WHERE r.root < e.y),
own AS (SELECT x AS doc_id, min(root) AS cluster FROM reach GROUP BY x),
clusters AS (SELECT cluster, count(*) AS members, count(DISTINCT exact) AS distinct_texts FROM own JOIN signed USING (doc_id) GROUP BY cluster HAVING count(DISTINCT exact) > 1)"""
SQL["near_members"] = f"WITH {NEAR} SELECT doc_id, rep AS representative FROM signed JOIN reps USING (signature)"
SQL["near_pairs"] = f"WITH {NEAR} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs"
SQL["near_clusters"] = f"WITH RECURSIVE {CLUSTERS} SELECT * FROM clusters"
SQL["near_summary"] = f"WITH RECURSIVE {CLUSTERS} SELECT (SELECT count(*) FROM signed) AS total, count(*) AS clusters, CAST(coalesce(sum(distinct_texts - 1), 0) AS BIGINT) AS near_duplicates, coalesce(max(distinct_texts), 0) AS largest FROM clusters"
SQL["dataset_overlap"] = f"""
WITH {NEAR}, apart AS (SELECT a, b, x.dataset AS da, y.dataset AS db FROM met JOIN signed x ON x.doc_id = a JOIN signed y ON y.doc_id = b WHERE x.dataset <> y.dataset),
both_ AS (SELECT da AS source, db AS target, a AS key FROM apart UNION ALL SELECT db, da, b FROM apart), sizes AS (SELECT dataset AS source, count(*) AS "of" FROM signed GROUP BY 1),
m AS (SELECT source, target, count(DISTINCT key) AS matched FROM both_ GROUP BY 1, 2)
SELECT source, target, matched, "of", round(matched / "of", 6) AS fraction FROM m JOIN sizes USING (source) ORDER BY fraction DESC, source, target LIMIT 60"""

CONTAM = f"""{DOCS},
item_words AS (SELECT item_id, {words('text')} AS w FROM benchmark),
items AS (SELECT item_id FROM item_words WHERE len(w) > 0),
item_grams AS (SELECT DISTINCT item_id, gram FROM ({gram_rows('item_words', 'item_id', 8)})),
index AS (SELECT item_id, gram, count(*) OVER (PARTITION BY item_id) AS grams FROM item_grams),
doc_words AS (SELECT doc_id, {words('text')} AS w FROM docs),
doc_grams AS (SELECT DISTINCT doc_id, gram FROM ({gram_rows('doc_words', 'doc_id', 8)})),
shared AS (SELECT item_id, grams, doc_id, count(*) AS shared FROM doc_grams JOIN index USING (gram) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS n FROM shared) WHERE n = 1)"""
SQL["benchmark_witnesses"] = f"WITH {CONTAM} SELECT 'benchmark' AS benchmark, item_id, doc_id, shared, grams, round(shared / grams, 6) AS coverage FROM best"
SQL["benchmark_contamination"] = f"WITH {CONTAM}, n AS (SELECT (SELECT count(DISTINCT item_id) FROM items) AS items, count(*) AS c FROM best WHERE shared / grams > 0.5) SELECT 'benchmark' AS benchmark, items, c AS contaminated, round(c / items, 6) AS rate, c / items > 0.02 AS flagged FROM n"

_unit = lambda v: f"CASE WHEN list_sum(list_transform({v}, lambda x: x * x)) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda z: z * z)))) ELSE {v} END"
VECTORS = f"""raw AS (SELECT vec_id, 'set' || CAST(vec_id % 5 AS VARCHAR) AS dataset, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
lengths AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM raw),
vectors AS (SELECT vec_id, dataset, label, e, CASE WHEN m > 0 THEN list_transform(e, lambda x: x / m) ELSE e END AS v FROM lengths),
parts AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS d FROM vectors WHERE label IS NOT NULL),
means AS (SELECT label, d, avg(x) AS x, count(*) AS n FROM parts GROUP BY label, d),
long_ AS (SELECT label AS region, max(n) AS size, list(x ORDER BY d) AS c FROM means GROUP BY label),
cells AS (SELECT region, 'cat' || CAST(region % 3 AS VARCHAR) AS category, size, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda z: z * z)))) AS vec FROM long_),
scores AS (SELECT vec_id, dataset, label, v, region, round(list_dot_product(v, vec), 9) AS score FROM vectors, cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, region) AS rank FROM scores),
placed AS (SELECT vec_id, dataset, label, v, region AS nearest, round(score, 6) AS score, CASE WHEN score < 0.278 THEN -1 ELSE region END AS region FROM ranked WHERE rank = 1)"""
W = f"WITH {VECTORS}"
SQL["atlas_centroid_sizes"] = f"{W} SELECT region, category, size, round(list_sum(vec), 6) AS vec_sum FROM cells"
SQL["atlas_assign"] = f"{W} SELECT vec_id, dataset, CAST(nearest AS BIGINT) AS nearest, score, CAST(region AS BIGINT) AS region FROM placed"
SQL["atlas_soft_assign"] = f"""{W}, k AS (SELECT vec_id, region, exp((score - max(score) OVER (PARTITION BY vec_id)) / 0.08) AS w FROM ranked WHERE rank <= 5), n AS (SELECT region, w / sum(w) OVER (PARTITION BY vec_id) AS w FROM k)
SELECT CAST(region AS BIGINT) AS region, round(sum(w), 4) AS mass, CAST(count_if(w > 0.15) AS BIGINT) AS strong FROM n GROUP BY region"""
_counts = "counts AS (SELECT region, count(*) AS n FROM placed WHERE region <> -1 GROUP BY region)"
SQL["atlas_coverage"] = f"""{W}, {_counts},
s AS (SELECT coalesce(n, 0) AS n, coalesce(n, 0) / sum(n) OVER () AS p, size / sum(size) OVER () AS q FROM cells LEFT JOIN counts USING (region)),
a AS (SELECT CAST(count_if(n > 0) AS BIGINT) AS regions, sum(CASE WHEN n > 0 THEN -p * ln(p) END) AS h, max(p) AS top, sum(CASE WHEN n > 0 THEN least(1.0, p / q) END) AS e, count(*) AS k FROM s)
SELECT (SELECT count(*) FROM placed) AS records, (SELECT count(*) FROM placed WHERE region <> -1) AS placed, (SELECT count(*) FROM placed WHERE region = -1) AS off, regions, round(h, 6) AS entropy, round(h / ln(k), 6) AS concentration, round(top, 6) AS top_share, round(e, 6) AS effective FROM a"""
SQL["atlas_density"] = f"""{W}, {_counts},
d AS (SELECT region, category, coalesce(n, 0) AS seen, sum(coalesce(n, 0)) OVER () * size / sum(size) OVER () AS due FROM cells LEFT JOIN counts USING (region)),
m AS (SELECT var_pop(seen / due) AS v, avg(1 / due) AS noise, count(*) AS k FROM d WHERE due >= 5), p AS (SELECT CASE WHEN k < 2 THEN 2.0 WHEN v - noise <= 1e-7 THEN 1e7 ELSE 1 / (v - noise) END AS a FROM m)
SELECT region, category, seen, round(due, 6) AS due, round((seen + a) / (due + a), 6) AS density FROM d, p"""
SQL["atlas_gaps"] = f"""{W}, {_counts}, c AS (SELECT category, CAST(coalesce(sum(n), 0) AS BIGINT) AS seen, CAST(count_if(n IS NULL) AS BIGINT) AS empty_regions, sum(size) AS size FROM cells LEFT JOIN counts USING (region) GROUP BY category),
w AS (SELECT *, seen / sum(seen) OVER () AS p, size / sum(size) OVER () AS q FROM c) SELECT category, seen, empty_regions, round(p, 6) AS share, round(q, 6) AS map_share FROM w WHERE p <= 0.3 OR empty_regions > 0"""
SQL["atlas_dataset_similarity"] = f"""{W}, c AS (SELECT dataset, region, count(*) AS n FROM placed WHERE region <> -1 GROUP BY ALL), m AS (SELECT dataset, sqrt(sum(n * n)) AS m FROM c GROUP BY dataset HAVING sum(n) >= 20),
r AS (SELECT x.dataset AS a, y.dataset AS b, sum(x.n * y.n) / (max(p.m) * max(q.m)) AS c FROM c x JOIN c y ON x.region = y.region AND x.dataset < y.dataset JOIN m p ON p.dataset = x.dataset JOIN m q ON q.dataset = y.dataset GROUP BY 1, 2)
SELECT a, b, round(c, 6) AS cosine FROM r ORDER BY round(c, 6) DESC, a, b LIMIT 5"""
SQL["atlas_cohesion"] = f"""{W}, p AS (SELECT region, unnest(v) AS x, unnest(range(len(v))) AS d FROM placed WHERE region <> -1), s AS (SELECT region, d, sum(x) AS s, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT region, sum(s * s) AS q, max(n) AS n FROM s GROUP BY region)
SELECT CAST(region AS BIGINT) AS region, n, round(greatest(-1.0, least(1.0, (q - n) / (n * (n - 1)))), 6) AS cohesion FROM t WHERE n >= 20"""
SQL["atlas_examples"] = f"{W} SELECT CAST(region AS BIGINT) AS region, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, vec_id) AS k FROM placed WHERE region <> -1) WHERE k <= 2"
SQL["atlas_compare"] = f"""{W}, c AS (SELECT region, CAST(count_if(dataset = 'set0') AS BIGINT) AS n_a, CAST(count_if(dataset IN ('set1', 'set2')) AS BIGINT) AS n_b FROM placed WHERE region <> -1 GROUP BY region)
SELECT CAST(region AS BIGINT) AS region, n_a, n_b, CASE WHEN n_b = 0 THEN 'a_only' WHEN n_a = 0 THEN 'b_only' ELSE 'shared' END AS status FROM c WHERE n_a + n_b > 0"""
SQL["atlas_off"] = f"""{W} SELECT dataset, count(*) AS total, CAST(count_if(region = -1) AS BIGINT) AS off, round(count_if(region = -1) / count(*), 6) AS off_share, round(quantile_cont(score, 0.5) FILTER (region = -1), 6) AS median_score,
  round(quantile_cont(score, 0.1) FILTER (region = -1), 6) AS p10_score, CAST(count_if(region = -1 AND score >= CAST(0.278 AS DOUBLE) - 0.05) AS BIGINT) AS near_misses FROM placed GROUP BY dataset"""
SQL["atlas_cutoff"] = f"{W} SELECT round(quantile_cont(score, 0.02), 6) AS cutoff FROM placed"
SQL["atlas_purity"] = f"""{W}, c AS (SELECT region, label, count(*) AS n FROM placed WHERE region <> -1 GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY region) AS r, sum(n) OVER (PARTITION BY label) AS l, sum(n) OVER () AS t, max(n) OVER (PARTITION BY region) AS top FROM c),
s AS (SELECT sum(n / t * ln(n * t / (r * l))) AS mi, sum(-n / t * ln(r / t)) AS hr, sum(-n / t * ln(l / t)) AS hl FROM w), d AS (SELECT DISTINCT region, top, r FROM w)
SELECT round(avg(top / r), 6) AS macro, round(sum(top) / sum(r), 6) AS micro, (SELECT round(2 * mi / (hr + hl), 6) FROM s) AS nmi FROM d"""
SQL["atlas_category_counts"] = f"{W} SELECT category, label, count(*) AS n FROM placed JOIN cells USING (region) GROUP BY category, label"
SQL["atlas_crosswalk"] = f"""{W}, c AS (SELECT region AS x, label AS y, count(*) AS n FROM placed GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c),
j AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n / (nx + ny - n) DESC, y) AS k FROM w) SELECT CAST(x AS BIGINT) AS region, CAST(y AS INTEGER) AS best, n AS shared, round(n / (nx + ny - n), 6) AS jaccard, round(n / nx, 6) AS containment FROM j WHERE k = 1"""
SQL["semantic_pairs"] = f"""{W}, s AS (SELECT vec_id, v, list_transform(e[1:4], lambda x: x > 0) AS b FROM vectors)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS cosine FROM s x JOIN s y ON x.b = y.b AND x.vec_id < y.vec_id WHERE round(list_dot_product(x.v, y.v), 6) >= 0.5"""

SQL["html_text"] = f"SELECT page_id, {ws('regexp_replace(regexp_replace(html, ' + Q(HTML_DROPPED) + ', ' + Q(' ') + ', ' + Q('g') + '), ' + Q('(?s)<[^>]+>') + ', ' + Q(' ') + ', ' + Q('g') + ')')} AS text FROM pages"
_md = "text"
for _e, _r in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^#{1,6}[ \t]*", ""), (r"[*_`~]{1,3}", "")):
    _md = f"regexp_replace({_md}, {Q(_e)}, {Q(_r)}, 'g')"
SQL["markdown_text"] = f"SELECT doc_id, {_md} AS text FROM documents"
SQL["formats"] = f"""
WITH c AS (SELECT ltrim(html) AS h FROM pages UNION ALL SELECT ltrim(text) FROM documents)
SELECT CASE WHEN {matches('h', '(?i)^(<!doctype html|<html)')} THEN 'html' WHEN {matches('h', r'^\{[^\n]*\}\s*\n\s*\{')} THEN 'jsonl' WHEN {matches('h', r'^[\[{]')} THEN 'json' WHEN {matches('h', r'(?m)^#{1,6} \S')} THEN 'markdown' ELSE 'plain' END AS format, count(*) AS files FROM c GROUP BY 1"""
SQL["event_windows"] = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
SQL["stream_exact_duplicates"] = "SELECT count(DISTINCT text) AS distinct_texts FROM documents WHERE text IS NOT NULL"


def _rows(name: str, count: str, total: str = "total", dataset: str = "dataset", severity: str = "NULL", where: str = "true") -> str:
    return f"SELECT CAST({dataset} AS VARCHAR) AS dataset, CAST({count} AS BIGINT) AS n, CAST({total} AS BIGINT) AS total, {severity} AS severity FROM ({SQL[name]}) WHERE {where}"


_CONV = "'conversations'"
_role_rows = f"WITH {TURNS}, f AS (SELECT conv_id, bool_or(role <> raw_role) AS r FROM turns GROUP BY conv_id) SELECT 'conversations' AS dataset, count_if(r) AS n, count(*) AS total, NULL AS severity FROM f"
_personal_rows = f"WITH {DOCS}, found AS (\n  {_PERSONAL}), k AS (SELECT DISTINCT doc_id FROM found) SELECT dataset, count(k.doc_id) AS n, count(*) AS total, NULL AS severity FROM docs LEFT JOIN k USING (doc_id) GROUP BY dataset"
_outlier_rows = f"SELECT dataset, n, CASE WHEN k = 1 THEN total ELSE 0 END AS total, NULL AS severity FROM (SELECT dataset, records AS n, total, row_number() OVER (PARTITION BY dataset ORDER BY lang) AS k FROM ({SQL['language_outliers']}))"
_licence_rows = f"WITH {DOCS} SELECT dataset, CAST(NOT bool_or(coalesce(contains(lower(text), 'license'), false)) AS INTEGER) AS n, 1 AS total, NULL AS severity FROM docs GROUP BY dataset"
_overlap_rows = f"SELECT source || ' in ' || target AS dataset, matched AS n, \"of\" AS total, NULL AS severity FROM ({SQL['dataset_overlap']}) ORDER BY fraction DESC, source, target LIMIT 1"
_blocking = lambda when, other: f"CASE WHEN {when} THEN 'blocking' ELSE '{other}' END"
#: (id, severity, profiles that it blocks, rows, least total, least rate)
CHECKS: list[tuple[str, str, str, str, int, float]] = [
    ("T0-ROLE-001", "blocking", "sft", _rows("role_structure", "affected", dataset=_CONV), 0, 0),
    ("T0-ROLE-002", "blocking", "sft", _role_rows, 0, 0),
    ("T0-REASON-001", "warning", "", _rows("reasoning_mix", "minority", dataset=_CONV, where="flagged"), 0, 0),
    ("T0-TRUNC-002", "warning", "sft", _rows("response_length_cap", "at_top", dataset=_CONV, where="flagged"), 0, 0),
    *((f"T0-QUAL-00{k}", "info", "", _rows("line_shape_quality", c), 50, 0) for k, c in ((1, "low_punct"), (2, "short_lines"), (3, "dup_lines"))),
    ("T0-ENC-001", "warning", "sft,corpus", _rows("encoding_hygiene", "affected"), 0, 0),
    ("T0-DUP-001", "warning", "", _rows("exact_duplicates", "copies", "first_seen"), 0, 0),
    ("T0-DEGEN-001", "warning", "", _rows("degeneracy", "trivial + looping + copies"), 0, 0),
    ("T0-TMPL-001", "warning", "sft", _rows("template_drift", "records", "records", "family"), 0, 0),
    ("T0-MASK-001", "blocking", "sft", _rows("mask_summary", "untrainable", dataset=_CONV), 0, 0),
    ("T0-TRUNC-001", "warning", "sft", _rows("truncation", "truncated"), 0, 0),
    ("T1-NDUP-001", "warning", "", _rows("near_summary", "near_duplicates", dataset="'all'"), 0, 0),
    ("T1-DUP-002", "warning", "", _rows("contradictory_prompts", "contradictory", "prompts", _CONV), 0, 0),
    ("T1-OVERLAP-001", "warning", "", _overlap_rows, 0, 0),
    ("T1-CONTAM-001", "blocking", "sft,corpus,preference", _rows("benchmark_contamination", "contaminated", "items", "benchmark", _blocking("flagged", "warning")), 0, 0),
    ("T1-LANG-001", "info", "", _rows("language_composition", "CASE WHEN lang = 'unknown' THEN records ELSE 0 END", "records", "dataset || lang"), 0, 0),
    ("T1-LANG-002", "warning", "", _outlier_rows, 0, 0),
    ("T1-LANG-003", "info", "", _rows("script_mismatches", "mismatched", dataset="lang"), 0, 0),
    ("T1-PII-001", "blocking", "sft,corpus,preference", _personal_rows, 0, 0),
    ("T1-IDENT-001", "warning", "sft", _rows("identity_refusal", "identity + refusal", severity=_blocking("identity > 0", "info")), 0, 0),
    ("T1-STYLE-001", "info", "", _rows("style_openers", "openers"), 0, 0.15),
    ("T1-LIC-001", "warning", "", _licence_rows, 0, 0),
]
_FOUND = "\nUNION ALL ".join(
    f"SELECT '{k}' AS check_id, coalesce(CASE WHEN bool_or(severity = 'blocking') THEN 'blocking' ELSE max(severity) END, '{sev}') AS severity, CAST(sum(n) AS BIGINT) AS count, CAST(sum(total) AS BIGINT) AS total, round(sum(n) / sum(total), 6) AS rate, CAST(count_if(n > 0) AS BIGINT) AS datasets, '{blocks}' AS blocks FROM ({rows}) HAVING sum(n) > 0 AND sum(total) >= {least} AND round(sum(n) / sum(total), 6) >= {rate}"
    for k, sev, blocks, rows, least, rate in CHECKS
)
SQL["finding_rows"] = f"SELECT check_id, severity, count, total, rate, datasets, CASE WHEN severity = 'blocking' THEN blocks ELSE '' END AS would_block FROM (\n{_FOUND})"
_facets = ", ".join(f"('{c[0]}', '{facet}')" for facet, (_, ids) in FACETS.items() for c in CHECKS if c[0] in ids)
SQL["fingerprint_measures"] = f"""
WITH found AS ({_FOUND}), every(check_id, facet) AS (VALUES {_facets}), both_ AS (SELECT * FROM every LEFT JOIN found USING (check_id)), t AS ({SQL['totals']}),
s AS (SELECT count(*) AS datasets, sum(records) AS records, sum(chars) AS chars, sum(words) AS words, sum(tokens) AS tokens FROM t)
SELECT facet, check_id || ' count' AS measure, CAST(coalesce(count, 0) AS DOUBLE) AS value FROM both_ UNION ALL SELECT facet, check_id || ' rate', CAST(coalesce(rate, 0) AS DOUBLE) FROM both_
UNION ALL SELECT 'shape', k, CAST(v AS DOUBLE) FROM (SELECT unnest(['datasets', 'records', 'chars', 'words', 'tokens']) AS k, unnest([datasets, records, chars, words, tokens]) AS v FROM s)"""

SQL["unread_keys"] = """
WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT 'aside' AS key, count(*) AS records, CAST(sum(length(t[1])) AS BIGINT) AS chars FROM t WHERE length(t[1]) >= 40 AND len(t) > 1"""
SQL["coerced_content"] = "SELECT 'conversations' AS dataset, count(DISTINCT conv_id) AS total, CAST(0 AS BIGINT) AS coerced FROM conversations"
_object = "coalesce(json_valid(props) AND json_type(props) = 'OBJECT', false)"
SQL["unparseable_records"] = f"SELECT 'events' AS dataset, count(*) AS total, CAST(count_if(NOT {_object}) AS BIGINT) AS errors FROM events UNION ALL SELECT 'conversations', count(DISTINCT conv_id), 0 FROM conversations"
SQL["normalised_records"] = f"""
SELECT 'events' AS dataset, CASE WHEN {_object} THEN 'raw' ELSE 'error' END AS layout, count(*) AS records, CAST(0 AS BIGINT) AS turns, CAST(sum(CASE WHEN {_object} THEN length(props) END) AS BIGINT) AS chars FROM events GROUP BY 2
UNION ALL SELECT 'conversations', 'chatml', count(*), CAST(sum(n) AS BIGINT), CAST(sum(chars) AS BIGINT) FROM (SELECT count(*) AS n, sum(length(coalesce(text, ''))) + count(*) - 1 AS chars FROM conversations GROUP BY conv_id)"""
SQL["induced_layouts"] = f"""
WITH v AS (SELECT 'events' AS dataset, CASE WHEN {_object} THEN 'raw' ELSE 'error' END AS layout, count(*) AS records FROM events GROUP BY 2 UNION ALL SELECT 'conversations', 'chatml', count(DISTINCT conv_id) FROM conversations),
r AS (SELECT *, records / sum(records) OVER (PARTITION BY dataset) AS s, row_number() OVER (PARTITION BY dataset ORDER BY records DESC, layout) AS k FROM v)
SELECT dataset, layout, records, round(s, 6) AS share, k = 1 AS is_main, false AS mixed, CAST(0 AS DOUBLE) AS log_share FROM r"""

SQL["atlas_findings"] = f"""{W}, r AS (SELECT region, 7 * count(*) AS n FROM placed WHERE region <> -1 GROUP BY region), p AS (SELECT sum(n) AS placed FROM r),
q AS (SELECT coalesce(n, 0) AS n, coalesce(n, 0) / placed AS p, size / sum(size) OVER () AS q FROM cells LEFT JOIN r USING (region), p),
e AS (SELECT count_if(n > 0) AS regions, count(*) AS cells, round(max(p), 6) AS top, round(sum(CASE WHEN n > 0 THEN least(1.0, p / q) END), 6) AS effective FROM q),
v AS (SELECT region, unnest(v) AS x, unnest(range(len(v))) AS d FROM placed WHERE region <> -1), s AS (SELECT region, d, 7 * sum(x) AS s FROM v GROUP BY ALL),
c AS (SELECT region, n, round(greatest(-1.0, least(1.0, (sum(s * s) - n) / (n * (n - 1)))), 6) AS cohesion FROM s JOIN r USING (region) GROUP BY region, n HAVING n >= 20),
a AS (SELECT sum(n) AS n, any_value(placed) AS placed FROM c, p WHERE placed >= 300 AND n >= 0.2 * placed AND cohesion >= 0.75)
SELECT 'T1-ATLAS-001' AS check_id, CAST(regions AS BIGINT) AS count, CAST(cells AS BIGINT) AS total, round(regions / cells, 6) AS rate FROM e, p WHERE placed >= 300 AND (effective <= 10 OR top >= 0.25)
UNION ALL SELECT 'T1-ATLAS-002', CAST(n AS BIGINT), CAST(placed AS BIGINT), round(n / placed, 6) FROM a WHERE n > 0"""
