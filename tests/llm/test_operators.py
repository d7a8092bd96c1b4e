"""Every operator against brute force, and over odd and empty tables."""

import random
import re

import pytest
from llm_texts import prose

from corpusloom.llm import decontam, fingerprint, html_extract, jaccard_join, lang_id, license_scan, secret_scan, spm, substring_dedup, url_filter
from corpusloom.llm.queries import SPM_MODEL


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, n_chars bigint")


def test_url_filter(spark):
    urls = ["http://www.cheap-pills.example.com/en/450", "https://a.example.org/about-us", "https://casino.example.org/about-us?x=1", "http://x.org/a.jpg", "http://x.org/a.jpg?x", None, "", "HTTP://X.ORG/CASINO/1", "http://x.org/" + "a/" * 50_000 + "casino/1", "http://porntube.example.net/"]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, urls[0], "h", "v")] * 2, "page_id bigint, url string, html string, verdict string")
    got = sorted((r.page_id is None, r.page_id, r.verdict, r.n_rules, r.rules) for r in url_filter.judge(pages).collect())
    want = []
    for page_id, u in [*enumerate(urls), (None, urls[0]), (None, urls[0])]:
        hit = [r for r in map(lambda x: url_filter.Rule(*x), url_filter.RULES) if u and r.compiled().search(u.lower())]
        want.append((page_id is None, page_id, "none" if not hit else "allow" if any(r.exception for r in hit) else "block", len(hit), ",".join(sorted(r.name for r in hit))))
    assert got == sorted(want)
    assert {g[1]: g[2] for g in got}[2] == "allow" and {g[1]: g[2] for g in got}[8] == "block"
    kept = url_filter.keep_allowed(pages)
    assert kept.columns == pages.columns and {r.page_id for r in kept.collect()} == {1, 2, 4, 5, 6, None}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_rules_are_filed_under_the_rarest_token():
    index = url_filter.Index((("a", "/common/rare/"), ("b", "/common/"), ("c", "*part*")), {"common": 100, "rare": 1})
    assert index.by == {"rare": [0], "common": [1]} and index.always == [2]
    with pytest.raises(ValueError):
        url_filter.Rule("all", "||*")


def test_secrets(spark, odd, empty):
    key = "AKIA" + "Z9" * 8
    texts = [f"the key {key} is here {key}", "nothing", "x" * 5000 + " ghp_" + "a1" * 18 + " end", prose(3, 3000) + f" {key} " + prose(4, 3000)]
    got = sorted((r.doc_id, r.rule, r.n_matches, r.first_at) for r in secret_scan.scan(docs(spark, texts)).collect())
    want = sorted((d, n, len(m), m[0].start()) for d, t in enumerate(texts) for n, p in secret_scan.RULES if (m := list(re.finditer(p, t, re.A))))
    assert got == want and len(got) == 3
    out = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert out[0] == "the key [SECRET] is here [SECRET]" and out[1] == "nothing"
    assert secret_scan.scan(odd).count() == 0 and secret_scan.scan(empty).count() == 0
    assert secret_scan.redact(odd).exceptAll(odd).count() == 0


def test_secrets_of_any_length(spark):
    """Scans and redactions take whole secrets, in linear time; the spans are those of the rules as they stand."""
    body = "\n".join("Ab3/" * 16 for _ in range(20))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    old = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}\n-----END RSA PRIVATE KEY-----"
    jwt = lambda *n: ".".join(h + "a1-_"[: k % 5] + "b2" * (k // 2) for h, k in zip(("eyJ", "eyJ", ""), n))
    secrets = [pem, old, jwt(20, 700, 342), jwt(800, 2000, 400), "sk-proj-" + "Zx9_" * 39, "xoxb-" + "1a" * 45, "ghp_" + "a1" * 40, 'password    =   "' + "q7" * 90 + '"', "api_key=" + "k8" * 20, "https://user" + "x" * 60 + ":" + "pw" * 50 + "@h"]
    texts = [f"say {x} end" for x in secrets] + [f"x-{secrets[2]} end", f"-----BEGIN PRIVATE KEY-----\n{body}", "eyJ-" * 100_000, "a -----BEGIN PRIVATE KEY----- only a header", "my token: internationalization, password hints"]
    out = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, texts)).collect()}
    want = {k: "say [SECRET] end" for k in range(len(secrets))} | {len(secrets): "x-[SECRET] end", len(secrets) + 1: "[SECRET]"}
    want |= {k: texts[k] for k in range(len(secrets) + 2, len(texts))} | {len(secrets) + 3: "a [SECRET] only a header"}
    assert out == want
    own = dict(secret_scan.RULES)["json_web_token"]
    for t in (*texts[:12], f"a.{secrets[2]}.{secrets[3]}", f"q-{jwt(9, 20, 20)} eyJeyJ-{jwt(20, 20, 9)} {jwt(30, 30, 30)}-eyJ.eyJ"):
        linear = [m.span(1) for m in re.finditer(secret_scan.LINEAR["json_web_token"], t, re.A)]
        assert linear == [m.span() for m in re.finditer(own, t, re.A)]


def test_fingerprints(spark, odd, empty):
    base = [prose(k, 400) for k in range(10, 16)]
    refs = spark.createDataFrame([(k, t) for k, t in enumerate(base)] + [(None, base[0]), (99, None), (98, "")], "item_id bigint, text string")
    near = " ".join(w for k, w in enumerate(base[2].split()) if k % 90)
    table = docs(spark, [base[0], near, prose(77, 400), "short"])
    one = {r.doc_id: r for r in fingerprint.fingerprints(table, refs, "item_id").collect()}
    assert one[0].best_id == 0 and one[0].score == pytest.approx(1) and one[1].best_id == 2 and one[1].score > 0.2
    assert one[2].best_id is None and one[2].score == 0 and one[3].best_id is None and one[3].score is None
    joined = {r.doc_id: r for r in fingerprint.fingerprints(table, refs, "item_id", send_bytes=0).collect()}
    assert {k: (v.best_id, v.score) for k, v in one.items()} == {k: (v.best_id, v.score) for k, v in joined.items()}
    assert fingerprint.fingerprints(odd, refs, "item_id").count() == odd.count()
    assert fingerprint.fingerprints(empty, refs, "item_id").count() == 0
    assert fingerprint.fingerprints(table, refs.limit(0), "item_id").where("best_id IS NOT NULL").count() == 0


def test_fingerprint_entropy():
    import numpy as np

    text = prose(5, 60).encode() + b"aaaa" * 40
    _, step = fingerprint.entropy(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    mine = step[step >= 0]
    for i in range(0, len(text) - 63, 17):
        counts = np.bincount(np.frombuffer(text[i : i + 64], np.uint8))
        p = counts[counts > 0] / 64
        assert abs(mine[i] - 1000 * -(p * np.log2(p)).sum() / 6) < 1.01


def brute_features(text, ranks):
    """Selected features by looking at every window and every run of 64 of them."""
    import numpy as np

    raw = text.encode()
    windows = [raw[k : k + 64] for k in range(len(raw) - 63)]
    own = []
    for w in windows:
        total = sum(round(c * np.log2(c) * 2**20) for c in (w.count(bytes([b])) for b in set(w)))
        own.append(ranks.get((6 * 2**20 - total // 64) * 1000 // (6 * 2**20)))
    padded = [None] * 63 + own + [None] * 63
    score = [0] * len(padded)
    for k in range(len(padded) - 63):
        known = [(r, k + i) for i, r in enumerate(padded[k : k + 64]) if r is not None]
        if known:
            score[min(known)[1]] += 1
    out = []
    for k, w in enumerate(windows):
        if own[k] is not None and score[k + 63] >= fingerprint.POPULAR:
            h = np.zeros(1, np.uint64)
            for word in np.frombuffer(w, np.uint64):
                h = fingerprint.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
            out.append(int(h[0]))
    return list(dict.fromkeys(out))


def brute_filters(features):
    """Bits of each filter, as sets, with their number of features."""
    return [({(h >> 11 * k) & 2047 for h in features[s : s + 160] for k in range(5)}, len(features[s : s + 160])) for s in range(0, len(features), 160)]


def brute_score(one, other):
    if len(one) > len(other):
        one, other = other, one
    pairs = [[(len(a & b), len(a), len(b)) for b, n in other if n >= 6] for a, m in one if m >= 6]
    if not pairs or not pairs[0]:
        return None
    best = []
    for row in pairs:
        scores = [0.0]
        for common, a, b in row:
            chance = a * b / 2048
            cut = chance + 0.3 * (min(a, b) - chance)
            scores.append((common - cut) / (min(a, b) - cut) if common > cut and min(a, b) > cut else 0.0)
        best.append(max(scores))
    return sum(best) / len(best)


def test_fingerprints_against_brute_force(spark):
    """Ranks, selection, chained filters, scores and the choice of the best, ties included."""
    from collections import Counter

    import numpy as np

    texts = [prose(1, 150), prose(1, 90) + " " + prose(2, 60), prose(3, 1800), "short", prose(4, 40) * 2, "", prose(3, 1500)]
    refs = [prose(1, 120), prose(3, 1700), prose(3, 1700), prose(9, 80), "x" * 100]
    counts = Counter()
    for t in texts:
        raw = t.encode()
        for k in range(len(raw) - 63):
            w = raw[k : k + 64]
            step = (6 * 2**20 - sum(round(c * np.log2(c) * 2**20) for c in Counter(w).values()) // 64) * 1000 // (6 * 2**20)
            counts[step] += step >= fingerprint.LEAST_ENTROPY
    ranks = {s: k for k, (_, s) in enumerate(sorted((n, s) for s, n in counts.items() if n))}
    own, known = ([brute_filters(brute_features(t, ranks)) for t in x] for x in (texts, refs))
    assert max(map(len, own)) > 1
    rows = fingerprint.fingerprints(docs(spark, texts), spark.createDataFrame(list(enumerate(refs)), "item_id bigint, text string"), "item_id").collect()
    for r in rows:
        bits, n = fingerprint.unpack(bytes(r.digest)) if r.digest else ([], [])
        assert [(set(np.flatnonzero(np.unpackbits(b))), int(c)) for b, c in zip(bits, n)] == own[r.doc_id]
        scores = [(s, -k) for k, f in enumerate(known) if (s := brute_score(own[r.doc_id], f)) is not None]
        best = max(scores, default=None)
        assert (r.score is None) == (best is None) and (best is None or abs(r.score - best[0]) < 1e-6)
        assert r.best_id == (None if not best or not best[0] else -best[1])


def brute_spans(text, items):
    w = words(text)
    covered = set()
    for item in items:
        i = words(item)
        if len(i) < decontam.MIN_WORDS:
            continue
        need = decontam.least_length(len(i))
        grams = {tuple(i[k : k + need]) for k in range(len(i) - need + 1)}
        for p in range(len(w) - need + 1):
            if tuple(w[p : p + need]) in grams:
                covered |= set(range(p, p + need))
    starts = sorted(p for p in covered if p - 1 not in covered)
    ends = sorted(p + 1 for p in covered if p + 1 not in covered)
    return list(zip(starts, ends))


def test_decontamination(spark, odd, empty):
    draw = random.Random(9)
    items = [prose(100 + k, draw.randrange(4, 60)) for k in range(20)]
    texts = [prose(k, 50) + " " + " ".join(items[k % 20].split()[draw.randrange(5) :]) + ", " + prose(k + 50, 30) for k in range(40)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, None), (51, ""), (52, items[0])], "item_id bigint, text string")
    got: dict[int, list] = {}
    for r in decontam.contaminated_spans(docs(spark, texts), bench).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    want = {d: s for d, t in enumerate(texts) if (s := brute_spans(t, items))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 30
    cleaned = {r.doc_id: r.text for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    for d, t in enumerate(texts):
        drop = {p for s, e in want.get(d, []) for p in range(s, e)}
        assert words(cleaned[d]) == [w for p, w in enumerate(words(t)) if p not in drop]
    assert decontam.decontaminate(odd, bench).exceptAll(odd).count() == 0
    assert decontam.contaminated_spans(empty, bench).count() == 0 and decontam.contaminated_spans(odd, bench.limit(0)).count() == 0


def test_substring_dedup(spark, odd, empty):
    shared = prose(7, 70)
    texts = [prose(1, 100), prose(2, 30) + " " + shared, shared + " " + prose(3, 80), prose(1, 100), shared + " " + prose(8, 5) + " " + shared, prose(9, 49)]
    seen: dict[tuple, list] = {}
    for d, t in enumerate(texts):
        w = words(t)
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), []).append((d, p))
    want = {}
    for places in seen.values():
        for k, at in enumerate(sorted(places)):
            if len(places) > 1:
                want[at] = (k == 0, len(places))
    rows = substring_dedup.repeated_spans(docs(spark, texts)).collect()
    cover = {(r.doc_id, r.is_first, p) for r in rows for p in range(r.start_word, r.end_word)}
    assert cover == {(d, f, q) for (d, p), (f, _) in want.items() for q in range(p, p + 50)}
    assert max(r.n_copies for r in rows) == 4
    copies = {r.doc_id for r in substring_dedup.repeated_spans(odd).collect()}
    assert {5, 6} <= copies and substring_dedup.repeated_spans(empty).count() == 0


def test_substring_dedup_of_hot_buckets(spark):
    """Hot buckets are counted window by window, with the same result."""
    shared = prose(7, 90)
    table = docs(spark, [prose(k, 20) + " " + shared + " " + prose(k + 50, k) for k in range(40)] + [prose(500, 80)] * 3)
    rows = sorted(substring_dedup.repeated_spans(table).collect())
    assert len(rows) > 40 and sorted(substring_dedup.repeated_spans(table, hot=4).collect()) == rows == sorted(substring_dedup.repeated_spans(table, hot=0).collect())


def test_substring_dedup_removes_copies(spark, odd):
    shared = prose(7, 70)
    texts = [f"A {shared}. Z", f"{prose(2, 9)}, {shared}! {prose(3, 9)}", prose(4, 30), f"{shared} {shared}"]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert out == {0: texts[0], 1: f"{prose(2, 9)}, ! {prose(3, 9)}", 2: texts[2], 3: ""}
    gone = substring_dedup.remove_repeats(odd)
    assert gone.columns == odd.columns and gone.count() == odd.count()
    assert sorted(r.text for r in gone.where("doc_id = 6").collect()) == [""] and substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def brute_licenses(text):
    found = [(m.start(), m.end(), k) for k, (_, _, e) in enumerate(license_scan.RULES) for m in re.finditer(e, text, re.I | re.A)]
    left = [a for a in found if not any(b != a and b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0] or b[2] < a[2]) for b in found)]
    kept = []
    for d in sorted(left, key=lambda d: (d[2], d[0])):
        if all(d[0] >= k[1] or d[1] <= k[0] for k in kept):
            kept.append(d)
    return sorted((license_scan.RULES[k][1], license_scan.RULES[k][0], s, e) for s, e, k in kept)


def test_licenses(spark, odd, empty):
    texts = [
        "Released under the MIT License. Also Apache License, Version 2.0.", "// SPDX-License-Identifier: GPL-2.0-or-later\n// x", "Licensed under CC BY-NC 4.0, see https://creativecommons.org/licenses/by-nc/4.0/",
        "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License", "All rights reserved. proprietary and confidential", "no such thing", "License " * 3000 + "GPLv3", "MIT LICENSE modern variant; BSD-3-Clause License",
    ]
    got: dict[int, list] = {d: [] for d in range(len(texts))}
    for r in license_scan.scan(docs(spark, texts)).collect():
        got[r.doc_id].append((r.license, r.rule, r.start_at, r.end_at))
    assert {d: sorted(v) for d, v in got.items()} == {d: brute_licenses(t) for d, t in enumerate(texts)}
    assert got[0][0][0] == "MIT" and got[5] == [] and len(license_scan.RULES) > 400
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


def test_sentencepiece(spark, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SPM_MODEL)
    texts = [prose(1, 50), "  two  spaces ", "\n\ttabs\n", "▁literal ▁ mark", "漢字 🎉 İstanbul naïve", "a", " ", "x" * 3000, "é" * 50]
    rows = {r.doc_id: r for r in spm.encode_documents(docs(spark, texts), SPM_MODEL).collect()}
    for d, t in enumerate(texts):
        assert rows[d].ids == library.encode(t) and rows[d].agrees and rows[d].n_tokens == len(rows[d].ids), t
        assert rows[d].round_trip or "▁" in t
    out = spm.encode_documents(odd, SPM_MODEL)
    assert out.count() == odd.count() and out.where("n_tokens IS NULL").count() == 1 and out.where("NOT agrees").count() == 0
    assert spm.encode_documents(empty, SPM_MODEL).count() == 0


def test_sentencepiece_holds_no_text_between_batches():
    """A codec's memory doesn't grow with what it has read, and batches of new words are the library's."""
    import pyarrow as pa

    own = spm.codec(open(SPM_MODEL, "rb").read())
    state = lambda: {k: len(v) for k, v in {**vars(own), **vars(own.vocabulary)}.items() if hasattr(v, "__len__")}
    before = state()
    for k in range(3):
        column = pa.array([" ".join(f"{w}{k}x{i} ж漢🎉{i}" for i, w in enumerate(prose(k, 3000).split())), None, "", "y" * 200, "  two  spaces "])
        ids, cuts = own.encode(column)
        assert all(own.agree(column, ids, cuts)) and own.round_trip(column, ids, cuts).all()
    assert state() == before


def test_word_table_is_made_in_little_memory():
    import tracemalloc

    from corpusloom.llm import kernels

    tracemalloc.start()
    table = kernels._word_table.__wrapped__()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (table == kernels._word_table()).all() and most < 20 << 20


def brute_pairs(texts, n=3, threshold=0.6):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def brute_classes(pairs):
    root = {d: d for p in pairs for d in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {d: (r, sum(d in p for p in pairs)) for d, r in root.items()}


def test_jaccard_join(spark, odd, empty):
    draw = random.Random(4)
    texts = []
    for k in range(40):
        base = prose(k, draw.randrange(20, 200)).split()
        texts.append(" ".join(base))
        for _ in range(draw.randrange(5)):
            texts.append(" ".join(w if draw.random() > draw.choice((0, 0.02, 0.06, 0.1)) else "other" for w in base))
    texts += ["", "one", "one", "one two"]
    texts += [texts[0]] * 5 + [texts[3].upper()]
    table = docs(spark, texts)
    want = brute_pairs(texts)
    known = {r.doc_id: r.representative for r in jaccard_join.members(table).collect()}
    assert set(known) == {d for d, t in enumerate(texts) if words(t)} and all(want[min(d, r), max(d, r)] == 1 for d, r in known.items() if d != r)
    between = {p: s for p, s in want.items() if all(known[d] == d for d in p)}
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_pairs(table).collect()}
    assert set(got) <= set(between) and len(got) >= 0.98 * len(between) and len(between) > 50
    assert all(abs(got[p] - between[p]) < 1e-12 for p in got)
    found = {p for p in want if known[p[0]] == known[p[1]] or tuple(sorted((known[p[0]], known[p[1]]))) in got}
    assert len(found) >= 0.98 * len(want)
    rows = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(table).collect()}
    assert rows == brute_classes(found)
    kept = {r.doc_id for r in jaccard_join.keep_one(table).collect()}
    assert kept == {d for d in range(len(texts)) if d not in rows or rows[d][0] == d}
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(odd).collect()} == {5: (5, 1), 6: (5, 1)}
    one = jaccard_join.keep_one(odd)
    assert one.columns == odd.columns and sorted((r.doc_id is None, r.doc_id) for r in one.collect()) == [(False, d) for d in (1, 2, 3, 4, 5, 7, 8)] + [(True, None)]
    assert jaccard_join.keep_one(empty).count() == 0 and jaccard_join.jaccard_classes(empty).count() == 0


def test_jaccard_join_in_parts(spark, monkeypatch):
    """Bands and blocks that are cut into many parts give the same."""
    base = prose(5, 120).split()
    texts = [" ".join(w if (k * 31 + i) % 40 else f"x{k}" for i, w in enumerate(base)) for k in range(60)] + [prose(k, 50) for k in range(20)]
    whole = sorted(jaccard_join.jaccard_classes(docs(spark, texts)).collect())
    assert {r.doc_id: (r.class_id, r.n_links) for r in whole} == brute_classes(brute_pairs(texts))
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 7)
    assert sorted(jaccard_join.jaccard_classes(docs(spark, texts)).collect()) == whole


def test_jaccard_join_of_repeated_ids(spark):
    """The text of least hash counts, in whatever order the rows come."""
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, a), (3, b), (1, a)]
    out = [sorted(jaccard_join.jaccard_classes(spark.createDataFrame(x, "doc_id bigint, text string").repartition(3)).collect()) for x in (rows, rows[::-1])]
    assert out[0] == out[1] and len(out[0]) == 2 and out[0][0] == (1, 1, 1)


def test_jaccard_join_in_a_crowd(spark):
    """Pairs at the threshold share a passage, of which many documents that are like nothing else quote a part."""
    texts, pairs = [], set()
    for k in range(4):
        passage = prose(1000 + k, 300).split()
        pairs.add((len(texts), len(texts) + 1))
        texts += [" ".join([*passage, prose(3000 + 2 * k + side, 90)]) for side in (0, 1)]
        assert brute_pairs(texts[-2:])
        texts += [" ".join([*passage[c % 60 : 240 + c % 60], prose(5000 + 1000 * k + c, 300)]) for c in range(500)]
    got = {(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_pairs(docs(spark, texts)).collect()}
    assert pairs <= got


def test_jaccard_join_loses_no_pair(spark):
    """Of 2,000 pairs that just reach the threshold, and of sets of every size that share much, none is left out."""
    draw = random.Random(8)
    texts = []
    for k in range(2000):
        own = [f"w{k}x{i}" for i in range(12)]
        texts += [" ".join(own[:10]), " ".join(own[:8] + own[10:])]  # 6 of 10 grams
    many = len(texts)
    for k in range(300):
        base = prose(9000 + k, draw.choice((3, 7, 40, 300, 3000))).split()
        for _ in range(2):
            texts.append(" ".join(w if draw.random() > 0.08 else "other" for w in base[: draw.randrange(len(base) * 7 // 10, len(base) + 1)]))
    got = {(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_pairs(docs(spark, texts)).collect()}
    assert {p for p in got if p[1] < many} == {(2 * k, 2 * k + 1) for k in range(2000)}
    known = {r.doc_id: r.representative for r in jaccard_join.members(docs(spark, texts)).collect()}
    want = {(a + many, b + many) for a, b in brute_pairs(texts[many:])}
    assert {p for p in got if p[0] >= many} == {p for p in want if all(known[d] == d for d in p)}


def test_bitmaps_rule_out_no_pair():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**64, 30_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:k][draw.random(k) < 0.85], draw.integers(0, 2**64, k // 20, dtype=np.uint64)])) for k in (1, 2, 9, 10, 60, 70, 500, 600, 9_000, 20_000, 30_000) for _ in range(3)]
    sets = [s if len(s) else base[:1] for s in sets]
    size = np.array(list(map(len, sets)))
    data, at = jaccard_join.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    held = jaccard_join.Bitmaps(pa.array([data[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]), size)
    i, j = np.triu_indices(len(sets), 1)
    same = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    true = same / (size[i] + size[j] - same)
    for threshold in (0.3, 0.6, 0.9):
        may = held.may_reach(i, j, threshold)
        assert may[true >= threshold].all() and not may[true < threshold / 3].any() and (true >= threshold).any()


def test_band_links():
    import numpy as np

    draw = np.random.default_rng(2)
    base = draw.integers(0, 256, (5, 160), dtype=np.uint8)
    of = draw.integers(0, 5, 60)
    sketches = np.where(draw.random((60, 160)) < 0.15, draw.integers(0, 256, (60, 160), dtype=np.uint8), base[of])
    root = np.arange(60)
    for i, j in zip(*jaccard_join.band_links(sketches, 0.5)):
        root[root == root[j]] = root[i]
    assert all((root[i] == root[j]) == (of[i] == of[j]) for i in range(60) for j in range(60))


def test_language_id(spark, odd, empty):
    langs = {"xx": "abcdefg", "yy": "hijklmn", "zz": "aeioustr"}
    draw = random.Random(3)
    say = lambda letters, n: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 8))) for _ in range(n))
    rows = [(k, say(langs[x], 60), x, 0) for k, x in enumerate(list(langs) * 60)]
    known = spark.createDataFrame(rows[:90], "doc_id bigint, text string, lang string, n_chars bigint")
    held = spark.createDataFrame(rows[90:], known.schema)
    prototypes = lang_id.train(known)
    got = {r.doc_id: r for r in lang_id.identify(held, prototypes).collect()}
    assert sum(got[k].detected == x for k, _, x, _ in rows[90:]) >= 0.98 * 90 and all(r.accepted for r in got.values())
    strange = docs(spark, ["ж" * 5 + " щцъ жщц ъщж", "", "123 456", say("abcdefg", 40)])
    assert [r.doc_id for r in lang_id.keep_accepted(strange, prototypes).collect()] == [3]
    assert lang_id.identify(odd).count() == odd.count() and lang_id.identify(empty).count() == 0


def brute_vector(text, dimensions):
    """Bind and bundle one trigram after the other."""
    import numpy as np

    vector = lambda c: lang_id._vectors(np.array([ord(c) if c != " " else 0], np.uint64), dimensions)[0].astype(int)
    flat = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    out = np.zeros(dimensions, int)
    for a, b, c in zip(flat, flat[1:], flat[2:]):
        if b != " ":
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_language_id_against_brute_force(spark):
    """Prototypes, cosines and verdicts equal those of a text-by-text computation; the first of equal languages counts."""
    import numpy as np

    rows = [(k, t, lang, len(t)) for k, (t, lang) in enumerate([("the quick brown fox", "en"), ("and the lazy dog", "en"), ("le renard brun", "fr"), ("et le chien", "fr"), ("und der hund", "de"), ("und der hund", "dd"), ("ja", None)])]
    known = spark.createDataFrame([*rows, (0, "stray words", "de", 1), (None, "nobody", "en", 1), (9, None, "en", 1)], "doc_id bigint, text string, lang string, n_chars bigint")
    sums: dict[str, object] = {}
    for k, t, lang, _ in [*rows[:6], (0, "stray words", "de", 1)]:
        v = brute_vector(t, 1024).astype(float)
        sums[lang] = sums.get(lang, 0) + np.rint(v / np.sqrt(v @ v) * 1e6)
    unit = {k: v / np.sqrt(v @ v) for k, v in sorted(sums.items())}
    prototypes = lang_id.train(known)
    assert prototypes.languages == list(unit) and np.allclose(prototypes.vectors, list(unit.values()), atol=1e-6)
    texts = ["le chien brun et le renard", "und der hund", "the dog!", "x", "77", "renard RENARD, 12 le-brun"]
    for r in lang_id.identify(docs(spark, texts), prototypes).collect():
        v = brute_vector(texts[r.doc_id], 1024).astype(float)
        if not v.any():
            assert (r.detected, r.cosine, r.accepted) == (None, None, False)
            continue
        cosine = {k: float(v @ u / np.sqrt(v @ v)) for k, u in unit.items()}
        best = max(cosine.values())
        n = sum(len(w) for w in re.findall(r"[^\W\d_]+", texts[r.doc_id]))
        assert abs(r.cosine - best) < 1e-9 and r.detected == next(k for k, c in cosine.items() if best - c < 1e-9)
        assert r.accepted == (best >= lang_id.MIN_COSINE * min(1, n / 40) ** 0.5)
    assert lang_id.train(known, most_languages=1).languages == ["de"]  # of equally frequent ones the first by name


def test_language_id_keeps_short_texts(spark):
    """One word in each language is enough to stay."""
    rows = [(k, f"{a} {b} {c}", lang, 0) for lang, words in {"en": "there with which", "fr": "avec dans cette", "de": "nicht auch durch"}.items() for k, (a, b, c) in enumerate([words.split()] * 9)]
    prototypes = lang_id.train(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, n_chars bigint"))
    got = {r.doc_id: r for r in lang_id.identify(docs(spark, ["Avec.", "which", "durch", "there"]), prototypes).collect()}
    assert [got[k].detected for k in range(4)] == ["fr", "en", "de", "en"] and all(r.accepted for r in got.values())


def test_repeated_ids_with_other_contents(spark):
    """Each row is judged, and extracted, by itself."""
    table = spark.createDataFrame([(1, "the quick brown fox jumps", "en", 1), (1, "le renard brun et le chien", "fr", 1)] * 3, "doc_id bigint, text string, lang string, n_chars bigint")
    assert sorted(r.detected for r in lang_id.identify(table).collect()) == ["en"] * 3 + ["fr"] * 3
    pages = spark.createDataFrame([(1, "u", f"<article><p>{w} one two</p></article><nav>x</nav>", "") for w in ("alpha", "beta")], "page_id bigint, url string, html string, text string")
    assert sorted(r.text for r in html_extract.extract_pages(pages, html_extract.DEFAULT | {"article": -100, "/article": -100}).collect()) == ["alpha one two", "beta one two"]


def test_html_training_finds_rare_labels(spark):
    """Pages without a label don't use up the limit."""
    rows = [(k, "u", f"<div><p>{prose(k, 30)}</p></div>", "") for k in range(300)] + [(1000, "u", f"<nav>a b</nav><article><p>{prose(1, 60)}</p></article><footer>c</footer>", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert html_extract.train(pages, 2) == html_extract.train(pages.where("page_id = 1000")) != html_extract.DEFAULT


PAGE = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/'>Home</a><a>More</a></nav><div>{}</div><footer><a>x</a></footer></body></html>"


def test_html_extract(spark):
    article = "<article><h1>Head &amp; line</h1>" + "".join(f"<p>{prose(k, 40)}</p>" for k in range(5)) + "</article>"
    pages = [PAGE.format(article), PAGE.format(article.replace("article>", "section>")), None, "", "no tags at all", "<p><b>", "<" * 5000, PAGE.format(f"<p>{prose(9, 5000)}</p>"), '<a title="x > y">one</a> <p>two three']
    table = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(pages)] + [(None, "u", pages[0], "t")], "page_id bigint, url string, html string, text string")
    weights = html_extract.train(table)
    assert weights["word"] > 0 and all(v < 0 for k, v in weights.items() if k != "word")
    rows = {r.page_id: r for r in html_extract.extract_pages(table, weights).collect()}
    for k, page in enumerate(pages):
        if page is None:
            assert rows[k].text is None and rows[k].n_words == 0
            continue
        names, n, starts, ends = html_extract.tokens(page)
        values = [c * weights["word"] if c else weights.get(x, html_extract.UNSEEN) for x, c in zip(names, n)]
        best = max([sum(values[s:e]) for e in range(len(values) + 1) for s in range(e)] or [0] if len(values) < 300 else [0])
        inside = [k2 for k2 in range(len(names)) if rows[k].n_words and starts[k2] >= rows[k].start_at and ends[k2] <= rows[k].end_at]
        if len(values) < 300:
            assert sum(values[i] for i in inside) == max(best, 0), page[:80]
    content = " ".join(w for k in range(5) for w in prose(k, 40).split())
    for k in (0, 1):
        assert content in rows[k].text.replace("\n", " ") and "Home" not in rows[k].text and "var a" not in rows[k].text
    assert "Head & line" in rows[0].text and rows[4].text == "no tags at all" and rows[3].text == ""
    assert html_extract.extract_pages(table.limit(0)).count() == 0


def test_html_tags_of_any_length():
    long = '<img src="data:image/png;base64,' + "Ab3/ " * 40_000 + '">'
    page = f"one {long} two"
    assert html_extract.tokens(page) == (["word", "img", "word"], [1, 0, 1], [0, 4, 4 + len(long)], [4, 4 + len(long), len(page)])
    assert html_extract.extract(page, html_extract.DEFAULT)[0] in ("one", "two")
    for part in ("<", "<a ", '<a "', "<!", "<script ", "</"):  # nothing ends: linear time
        assert "a" not in html_extract.tokens(part * 200_000)[0]
    assert html_extract.tokens("x <b <!-- y <i")[0] == ["word", "!"]
