"""Language by letters and common words, and the script that a text is written in."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Telling letters, and common words, of each language; the first of equal scores counts.
PROFILES: dict[str, tuple[str, str]] = {
    "tr": ("ıİğĞşŞçÇöÖüÜ", "bir ve bu için değil ile daha"),
    "en": ("", "the and of to is that it"),
    "de": ("äöüß", "der die und das ist nicht ein"),
    "fr": ("àâçéèêëîïôùûü", "le la et les des est une"),
    "es": ("áéíóúñ¿¡", "el la de que y los en"),
    "it": ("àèéìòù", "il di che la per non una"),
    "pt": ("ãõáéíóúç", "de que não uma com para"),
    "ru": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "и в не на что"),
    "ar": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "في من على الى"),
}
FLOOR, LEAST, MOST, SHORTEST = 0.30, 0.15, 0.75, 12
#: Characters whose scripts are counted together, at some 20 bytes each.
PIECE = 1 << 18
_PROFILES = {lang: ((frozenset(letters), len(letters)), frozenset(common.split())) for lang, (letters, common) in PROFILES.items()}

#: Ranges of letters by script, as inner parts of a class.
SCRIPTS: dict[str, str] = {
    "Latin": r"\x{41}-\x{24f}", "Greek": r"\x{370}-\x{3ff}", "Cyrillic": r"\x{400}-\x{4ff}", "Hebrew": r"\x{590}-\x{5ff}", "Arabic": r"\x{600}-\x{6ff}",
    "Devanagari": r"\x{900}-\x{97f}", "Hangul": r"\x{ac00}-\x{d7af}", "Hiragana": r"\x{3040}-\x{309f}", "Katakana": r"\x{30a0}-\x{30ff}", "Han": r"\x{4e00}-\x{9fff}",
}

EXPECTED: dict[str, str] = {
    **dict.fromkeys("tr en de fr es it".split(), "Latin"), "az": "Latin Cyrillic Arabic", "tk": "Latin Cyrillic", **dict.fromkeys("ru uk bg".split(), "Cyrillic"),
    **dict.fromkeys("ar fa ur".split(), "Arabic"), "he": "Hebrew", "el": "Greek", "hi": "Devanagari", "ja": "Hiragana Katakana Han", "ko": "Hangul", "zh": "Han",
}

CONFUSABLE: tuple[str, ...] = ("tr az tk ug uz kk ky", "es gl pt ca", "hr sr bs sl", "da no nb nn sv", "hi mr ne bh", "id ms", "cs sk")


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """For each code point the number of its script, len(SCRIPTS) for letters of others, and one more for what is no letter."""
    table = np.full(sys.maxunicode + 1, len(SCRIPTS) + 1, np.uint8)
    for c in range(0x10000):  # letters beyond the basic plane are not counted
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = len(SCRIPTS)
    for k, inner in enumerate(SCRIPTS.values()):
        lo, hi = (int(x, 16) for x in re.findall(r"\{([0-9a-f]+)\}", inner))
        own = table[lo : hi + 1]
        own[own == len(SCRIPTS)] = k
    return table


def script_of(text: str) -> str:
    """The script of most letters, the first of equals; None without letters."""
    counts = np.zeros(len(SCRIPTS) + 2, np.int64)
    for k in range(0, len(text), PIECE):
        points = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(_letter_table()[points], minlength=len(counts))
    counts = counts[:-1]
    return (*SCRIPTS, "Other")[int(counts.argmax())] if counts.any() else "None"


def language_of(low: str) -> tuple[str, float]:
    """(lang, confidence) of a text in lower case and normal form C, by 0.4 x the share of telling letters and 0.6 x that of common words; unknown below 0.30; never over 0.75."""
    letters, words = set(low), set(low.split(" "))
    best, name = -1.0, ""
    for lang, (telling, common) in _PROFILES.items():
        share = len(telling[0] & letters) / telling[1] if telling[1] else 0.0
        score = 0.4 * share + 0.6 * (len(common & words) / len(common))
        if score > best:
            best, name = score, lang
    capped = min(best, MOST)
    return ("unknown", best) if best <= LEAST else ("unknown", capped) if capped < FLOOR else (name, capped)


def detect(text: Column) -> Column:
    """(lang, confidence, script) of each text, as language_of and script_of have it, of the whole text; language unknown for fewer than 12 characters. Null for null."""

    @F.arrow_udf("struct<lang:string,confidence:double,script:string>")
    def look(column: pa.Array) -> pa.Array:
        found = []
        for value in column:  # one text at a time: a batch is large, and as strings several times that
            t = (value.as_py() or "").strip()
            lang = ("unknown", 0.0) if len(t) < SHORTEST else language_of(t.lower() if t.isascii() else unicodedata.normalize("NFC", t.lower()))
            found.append((*lang, script_of(t)))
        names = ["lang", "confidence", "script"]
        parts = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
        return pa.StructArray.from_arrays(parts, names, mask=pa.array(column.is_null()))

    return look(text)


def script_mismatch(lang: Column, written: Column) -> Column:
    """Whether a known language is written in a script that isn't its own."""
    own = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v.split()]))])
    return F.coalesce(~F.array_contains(F.element_at(own, lang), written), F.lit(False)) & ~written.isin("None", "Other")


def confusable(lang: Column) -> Column:
    """The languages that are often taken for this one."""
    groups = [g.split() for g in CONFUSABLE]
    table = F.create_map(*[x for g in groups for one in g for x in (F.lit(one), F.array(*[F.lit(o) for o in g if o != one]))])
    return F.coalesce(F.element_at(table, lang), F.array().cast("array<string>"))
