"""Text functions as column expressions; Arrow functions only where Spark has none."""

from __future__ import annotations

from collections.abc import Sequence
import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from quillstone.functions.probability import let

# Ranges of letters by script, counted in this order.
SCRIPTS = {
    "latin": r"A-Za-zÀ-ɏḀ-ỿ",
    "arabic": r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿",
    "devanagari": r"ऀ-ॿ",
    "cyrillic": r"Ѐ-ԯ",
    "kana": r"぀-ヿㇰ-ㇿｦ-ﾝ",
    "cjk": r"㐀-䶿一-鿿",
}
# Characters that are words by themselves.
WORD_CHARACTERS = r"[぀-ヿ㐀-鿿가-힯]"
# Function words that separate languages in Latin script; among equal scores no language wins.
FUNCTION_WORDS = {
    "de": [" und ", " der ", " die ", " nicht ", " ich ", " ein "],
    "fr": [" le ", " la ", " les ", " est ", " pas ", " une "],
    "es": [" el ", " los ", " las ", " una ", " que ", " por "],
    "it": [" il ", " che ", " non ", " una ", " per ", " sono "],
    "pt": [" não ", " uma ", " para ", " com ", " você ", " não"],
    "nl": [" het ", " een ", " van ", " niet ", " zijn ", " dat "],
    "pl": [" nie ", " się ", " jest ", " na ", " to ", " czy "],
    "tr": [" bir ", " ve ", " için ", " bu ", " değil ", " ile "],
    "en": [" the ", " and ", " is ", " to ", " of ", " that "],
}
# Words that count as English.
ENGLISH_WORDS = "the and you to is of for please my we i it this that with have not are was can your our on".split()

_SPACE = r"(?U)[\s\x1c-\x1f]+"


#: Marks and parts of syllables that may compose with their neighbours.
_COMBINING = r"[\x{300}-\x{36f}\x{1100}-\x{11ff}\x{3099}\x{309a}]"


def norm(col: Column) -> Column:
    """White space collapsed and trimmed, lower case: the key by which corpora compare texts."""
    return F.lower(F.trim(F.regexp_replace(col, _SPACE, " ")))


def shown(col: Column) -> Column:
    """Whether a text has anything but white space, hence a normal form that isn't empty; found without making it."""
    return col.rlike(r"(?U)[^\s\x1c-\x1f]")


def word_count(col: Column) -> Column:
    """Words between white space; each kana, CJK or hangul character is a word. Composed and combining spellings count alike."""
    col = F.coalesce(nfc(F.when(col.rlike(_COMBINING), col)), col)
    rest = F.trim(F.regexp_replace(F.regexp_replace(col, WORD_CHARACTERS, " "), _SPACE, " "))
    return F.regexp_count(col, F.lit(WORD_CHARACTERS)) + F.when(rest == "", 0).otherwise(F.size(F.split(rest, " ")))


def script_counts(col: Column) -> Column:
    """Letters per script."""
    return F.struct(*(F.regexp_count(col, F.lit(f"[{r}]")).alias(n) for n, r in SCRIPTS.items()))


def _script_tests(s: Column) -> dict[str, Column]:
    n = {k: s[k] for k in SCRIPTS}
    total = sum(n.values(), F.lit(0))
    p = {k: v / total for k, v in n.items()}
    foreign = p["arabic"] + p["devanagari"] + p["cyrillic"] + p["kana"] + p["cjk"]
    # The shares and counts from which a text counts as written in a script.
    return {
        "few": total < 4,
        "ar": (p["arabic"] >= 0.6) & (p["latin"] < 0.25),
        "hi": (p["devanagari"] >= 0.6) & (p["latin"] < 0.25),
        "ru": (p["cyrillic"] >= 0.6) & (p["latin"] < 0.25),
        "ja": (n["kana"] >= 4) & (p["kana"] >= 0.05) & (p["kana"] + p["cjk"] >= 0.5) & (p["arabic"] < 0.1),
        "zh": (n["cjk"] >= 8) & (p["cjk"] >= 0.5) & (n["kana"] <= 1) & (p["kana"] < 0.02),
        "latin": (p["latin"] >= 0.7) & (foreign <= 0.15),
    }


def language_ok(col: Column, lang: Column) -> Column:
    """Whether the scripts of a text fit a language; fewer than four letters never do."""

    def fits(s: Column) -> Column:
        t = _script_tests(s)
        out = F.when(t["few"], F.lit(False))
        for k in ("ar", "hi", "ru", "ja", "zh"):
            out = out.when(lang == k, t[k])
        return out.otherwise(t["latin"])

    return F.when(col.isNotNull(), let(script_counts(col), fits))


def script_family(col: Column) -> Column:
    """ar, hi, ru, ja, zh or latin; null where no script dominates."""

    def family(s: Column) -> Column:
        t = _script_tests(s)
        out = F.when(t["few"], F.lit(None).cast("string"))
        for k in ("ar", "hi", "ru", "ja", "zh", "latin"):
            out = out.when(t[k], k)
        return out

    return F.when(col.isNotNull(), let(script_counts(col), family))


def guess_lang(col: Column, candidates: Sequence[str] | None = None) -> Column:
    """Language by script, in Latin script by two or more function words if one language has the most; else empty.

    With ``candidates`` only these count: a script or the words of another language give none.
    """
    lists = {k: v for k, v in FUNCTION_WORDS.items() if candidates is None or k in candidates}

    def scores(padded: Column) -> Column:
        points = lambda words: sum(((F.instr(padded, w) > 0).cast("int") for w in words), F.lit(0))
        return F.sort_array(F.array(*(F.struct(points(words).alias("n"), F.lit(k).alias("k")) for k, words in lists.items())), asc=False)

    def best(r: Column) -> Column:
        first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        return F.when((first["n"] >= 2) & (first["n"] > F.coalesce(second["n"], F.lit(0))), first["k"]).otherwise("")

    latin = let(let(F.concat(F.lit(" "), norm(col), F.lit(" ")), scores), best) if lists else F.lit("")
    known = lambda f: F.lit(True) if candidates is None else f.isin(list(candidates))
    return let(script_family(col), lambda f: F.when(f == "latin", latin).otherwise(F.coalesce(F.when(known(f), f), F.lit(""))))


def looks_english(col: Column) -> Column:
    """Nearly all letters ASCII and a tenth of the words common English ones."""
    letters = F.regexp_count(col, F.lit("[A-Za-z]"))
    other = F.regexp_count(col, F.lit(r"[^\x00-\x7f]"))
    words = F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0))
    n = F.size(words)
    hits = F.size(F.filter(words, lambda w: w.isin(ENGLISH_WORDS)))
    return F.when((letters == 0) | (other * 50 > letters), False).otherwise(F.when(n < 4, n > 0).otherwise(hits * 10 >= n))


def tokens(col: Column, lang: Column) -> Column:
    """Lower-cased runs of letters and digits; in Japanese and Chinese single letters and digits."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    return F.when(lang.isin("ja", "zh"), F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]"), F.lit(0))).otherwise(words)


def first_prefix(col: Column, lang: Column) -> Column:
    """The first three tokens of a text."""
    t = F.slice(tokens(col, lang), 1, 3)
    return F.when(lang.isin("ja", "zh"), F.array_join(t, "")).otherwise(F.array_join(t, " "))


def char_ngrams(col: Column, n: int = 5) -> Column:
    """Distinct n-grams of the normalised text; a shorter text is its own gram, an empty one has none."""

    @F.pandas_udf(ArrayType(StringType()))
    def grams(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1))) if len(t) > n else [t] if t else [])

    return grams(norm(col))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 for two empty ones, 0 for an empty and another one."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def human(col: Column) -> Column:
    """A label as words: camel case and separators opened, lower case."""
    s = F.regexp_replace(F.regexp_replace(col, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-/]+", " ")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def squash(col: Column) -> Column:
    """A label without anything but letters and digits, lower case."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))


def scrub(col: Column, mask: str = "[MASK]") -> Column:
    """Text in which a mask token is a blank."""
    return F.replace(col, F.lit(mask), F.lit(" "))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by values; names without a value stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("{" + k + "}")))
    return template


def valid_request_id(col: Column) -> Column:
    return col.rlike(r"\A[A-Za-z0-9._-]{1,128}\z")


def window_around(text: Column, at: Column, length: Column, width: int, seed: Column) -> Column:
    """``width`` characters that hold the span of ``length`` at 0-based ``at``, at a seeded offset."""
    slack = F.greatest(F.lit(0), F.lit(width) - length)
    shift = F.pmod(F.xxhash64(seed), slack + 1)
    start = F.greatest(F.lit(0), F.least(at - shift, F.length(text) - width))
    return F.when(F.length(text) <= width, text).otherwise(F.substring(text, start.cast("int") + 1, F.lit(width)))


def _strings(v) -> list[str]:
    return [v] if isinstance(v, str) else [s for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else []) for s in _strings(x)]


def _json(s: str | None):
    try:
        return json.loads(s) if s is not None else None
    except (ValueError, RecursionError):
        return s


@F.pandas_udf(ArrayType(StringType()))
def nested_strings(s: pd.Series) -> pd.Series:
    """All strings in a JSON text, never keys; text that is no JSON is its own string."""
    return s.map(lambda t: None if t is None else _strings(_json(t)))


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; invalid JSON is null."""

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def python_json(s: pd.Series) -> pd.Series:
    """JSON respelled with ``, `` and ``: ``, key order and other scripts kept; strings stay as they are."""

    def one(t):
        v = _json(t)
        return t if t is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return s.map(one)


@F.pandas_udf(StringType())
def python_float(s: pd.Series) -> pd.Series:
    """The shortest decimal that reads back as the same double, exponents below 1e-4 and from 1e16."""
    return s.map(lambda x: None if x is None else repr(float(x)))


@F.pandas_udf(StringType())
def content_free(s: pd.Series, filler: pd.Series) -> pd.Series:
    """JSON of the same shape with every string replaced; plain text is replaced as a whole."""

    def shape(v, f):
        return f if isinstance(v, str) else [shape(x, f) for x in v] if isinstance(v, list) else {k: shape(x, f) for k, x in v.items()} if isinstance(v, dict) else v

    def one(t, f):
        if t is None:
            return None
        v = _json(t)
        return f if isinstance(v, str) or not isinstance(v, (list, dict)) else json.dumps(shape(v, f), ensure_ascii=False)

    return pd.Series([one(t, f) for t, f in zip(s, filler)])


@F.pandas_udf(StringType())
def literal_json(s: pd.Series) -> pd.Series:
    """JSON or a Python literal, as JSON; anything else is null."""

    def one(t):
        for parse in (json.loads, ast.literal_eval):
            try:
                return json.dumps(parse(t), ensure_ascii=False)
            except (TypeError, ValueError, SyntaxError, RecursionError, MemoryError):
                continue
        return None

    return s.map(one)


def has_key(col: Column, key: str) -> Column:
    """Whether a JSON text has an object with the key, at any depth."""

    def find(v) -> bool:
        return key in v or any(map(find, v.values())) if isinstance(v, dict) else any(map(find, v)) if isinstance(v, list) else False

    @F.pandas_udf(BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else find(_json(t)))

    return run(col)


def flatten_text(col: Column, preferred: tuple[str, ...] = ("text", "content", "utterance", "message")) -> Column:
    """The strings of a JSON text on lines; of an object with a preferred field only that."""

    def flat(v) -> list[str]:
        if isinstance(v, str):
            return [v]
        if isinstance(v, list):
            return [s for x in v for s in flat(x)]
        if isinstance(v, dict):
            for k in preferred:
                if k in v:
                    return flat(v[k])
            return [s for x in v.values() for s in flat(x)]
        return []

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join(flat(_json(t))))

    return run(col)


@F.pandas_udf(StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    """The object in the answer of a language model: thinking and fences dropped, first to last brace; else null."""

    def one(t):
        if t is None:
            return None
        t = re.sub(r"<think>.*?</think>", "", t, flags=re.S)
        t = re.sub(r"```(?:json)?", "", t)
        a, b = t.find("{"), t.rfind("}")
        try:
            return json.dumps(json.loads(t[a : b + 1]), ensure_ascii=False) if 0 <= a < b else None
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def dotted(col: Column, path: str) -> Column:
    """A value in a JSON text by dotted path."""
    return F.get_json_object(col, "$." + path)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of zero-joined parts."""
    digest = F.sha2(F.concat_ws("\x00", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
