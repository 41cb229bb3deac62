"""Per-document text quality statistics and a robust distance from the prose of the same language.

Statistics come from one pass over the whole text. For each language, the mean and covariance of prose
are estimated robustly from all distinct documents: start at median and MAD, then a fixed number of
concentration steps (fewer if the documents kept stay the same), each one distributed aggregation of sums and products over the documents close to
the last estimate. A document's squared Mahalanobis distance splits exactly into contributions of
the statistics (the terms ``z_j * (S^-1 z)_j``), which say what makes it an outlier.

The language of a document is the one whose common words it uses most; only without any does its label
count. Junk seldom has common words, hence carries whatever language its label names and is far from it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.languages import language_code_py
from quillstone.llm.looks import looks
from quillstone.session import cut

# Common words of each language; of Japanese and Chinese, common characters.
COMMON = {
    "en": "the of and to in a is it that for on was with as at by be this from or an are not so but which they we i my me us you our has have had if when after before while than then into would could because although until no nobody still",
    "de": "der die das und ist in zu den von mit nicht ein eine einen einem einer auf für hat sich des dem im wir ich uns als auch es an nach bei aus wie war noch nie weil obwohl so was jede ihre vor damit bis seit wird haben",
    "fr": "le la les de des du un une et est à en que qui pour dans pas sur au aux ce cette il elle nous on a par plus ne avec se sa son mais donc je ma mon après avant sans selon jusqu parce ai chaque ont été devait",
    "es": "el la los las de del y que en un una es se no por con para su al lo como más pero sus le ya o este esta fue nos mi antes después según sin muy algo todavía porque aunque hasta me nunca cada mientras nadie en",
    "it": "il lo la i gli le di del della dei che e è un una in per non con su da al alla ma come più questo questa si ci ho ha mi mia mio anche se prima dopo secondo sono nel nella dell all ancora perché nessuno fino era",
    "pt": "o a os as de do da dos das e que em um uma é para com não por se no na ao à mais mas como foi depois antes isso esta este nos me minha meu até porque embora ainda nunca conforme você tenho ninguém sem numa num",
    "nl": "de het een en van in is op te dat die voor met niet zijn aan er om ook als maar bij uit naar wij ik ons mij mijn heeft hebben nog na dus tot sinds volgens hoewel omdat niemand dan deze dit geldt nooit",
    "pl": "w i na z do że się nie to o jak po co jest za od ale przez dla tak przed oraz już ma mi mam moja mój nam nas są był była być aby ta ten tego tej bo choć mimo nigdy według jasne nikt jeszcze więc dlatego od",
    "ru": "и в не на что с по к из за от у мы я меня мне нас нам это эта этот как же но для до так его её их был была было будет все никто никогда потому поэтому хотя перед после ей ему который а о то мой моя",
    "ja": "のはをがにでとたしてましすいるかられもさんまへよりそこ",
    "zh": "的了在是不我有就这个们没一把被从到和上跟之后前很因为可",
}
UNSPACED = ("ja", "zh")
STATS = ["log_words", "mean_word_length", "symbol_share", "digit_share", "punctuated_lines", "common_share", "common_gap", "sentence_length", "distinct_share", "compression", "letter_share", "short_units"]

#: Least standard deviation of each statistic: prose of one layout must not make another layout an outlier.
FLOORS = [0.3, 0.5, 0.01, 0.015, 0.3, 0.04, 0.25, 0.3, 0.1, 0.1, 0.02, 0.1]

_SETS = {k: frozenset(looks(v) if k in UNSPACED else looks(v).split()) for k, v in COMMON.items()}
_CJK = "぀-ヿ㐀-鿿"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_DIGIT = re.compile(r"\d")
_END = ".!?。！？…:;»\"”)"
_SENTENCE = re.compile(r"[.!?。！？…]+(?=[\s\"»”)]|$)|[。！？]")


def document_stats(text: str | None, label: str | None = None) -> tuple[str, int, list[float]]:
    """(language, word count, statistics in the order of STATS) of one text; null counts as empty.

    mean_word_length in letters and digits; symbol_share, digit_share and letter_share of the
    characters other than white space; punctuated_lines of the non-empty lines; common_share of the
    words; common_gap: log of the mean number of words between common words; sentence_length: log of words
    per sentence end; distinct_share: log of distinct words against what prose of that length has;
    compression: log of compressed against raw bytes; short_units: share of lines (or of sentences, if
    there are fewer lines) of at most four words. An empty text has zeros throughout.
    """
    t = looks(text or "").strip()
    words = _WORD.findall(t.lower())
    n = len(words)
    if not n:
        solid = len("".join(t.split()))
        return language_code_py(label) or "en", 0, [0.0, 0.0, float(solid > 0), *[0.0] * (len(STATS) - 3)]
    best, hits = "", 0
    counts = Counter(words)
    distinct = counts.keys()
    for lang, s in _SETS.items():
        h = sum(map(counts.__getitem__, distinct & s))
        if h > hits:
            best, hits = lang, h
    own = language_code_py(label)
    if hits < 0.02 * n or not best:
        best = own if own in _SETS else best or "en"
    common = _SETS[best]
    solid = "".join(t.split())
    chars = len(solid)
    letters = sum(map(len, words))
    digits = len(_DIGIT.findall(solid))
    lines = [x.strip() for x in t.split("\n")]
    lines = [x for x in lines if x]
    punctuated = sum(x[-1] in _END for x in lines) / len(lines)
    flags = [w in common for w in words]
    c = sum(flags)
    gaps, run, longest = [], 0, 0
    for f in flags:
        if f:
            gaps.append(run)
            run = 0
        else:
            run += 1
    gaps.append(run)
    square = sum(g * g for g in gaps) / n  # mean length of the stretch a word stands in
    sentences = [x for x in _SENTENCE.split(t) if x and x.strip()]
    units = lines if len(lines) > len(sentences) else sentences
    lengths = [len(_WORD.findall(x)) for x in units] if best in UNSPACED else [len(x.split()) for x in units]
    # words in short units against all words: one short list in prose weighs little
    short = sum(k for k in lengths if k <= (8 if best in UNSPACED else 4)) / n
    raw = t.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1))
    return best, n, [
        math.log(n), letters / n, (chars - letters) / chars, digits / chars, punctuated, c / n, math.log1p(square),
        math.log(n / max(1, len(sentences))), math.log(len(distinct)) - 0.75 * math.log(n), math.log(packed / (len(raw) + 20)), (letters - digits) / chars, short,
    ]


#: Squared distance beyond which a document isn't prose: six for each of the twelve statistics.
LIMIT = 6.0 * len(STATS)
STEPS = 5
_KEEP = 2.2 * len(STATS)  # squared distance within which a document counts in a concentration step


def _stats(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [document_stats(t, x) for t, x in zip(b["_t"], b["_l"])]
            yield pd.DataFrame({"_d": b["_d"], "lang": [r[0] for r in rows], "words": np.array([r[1] for r in rows], dtype="int64"), "s": [r[2] for r in rows]})

    src = docs.select(F.col(doc_id).cast("string").alias("_d"), F.col(text).alias("_t"), F.col(lang).alias("_l"))
    return src.mapInPandas(run, "_d string, lang string, words bigint, s array<double>")


def _moments(stats: DataFrame, near) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products of the documents that ``near`` keeps, by language; one row per task and language."""
    p = len(STATS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.array(b["s"].tolist(), dtype=np.float64).reshape(-1, p)
            keep = near(b["lang"].to_numpy(), x) & (b["words"].to_numpy() > 0)
            for lang in np.unique(b["lang"].to_numpy().astype(str)[keep]) if keep.any() else []:
                y = x[keep & (b["lang"].to_numpy() == lang)]
                y = np.hstack([np.ones((len(y), 1)), y])
                sums[lang] = sums.get(lang, 0) + y.T @ y
        yield pd.DataFrame({"lang": list(sums), "m": [m.ravel() for m in sums.values()]})

    parts = stats.select("lang", "words", "s").mapInPandas(run, "lang string, m array<double>")
    size = (p + 1) ** 2
    total = parts.groupBy("lang").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(size))).alias("m")).collect()
    out = {}
    for r in total:
        m = np.array(r["m"]).reshape(p + 1, p + 1)
        out[r["lang"]] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


class Prose:
    """Mean and inverse covariance of prose by language, with pooled ones for languages not seen."""

    def __init__(self, moments: dict[str, tuple[float, np.ndarray, np.ndarray]]):
        floor = np.diag(np.square(FLOORS))
        n = sum(m[0] for m in moments.values())
        within = sum((m[2] - np.outer(m[1], m[1]) / m[0] for m in moments.values()), np.zeros((len(STATS),) * 2)) / max(n, 1)
        mean = sum((m[1] for m in moments.values()), np.zeros(len(STATS))) / max(n, 1)
        self.model = {"": (mean, np.linalg.inv(within + floor))}
        for lang, (k, s, q) in moments.items():
            mu = s / k
            own = q - np.outer(s, s) / k
            self.model[lang] = (mu, np.linalg.inv((own + 20 * within) / (k + 20) + floor))

    def contributions(self, langs: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(n, statistics): terms that add up to the squared distance of each row."""
        out = np.empty_like(x)
        for lang in set(langs.tolist()):
            mu, inverse = self.model.get(lang, self.model[""])
            at = langs == lang
            z = x[at] - mu
            out[at] = z * (z @ inverse)
        return out


def fit_prose(stats: DataFrame, steps: int = STEPS) -> Prose | None:
    """Robust mean and covariance of prose by language from all documents; None without any words."""
    # copies of a text have equal statistics and count once, so a hot group of copies cannot pass for prose
    some = cut(stats.where("words > 0").groupBy("lang", F.xxhash64("s").alias("_h")).agg(F.first("words").alias("words"), F.first("s").alias("s")))
    half = some.groupBy("lang").agg(*(F.percentile_approx(F.col("s")[i], 0.5, 2000).alias(f"m{i}") for i in range(len(STATS)))).collect()
    if not half:
        return None
    median = {r["lang"]: np.array([r[f"m{i}"] for i in range(len(STATS))]) for r in half}
    pairs = F.create_map(*(x for k, v in median.items() for x in (F.lit(k), F.array(*map(F.lit, v.tolist())))))
    off = some.withColumn("c", F.element_at(pairs, F.col("lang"))).groupBy("lang").agg(*(F.percentile_approx(F.abs(F.col("s")[i] - F.col("c")[i]), 0.5, 2000).alias(f"m{i}") for i in range(len(STATS)))).collect()
    scale = {r["lang"]: np.maximum(1.4826 * np.array([r[f"m{i}"] for i in range(len(STATS))]), FLOORS) for r in off}

    def start(langs: np.ndarray, x: np.ndarray) -> np.ndarray:
        d = np.empty(len(x))
        for lang in set(langs.tolist()):
            at = langs == lang
            d[at] = np.square((x[at] - median[lang]) / scale[lang]).clip(max=30).sum(axis=1)
        return d <= _KEEP

    moments = _moments(some, start)
    model = Prose(moments)
    for _ in range(steps):
        now, kept = model, {k: m[0] for k, m in moments.items()}

        def near(langs: np.ndarray, x: np.ndarray, now: Prose = now) -> np.ndarray:
            return now.contributions(langs, x).sum(axis=1) <= _KEEP

        moments = _moments(some, near)
        if not moments:
            break
        model = Prose(moments)
        if {k: m[0] for k, m in moments.items()} == kept:  # the same documents as before: converged
            break
    return model


def document_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: float = LIMIT, steps: int = STEPS) -> DataFrame:
    """Statistics, distance from prose, contributions and verdict of every document.

    Returns (doc_id, lang, words, one column per statistic, distance, contributions, is_prose): ``lang`` as used
    for the comparison, ``distance`` the squared Mahalanobis distance, ``contributions`` a map from each
    statistic to its part of it. Null and empty texts have zeros, a null distance and are not prose; null labels
    are allowed; repeated rows stay as many; an empty table gives an empty result. Texts are processed whole.
    """
    stats = cut(_stats(docs, doc_id, text, lang))
    model = fit_prose(stats, steps)
    kind = dict(docs.dtypes)[doc_id]
    schema = f"{doc_id} string, lang string, words bigint, {', '.join(f'{s} double' for s in STATS)}, distance double, contributions map<string,double>, is_prose boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["s"].tolist(), dtype=np.float64).reshape(-1, len(STATS))
            some = b["words"].to_numpy() > 0
            parts = model.contributions(b["lang"].to_numpy(), x) if model else np.zeros_like(x)
            d = parts.sum(axis=1)
            out = pd.DataFrame(x, columns=STATS)
            out.insert(0, doc_id, b["_d"].to_numpy())
            out.insert(1, "lang", b["lang"].to_numpy())
            out.insert(2, "words", b["words"].to_numpy())
            out["distance"] = np.where(some, d, np.nan)
            out["contributions"] = [dict(zip(STATS, row)) if s else None for row, s in zip(parts.tolist(), some)]
            out["is_prose"] = some & (d <= limit)
            yield out

    return stats.mapInPandas(run, schema).withColumn(doc_id, F.col(doc_id).cast(kind)).withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
