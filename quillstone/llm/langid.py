"""Languages of documents and of their segments: averaged hashed subword embeddings with a linear softmax.

A segment is a sentence; of a JSON state, a sentence of one of its string values. Its embedding is the
mean of the embeddings of its hashed character n-grams, a linear layer and a softmax follow. Training
is stochastic gradient descent in numpy on a bounded sample of labelled rows (``rows_per_language``),
whose labels may be wrong: after a first fit, segments that the model gives to another language leave
the training set, and the second fit starts anew. Sentences are learnt together with their pieces, as short as a
segment may be, so that no single phrase decides. Confidence is calibrated on the pieces of held-out sentences, the hardest
segments there are: a temperature of least loss, and as rejection threshold the least confidence above which they
reach the accuracy asked for. Segments with too few letters are rejected, too.

Embedding and linear layer are one product, so scoring gathers and averages one row of logits per n-gram;
that table is what workers get, and its size is fixed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.languages import language_code, language_code_py
from quillstone.llm.looks import looks
from quillstone.llm.shingles import mix

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
ROWS_PER_LANGUAGE = 400
#: Steps of gradient descent, whatever the number of segments; the fit that only finds disputed labels takes half.
STEPS = 2500
#: Share of held-out pieces above the rejection threshold that must be right.
ACCURACY = 0.9995
#: A segment needs so many words with so many letters (or so many characters without spaces) to be a sentence.
LEAST_WORDS, LEAST_LETTERS, LEAST_UNSPACED = 4, 12, 6

_END = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+|(?<=[。！？])[」』”]*|\n+")
#: Sentence ends that need no white space behind them; found before the full-width ones become ASCII.
_WIDE_END = re.compile(r"[！？]+[」』”’）]*|(?<=[぀-ヿ㐀-鿿])(?:．+|[!?]+(?=[぀-ヿ㐀-鿿]))")
_CODE = re.compile(r"\S*\d\S*")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
#: Cyrillic capitals that look like Latin ones although their small letters don't.
_CAPITALS = str.maketrans("BHKMT", "внкмт")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f\u0400-\u04ff]+")
_QUOTED = re.compile(r"[«„“\"(「『][^«»„“”\"()「」『』]{1,24}[»“”\")」』]")


def strings(value) -> Iterator[str]:
    """The strings in a JSON value, never its keys."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)


def segments(state: str | None) -> list[str]:
    """The sentences of a state, in order; of a JSON object or array those of its string values."""
    if not state:
        return []
    visible = lambda x: looks(_WIDE_END.sub("\\g<0>\n", x))
    t = visible(state)
    texts = [t]
    if t.lstrip()[:1] in ("{", "["):
        try:
            texts = [visible(x) for x in strings(json.loads(t, strict=False))]  # what was escaped in JSON shows only now
        except (ValueError, RecursionError):
            pass
    return [s for x in texts for s in (y.strip() for y in _END.split(x)) if s]


def clean(segment: str) -> str:
    """What counts as language: lower-cased, without codes, quoted words and names; empty if that is no sentence.

    Names are taken to be capitalised words after the first of a sentence; German nouns go with them. Where most
    letters are capitals nothing tells names, and every word counts. Of two kinds of script, with and without
    spaces between words, the lesser one goes.
    """
    s = _QUOTED.sub(" ", segment)
    unspaced = _UNSPACED.findall(s)
    if unspaced and len(unspaced) * 3 >= sum(map(len, _LATIN.findall(s))):
        if len(unspaced) < LEAST_UNSPACED:
            return ""
        return f" {' '.join(_LETTERS.findall(_LATIN.sub(' ', s)))} "
    whole = _LETTERS.findall(_CODE.sub(" ", _UNSPACED.sub(" ", s) if unspaced else s))
    words = [w for i, w in enumerate(whole) if not i or not w[0].isupper()]
    if sum(map(len, words[1:])) * 2 < sum(map(len, whole)):  # else most letters are small
        t = "".join(whole)
        if sum(map(str.isupper, t)) > sum(map(str.islower, t)):
            russian = len(_CYRILLIC.findall(t)) * 4 >= len(t)
            words = [w.translate(_CAPITALS) for w in whole] if russian else whole
    if len(words) < LEAST_WORDS or sum(map(len, words)) < LEAST_LETTERS:
        return ""
    return f" {' '.join(words).lower()} "


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size (start, buckets): the hashed n-grams of text i begin at ``start[i]``."""
    texts = [t if len(t) >= max(GRAMS) else t.ljust(max(GRAMS)) for t in texts]
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(codes))  # characters from here to the end of the text
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            bucket = (mix(h[left[:m] >= n]) >> np.uint64(48)).astype(np.int64) % BUCKETS
            count = lens - n + 1
            yield np.cumsum(count) - count, bucket


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start, buckets) of all sizes together."""
    parts = list(windows(texts))
    sizes = [np.diff(np.append(s, len(b))) for s, b in parts]
    who = np.concatenate([np.repeat(np.arange(len(texts)), n) for n in sizes])
    total = sum(sizes)
    return np.cumsum(total) - total, np.concatenate([b for _, b in parts])[np.argsort(who, kind="stable")]


@dataclass
class LanguageModel:
    """Logits per bucket, languages, temperature and rejection threshold."""

    table: np.ndarray
    languages: list[str]
    temperature: float = 1.0
    threshold: float = 0.5

    def logits(self, texts: list[str]) -> np.ndarray:
        total, n = 0.0, 0
        for start, bucket in windows(texts):
            total = total + np.add.reduceat(self.table[bucket], start, axis=0)
            n = n + np.diff(np.append(start, len(bucket)))
        return total / n[:, None]

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of cleaned segments; the language is null where it is rejected."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        for c in range(0, len(some), 2000):
            part = some[c : c + 2000]
            p = _softmax(self.logits([texts[i] for i in part]) / self.temperature)
            best = p.argmax(axis=1)
            for i, b, q in zip(part, best.tolist(), p.max(axis=1).tolist()):
                out[i] = (self.languages[b] if q >= self.threshold else None, q)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sgd(texts: list[str], y: np.ndarray, k: int, seed: int, least_steps: int, batch: int = 64, rate: float = 50.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, k)).astype(np.float32)
    start, bucket = grams(texts)
    stop = np.append(start[1:], len(bucket))
    epochs = max(2, -(-least_steps // (len(texts) // batch + 1)))
    steps = epochs * (len(texts) // batch + 1)
    turn = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for c in range(0, len(texts), batch):
            part = order[c : c + batch]
            n = stop[part] - start[part]
            flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[part], n)
            g = bucket[flat]
            first = np.cumsum(n) - n
            mean = np.add.reduceat(e[g], first, axis=0) / n[:, None]
            d = _softmax(mean @ w)
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            step = rate * (1 - turn / steps)
            back = d @ w.T / n[:, None]
            w -= 0.05 * step * (mean.T @ d)
            by = np.argsort(g, kind="stable")  # one row per bucket of the batch, then one subtraction
            g, who = g[by], np.repeat(np.arange(len(part)), n)[by]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            e[g[first]] -= np.add.reduceat((step * back).astype(np.float32)[who], first, axis=0)
            turn += 1
    return e @ w


def pieces(cleaned: str) -> list[str]:
    """Consecutive parts of a cleaned segment, each as short as a segment may be."""
    words = cleaned.split()
    if _UNSPACED.search(cleaned):
        whole = "".join(words)
        return [f" {whole[i : i + LEAST_UNSPACED]} " for i in range(0, len(whole) - LEAST_UNSPACED + 1, LEAST_UNSPACED)]
    parts = (" ".join(words[i : i + LEAST_WORDS]) for i in range(0, len(words) - LEAST_WORDS + 1, LEAST_WORDS))
    return [f" {p} " for p in parts if len(p) - LEAST_WORDS + 1 >= LEAST_LETTERS]


def fit(rows: list[tuple[str, str]], accuracy: float = ACCURACY, seed: int = 5) -> LanguageModel | None:
    """A model from (state, language code) rows; None if there are no segments of two languages."""
    texts, names = [], []
    for state, code in rows:
        for s in segments(state):
            if c := clean(s):
                texts.append(c)
                names.append(code)
    languages = sorted(set(names))
    if len(languages) < 2:
        return None
    y = np.array([languages.index(n) for n in names])
    held = np.random.default_rng(seed).random(len(texts)) < 0.15
    if held.all() or not held.any():
        held[:] = False

    def parts(at: np.ndarray) -> tuple[list[str], np.ndarray]:
        found = [(p, y[i]) for i in np.flatnonzero(at) for p in pieces(texts[i])]
        return [p for p, _ in found], np.array([k for _, k in found], dtype=np.int64)

    def learn(at: np.ndarray, seed: int, steps: int) -> LanguageModel:
        short, which = parts(at)
        return LanguageModel(_sgd([texts[i] for i in np.flatnonzero(at)] + short, np.concatenate([y[at], which]), len(languages), seed, steps), languages)

    logits = lambda m, x: np.concatenate([m.logits(x[c : c + 2000]) for c in range(0, len(x), 2000)])
    model = learn(~held, seed, STEPS // 2)
    clear = logits(model, texts).argmax(axis=1) == y  # labels that the model doesn't dispute
    for k in range(len(languages)):  # a language that the model hardly knows yet keeps its labels
        if clear[y == k].mean() < 0.5:
            clear[y == k] = True
    train = ~held & clear
    if len(set(y[train].tolist())) == len(languages):
        model = learn(train, seed + 1, STEPS)
    test, want = parts(held & clear)
    if test:
        z = logits(model, test)
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(test)), want], 1e-12)).mean()
        # without a single error any low temperature would do; one counted error in twice as many pieces is the rule of succession
        smooth = lambda t: loss(t) + -np.log(np.maximum(1 - _softmax(z / t).max(axis=1), 1e-12)).mean() / (2 * len(test))
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=smooth))
        p = _softmax(z / model.temperature)
        conf, right = p.max(axis=1), p.argmax(axis=1) == want
        by = np.argsort(-conf)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= accuracy)
        model.threshold = float(conf[by][good[-1]]) if len(good) else 1.0
    return model


def train_language_model(df: DataFrame, id_col: str = "item_id", state: str = "state", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, least_rows: int = 5) -> LanguageModel | None:
    """A model fitted on ``rows_per_language`` labelled rows of each language, drawn by a hash of their id.

    Languages that fewer than ``least_rows`` labels name are left out.
    """
    named = df.select(F.col(id_col).alias("_id"), language_code(F.col(lang)).alias("_l")).where("_l is not null")
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id"))
    picked = named.withColumn("_n", rank).where(F.col("_n") <= rows_per_language).select("_id", "_l")
    rows = df.select(F.col(id_col).alias("_id"), F.col(state).alias("_s")).where("_s is not null").join(picked, "_id").orderBy(F.xxhash64("_id"), "_s").select("_s", "_l").collect()
    n: dict[str, int] = {}
    for r in rows:
        n[r["_l"]] = n.get(r["_l"], 0) + 1
    return fit([(r["_s"], r["_l"]) for r in rows if n[r["_l"]] >= least_rows])


def segment_languages(df: DataFrame, model: LanguageModel | None, id_col: str = "item_id", state: str = "state", lang: str = "lang") -> DataFrame:
    """(id, label, segment, text, lang, confidence): each sentence of each state with its language.

    ``label`` is the language that the row's label names, null if none; ``lang`` is null where the segment is
    rejected: no sentence, or a confidence below the threshold. Null and empty states have no segments;
    without a model every segment is rejected; repeated rows give repeated segments.
    """
    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).cast("string").alias("_id"), F.col(state).alias("_s"), F.col(lang).alias("_l")).where("_s is not null")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        code: dict = {}
        for whole in batches:
            for c in range(0, len(whole), 1000):
                b = whole.iloc[c : c + 1000]
                ids, labels, at, texts = [], [], [], []
                for i, s, x in zip(b["_id"], b["_s"], b["_l"]):
                    if x not in code:
                        code[x] = language_code_py(x)
                    for k, t in enumerate(segments(s)):
                        ids.append(i)
                        labels.append(code[x])
                        at.append(k)
                        texts.append(t)
                found = m.predict([clean(t) for t in texts]) if m else [(None, 0.0)] * len(texts)
                yield pd.DataFrame({id_col: ids, "label": labels, "segment": at, "text": texts, "lang": [f for f, _ in found], "confidence": [q for _, q in found]})

    out = src.mapInPandas(run, f"{id_col} string, label string, segment int, text string, lang string, confidence double")
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def document_languages(segs: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, label, lang, confidence, share, mixed): the language that most of a document is written in.

    ``share`` is its share of the accepted letters, ``confidence`` the mean of its segments, weighted by length;
    ``mixed`` says whether another language has a whole sentence. Documents without accepted segments have
    a null language and confidence 0.
    """
    weight = F.length("text")
    per = segs.groupBy(id_col, "label", "lang").agg(F.sum(weight).alias("n"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))
    some = F.col("lang").isNotNull()
    out = per.groupBy(id_col, "label").agg(
        F.max_by("lang", F.when(some, F.struct("n", "confidence", "lang"))).alias("lang"), F.max_by("confidence", F.when(some, F.struct("n", "confidence", "lang"))).alias("confidence"),
        F.max(F.when(some, F.col("n"))).alias("top"), F.sum(F.when(some, F.col("n"))).alias("all"), F.count_if(some).alias("k"),
    )
    return out.select(id_col, "label", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("top") / F.col("all"), F.lit(0.0)).alias("share"), (F.col("k") > 1).alias("mixed"))


def unnamed_languages(segs: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(id, lang), each once: languages of whole sentences that the row's label doesn't name."""
    return segs.where("lang is not null and (label is null or label <> lang)").select(id_col, "lang").distinct()
