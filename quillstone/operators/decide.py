"""Typed decisions over DataFrames: validate, expand, lay out, score, decode, ensemble, calibrate, fuse, route.

A question set is small (at most 64 questions) and becomes a broadcast table; states are the data. Every
step but the layout of token arrays and JSON validation is a column expression, so that scoring a state
with all questions is one scan. A scorer is any object with ``logits(df) -> df`` that adds an array
column ``logits`` with one score per option to rows of ``state`` and ``options``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import probability as P
from quillstone.functions import text as X

TYPES = ("choice", "score", "noul")
#: Limits of a request: questions, code points of a text, options of a question, score levels, options in total, JSON depth.
LIMITS = {"questions": 64, "text": 50_000, "options": 100, "levels": 32, "total": 512, "depth": 64}
# Keywords of each question family, as whole words.
FAMILIES = {
    "sentiment": ["sentiment", "polarity"],
    "emotion": ["emotion", "emotions", "emotional", "feeling", "feelings", "mood"],
    "complaint": ["complaint", "complaints", "complain", "complaining"],
    "nli": ["nli", "entailment", "entail", "entails", "contradiction", "contradict", "contradicts"],
    "safety": ["safety", "unsafe", "toxic", "toxicity", "harmful", "moderation"],
    "reading": ["reading", "comprehension", "passage"],
    "similarity": ["similarity", "similar", "paraphrase", "paraphrases"],
    "topic": ["topic", "topics"],
    "intent": ["intent", "intents", "intention"],
    "stance": ["stance"],
    "formality": ["formality", "formal", "informal"],
    "urgency": ["urgency", "urgent"],
    "fact_check": ["fact", "facts", "factual", "claim", "claims"],
    "pii": ["pii", "personally"],
}
NO, YES = "no, the statement does not hold", "yes, the statement holds"
FILLS = ("", "N/A", "[MASK]")


class QuestionError(ValueError):
    """A question that cannot be asked; the message says why."""


def _py(v: Any) -> str:
    return v if isinstance(v, str) else str(v) if v is None or isinstance(v, (bool, int, float)) else json.dumps(v, ensure_ascii=False)


def _key(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


@dataclass
class Question:
    """One validated question with its rendered options."""

    id: str
    type: str
    instructions: str
    labels: list[str] = field(default_factory=list)
    options: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, qid: str, q: Any) -> Question:
        """Validate a definition; raises :class:`QuestionError`."""

        def fail(why: str) -> None:
            raise QuestionError(f"question {qid!r}: {why}")

        if not isinstance(q, Mapping):
            fail("must be an object")
        kind = {"yes_no": "noul"}.get(q.get("type"), q.get("type")) if isinstance(q.get("type"), str) else None
        if kind not in TYPES:
            fail(f"type must be one of {', '.join(TYPES)} or yes_no")
        if "instructions" not in q:
            fail("has no instructions")
        crit, labels, options = q.get("criteria"), [], []
        if "labels" in q and kind != "noul":
            fail("labels go with noul questions only")
        if kind == "choice":
            if not isinstance(crit, (Mapping, list)):
                fail("criteria must map labels to descriptions or list labels")
            if not crit:
                fail("needs a label")
            if isinstance(crit, list):
                if any(isinstance(c, (Mapping, list)) for c in crit):
                    fail("labels must be scalars")
                for c in crit:
                    if not any(c == x and type(c) is type(x) for x in labels):
                        labels.append(c)
                options = [_py(c) for c in labels]
            else:
                labels = list(crit)
                options = [k if v is None or v == "" else f"{k}: {_py(v)}" for k, v in crit.items()]
        elif kind == "score":
            if not isinstance(crit, list) or not crit:
                fail("criteria must list levels, the lowest first")
            if any(c is None for c in crit):
                fail("every level needs a description")
            labels = [str(i) for i in range(len(crit))]
            options = [f"level {i}: {_py(c)}" for i, c in enumerate(crit)]
        else:
            if crit is not None and not isinstance(crit, Mapping):
                fail("criteria must map true and false to descriptions")
            given = {str(k).lower(): v for k, v in (crit or {}).items()}
            if given.keys() - {"true", "false"}:
                fail("criteria know true and false only")
            names = {"false": "false", "true": "true"}
            if "labels" in q:
                own = q["labels"]
                if not isinstance(own, Mapping) or set(own) != set(names) or not all(isinstance(v, str) and v.strip() for v in own.values()) or own["true"].strip() == own["false"].strip():
                    fail("labels must name true and false by different texts")
                names = {k: own[k].strip() for k in names}
            labels = [names["false"], names["true"]]
            options = [f"{names['false']}: {_py(given['false']) if given.get('false') else NO}", f"{names['true']}: {_py(given['true']) if given.get('true') else YES}"]
        return cls(qid, kind, _py(q["instructions"]), [_key(x) for x in labels], options)


def parse_questions(questions: Mapping[str, Any]) -> list[Question]:
    """An ordered set of questions within the limits."""
    if not isinstance(questions, Mapping) or not questions:
        raise QuestionError("questions must be an object with a question")
    out = [Question.parse(k, v) for k, v in questions.items()]
    if len(out) > LIMITS["questions"]:
        raise QuestionError(f"more than {LIMITS['questions']} questions")
    for q in out:
        if len(q.options) > LIMITS["levels" if q.type == "score" else "options"] or len(q.instructions) > LIMITS["text"]:
            raise QuestionError(f"question {q.id!r}: too large")
    if sum(len(q.options) for q in out) > LIMITS["total"]:
        raise QuestionError(f"more than {LIMITS['total']} options")
    return out


SCHEMA = "qpos int, qid string, qtype string, instructions string, labels array<string>, options array<string>"


def question_frame(spark: SparkSession, questions: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame([(i, q.id, q.type, q.instructions, q.labels, q.options) for i, q in enumerate(parse_questions(questions))], SCHEMA)


def expand(states: DataFrame, questions: DataFrame) -> DataFrame:
    """Every state with every question; the question table has at most 64 rows and is broadcast."""
    return states.crossJoin(F.broadcast(questions))


def words(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)))


def word_hashes(col: Column) -> Column:
    """Hashes of the distinct words of a text: cheaper to keep and to intersect."""
    return F.transform(words(col), lambda w: F.xxhash64(w))


class Scorer(Protocol):
    def logits(self, df: DataFrame) -> DataFrame: ...


class LexicalScorer:
    """The number of distinct words of each option that the state has; deterministic and model-free."""

    def prepare(self, states: DataFrame) -> DataFrame:
        """The words of each state, once per state and not once per question."""
        return states.withColumn("_have", word_hashes(F.col("state")))

    def prepare_questions(self, questions: DataFrame) -> DataFrame:
        """The words of each option, once per question and not once per state."""
        return questions.withColumn("_words", F.transform("options", word_hashes))

    def logits(self, df: DataFrame) -> DataFrame:
        have = df if "_have" in df.columns else self.prepare(df)
        both = have if "_words" in df.columns else self.prepare_questions(have)
        one = lambda w: F.size(F.array_intersect(w, F.col("_have"))).cast("double")
        return both.withColumn("logits", F.transform("_words", one)).drop("_have", "_words")


def score(states: DataFrame, questions: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Every state with every question and its ``logits``."""
    scorer = scorer or LexicalScorer()
    ready = lambda name, df: getattr(scorer, name)(df) if hasattr(scorer, name) else df
    return scorer.logits(expand(ready("prepare", states), ready("prepare_questions", questions)))


class FunctionScorer:
    """A Python function over Arrow batches: ``f(states, options) -> list of score lists``."""

    def __init__(self, f):
        self.f = f

    def logits(self, df: DataFrame) -> DataFrame:
        f = self.f

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                scores = f(b["state"].tolist(), [list(o) for o in b["options"]])
                yield b.assign(logits=[[float(x) for x in row] for row in scores])

        # an operator of its own, not an expression that optimizer rules could copy into others
        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))]))


def layout(head: Column, options: Column, state: Column, max_len: int, head_max_len: int, keep_tail: Column, cls: str | int = "[CLS]", sep: str | int = "[SEP]", mask: str | int = "[MASK]") -> tuple[Column, Column, Column]:
    """(tokens, markers, fits) of ``[CLS] head [SEP] ([MASK] option)* [SEP] state [SEP]`` from token arrays.

    Options have at most 48 tokens. Where they leave the head fewer than 16 of ``head_max_len``, each is cut to
    an equal share of at least 4; the head keeps the rest, 8 at least. A state that is too long loses its
    end, an array state its beginning. ``fits`` is false where a marker falls beyond ``max_len``.
    """
    lits = lambda *x: F.array(*(F.lit(v) for v in x))
    cut = lambda a, n: F.slice(a, F.lit(1), F.greatest(F.lit(0), n).cast("int"))
    opts = F.transform(options, lambda o: F.concat(lits(mask), cut(o, F.lit(48))))
    sizes = lambda a: F.aggregate(a, F.lit(0), lambda s, o: s + F.size(o))
    tight = F.lit(head_max_len) - sizes(opts) < 16
    share = F.greatest(F.lit(4), F.floor(F.lit(head_max_len - 16) / F.greatest(F.lit(1), F.size(opts))).cast("int"))
    opts = F.when(tight, F.transform(opts, lambda o: cut(o, share))).otherwise(opts)
    kept = cut(head, F.greatest(F.lit(8), F.lit(head_max_len) - sizes(opts)))
    front = F.concat(lits(cls), kept, lits(sep), F.flatten(opts), lits(sep))
    room = F.greatest(F.lit(0), F.lit(max_len) - F.size(front) - 1)
    n = F.least(F.size(state), room)
    part = F.when(n == 0, F.slice(state, 1, 0)).when(keep_tail, F.slice(state, F.size(state) - n + 1, n)).otherwise(cut(state, n))
    tokens = cut(F.concat(front, part, lits(sep)), F.lit(max_len))
    start = F.size(kept) + 2
    markers = F.transform(opts, lambda _, i: start + sizes(F.slice(opts, F.lit(1), i)))
    return tokens, markers, F.forall(markers, lambda m: m < max_len)


def encoded(states: DataFrame, questions: DataFrame, load: Any, cls: int, sep: int, mask: int, key: str = "state_id", max_len: int = 1024, head_max_len: int = 256) -> DataFrame:
    """(key, qid, tokens, markers, fits): every state with every question as token ids, ready for an encoder.

    ``load`` gives a :class:`quillstone.functions.tokens.Tokenizer`; states and questions are tokenized once each, before they meet.
    """
    from quillstone.functions.tokens import token_ids

    q = questions.select("qpos", "qid", token_ids(F.concat("qtype", F.lit(" question: "), "instructions"), load).alias("_head"), "options")
    opts = q.select("qpos", F.posexplode("options").alias("i", "o")).select("qpos", "i", token_ids(F.col("o"), load).alias("t"))
    opts = opts.groupBy("qpos").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("_options"))  # the options of a question
    q = q.drop("options").join(opts, "qpos")
    rows = expand(states.where(F.col("state").isNotNull()).select(key, token_ids(F.col("state"), load).alias("_state")), q)
    tokens, markers, fits = layout(F.col("_head"), F.col("_options"), F.col("_state"), max_len, head_max_len, F.lit(False), cls, sep, mask)
    return rows.select(key, "qid", tokens.alias("tokens"), markers.alias("markers"), fits.alias("fits"))


def temperatures(df: DataFrame, by_type: Mapping[str, float] | None = None, by_bucket: Mapping[str, float] | None = None, by_lang: Mapping[str, Mapping[str, float]] | None = None, lang: Column | None = None) -> DataFrame:
    """Adds ``temperature``: of the language's bucket, the language's type, the bucket, the type, else 1."""
    bucket = P.temperature_bucket(F.col("qtype"), F.size("options"))
    options: list[Column] = []
    if by_lang and lang is not None:
        code = F.lower(F.substring_index(lang, "-", 1))
        for per in (bucket, F.col("qtype")):
            pairs = [x for l, m in by_lang.items() for k, v in m.items() for x in (F.lit(f"{l} {k}"), F.lit(float(v)))]
            options.append(F.element_at(F.create_map(*pairs), F.concat(code, F.lit(" "), per)))
    for table, per in ((by_bucket, bucket), (by_type, F.col("qtype"))):
        if table:
            options.append(F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(float(v))))), per))
    return df.withColumn("temperature", P.clamp_temperature(F.coalesce(*options, F.lit(1.0))))


def decode(df: DataFrame) -> DataFrame:
    """Adds ``answer`` to rows with logits and temperature: probabilities by label, decision and confidences.

    Choice: the most probable label, first of equals; score: the mean level; noul: the probability of true.
    Values are rounded to four decimals, halves to even.
    """

    def answer(p: Column) -> Column:
        second = F.get(p, F.lit(1))
        top = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max(p)))
        own = F.when(F.col("qtype") == "noul", F.greatest(second, 1 - second)).otherwise(P.confidence(p))
        return F.struct(
            F.col("qtype").alias("type"),
            F.when(F.col("qtype") == "choice", F.get("labels", P.argmax(p))).alias("choice"),
            F.when(F.col("qtype") == "score", P.round4(P.expectation(p))).alias("score"),
            F.when(F.col("qtype") == "noul", P.round4(second)).alias("noul"),
            F.map_from_arrays("labels", F.transform(p, P.round4)).alias("probabilities"),
            P.round4(own).alias("confidence"),
            P.round4(top).alias("answer_confidence"),
        )

    probabilities = P.softmax(F.col("logits"), F.col("temperature"))
    return df.withColumn("answer", P.let(probabilities, answer))


def views(df: DataFrame, ensemble: int, margin: float = 1.0) -> DataFrame:
    """Extra cyclic option orders for close choice questions: rows with ``view``, ``shift`` and rotated ``options``.

    ``df`` has base ``logits``; a choice with k options and a top margin below ``margin`` gets
    min(ensemble, k) - 1 views, each shifted by view * k / min(ensemble, k).
    """
    k = F.size("options")
    n = F.least(F.lit(ensemble), k)
    close = (F.col("qtype") == "choice") & (k >= 2) & (P.margin(P.softmax(F.col("logits"))) < margin)
    rows = df.where(close & (n > 1)).withColumn("view", F.explode(F.sequence(F.lit(1), n - 1)))
    rows = rows.withColumn("shift", F.floor(F.col("view") * k / n).cast("int"))
    return rows.withColumn("options", P.rotation(F.col("options"), F.col("shift"))).drop("logits")


def ensemble(df: DataFrame, scorer: Scorer, keys: Sequence[str], n: int, margin: float = 1.0) -> DataFrame:
    """Mean log-softmax over the base and all extra views, mapped back to label order; other rows keep their logits."""
    more = scorer.logits(views(df, n, margin))
    more = more.withColumn("z", P.rotation(P.log_softmax(F.col("logits")), F.size("logits") - F.col("shift")))
    sums = more.select(*keys, F.posexplode("z").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    z = sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_z"), F.first("n").alias("_n"))
    joined = df.join(z, list(keys), "left")
    mean = F.zip_with(P.log_softmax(F.col("logits")), F.col("_z"), lambda a, b: (a + b) / (F.col("_n") + 1))
    return joined.withColumn("logits", F.when(F.col("_z").isNotNull(), mean).otherwise(F.col("logits"))).drop("_z", "_n")


def calibrate(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Subtracts from the logits of choice questions the log mean probability of content-free states.

    A content-free state has every string replaced by an empty text, N/A or the mask; each (question, shape) is
    scored once and joined back.
    """
    shape = X.content_free(F.col("state"), F.lit(""))
    rows = df.withColumn("_shape", shape)
    distinct = rows.where((F.col("qtype") == "choice") & (F.size("options") >= 2)).groupBy("qpos", "_shape").agg(F.first("options").alias("options"))
    fills = distinct.withColumn("_fill", F.explode(F.array(*map(F.lit, FILLS))))
    fills = fills.withColumn("state", F.when(F.col("_shape") == "", F.col("_fill")).otherwise(F.replace(F.col("_shape"), F.lit('""'), F.concat(F.lit('"'), F.col("_fill"), F.lit('"')))))
    p = scorer.logits(fills).select("qpos", "_shape", F.posexplode(P.softmax(F.col("logits"))).alias("pos", "p"))
    mean = p.groupBy("qpos", "_shape", "pos").agg(F.avg("p").alias("p")).groupBy("qpos", "_shape").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: F.ln(F.greatest(s["p"], F.lit(1e-12)))).alias("_null"))
    out = rows.join(mean, ["qpos", "_shape"], "left")
    return out.withColumn("logits", F.when(F.col("_null").isNull(), F.col("logits")).otherwise(F.zip_with("logits", "_null", lambda a, b: a - b))).drop("_shape", "_null")


def decide(states: DataFrame, questions: DataFrame, scorer: Scorer | None = None, key: str = "state_id", n: int = 1, margin: float = 1.0, calibrated: bool = False, min_confidence: float = 0.0, **temps: Any) -> DataFrame:
    """One row per state and question with ``logits``, ``answer`` and ``escalate``.

    ``states`` has ``key`` and ``state``; null states have no answers.
    """
    scorer = scorer or LexicalScorer()
    rows = score(states.where(F.col("state").isNotNull()), questions, scorer)
    if n > 1:
        rows = ensemble(rows, scorer, [key, "qpos"], n, margin)
    if calibrated:
        rows = calibrate(rows, scorer)
    return escalate(decode(temperatures(rows, **temps)), min_confidence)


def escalate(df: DataFrame, min_confidence: float) -> DataFrame:
    """Adds ``escalate``: the answer's confidence is below the threshold; null without a threshold."""
    return df.withColumn("escalate", F.col("answer.answer_confidence") < min_confidence if min_confidence > 0 else F.lit(None).cast("boolean"))


def gather(rows: DataFrame, key: str = "state_id") -> DataFrame:
    """One row per state: a map from question id to answer, in the order of the questions (at most 64 of them)."""
    by_position = lambda a, b: a["qpos"] - b["qpos"]
    entries = F.transform(F.array_sort(F.collect_list(F.struct("qpos", "qid", "answer")), by_position), lambda s: F.struct(s["qid"], s["answer"]))
    return rows.groupBy(key).agg(F.map_from_entries(entries).alias("answers"), F.max("escalate").alias("escalate"))


def fuse(runs: Sequence[DataFrame], weights: Sequence[float], keys: Sequence[str] = ("state_id", "qpos")) -> DataFrame:
    """Consensus of several scored runs: weighted sums of log-softmax, decoded at temperature 1."""
    if len(runs) != len(weights) or not runs:
        raise ValueError("one weight per run")
    weighted = lambda w: F.transform(P.log_softmax(F.col("logits")), lambda x: x * w)
    parts = [r.select(*keys, weighted(w).alias(f"_z{i}")) for i, (r, w) in enumerate(zip(runs, weights))]
    joined = reduce(lambda a, b: a.join(b, list(keys)), parts)
    z = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(f"_z{i}") for i in range(len(parts))])
    base = runs[0].drop("logits", "answer", "temperature", "escalate")
    return decode(base.join(joined.select(*keys, z.alias("logits")), list(keys)).withColumn("temperature", F.lit(1.0)))


def families_in(col: Column) -> Column:
    """Families with a keyword among the ASCII words of a text."""
    def hits(have: Column) -> Column:
        return F.array_compact(F.array(*(F.when(F.arrays_overlap(have, F.array(*map(F.lit, ks))), F.lit(f)) for f, ks in FAMILIES.items())))

    return P.let(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0)), hits)


def question_family(qid: Column, instructions: Column) -> Column:
    """The one family named by the id or, if that names none, by the instructions; null if several or none."""
    by_id, by_text = families_in(qid), families_in(instructions)
    hits = F.when(F.size(by_id) > 0, by_id).otherwise(by_text)
    return P.let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))))


def request_family(df: DataFrame, keys: Sequence[str], family: Column) -> DataFrame:
    """The family that all questions of a request share, else null."""
    return df.groupBy(*keys).agg(F.when((F.count_if(family.isNull()) == 0) & (F.min(family) == F.max(family)), F.min(family)).alias("family"))


def route_adapter(requests: DataFrame, adapters: DataFrame) -> DataFrame:
    """Adds ``adapter``: the first (by ``position``) whose ``categories`` contain the request's family."""
    a = adapters.select("adapter", "position", F.explode("categories").alias("family"))
    first = a.groupBy("family").agg(F.min_by("adapter", "position").alias("adapter"))
    return requests.join(F.broadcast(first), "family", "left")  # one row per family: FAMILIES bounds it
