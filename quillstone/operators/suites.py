"""Evaluation suites as one parametrised operator: tables of labelled examples to items, pooled, sampled and recorded.

A suite says which columns hold the text, the label and the language, how labels read, and how many examples
of which pool are taken. Its items have the shape that :mod:`decide` answers and :mod:`evals` judges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.sampling import indexed, running, seeded

# Class names of public benchmark datasets, in the order of their numbers.
AG_NEWS = ["World", "Sports", "Business", "Sci/Tech"]
EMOTION = ["sadness", "joy", "love", "anger", "fear", "surprise"]
NLI = ["entailment", "neutral", "contradiction"]
SENTIMENT = ["negative", "neutral", "positive"]
SIB200 = ["science/technology", "travel", "politics", "sports", "health", "entertainment", "geography"]


@dataclass(frozen=True)
class Suite:
    """How the rows of a labelled table become items of one question.

    ``labels`` are the options in order (None: the distinct labels of the table, sorted); a whole-number label is a position in
    ``labels``. ``readings`` gives options another text, ``texts`` joins columns under headings, ``choices`` takes the options from an
    array column, and ``truth`` makes a yes/no item of the labels that count as yes. ``per_label`` draws evenly by label, ``skip`` leaves the
    first rows of the pool to other uses, ``n`` is how many items are drawn (None: all).
    """

    name: str
    instructions: str
    label: str
    texts: Mapping[str, str] = field(default_factory=lambda: {"text": ""})
    labels: Sequence[str] | None = None
    readings: Mapping[str, str] = field(default_factory=dict)
    choices: str | None = None
    truth: Sequence[str] | None = None
    lang: str | None = None
    n: int | None = None
    per_label: bool = False
    skip: int = 0
    seed: int = 0


def _state(s: Suite) -> Column:
    parts = [F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{head}: " if head else ""), F.trim(F.col(c)))) for c, head in s.texts.items()]
    every = parts[0].isNotNull()
    for p in parts[1:]:
        every = every & p.isNotNull()
    return F.when(every, F.concat_ws("\n", *parts))


def items(df: DataFrame, s: Suite, id_col: str) -> DataFrame:
    """(id, suite, lang, qtype, state, instructions, options, gold): rows with all their texts and a known label; gold is a position."""
    label = F.col(s.label)
    whole = dict(df.dtypes)[s.label] in ("int", "bigint", "smallint", "tinyint")
    lang = F.col(s.lang) if s.lang else F.lit("en")
    rows = df
    if s.truth is not None:
        options, qtype = F.array(F.lit("false"), F.lit("true")), "noul"
        names = F.get(F.array(*map(F.lit, s.labels or [])), label.cast("int")) if whole else label
        gold = F.when(names.isNotNull(), names.isin(list(s.truth)).cast("int"))
    elif s.choices:
        options, qtype = F.col(s.choices), "choice"
        gold = F.when(label.between(0, F.size(s.choices) - 1), label) if whole else F.nullif(F.array_position(s.choices, label), F.lit(0)) - 1
    else:
        qtype = "choice"
        if s.labels is None:
            vocabulary = df.where(label.isNotNull()).select(label.cast("string").alias("l")).distinct().agg(F.sort_array(F.collect_list("l")).alias("_names"))
            rows = df.crossJoin(F.broadcast(vocabulary))  # one row: the label set of a suite
            names = F.col("_names")
        else:
            names = F.array(*map(F.lit, s.labels))
        whole = whole and s.labels is not None
        gold = F.when(label.between(0, F.size(names) - 1), label) if whole else F.nullif(F.array_position(names, label.cast("string")), F.lit(0)) - 1
        reading = F.create_map(*(F.lit(x) for kv in s.readings.items() for x in kv)) if s.readings else None
        options = names if reading is None else F.transform(names, lambda x: F.coalesce(F.element_at(reading, x), x))
    out = rows.select(F.col(id_col), F.lit(s.name).alias("suite"), lang.alias("lang"), F.lit(qtype).alias("qtype"), _state(s).alias("state"), F.lit(s.instructions).alias("instructions"), options.alias("options"), gold.cast("int").alias("gold"))
    return out.where(F.col("state").isNotNull() & F.col("gold").isNotNull() & (F.size("options") >= 2))


def pooled(rows: DataFrame, s: Suite, id_col: str) -> DataFrame:
    """The items of the suite's pool: without the first ``skip`` by id, ``n`` in seeded order, of each language; evenly by label if asked."""
    if s.skip:
        rows = indexed(rows, ["lang", id_col], "_at")
        first = rows.groupBy(F.col("lang").alias("_l")).agg(F.min("_at").alias("_first"))
        rows = rows.join(first, rows["lang"].eqNullSafe(F.col("_l"))).where(F.col("_at") - F.col("_first") >= s.skip).drop("_at", "_l", "_first")
    if s.n is None:
        return rows
    by = ["lang", "gold"] if s.per_label else ["lang"]
    drawn = running(rows.withColumn("_h", seeded(s.seed, id_col)), by, "_h", id_col).where(F.col("_r") <= s.n)
    if s.per_label:  # in turn: the first ones of all labels, then the second ones; no label has more than n rows left
        turn = F.row_number().over(Window.partitionBy("lang").orderBy("_r", "_h", id_col))
        drawn = drawn.withColumn("_t", turn).where(F.col("_t") <= s.n).drop("_t")
    return drawn.drop("_h", "_r")


def suite(df: DataFrame, s: Suite, id_col: str) -> DataFrame:
    """The items of a suite over a table."""
    return pooled(items(df, s, id_col), s, id_col)


def metadata(rows: DataFrame, s: Suite, id_col: str) -> DataFrame:
    """(suite, lang, n, seed, skip, classes, gold_counts, pool): what a result says about its items; ``pool`` identifies them whatever their order."""
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), "state", F.col("gold").cast("string")), 256), i, 12), 16, 10).cast("decimal(20,0)"))
    each = rows.groupBy("suite", "lang", "gold").agg(F.count(F.lit(1)).alias("c"), part(1).alias("a"), part(13).alias("b"))
    pool = F.sha2(F.concat_ws("|", F.sum("a").cast("string"), F.sum("b").cast("string"), F.sum("c").cast("string")), 256)
    return each.groupBy("suite", "lang").agg(F.sum("c").alias("n"), F.lit(s.seed).alias("seed"), F.lit(s.skip).alias("skip"), F.count(F.lit(1)).alias("classes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("gold", "c")))).alias("gold_counts"), pool.alias("pool"))


def registry() -> dict[str, Suite]:
    """Suites over the columns of well-known public datasets; the datasets themselves are not part of this library."""
    both = {"premise": "Premise", "hypothesis": "Hypothesis"}
    kinds = [
        Suite("ag_news", "Which section does the news item belong to?", "label", labels=AG_NEWS, n=2000),
        Suite("emotion", "Which emotion does the writer express?", "label", labels=EMOTION, n=2000),
        Suite("banking77", "What does the customer want?", "label", n=2000),
        Suite("go_emotions", "Which emotion does the comment express?", "label", n=2000),
        Suite("hatecheck", "Is the text hateful?", "label", labels=["non-hateful", "hateful"], truth=["hateful"], lang="lang", n=500),
        Suite("sib200", "What is the sentence about?", "category", labels=SIB200, lang="lang", n=200),
        Suite("hwu64", "What does the user want?", "label", n=1000),
        Suite("nli", "How does the hypothesis relate to the premise?", "label", texts=both, labels=NLI, lang="lang", n=500),
        Suite("semrel", "Do the two sentences mean the same?", "label", texts={"a": "A", "b": "B"}, labels=["unrelated", "related"], truth=["related"], lang="lang", n=500),
        Suite("belebele", "Which answer is right?", "answer", texts={"passage": "Passage", "question": "Question"}, choices="options", lang="lang", n=300),
        Suite("massive", "What does the user want?", "intent", lang="lang", n=300),
        Suite("sentiment", "How does the writer feel about it?", "label", labels=SENTIMENT, lang="lang", n=300),
        Suite("categories", "Which category fits the text?", "gold", lang="lang", n=300, per_label=True),
        Suite("validation", "Which category fits the text?", "gold", lang="lang", skip=300, n=300),
        Suite("typed_decisions", "Which answer fits?", "gold", texts={"state": "State", "question": "Question"}, choices="options", lang="lang"),
    ]
    return {s.name: s for s in kinds}
