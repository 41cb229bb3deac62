"""Dataset rows to items: table functions that give none to several items per row.

An item is (state, qtype, instructions, options, target, src, lang). Each adapter builds an array of item
structs and explodes it, so an adapter is one projection; option order is a seeded hash order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import human, uniform
from quillstone.operators.policies import score_bin
from quillstone.operators.sampling import keyed, positions, same

ITEM = "struct<state:string,qtype:string,instructions:string,options:array<string>,target:array<double>,src:string,lang:string>"


def _item(state: Column, qtype: str, instructions: Column | str, options: Column, gold: Column, src: Column, lang: Column) -> Column:
    """An item whose target is 1 for the option ``gold`` names; null if none does or fewer than two options."""
    ins = F.lit(instructions) if isinstance(instructions, str) else instructions
    at = F.array_position(options, gold)
    target = F.transform(options, lambda _, i: (i + 1 == at).cast("double"))
    s = F.struct(state.alias("state"), F.lit(qtype).alias("qtype"), ins.alias("instructions"), options.alias("options"), target.alias("target"), src.alias("src"), lang.alias("lang"))
    return F.when((at > 0) & (F.size(options) >= 2) & (F.trim(state) != ""), s)


def shuffled(options: Column, *seed: Column) -> Column:
    """Options in the order of a seeded hash."""
    return F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.xxhash64(o, *seed).alias("h"), o.alias("o")))), lambda s: s["o"])


def choice(state: Column, instructions: Column | str, options: Column, gold: Column, src: Column, lang: Column) -> Column:
    return _item(state, "choice", instructions, shuffled(options, state), gold, src, lang)


def noul(state: Column, instructions: Column | str, truth: Column, src: Column, lang: Column) -> Column:
    return _item(state, "noul", instructions, F.array(F.lit("false"), F.lit("true")), F.when(truth, "true").when(~truth, "false"), src, lang)


def score(state: Column, instructions: Column | str, levels: Sequence[str], level: Column, src: Column, lang: Column) -> Column:
    arr = F.array(*map(F.lit, levels))
    return _item(state, "score", instructions, arr, F.get(arr, level.cast("int")), src, lang)


def items(df: DataFrame, *candidates: Column) -> DataFrame:
    """One row per candidate item that isn't null."""
    return df.select(F.inline(F.array_compact(F.array(*candidates))))


def _meta(src: str, lang: str) -> tuple[Column, Column]:
    return F.lit(src), F.col(lang) if lang else F.lit("en")


def classification(df: DataFrame, text: str, labels: Sequence[str], src: str, lang: str = "lang", k: int = 80, instructions: str = "Which {} fits the text?") -> DataFrame:
    """One choice per label column, over its ``k`` most frequent labels."""
    out = None
    s, code = _meta(src, lang)
    for c in labels:
        top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(k).agg(F.sort_array(F.collect_list(human(F.col(c)))).alias("_vocab"))  # at most k rows
        rows = items(df.crossJoin(F.broadcast(top)), choice(F.col(text), instructions.format(c), F.col("_vocab"), human(F.col(c)), s, code))
        out = rows if out is None else out.unionByName(rows)
    return out


def probe(labels: Column, vocabulary: Sequence[str], *seed: Column) -> Column:
    """(label, truth): a seeded half of the rows asks for a label that holds, the rest for one that doesn't."""
    vocab = F.array(*map(F.lit, vocabulary))
    other = F.array_except(vocab, labels)
    yes = uniform(*seed, F.lit("side")) < 0.5
    pick = lambda a: F.get(a, F.floor(uniform(*seed, F.lit("pick")) * F.size(a)).cast("int"))
    return F.when(yes & (F.size(labels) > 0), F.struct(pick(labels).alias("label"), F.lit(True).alias("truth"))).otherwise(F.struct(pick(other).alias("label"), F.lit(False).alias("truth")))


def emotion(df: DataFrame, text: str, labels: str, vocabulary: Sequence[str], src: str, lang: str = "lang") -> DataFrame:
    """A choice where one label holds, and a balanced yes/no probe."""
    s, code = _meta(src, lang)
    p = probe(F.col(labels), vocabulary, F.col(text))
    one = F.when(F.size(labels) == 1, choice(F.col(text), "Which emotion does the writer express?", F.array(*map(F.lit, vocabulary)), F.col(labels)[0], s, code))
    return items(df, one, noul(F.col(text), F.concat(F.lit("Does the writer express "), p["label"], F.lit("?")), p["truth"], s, code))


def nli(df: DataFrame, premise: str, hypothesis: str, label: str, src: str, lang: str = "lang") -> DataFrame:
    """A three-way choice and whether the premise entails the hypothesis."""
    s, code = _meta(src, lang)
    state = F.concat(F.lit("Premise: "), premise, F.lit("\nHypothesis: "), hypothesis)
    names = F.array(*map(F.lit, ("entailment", "neutral", "contradiction")))
    return items(df, choice(state, "How does the hypothesis relate to the premise?", names, F.col(label), s, code), noul(state, "Does the premise entail the hypothesis?", F.col(label) == "entailment", s, code))


def similarity(df: DataFrame, a: str, b: str, value: str, src: str, lang: str = "lang", levels: int = 5) -> DataFrame:
    """A value within 0 and 1 as a level; pairs at the ends also as yes/no."""
    s, code = _meta(src, lang)
    state = F.concat(F.lit("A: "), a, F.lit("\nB: "), b)
    names = [f"{i} of {levels - 1}" for i in range(levels)]
    sure = F.when(F.col(value) >= 0.8, True).when(F.col(value) <= 0.2, False)
    return items(df, score(state, "How similar are the two texts?", names, score_bin(F.col(value), levels), s, code), noul(state, "Do the two texts mean the same?", sure, s, code))


def safety(df: DataFrame, text: str, categories: str, vocabulary: Sequence[str], src: str, lang: str = "lang") -> DataFrame:
    """Whether a text is unsafe, and which category where there is one."""
    s, code = _meta(src, lang)
    one = F.when(F.size(categories) == 1, choice(F.col(text), "Which kind of harm does the text show?", F.array(*map(F.lit, vocabulary)), F.col(categories)[0], s, code))
    return items(df, one, noul(F.col(text), "Is the text unsafe?", F.size(categories) > 0, s, code))


def always(df: DataFrame, text: str, instructions: str, src: str, lang: str = "lang", truth: bool = True) -> DataFrame:
    s, code = _meta(src, lang)
    return items(df, noul(F.col(text), instructions, F.lit(truth), s, code))


def error_free(df: DataFrame, text: str, errors: str, src: str, lang: str = "lang") -> DataFrame:
    s, code = _meta(src, lang)
    return items(df, noul(F.col(text), "Is the text free of errors?", F.col(errors) == 0, s, code))


def scaled(df: DataFrame, text: str, value: str, lo: float, hi: float, instructions: str, levels: Sequence[str], src: str, lang: str = "lang") -> DataFrame:
    """A value within ``lo`` and ``hi`` as a level."""
    s, code = _meta(src, lang)
    return items(df, score(F.col(text), instructions, levels, score_bin((F.col(value) - lo) / (hi - lo), len(levels)), s, code))


def translations(df: DataFrame, translation: str, src: str) -> DataFrame:
    """One row per entry of a map from language to text: which language is it?"""
    rows = df.select(F.map_keys(translation).alias("_codes"), F.explode(translation).alias("_l", "_t"))
    return items(rows, choice(F.col("_t"), "Which language is the text written in?", F.col("_codes"), F.col("_l"), F.lit(src), F.col("_l")))


def reading(df: DataFrame, context: str, question: str, options: str, answer: str, src: str, lang: str = "lang") -> DataFrame:
    """A choice among options where there are some, else whether the context answers the question."""
    s, code = _meta(src, lang)
    with_options = F.size(F.coalesce(F.col(options), F.array().cast("array<string>"))) > 1
    pick = F.when(with_options, choice(F.col(context), F.col(question), F.col(options), F.col(answer), s, code))
    ask = F.when(~with_options, noul(F.col(context), F.concat(F.lit("Does the text answer: "), question), F.col(answer).isNotNull() & (F.trim(F.col(answer)) != ""), s, code))
    return items(df, pick, ask)


def paired_style(df: DataFrame, columns: Mapping[str, bool], instructions: str, src: str, lang: str = "lang") -> DataFrame:
    """One yes/no item per column; the column says the answer."""
    s, code = _meta(src, lang)
    return items(df, *(noul(F.col(c), instructions, F.lit(v), s, code) for c, v in columns.items()))


def typed(df: DataFrame, state: str, instructions: str, options: str, target: str, src: str, lang: str = "lang") -> DataFrame:
    """Soft targets to the choice of their greatest weight, the first of equals."""
    s, code = _meta(src, lang)
    best = F.get(F.col(options), F.array_position(target, F.array_max(target)).cast("int") - 1)
    return items(df, choice(F.col(state), F.col(instructions), F.col(options), best, s, code))


def mentions(df: DataFrame, dialogue: str, liked: str, src: str, lang: str = "lang") -> DataFrame:
    """Dialogue by entry of a map from thing to liked, not liked or null: one three-way item each."""
    rows = df.select(dialogue, *([lang] if lang else []), F.explode(liked).alias("_thing", "_v"))
    s, code = _meta(src, lang)
    names = F.array(*map(F.lit, ("liked", "not liked", "not said")))
    gold = F.when(F.col("_v"), "liked").when(~F.col("_v"), "not liked").otherwise("not said")
    return items(rows, choice(F.col(dialogue), F.concat(F.lit("What does the speaker think of "), "_thing", F.lit("?")), names, gold, s, code))


def facts(df: DataFrame, question: str, right: str, wrong: str, src: str, lang: str = "lang") -> DataFrame:
    """Two items: a right answer holds, a wrong one doesn't."""
    s, code = _meta(src, lang)
    state = lambda a: F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), a)
    return items(df, noul(state(F.col(right)), "Is the answer right?", F.lit(True), s, code), noul(state(F.col(wrong)), "Is the answer right?", F.lit(False), s, code))


def personal_data(df: DataFrame, text: str, kinds: str, vocabulary: Sequence[str], src: str, lang: str = "lang") -> DataFrame:
    """Whether a text has personal data, whether it has one kind, and which where there is one."""
    s, code = _meta(src, lang)
    p = probe(F.col(kinds), vocabulary, F.col(text))
    one = F.when(F.size(kinds) == 1, choice(F.col(text), "Which kind of personal data is in the text?", F.array(*map(F.lit, vocabulary)), F.col(kinds)[0], s, code))
    return items(df, noul(F.col(text), "Does the text contain personal data?", F.size(kinds) > 0, s, code), noul(F.col(text), F.concat(F.lit("Does the text contain a "), p["label"], F.lit("?")), p["truth"], s, code), one)


def utterances(df: DataFrame, turns: str, text: str = "text", label: str = "label") -> DataFrame:
    """One row per annotated turn of a conversation, with its position."""
    return df.withColumn("_x", F.explode(F.transform(turns, lambda t, i: F.struct(i.alias("turn"), t[text].alias("text"), t[label].alias("label"))))).select(*(c for c in df.columns if c != turns), "_x.*")


def conversation_state(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns joined on lines in their order; a conversation is one group by nature."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, role, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: F.concat(s[role], F.lit(": "), s[text])), "\n").alias("state"))


def neighbour_pairs(df: DataFrame, text: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, a, b): each text with the next one of its group."""
    rows = positions(df.select(*by, text, *(c for c in order if c not in (*by, text))), by, order, "_i").select(*by, F.col(text).alias("_t"), "_i")
    after = keyed(rows.select(*by, (F.col("_i") - 1).alias("_i"), F.col("_t").alias("b")), [*by, "_i"])
    return rows.join(after, same(rows, after, [*by, "_i"])).where("b is not null").select(*by, F.col("_t").alias("a"), "b")


def drop_constant(df: DataFrame, by: Sequence[str], share: float = 0.97, least: int = 20) -> DataFrame:
    """Yes/no items of a source are dropped if one answer has nearly all of at least ``least``."""
    yes = F.element_at("target", 2)
    flat = df.where("qtype = 'noul'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(yes).alias("m")).where((F.col("n") >= least) & (F.greatest(F.col("m"), 1 - F.col("m")) >= share))
    bad = flat.select(*by).withColumn("qtype", F.lit("noul"))
    return df.join(bad, [*by, "qtype"], "left_anti").select(df.columns)


# Kinds of claims and how they read; those that state a fact.
CLAIMS = {"fact": "fact", "opinion": "opinion", "both": "fact and opinion", "neither": "neither"}
FACTUAL = ["fact", "both"]


def claim_type(df: DataFrame, text: str, label: str, src: str, lang: str = "lang") -> DataFrame:
    """Which kind of claim a text makes, and whether it states a fact; rows with another label give nothing."""
    s, code = _meta(src, lang)
    kind = F.lower(F.trim(F.col(label)))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in CLAIMS.items() for x in kv)), kind)
    known = F.when(name.isNotNull(), F.col(text))
    return items(df, choice(known, "Which kind of claim does the text make?", F.array(*map(F.lit, CLAIMS.values())), name, s, code), noul(known, "Does the text state a fact that can be checked?", kind.isin(FACTUAL), s, code))


# Parts of a source's category and the task of its items, the first that fits.
TASKS = [
    ("5-spam", "spam"), ("5-toxicity-hate", "toxicity"), ("5-safety", "moderation"), ("5-toxicity-moderation", "moderation"), ("1-sentiment", "sentiment"), ("2-emotion", "emotion"),
    ("3-complaint", "complaint_category"), ("10-urgency", "urgency"), ("4-nli", "nli"), ("7-similarity", "similarity"), ("8-topic", "topic"), ("9-intent", "intent"),
    ("10-stance", "stance"), ("10-argument", "stance"), ("10-sarcasm", "sarcasm"), ("10-humor", "sarcasm"), ("10-formality", "formality"), ("10-fact-check", "fact_check"),
    ("10-claim", "fact_check"), ("10-pii", "pii"), ("10-language-id", "language_id"), ("6-reading", "reading"),
]
RELEVANCE = ["query", "passage", "product_title", "answer"]


def task_of(category: Column, fields: Column, source: Column, aspects: Sequence[str] = (), dialogues: Sequence[str] = ()) -> Column:
    """The task of a source by its category; fields and names refine sentiment, similarity and intent; null if none fits.

    ``aspects`` are sources about aspects, ``dialogues`` parts of the names of dialogue sources.
    """
    named = F.lower(F.array_join(fields, " "))
    has = lambda col, parts: col.rlike("|".join(parts)) if parts else F.lit(False)
    out = F.when(source.isin(list(aspects)), "aspect_sentiment").when(F.contains(category, F.lit("prompt-injection")), "prompt_injection")
    for part, task in TASKS:
        hit = F.contains(category, F.lit(part))
        if task == "sentiment":
            out = out.when(hit & F.contains(named, F.lit("aspect")), "aspect_sentiment")
        if task == "similarity":
            out = out.when(hit & has(named, RELEVANCE), "relevance")
        if task == "intent":
            out = out.when(hit & has(F.lower(source), dialogues), "dialogue_act")
        out = out.when(hit, task)
    return out


def registry() -> dict[str, Callable[..., DataFrame]]:
    """Adapters by the category of a source."""
    return {"classification": classification, "complaint": classification, "emotion": emotion, "nli": nli, "similarity": similarity, "safety": safety, "positive": always, "keigo": error_free, "empathic": scaled, "language": translations, "reading": reading, "paired_style": paired_style, "typed": typed, "redial": mentions, "fact": facts, "claim_type": claim_type, "pii": personal_data}

