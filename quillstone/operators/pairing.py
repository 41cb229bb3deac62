"""Joins by position and turn, batch packing, accounting and record assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.evals import macro_average
from quillstone.operators.sampling import positions


def consume_once(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Each left row takes the next unused right row of its key, in order; left rows without one keep nulls, and so do left rows with a null key."""
    turn = lambda df, order: positions(df, keys, order, "_turn").drop("_turn_of")
    return turn(left, left_order).join(turn(right, right_order), [*keys, "_turn"], "left").drop("_turn")


def half_offset_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """(by, a, b): each text with the one half a group further on, wrapping: pairs that are probably unrelated."""
    rows = positions(df.select(*by, text, *(c for c in order if c not in (*by, text))), by, order, "_i").select(*by, F.col(text).alias("_t"), "_i", F.col("_i_of").alias("_n"))
    other = rows.select(*by, F.col("_i").alias("_j"), F.col("_t").alias("b"))
    j = F.pmod(F.col("_i") + F.floor(F.col("_n") / 2), F.col("_n"))
    a = rows.where("_n > 1").select(*by, F.col("_t").alias("a"), j.alias("_j"))
    return a.join(other, [*by, "_j"]).drop("_j")


def foreign_contexts(df: DataFrame, group: str, question: str, context: str, order: Sequence[str]) -> DataFrame:
    """(question, context): each question with a context of the next group in order, hence not its own.

    Groups are numbered; a question of group k meets the first context of group k + 1, the last group wraps. One
    context per group is chosen by aggregation, so no pair is built that isn't used.
    """
    first = df.groupBy(group).agg(F.min_by(context, F.struct(*order)).alias("context"))
    rank = first.withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(group)))  # one row per group
    total = rank.agg(F.max("_k").alias("_n"))
    target = rank.crossJoin(F.broadcast(total)).where("_n > 1").select((F.when(F.col("_k") == 1, F.col("_n")).otherwise(F.col("_k") - 1)).alias("_k"), "context")  # one row
    mine = rank.select(group, "_k").join(target, "_k").select(group, F.col("context").alias("_context"))
    return df.join(mine, group).select(question, F.col("_context").alias("context"))


def pack(df: DataFrame, length: str, rows: int = 32, padded: int = 8192) -> DataFrame:
    """Adds ``batch``: rows sorted by length within each partition, cut at ``rows`` rows or ``padded`` padded tokens.

    Lengths fall into steps of an eighth of a power of two; a batch holds one step, so padding wastes little, and
    its row limit follows from the step.
    """
    step = F.ceil(F.log2(F.greatest(F.col(length), F.lit(1))) * 8)
    most = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(padded) / F.pow(F.lit(2.0), step / 8)))).cast("int")
    part = df.withColumns({"_step": step, "_part": F.spark_partition_id(), "_order": F.monotonically_increasing_id()})
    i = F.row_number().over(Window.partitionBy("_part", "_step").orderBy(length, "_order")) - 1
    batch = F.concat_ws("-", "_part", F.col("_step").cast("int"), F.floor(i / most))
    return part.withColumn("batch", batch).drop("_step", "_part", "_order")


def top_scored(df: DataFrame, by: Sequence[str], features: Mapping[str, float], name: str, k: int = 12) -> DataFrame:
    """The ``k`` rows of each group with the greatest linear score, ties by name; adds ``score``."""
    score = sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in features.items()), F.lit(0.0))
    rows = df.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), name))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def source_accounting(df: DataFrame, src: str, chosen: DataFrame, enabled: DataFrame, name: str = "source") -> DataFrame:
    """(class, source, n): rows of chosen sources, of other enabled ones and of unknown ones."""
    c = chosen.select(F.col(name).alias(src)).distinct().withColumn("_c", F.lit(True))
    e = enabled.select(F.col(name).alias(src)).distinct().withColumn("_e", F.lit(True))
    per = df.groupBy(src).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("_c"), "chosen").when(F.col("_e"), "other").otherwise("unknown")
    return per.join(c, src, "left").join(e, src, "left").select(kind.alias("class"), F.col(src).alias("source"), "n")


def has_category(categories: Column, *names: str) -> Column:
    """Whether a list of categories separated by semicolons names one of these."""
    parts = F.transform(F.split(F.lower(categories), ";"), lambda x: F.trim(x))
    return F.coalesce(F.arrays_overlap(parts, F.array(*(F.lit(n.lower()) for n in names))), F.lit(False))


def evaluation_records(cells: DataFrame, suites: DataFrame, metrics: Sequence[str], suite: str = "suite", lang: str = "lang") -> DataFrame:
    """Cell rows, a macro row per suite, and a row for each suite without cells, told apart by ``kind``."""
    macro = macro_average(cells, [lang], metrics, [suite]).select(suite, F.lit("macro").alias(lang), *metrics, F.lit("macro").alias("kind"))
    own = cells.select(suite, lang, *metrics, F.lit("cell").alias("kind"))
    missing = suites.select(suite).distinct().join(cells.select(suite).distinct(), suite, "left_anti")
    skipped = missing.select(suite, F.lit(None).cast("string").alias(lang), *(F.lit(None).cast("double").alias(m) for m in metrics), F.lit("skipped").alias("kind"))
    return own.unionByName(macro).unionByName(skipped)


def scraped_metrics(lines: DataFrame, text: str, patterns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """The greatest number that each pattern captures in log lines, per group."""
    aggs = [F.max(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.cast("double")))).alias(k) for k, p in patterns.items()]
    return lines.groupBy(*by).agg(*aggs)


def difference_interval(cells: DataFrame, z: float = 1.96, confidence: float = 0.95) -> DataFrame:
    """Adds ``lo`` and ``hi`` of a mean difference; without discordant pairs the width is the exact zero-event bound."""
    zero = F.lit(1.0) - F.pow(F.lit((1 - confidence) / 2), 1.0 / F.greatest(F.col("n"), F.lit(1)))
    half = F.sqrt(F.pow(z * F.col("se"), 2) + F.when(F.col("lost") + F.col("gained") == 0, F.pow(zero, 2)).otherwise(0.0))
    return cells.withColumn("lo", F.col("d") - half).withColumn("hi", F.col("d") + half)
