"""Reports on labelled items: balance, repetition, vocabularies, acceptance, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.text import first_prefix, tokens
from quillstone.operators.paired import chi_square_p


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in an append-only log; one partial aggregation, ties fall to the greatest columns of ``order``."""
    whole = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def counts(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts by several sets of columns in one scan; columns outside a set are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("set_id"))


def acceptance(df: DataFrame, attributes: Sequence[str], accepted: Column, attempts: Column | None = None) -> DataFrame:
    """(attribute, value, attempts, accepted, rate) for each value of each attribute; null values are skipped."""
    stacked = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    rows = df.select(stacked.alias("s"), accepted.cast("long").alias("ok"), (attempts if attempts is not None else F.lit(1)).alias("t")).select("s.*", "ok", "t").where("value is not null")
    return rows.groupBy("attribute", "value").agg(F.sum("t").cast("bigint").alias("attempts"), F.sum("ok").alias("accepted"), (F.sum("ok") / F.sum("t")).alias("rate"))


def reasons(df: DataFrame, reason: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def acceptance_weight(rate: Column) -> Column:
    """How often to ask for an attribute again: the inverse of its rate, within 1 and 4; 4 for a rate of 0."""
    return F.when(rate <= 0, 4.0).otherwise(F.least(F.lit(4.0), F.greatest(F.lit(1.0), 1.0 / rate)))


def position_balance(df: DataFrame, by: Sequence[str], position: str, options: str) -> DataFrame:
    """Chi-square of gold positions against uniformity; null where fewer than five are expected per position."""
    rows = df.where(F.col(position).isNotNull() & (F.col(options) > 0))
    per = rows.groupBy(*by, options, position).agg(F.count(F.lit(1)).alias("c"))
    out = per.groupBy(*by, options).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    e = F.col("n") / F.col(options)
    stat = F.when(e >= 5, F.col("s2") / e - F.col("n"))
    return out.select(*by, options, "n", stat.alias("chi_square")).withColumn("p_value", chi_square_p(F.col(options) - 1, F.col("chi_square")))


def position_histogram(df: DataFrame, by: Sequence[str], position: str, options: str) -> DataFrame:
    """Gold positions as fractions of their number of options, in five bins."""
    b = F.least(F.lit(4), F.floor(F.col(position) * 5 / F.greatest(F.lit(1), F.col(options) - 1))).cast("int")
    return df.where(F.col(position).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distinct_n(df: DataFrame, by: Sequence[str], text: str, lang: Column, n: int) -> DataFrame:
    """Distinct n-grams of tokens over all of them."""
    t = tokens(F.col(text), lang)
    grams = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, F.lit(n)))))
    per = df.select(*by, F.explode(grams).alias("g")).groupBy(*by, "g").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("total"), (F.count(F.lit(1)) / F.sum("c")).alias("distinct_n"))


def top_prefix(df: DataFrame, by: Sequence[str], text: str, lang: Column) -> DataFrame:
    """The most common opening of three tokens and its share of all rows; ties fall to the least opening."""
    rows = df.select(*by, first_prefix(F.col(text), lang).alias("prefix"))
    per = rows.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("c"))
    total = per.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.when(F.col("prefix") != "", F.struct("c"))).alias("m"), F.min_by("prefix", F.when(F.col("prefix") != "", F.struct((-F.col("c")).alias("c"), "prefix"))).alias("prefix"))
    return total.select(*by, "n", "prefix", F.col("m.c").alias("count"), (F.col("m.c") / F.col("n")).alias("share"))


def key_reuse(df: DataFrame, keys: Column, k: int = 20) -> DataFrame:
    """The ``k`` option keys that most items use, and their share of the items."""
    rows = df.select(F.array_distinct(keys).alias("_k")).withColumn("_n", F.lit(1))
    n = rows.agg(F.count(F.lit(1)).alias("items"))
    top = rows.select(F.explode("_k").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(k)
    return top.crossJoin(F.broadcast(n)).select("key", "n", (F.col("n") / F.col("items")).alias("share"))  # one row


def label_sets(df: DataFrame, by: Sequence[str], keys: Column) -> DataFrame:
    """Per group: number of different option sets, and whether the labels are a closed set."""
    return df.groupBy(*by).agg(F.countDistinct(F.array_sort(keys)).alias("sets"), F.count(F.lit(1)).alias("n")).withColumn("closed", F.col("sets") == 1)


def constant_labels(df: DataFrame, by: Sequence[str], label: str, share: float = 0.9, least: int = 20) -> DataFrame:
    """Groups of at least ``least`` rows of which one label has at least ``share``."""
    per = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.struct("c", label)).alias("m"))
    return top.select(*by, "n", F.col(f"m.{label}").alias(label), (F.col("m.c") / F.col("n")).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))


def vocabulary(df: DataFrame, by: Sequence[str], label: str, k: int = 80) -> DataFrame:
    """The ``k`` most frequent labels per group, ties by label."""
    per = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), label))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)


def difficulty(df: DataFrame, by: Sequence[str], correct: Column, confidence: Column, sure: float = 0.9) -> DataFrame:
    """Shares of trivial rows (right and sure) and of those that are wrong and sure."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), (F.count_if(correct & (confidence >= sure)) / n).alias("trivial"), (F.count_if(~correct & (confidence >= sure)) / n).alias("confidently_wrong"))


def fingerprint(df: DataFrame, by: Sequence[str], row: Column) -> DataFrame:
    """A digest of a multiset of rows that does not depend on their order: sums of two parts of each row's SHA-256, and the count.

    Sums combine on the map side, so no group is ever collected.
    """
    rows = df.select(*by, F.sha2(row, 256).alias("_h"))
    part = lambda i: F.sum(F.conv(F.substring("_h", i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", part(1), part(13), F.count(F.lit(1)).cast("string")), 256).alias("fingerprint"))


def pairwise_similarity(df: DataFrame, by: Sequence[str], id_col: str, grams: str, pairs: int = 2000, seed: int = 0) -> DataFrame:
    """Mean Jaccard similarity of up to ``pairs`` seeded pairs per group: neighbours in a hashed order."""
    from quillstone.functions.text import jaccard
    from quillstone.operators.sampling import seeded

    w = Window.partitionBy(*by).orderBy("_h", id_col)
    rows = df.withColumn("_h", seeded(seed, id_col))
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pairs + 1)
    near = ranked.withColumn("_o", F.lag(grams).over(w)).where("_o is not null")
    return near.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(jaccard(F.col(grams), F.col("_o"))).alias("similarity"))
