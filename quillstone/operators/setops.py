"""Set operations, provenance joins and accounting over parts of a corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import norm
from quillstone.operators.sampling import indexed, seeded


def within_length(df: DataFrame, text: str, most: int = 6000) -> DataFrame:
    """Rows whose text has at most ``most`` characters; null texts go."""
    return df.where(F.length(text) <= most)


def mixture(parts: Mapping[str, DataFrame], first: str, n_dev: int, order: Sequence[str], id_col: str, seed: int | str) -> DataFrame:
    """The union of named parts with ``part`` and ``position``: the first ``n_dev`` rows of one part in their order, then all others in seeded order.

    Columns are those of the first part by name; others must have them. Positions are 0-based and without gaps.
    """
    columns = parts[first].columns
    lead = indexed(parts[first], order, "_i")
    head = lead.where(F.col("_i") < n_dev).select(*columns, F.lit(first).alias("part"), F.lit(0).alias("_late"), F.lpad(F.col("_i").cast("string"), 20, "0").alias("_o"))
    tail = [lead.where(F.col("_i") >= n_dev).select(*columns, F.lit(first).alias("part"))] + [p.select(*columns, F.lit(k).alias("part")) for k, p in parts.items() if k != first]
    rest = reduce(DataFrame.unionByName, tail).withColumns({"_late": F.lit(1), "_o": seeded(seed, "part", id_col)})
    return indexed(head.unionByName(rest), ["_late", "_o", "part", id_col], "position").drop("_late", "_o")


def banned_texts(*tables: tuple[DataFrame, str]) -> DataFrame:
    """(banned): the distinct normalised texts of several (table, column) pairs; blank ones ban nothing."""
    each = [t.select(norm(F.col(c)).alias("banned")) for t, c in tables]
    return reduce(DataFrame.union, each).where("banned <> ''").distinct()


def common_values(df: DataFrame, value: str, by: str) -> DataFrame:
    """(value): what occurs with every value of ``by``; null values are none."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(value, by).distinct()
    n = rows.select(by).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("_k")).crossJoin(F.broadcast(n)).where("_k = _n").select(value)  # one row


def upstream_rows(df: DataFrame, upstream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that an upstream table has with equal keys, texts trimmed; a null key is never verified."""
    trimmed = lambda d: [F.trim(F.col(c)).alias(f"_u{i}") if dict(d.dtypes)[c] == "string" else F.col(c).alias(f"_u{i}") for i, c in enumerate(keys)]
    names = [f"_u{i}" for i in range(len(keys))]
    return df.select("*", *trimmed(df)).join(upstream.select(*trimmed(upstream)).distinct(), names, "left_semi").select(df.columns)


def lineage(df: DataFrame, upstream: DataFrame, id_col: str, text: str, label: str, redacted: str, native: Column, labels: Sequence[str]) -> DataFrame:
    """Adds ``kept`` and ``fault``: whether a derived row agrees with the upstream row of its id.

    Faults, the first that holds: ``unknown`` (no upstream row), ``redacted`` (a reconstruction id, or the text says so),
    ``label`` (none of ``labels`` or another than upstream), ``changed`` (a row in the upstream's language with another text).
    """
    base = upstream.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(label, text).alias("_label"), F.min(text).alias("_text"))
    j = df.join(base, F.col(id_col) == F.col("_id"), "left")
    fault = (
        F.when(F.col("_id").isNull(), "unknown").when(F.col(redacted).isNotNull() | F.coalesce(F.contains(text, F.lit("REDACTED")), F.lit(False)), "redacted")
        .when(F.col(text).isNull() | ~F.coalesce(F.col(label).isin(list(labels)) & (F.col(label) == F.col("_label")), F.lit(False)), "label")
        .when(native & (F.trim(text) != F.trim("_text")), "changed")
    )
    return j.withColumn("fault", fault).withColumn("kept", F.col("fault").isNull()).select(*df.columns, "kept", "fault")


def explicit_negatives(labels: Column, denied: Column, vocabulary: Sequence[str]) -> Column:
    """The labels of a vocabulary that a row explicitly denies and does not carry; empty where it says nothing."""
    known = F.array(*map(F.lit, vocabulary))
    return F.array_except(F.array_intersect(F.coalesce(denied, F.array().cast("array<string>")), known), F.coalesce(labels, F.array().cast("array<string>")))


def profile(df: DataFrame, run: str, op: str, seconds: str, categories: DataFrame, category: str = "category") -> DataFrame:
    """(category, runs, median, share): durations summed by category and run, then the median over runs; unknown operations are ``other``."""
    per = df.join(categories.select(F.col(op), F.col(category)), op, "left").groupBy(run, F.coalesce(category, F.lit("other")).alias(category)).agg(F.sum(seconds).alias("_s"))
    whole = per.groupBy(run).agg(F.sum("_s").alias("_all"))
    return per.join(whole, run).groupBy(category).agg(F.count(F.lit(1)).alias("runs"), F.median("_s").alias("median"), F.median(F.when(F.col("_all") > 0, F.col("_s") / F.col("_all"))).alias("share"))


def licence_table(df: DataFrame, source: str, licence: str, lang: str, kept: Column, most_langs: int = 5) -> DataFrame:
    """(source, licence, kept, languages): sources with kept rows; the languages in order, a count in place of those beyond ``most_langs``."""
    langs = F.sort_array(F.collect_set(lang))
    out = df.where(kept).groupBy(source, licence).agg(F.count(F.lit(1)).alias("kept"), langs.alias("_l"))
    more = F.when(F.size("_l") > most_langs, F.concat(F.lit(" + "), (F.size("_l") - most_langs).cast("string"))).otherwise(F.lit(""))
    return out.select(source, licence, "kept", F.concat(F.array_join(F.slice("_l", 1, most_langs), ", "), more).alias("languages"))


def glossary(df: DataFrame, terms: DataFrame, key: str, lang: str, fallback: str = "en", out: str = "term") -> DataFrame:
    """Adds the term of a key in a row's language, in the fallback language where there is none, else the key with blanks for underscores.

    ``terms`` has (key, lang, term).
    """
    own = terms.select(F.col(key), F.col(lang), F.col("term").alias("_own"))
    other = terms.where(F.col(lang) == fallback).select(F.col(key), F.col("term").alias("_other"))
    return df.join(own, [key, lang], "left").join(other, key, "left").withColumn(out, F.coalesce("_own", "_other", F.replace(F.col(key), F.lit("_"), F.lit(" ")))).select(*df.columns, out)


def paraphrases(df: DataFrame, table: DataFrame, keys: Sequence[str], seed: int | str, id_col: str, focus: str, out: str = "question") -> DataFrame:
    """Adds one of the paraphrases of a row's keys, drawn by seed and id, with ``{focus}`` filled; null where the table has none.

    ``table`` has the keys, ``slot`` and ``text``.
    """
    n = table.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "text"))), lambda s: s["text"]).alias("_texts"))  # configuration: a few per key
    pick = F.pmod(F.conv(F.substring(seeded(seed, id_col), 1, 8), 16, 10).cast("bigint"), F.greatest(F.size("_texts"), F.lit(1))).cast("int")
    return df.join(n, list(keys), "left").withColumn(out, F.replace(F.get("_texts", pick), F.lit("{focus}"), F.coalesce(F.col(focus), F.lit("")))).select(*df.columns, out)
