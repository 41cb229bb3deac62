"""Visually identical text with different characters.

Look-alike-mapped values are grouped under the accent-sensitive collation UNICODE. Of each class the least member in
code point order is canonical; it is joined back, and :func:`consistent` puts it out for all members. All of this is SQL.

Comparing whole texts under a collation is dear, so it is confined to rows that can have a partner: a first pass
hashes the mapped text without accents, which is the same for whatever the collation may find equal, and the raw
characters; only spellings whose hash has another spelling reach the collation, which then decides. Sorting goes by
that hash first, so that the collator compares within it only. Copies are one spelling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillstone.llm.looks import looks, sql_bare, sql_looks
from quillstone.session import cut, small

_CELL, _ITEM = "\ue000", "\ue001"  # private-use characters: unlike controls, no collation ignores them


def options_text(options: Column) -> Column:
    """Keys and descriptions in order as one text; a null description equals an empty one."""
    one = lambda o: F.concat(F.coalesce(o["key"], F.lit("")), F.lit(_CELL), F.coalesce(o["description"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(options, one), _ITEM), F.lit(""))


def _raw(s: Column, o: Column) -> dict[str, Column]:
    """Two hashes of the raw characters."""
    return {"_r1": F.xxhash64(s, o), "_r2": F.xxhash64(F.lit(1), s, o)}


def _mapped(s: Column, o: Column) -> Column:
    return F.concat(sql_looks(s), F.lit(_ITEM + _CELL), sql_looks(o))


def _members(df: DataFrame, id_col: str, state: str, options: str) -> DataFrame:
    """(_id, _r1, _r2, _first, class_id, _rep): rows that look like another spelling, whether theirs is the canonical one, and the least id with that; materialised."""
    rows = df.where(F.col(state).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(state).alias("_s"), options_text(F.col(options)).alias("_o"))
    both = F.col("_s"), F.col("_o")
    keyed = cut(rows.select("_id", F.xxhash64(sql_bare(_mapped(*both))).alias("_b"), *(c.alias(k) for k, c in _raw(*both).items())))
    raw = F.struct("_r1", "_r2")
    mixed = keyed.groupBy("_b").agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).where("lo < hi").select("_b")
    chosen = cut(keyed.join(mixed, "_b", "left_semi"))
    one = cut(chosen.groupBy("_r1", "_r2").agg(F.min("_id").alias("_id")).select("_id").distinct())
    # texts again, one row per spelling
    forms = rows.join(small(one), "_id", "left_semi").withColumns(_raw(*both)).groupBy("_r1", "_r2").agg(F.first("_s").alias("_s"), F.first("_o").alias("_o"))
    mapped = _mapped(*both)
    forms = cut(forms.select("_r1", "_r2", "_s", "_o", F.xxhash64(sql_bare(mapped)).alias("_b"), mapped.alias("_m")))
    looked = forms.withColumn("_look", F.collate("_m", "UNICODE"))
    classes = looked.groupBy("_b", "_look").agg(F.min(F.struct("_s", "_o", "_r1", "_r2")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    canonical = F.sha2(F.concat(F.col("c._s"), F.lit(_ITEM + _CELL), F.col("c._o")), 256)
    named = looked.join(classes, ["_b", "_look"]).select("_r1", "_r2", ((F.col("_r1") == F.col("c._r1")) & (F.col("_r2") == F.col("c._r2"))).alias("_first"), canonical.alias("class_id"))
    members = cut(chosen.join(named, ["_r1", "_r2"]).select("_id", "_r1", "_r2", "_first", "class_id"))
    reps = members.where("_first").groupBy("class_id").agg(F.min("_id").alias("_rep"))
    return cut(members.join(reps, "class_id"))


def look_classes(df: DataFrame, id_col: str = "item_id", state: str = "state", options: str = "options") -> DataFrame:
    """Rows that look like another row but differ from it in characters.

    Returns (id, raw, class_id): rows with one ``class_id`` look the same; ``raw`` tells their distinct
    spellings apart, and every class has at least two; ``class_id`` is the SHA-256 of the canonical one. Rows with a null id or state take no part; null options
    count as none; repeated rows stay one row per id. An empty table gives an empty result.
    """
    m = _members(df, id_col, state, options)
    return m.select(F.col("_id").alias(id_col), F.concat_ws(" ", "_r1", "_r2").alias("raw"), "class_id")


def look_summary(df: DataFrame, id_col: str = "item_id", state: str = "state", options: str = "options") -> DataFrame:
    """(class_id, canonical id, spellings, records), one row per class of :func:`look_classes`; no pairs are built."""
    m = _members(df, id_col, state, options).distinct()
    per = m.groupBy("class_id", "_rep", "_r1", "_r2").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("class_id", F.col("_rep").alias(id_col)).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records"))


def look_pairs(df: DataFrame, id_col: str = "item_id", state: str = "state", options: str = "options") -> DataFrame:
    """Pairs (a < b) of rows that look the same and differ in characters, each once."""
    c = look_classes(df, id_col, state, options).distinct()
    a = c.select(F.col(id_col).alias(f"{id_col}_a"), F.col("raw").alias("ra"), "class_id")
    b = c.select(F.col(id_col).alias(f"{id_col}_b"), F.col("raw").alias("rb"), "class_id")
    on = (a["class_id"] == b["class_id"]) & (a["ra"] != b["rb"]) & (F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
    return a.join(b, on).select(f"{id_col}_a", f"{id_col}_b").distinct()


@F.pandas_udf(ArrayType(StringType()))
def _visible(fields: pd.Series) -> pd.Series:
    return fields.map(lambda x: [looks(v) if v is not None else None for v in x] if x is not None else None)


def consistent(df: DataFrame, id_col: str = "item_id", state: str = "state", options: str = "options") -> DataFrame:
    """Every row with both fields in one consistent form.

    Returns (id, state, options, class_id, changed): a row that looks like another spelling has the fields of the canonical
    member of its class, every other row its own; both are put out in visible form with composed accents, so that single
    characters are consistent across texts, too. ``class_id`` is null for rows without such a partner. A null state
    stays null, null options stay null and so do null descriptions, except in a class whose canonical member has empty ones.
    Rows with null ids have their own form; repeated rows stay as many.
    """
    members = _members(df, id_col, state, options).distinct()
    text = options_text(F.col("_o"))
    src = df.select(F.col(id_col).alias("_id"), F.col(state).alias("_s"), F.col(options).alias("_o")).withColumns(_raw(F.col("_s"), text))
    ends = cut(members.select("_id", "_r1", "_r2", "class_id"))
    first = cut(members.where("_first and _id = _rep").select("_id", "_r1", "_r2", "class_id").distinct())
    canon = src.join(small(first), ["_id", "_r1", "_r2"])
    canon = canon.groupBy("class_id").agg(F.first(F.struct("_s", "_o")).alias("c"))
    keys = ["_id", "_r1", "_r2"]
    # narrow keys travel, not the texts of all rows
    inside = src.join(small(ends), keys).join(canon, "class_id").select("_id", "_s", "_o", "class_id", F.col("c._s").alias("s"), F.col("c._o").alias("o"))
    outside = src.join(small(ends.select(keys)), keys, "left_anti").select("_id", "_s", "_o", F.lit(None).cast("string").alias("class_id"), F.col("_s").alias("s"), F.col("_o").alias("o"))
    rows = inside.unionByName(outside)
    flat = F.concat(F.array("s"), F.coalesce(F.flatten(F.transform("o", lambda x: F.array(x["key"], x["description"]))), F.array().cast("array<string>")))
    ascii_only = ~F.coalesce(F.array_join(flat, ""), F.lit("")).rlike(r"[^\x00-\x7f]|\r\n")
    rows = rows.withColumn("_f", _visible(F.when(~ascii_only, flat)))
    own = lambda i, x: F.when(F.col("_f").isNull(), x).otherwise(F.get("_f", i))
    new = rows.select(
        "_id", "_s", "_o", own(F.lit(0), F.col("s")).alias("state"),
        F.transform("o", lambda x, i: F.when(x.isNotNull(), x.withField("key", own(2 * i + 1, x["key"])).withField("description", own(2 * i + 2, x["description"])))).alias("options"), "class_id",
    )
    changed = ~(F.col("state").eqNullSafe(F.col("_s")) & options_text(F.col("options")).eqNullSafe(options_text(F.col("_o"))))
    return new.select(F.col("_id").alias(id_col), "state", "options", "class_id", changed.alias("changed"))
