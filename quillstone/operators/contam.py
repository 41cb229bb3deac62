"""Overlap of texts with evaluation texts: exact, contained either way, by shared shingles, by nested strings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from quillstone.functions.text import nested_strings, norm

ANCHOR, LEAST = 24, 80
WORD_SHINGLE, CHAR_SHINGLE, CONTAINED = 8, 20, 40


def exclude_texts(df: DataFrame, text: str, banned: DataFrame, banned_text: str) -> DataFrame:
    """Rows whose normalised text is none of the banned ones; null texts stay."""
    ban = banned.select(norm(F.col(banned_text)).alias("_b")).where("_b is not null").distinct()
    return df.withColumn("_b", norm(F.col(text))).join(ban, "_b", "left_anti").drop("_b")


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for i in range(k if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)]
    return h


def _codes(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


_CJK = re.compile("[぀-ヿ㐀-鿿]")


def shingles_of(col: Column, n: int = WORD_SHINGLE) -> Column:
    """Word n-grams of the normalised text; of a text with fewer words or with CJK letters, whatever its blanks, also its 20-character grams."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            w = t.split()
            out = dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            if len(w) < n or _CJK.search(t):
                out |= dict.fromkeys(t[i : i + CHAR_SHINGLE] for i in range(len(t) - CHAR_SHINGLE + 1))
            return list(out)

        return s.map(one)

    return run(norm(col))


def shared_shingles(df: DataFrame, id_col: str, text: str, pool: DataFrame, pool_id: str, pool_text: str) -> DataFrame:
    """(id, pool_id, shared): how many distinct word shingles a row and a pool text have in common.

    Shingles travel as 64-bit hashes. The pool side is the small one; rows without any pool shingle drop out in the join.
    """
    a = df.select(F.col(id_col), F.explode(F.transform(shingles_of(F.col(text)), lambda s: F.xxhash64(s))).alias("_h"))
    b = pool.select(F.col(pool_id), F.explode(F.transform(shingles_of(F.col(pool_text)), lambda s: F.xxhash64(s))).alias("_h"))
    return a.join(b, "_h").groupBy(id_col, pool_id).agg(F.count(F.lit(1)).alias("shared"))


def _fingerprints(t: str, span: int, first: bool) -> list[int]:
    """The least hash of windows of half of ``span`` characters in every run of windows that covers ``span`` (winnowing), or in the first run only.

    Texts that share ``span`` characters in a row share a fingerprint.
    """
    k = span // 2
    codes = _codes(t[:span] if first else t)
    if len(codes) < span:
        return []
    h = _windows(codes, k)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h ^ (h >> np.uint64(29)), span - k + 1).min(axis=1)).view(np.int64).tolist()


def fingerprints(text: Column, span: int, first: bool = False) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _fingerprints(t, span, first) if t is not None else None)

    return run(text)


def _containment(df: DataFrame, id_col: str, text: str, pool: DataFrame, pool_id: str, pool_text: str, span: int, least_pool: int, least_own: int) -> DataFrame:
    """(_i, _p, kind): same, pool_inside (a pool text of ``least_pool`` characters or more in a row's) and inside_pool (a row's of ``least_own`` or more in a pool text).

    Candidates meet by a hash join of the first fingerprint of the inner text with all of the outer one, about four for every ``span``
    characters; no such text is missed, and whole strings decide. Nothing is collected.
    """
    own = df.select(F.col(id_col).alias("_i"), norm(F.col(text)).alias("_t")).where("_t <> ''").distinct()
    theirs = pool.select(F.col(pool_id).alias("_p"), norm(F.col(pool_text)).alias("_u")).where("_u <> ''").distinct()
    equal = own.select("_i", F.sha2("_t", 256).alias("_h")).join(theirs.select("_p", F.sha2("_u", 256).alias("_h")), "_h").select("_i", "_p", F.lit("same").alias("kind"))

    def met(inner: DataFrame, i: str, t: str, least: int, outer: DataFrame, o: str, u: str, kind: str) -> DataFrame:
        long = inner.where(F.length(t) >= max(least, span))
        hits = outer.select(o, F.explode(fingerprints(F.col(u), span)).alias("_a")).join(long.select(i, F.explode(fingerprints(F.col(t), span, True)).alias("_a")), "_a").select(i, o).distinct()
        both = hits.join(inner, i).join(outer, o)
        return both.where((F.length(t) >= least) & F.contains(u, t) & (F.col(u) != F.col(t))).select("_i", "_p", F.lit(kind).alias("kind"))

    out = equal.union(met(theirs, "_p", "_u", least_pool, own, "_i", "_t", "pool_inside")).union(met(own, "_i", "_t", least_own, theirs, "_p", "_u", "inside_pool"))
    return out.distinct()


def shared_texts(df: DataFrame, id_col: str, text: str, pool: DataFrame, pool_id: str, pool_text: str) -> DataFrame:
    """(id, pool_id, kind): rows that share a whole text with the pool; null and blank texts share none.

    ``same``: normalised texts are equal. ``pool_inside`` and ``inside_pool``: one of at least 40 characters stands in the other.
    """
    return _containment(df, id_col, text, pool, pool_id, pool_text, CONTAINED, CONTAINED, CONTAINED).select(F.col("_i").alias(id_col), F.col("_p").alias(pool_id), "kind")


def contained(df: DataFrame, id_col: str, text: str, banned: DataFrame, ban_id: str, ban_text: str) -> DataFrame:
    """(id, ban_id, kind): ``exact``, or ``contains`` where one normalised text stands in the other.

    Of banned texts those of at least 80 characters are looked for, or in; a row's text needs 24 to be found in one.
    """
    pairs = _containment(df, id_col, text, banned, ban_id, ban_text, ANCHOR, LEAST, ANCHOR)
    if LEAST > ANCHOR:  # what lies in a banned text of fewer characters doesn't count
        long = banned.where(F.length(norm(F.col(ban_text))) >= LEAST).select(F.col(ban_id).alias("_p")).distinct()
        pairs = pairs.where("kind = 'same'").union(pairs.where("kind <> 'same'").join(long, "_p", "left_semi").select("_i", "_p", "kind"))
    kind = F.when(F.col("kind") == "same", "exact").otherwise("contains")
    return pairs.select(F.col("_i").alias(id_col), F.col("_p").alias(ban_id), kind.alias("kind")).distinct()


def without_shared(df: DataFrame, id_col: str, text: str, pool: DataFrame, pool_id: str, pool_text: str) -> DataFrame:
    """Rows that share no whole text with the pool."""
    return df.join(shared_texts(df, id_col, text, pool, pool_id, pool_text).select(id_col).distinct(), id_col, "left_anti")


def nested_overlap(df: DataFrame, id_col: str, state: str, banned: DataFrame, ban_text: str, least: int = 30) -> DataFrame:
    """(id, strings): rows of which a string of at least ``least`` characters, at any depth, is a banned text."""
    own = df.select(F.col(id_col), F.explode(nested_strings(F.col(state))).alias("_s")).where(F.length(norm(F.col("_s"))) >= least).select(id_col, F.sha2(norm(F.col("_s")), 256).alias("_h"))
    ban = banned.select(F.sha2(norm(F.col(ban_text)), 256).alias("_h")).distinct()
    return own.join(ban, "_h", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("strings"))
