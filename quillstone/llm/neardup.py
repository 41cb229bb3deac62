"""Near-duplicate records with small edits: ProbMinHash signatures, banding, estimation, verification.

A signature has ``registers`` components. Every weighted shingle sends arrivals of a Poisson process of
its weight to uniformly drawn registers; a register keeps the shingle that arrived first. Equal
components of two signatures estimate the probability Jaccard similarity, which for equal weights is
the Jaccard similarity of the sets. All first arrivals are taken before all second ones and so on, and a
shingle whose next arrival lies beyond the latest kept one of its text stops (early termination), so
that a batch of texts needs few passes over a shrinking array.

Texts that agree in a band of ``rows`` components are candidates; a 128-bit sketch of one bit per
register travels with each band key, and the join keeps a candidate only if the similarity it estimates
can reach the threshold. What is left is verified on whole texts. With 18 bands of 5 registers,
a pair at 0.8 shares a band with probability 0.9992 and passes the sketch with more than 0.9999; a pair
at 0.9 is lost with a probability below 1e-6. Bands follow from the threshold.

Copies of a text under the same instructions collapse within each task before anything is shuffled, so a hot
text is one row per task and band. Both sides of the band join are one plain exchange: nothing stands between it and the
join, so that adaptive execution splits a hot band over tasks. Buckets have no cap. A text is known by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shingles import hash_text, jaccard, letters, mix, plain, shingles
from quillstone.operators.dedup import sketch_least
from quillstone.operators.graph import components
from quillstone.session import cut, partitions_for

THRESHOLD = 0.8
REGISTERS, BANDED = 128, 90
#: A pair at the threshold may share no band with this probability. Of 128 sketch bits, 101 must be equal at a threshold of 0.8.
SKETCH_BITS, LOSS = 128, 0.001


def rows_for(t: float) -> int:
    """Rows of a band for the threshold ``t``: the most that keep a pair at ``t`` but with probability ``LOSS``; 5 at 0.8.

    ``BANDED`` registers are spent on bands; a threshold that they cannot serve is refused.
    """
    fit = [r for r in range(1, BANDED + 1) if (1 - t**r) ** (BANDED // r) <= LOSS]
    if not fit:
        raise ValueError(f"a threshold of {t} needs more than {BANDED} registers")
    return max(fit)


def prob_minhash(start: np.ndarray, elements: np.ndarray, weights: np.ndarray | None = None, registers: int = REGISTERS, seed: int = 1) -> np.ndarray:
    """Signatures (texts x registers) of weighted sets; a text without elements has zeros only.

    ``elements[start[i]:start[i + 1]]`` are the distinct elements of text i, ``weights`` theirs (1 if null).
    """
    n = len(start) - 1
    size = np.diff(start)
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), size)
    h = elements.astype(np.uint64)
    rate = None if weights is None else 1.0 / np.asarray(weights, dtype=np.float64)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        draw = mix(h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF))
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
        uniform = ((draw >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32
        step = -np.log(uniform)
        time = time + (step if rate is None else step * rate)
        at = owner * registers + register.astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        kept[at[won]] = h[won]
        limit = first.reshape(n, registers).max(axis=1)
        on = time < limit[owner]
        h, owner, time = h[on], owner[on], time[on]
        rate = None if rate is None else rate[on]
        turn += 1
    return kept.reshape(n, registers)


def band_keys(signatures: np.ndarray, salt: np.ndarray, rows: int = 5) -> np.ndarray:
    """One 64-bit key per band, different for different salts and bands."""
    n, m = len(signatures), min(signatures.shape[1], BANDED)
    keys = np.empty((n, m // rows), dtype=np.uint64)
    for b in range(m // rows):
        k = salt.astype(np.uint64) ^ np.uint64(b + 1)
        for r in range(rows):
            k = mix(k ^ signatures[:, b * rows + r])
        keys[:, b] = k
    return keys


def sketch(signatures: np.ndarray) -> np.ndarray:
    """(n, 2) words of one bit per register; equal registers have equal bits, others half of the time."""
    bits = (mix(signatures[:, :SKETCH_BITS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def near_duplicates(df: DataFrame, id_col: str = "item_id", instructions: str = "instructions", state: str = "state", t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records with the same instructions and states of a similarity of ``t`` or more.

    members: (id, class, check) names the class of each record by two hashes of instructions and state; records of one
    class are copies as they look. links: (a, ca, b, cb, similarity) with a < b: classes that reach ``t`` themselves.
    Records with a null id or state take no part; null instructions equal empty ones; empty states are copies of
    each other; repeated rows count once per id; an empty table has neither members nor links.
    """
    rows = df.where(F.col(state).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(instructions), F.lit("")).alias("_i"), F.col(state).alias("_s"))
    depth = rows_for(t)

    def keyed(b: pd.DataFrame) -> pd.DataFrame:
        text = [plain(s) for s in b["_s"]]
        ih = b["_i"].map({i: letters(i) for i in b["_i"].unique()})
        whole = [f"{i}\n{x}" for i, x in zip(ih, text)]
        return pd.DataFrame({"_id": b["_id"], "class": np.array([hash_text(w) for w in whole], dtype="int64"), "check": np.array([hash_text(w, 1) for w in whole], dtype="int64"), "ih": ih, "text": text})

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield keyed(b)[["_id", "class", "check"]]

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield keyed(b)[["class", "check", "text"]].drop_duplicates(["class", "check"])

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # copies end here, so a hot text is one row per task and band
        for b in batches:
            k = keyed(b)
            new = []
            if len(seen) > 1_000_000:
                seen.clear()
            for x in zip(k["class"].tolist(), k["check"].tolist()):
                new.append(x not in seen)
                seen.add(x)
            k = k[new]
            start, h = shingles(k["text"].tolist())
            size = np.diff(start)
            sig = prob_minhash(start, h)
            key = band_keys(sig, np.array([hash_text(i) for i in k["ih"]], dtype=np.int64).view(np.uint64), depth)
            sk = sketch(sig).view(np.int64)
            some = np.flatnonzero(size > 0)
            m = key.shape[1]
            rep = lambda x: np.repeat(x[some], m)
            yield pd.DataFrame({"key": key[some].reshape(-1).view(np.int64), "class": rep(k["class"].to_numpy()), "n": rep(size.astype("int32")), "s0": rep(sk[:, 0]), "s1": rep(sk[:, 1])})

    named = cut(rows.mapInPandas(members, "_id bigint, class bigint, check bigint"))
    banded = rows.select("_i", "_s", F.lit(0).alias("_id")).mapInPandas(bands, "key bigint, class bigint, n int, s0 bigint, s1 bigint")
    a, b = (banded.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "s0", "s1"))) for x in "ab")
    near = f"class_a < class_b and least(n_a, n_b) >= {t} * greatest(n_a, n_b) - 1e-9 and bit_count(s0_a ^ s0_b) + bit_count(s1_a ^ s1_b) <= {SKETCH_BITS - sketch_least(t, SKETCH_BITS, 1e-4)}"
    # both sides of about 28 bytes a row reach every task; a sort-merge join, as estimates of small inputs must not lead to a broadcast of all bands
    with partitions_for(df.sparkSession, named.count() * (BANDED // depth) * 28 * 2):
        cand = cut(a.hint("merge").join(b.hint("merge"), "key").where(near).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct())
    need = cand.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    one = named.join(need, "class", "left_semi").groupBy("class", "check").agg(F.min("_id").alias("_id")).select("_id").distinct()
    text = cut(rows.join(one, "_id", "left_semi").mapInPandas(texts, "class bigint, check bigint, text string").groupBy("class", "check").agg(F.first("text").alias("text")))
    side = lambda x: text.select(F.col("class").alias(x), F.col("check").alias(f"c{x}"), F.col("text").alias(f"t{x}"))
    both = cand.join(side("a"), "a").join(side("b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = jaccard(x["ta"].tolist(), x["tb"].tolist())
            yield x.assign(similarity=s).loc[s >= t - 1e-12, ["a", "ca", "b", "cb", "similarity"]]

    links = both.mapInPandas(verify, "a bigint, ca bigint, b bigint, cb bigint, similarity double")
    return named.withColumnRenamed("_id", id_col), links


def near_pairs(df: DataFrame, id_col: str = "item_id", instructions: str = "instructions", state: str = "state", t: float = THRESHOLD) -> DataFrame:
    """All pairs of records (a < b) that reach ``t`` themselves, copies included; each once."""
    m, links = near_duplicates(df, id_col, instructions, state, t)
    m = m.distinct()
    a = m.select(F.col("class").alias("a"), F.col("check").alias("ca"), F.col(id_col).alias("x"))
    b = m.select(F.col("class").alias("b"), F.col("check").alias("cb"), F.col(id_col).alias("y"))
    across = links.drop("similarity").join(a, ["a", "ca"]).join(b, ["b", "cb"]).select("x", "y")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))).where("x < y").select("x", "y")
    return across.union(within).where("x <> y").select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()


def near_groups(df: DataFrame, id_col: str = "item_id", instructions: str = "instructions", state: str = "state", t: float = THRESHOLD) -> DataFrame:
    """(id, group_id, copies, links): each record's group, the connected component over links.

    ``copies`` counts the records of its text class, ``links`` the other classes it reaches ``t`` with;
    ``group_id`` is the least record id of the group. Every record with a state has a row.
    """
    m, links = near_duplicates(df, id_col, instructions, state, t)
    m = m.distinct()
    classes = cut(m.groupBy("class", "check").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies")))
    by = lambda c: classes.select(F.col("class").alias(c), F.col("check").alias(f"c{c}"), F.col("rep").alias(f"rep_{c}"))
    edges = cut(links.join(by("a"), ["a", "ca"]).join(by("b"), ["b", "cb"]).select("rep_a", "rep_b"))
    degree = edges.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    group = components(edges, "rep_a", "rep_b")
    out = classes.join(degree, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    out = out.select("class", "check", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.coalesce("component", "rep").alias("group_id"))
    return m.join(out, ["class", "check"]).select(id_col, "group_id", "copies", "links")
