"""Joins by parity bitmaps against brute force, and the work that they take."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import parity
from quillstone.llm.shingles import jaccard, shingles
from quillstone.llm.splits import prefix_join
from quillstone.operators import dedup as D
from quillstone.operators.blocks import placed_blocks


def _sets(texts, t):
    start, h = shingles(texts)
    return parity.bitmaps(start, h, t), np.diff(start)


def _variants(n, seed):
    """Texts of very different lengths, each followed by one with some words changed; an empty one last."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    out = []
    for k in range(n):
        w = [word() for _ in range(rng.choice([1, 3, 12, 60, 400]))]
        v = list(w)
        for _ in range(k % 5 * len(w) // 40 + k % 2):
            v[rng.randrange(len(v))] = word()
        out += [" ".join(w), " ".join(v)]
    return [*dict.fromkeys(out), ""]


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8, 1.0])
def test_bitmaps_lose_no_pair(t):
    a, b = _variants(120, 1), _variants(90, 1)
    want = {(i, j) for i, x in enumerate(a) for j, s in enumerate(jaccard([x] * len(b), b)) if s >= t - 1e-12}
    (ma, na), (mb, nb) = _sets(a, t), _sets(b, t)
    i, j = parity.may_reach(ma, na, mb, nb, t)
    got = list(zip(i.tolist(), j.tolist()))
    assert want <= set(got) and len(got) == len(set(got)) and len(want) > 150
    i, j = parity.may_reach(ma, na, mb, nb, t, upward=True)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, y in got if na[x] >= nb[y]}
    assert len(parity.may_reach([], na[:0], mb, nb, t)[0]) == 0


def test_a_block_takes_a_few_nanoseconds_a_pair():
    """Texts made of the same sentences: where prefixes meet again and again, bitmaps are compared at one pace."""
    rng = random.Random(2)
    said = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(9)) for _ in range(40)]
    texts = [". ".join(f"{rng.choice(said)} {rng.randrange(9999)}" for _ in range(6)) for _ in range(4000)]
    a, b = texts[:1000], texts[1000:]
    began = time.thread_time()
    i, j, _ = prefix_join(a, b, 0.8)
    before = time.thread_time() - began
    (ma, na), (mb, nb) = _sets(a, 0.8), _sets(b, 0.8)
    began = time.thread_time()
    x, y = parity.may_reach(ma, na, mb, nb, 0.8)
    assert time.thread_time() - began < before / 3
    assert set(zip(i.tolist(), j.tolist())) <= set(zip(x.tolist(), y.tolist()))


def _alike(n, seed):
    """Texts that share sentences; of some only a few letters differ."""
    rng = random.Random(seed)
    said = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(6)) for _ in range(30)]
    rows = []
    for k in range(n):
        t = ". ".join(f"{rng.choice(said)} {rng.randrange(9999)}" for _ in range(8))
        rows += [(2 * k, "xy"[k % 2], t), (2 * k + 1, "xy"[k // 2 % 2], t.replace("a", "e", k % 9))] if k % 10 == 0 else [(2 * k, "xy"[k % 2], t)]
    return rows


def test_loose_links_within_groups(spark, monkeypatch):
    """At 0.6 nearly all texts of one kind shared a band; the pairs of bitmaps are few, and none is lost, in one block or in many."""
    rows = _alike(300, 4)
    df = spark.createDataFrame(rows, "id bigint, g string, t string")
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, _, t in rows}
    first = {t: i for i, _, t in reversed(rows)}
    reps = [r for r in rows if first[r[2]] == r[0]]
    want = {(a[0], b[0]) for a in reps for b in reps if a[0] < b[0] and len(sets[a[0]] & sets[b[0]]) >= 0.6 * len(sets[a[0]] | sets[b[0]])}
    same = {(a, b) for a, b in want if dict((i, g) for i, g, _ in rows)[a] == dict((i, g) for i, g, _ in rows)[b]}
    assert len(want) > len(same) > 10
    for least in (D.LEAST_BLOCK, 9_000):
        monkeypatch.setattr(D, "LEAST_BLOCK", least)
        assert sorted((r["a"], r["b"]) for r in D.near_links(df, "id", "t", 0.6).collect()) == sorted(want)
        assert sorted((r["a"], r["b"]) for r in D.near_links(df, "id", "t", 0.6, "g").collect()) == sorted(same)
    kept = df.where(F.col("id").isin([r[0] for r in reps])).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.lit(0).cast("bigint").alias("_g"))
    assert D._bitmap_pairs(kept, 0.6).count() < 4 * len(want)


def test_blocks_of_one_group_are_spread_over_tasks(spark):
    docs = spark.createDataFrame([(r, 1, i, 50 + i % 40) for r in (0, 1) for i in range(400)], "_role int, ih bigint, th bigint, n int")
    tasks = placed_blocks(docs, docs, 0.8, 2000, 4000).select(F.spark_partition_id().alias("p"), "band", "sub", "part").distinct().groupBy("band", "sub", "part").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p")).collect()
    assert {r["n"] for r in tasks} == {1} and len(tasks) > 10 and len({r["p"] for r in tasks}) > 1
