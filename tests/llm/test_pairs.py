"""Look-alikes, cross-split overlap and near-duplicates against brute force, with odd rows."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm.lookalikes import consistent, look_classes, look_pairs, look_summary
from quillstone.llm.looks import looks, sql_bare, sql_looks
from quillstone.llm.neardup import band_keys, near_groups, near_pairs, prob_minhash, rows_for, sketch
from quillstone.llm.shingles import jaccard, letters, plain, shingles
from quillstone.llm.splits import ordered, placed_blocks, prefix_join, split_pairs

OPTIONS = "array<struct<key:string,description:string>>"


@pytest.mark.parametrize("a,b", [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("a b c", "a b c"), ("z​e­ro", "zero"), ("pаypаl", "paypal"), ("ﬁne oﬃce", "fine office"),
    ("café", "café"), ("non‑breaking", "non-breaking"), ("Ѕtор", "Stop"), ("ﾊﾟﾝ", "パン"), ("が", "が"), ("όχι", "óχi"), ("ё", "ë"), ("x\r\ny", "x\ny"), ("a᠎b﻿", "ab"),
])
def test_same_looks(a, b):
    assert looks(a) == looks(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("1", "l"), ("0", "O"), ("a.b", "a,b"), ("a b", "a  b"), ("x²", "x2"), ("a–b", "a-b"), ("é", "è"), ("и", "u")])
def test_visible_differences_stay(a, b):
    assert looks(a) != looks(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_looks_is_stable(t):
    once = looks(t)
    assert looks(once) == once and unicodedata.is_normalized("NFC", once)
    assert looks(unicodedata.normalize("NFD", t)) == once or "\r" in t


def test_sql_looks_agrees(spark):
    rows = ["ｆｕｌｌ　ｗｉｄｔｈ", "pаypаl ​ café", "ﬁne", "non‑br­eaking", "", "plain ascii", "漢字とカナ", "ﾊﾟﾝ"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", sql_looks(F.col("t")).alias("s")).collect()
    for r in got:
        assert unicodedata.normalize("NFC", r["s"]) == looks(r["t"])


def _items(spark, rows):
    """Rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, f"item_id bigint, state string, options {OPTIONS}")
    return df.withColumns({c: F.lit(1) for c in ("_id", "_s", "_o", "_raw", "_b", "class_id", "raw", "n", "text", "key")})


def test_look_pairs(spark):
    o1, o2, null, empty = [("a", "x y")], [("a", "x y")], [("a", None)], [("a", "")]
    rows = [
        (1, "same text", o1), (2, "same text", o1), (3, "same text", o2), (4, "same text", o1), (5, "Same text", o1), (6, "same text", null), (7, "same​ text", empty), (8, "same text", empty),
        (9, None, o1), (10, "same text", None), (11, "", o1), (12, "​", o1), (13, "same text", [("a", "x y"), ("b", "")]), (14, "café " * 2000, []), (15, "café " * 2000, []), (2, "same text", o1), (None, "same text", o1),
        (16, "axx", [("", "y")]), (17, "axx", [("y", "")]),
    ]
    got = {tuple(r) for r in look_pairs(_items(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (6, 7), (7, 8), (11, 12), (14, 15)}
    c = look_classes(_items(spark, rows)).collect()
    assert len({r["class_id"] for r in c}) == 4
    assert look_pairs(_items(spark, [])).count() == 0
    fixed = {r["item_id"]: r for r in consistent(_items(spark, rows[:8] + rows[8:10])).collect()}
    assert len({(fixed[i]["state"], str(fixed[i]["options"])) for i in (1, 2, 3, 4)}) == 1 and fixed[2]["changed"] and not fixed[1]["changed"]
    assert fixed[9]["state"] is None and fixed[10]["options"] is None and fixed[6]["options"][0]["description"] is None
    assert fixed[1]["class_id"] == fixed[3]["class_id"] and fixed[5]["class_id"] is None


def grams(t):
    p = plain(t)
    return {p[i : i + 5] for i in range(len(p) - 4)} if len(p) >= 5 else {p} if p else set()


def similarity(a, b):
    x, y = grams(a), grams(b)
    return 1.0 if plain(a) == plain(b) else len(x & y) / max(1, len(x | y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc é漢", max_size=25), min_size=1, max_size=12), st.lists(st.text(alphabet="abc é漢", max_size=25), min_size=1, max_size=12), st.sampled_from([0.5, 0.8]))
def test_prefix_join_is_exact(a, b, t):
    a, b = [plain(x) for x in a], [plain(x) for x in b]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if similarity(x, y) >= t - 1e-12}
    i, j, s = prefix_join(a, b, t)
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    assert all(abs(similarity(a[x], b[y]) - z) < 1e-9 for x, y, z in zip(i, j, s))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_shingles_and_jaccard(texts):
    texts = [plain(t) for t in texts]
    start, h = shingles(texts)
    assert np.diff(start).tolist() == [len(grams(t)) for t in texts]
    assert jaccard(texts, texts[::-1]) == pytest.approx([similarity(a, b) for a, b in zip(texts, texts[::-1])])


def _texts(seed, n=40):
    rng = random.Random(seed)
    words = "lamp kettle office bakery ticket parcel number returned moved boxes garage clinic asked colleague wonderful broken scanner badge".split()
    base = [" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(8, 40))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        w = t.split()
        for k in (1, 2, 4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = rng.choice(words)
            out.append(" ".join(v))
        out.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2]))
        out.append(t.upper().replace(" ", "  "))
    return out


def _verify(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i, t in enumerate(_texts(seed)):
        rows.append((i, rng.choice(["train", "train", "train", "dev", "test"]), rng.choice(["s1", "s2", "off"]), rng.choice(["Which one?", "which  ONE", "How many?"]), t))
    n = len(rows)
    rows += [(n, "train", "s1", None, ""), (n + 1, "dev", "s1", "", ""), (n + 2, "train", "s1", "Which one?", None), (n + 3, "dev", None, "Which one?", rows[0][4]), (n + 4, None, "s1", "Which one?", rows[0][4]), rows[0], (None, "train", "s1", "Which one?", rows[0][4]), (n + 5, "train", "s1", "Which one?", "abc"), (n + 6, "test", "s1", "Which one?", "ABC"), (n + 7, "train", "s1", "Which one?", "long word " * 5000), (n + 8, "dev", "s2", "Which one?", "long word " * 5001)]
    df = spark.createDataFrame(rows, "item_id bigint, split string, suite string, instructions string, state string")
    return rows, df.withColumns({c: F.lit("x") for c in ("_id", "_role", "ih", "th", "text", "class", "key", "_sp", "_su", "band")})


@pytest.mark.parametrize("seed,block", [(1, 3_000_000), (2, 1500)])
def test_split_pairs(spark, seed, block):
    rows, df = _verify(spark, seed)
    suites = spark.createDataFrame([("s1", 1), ("s2", 1), ("s1", 2), (None, 3)], "suite string, _listed int")
    rows = [r for r in rows if r[0] is not None and r[4] is not None]
    want = set()
    for a, b in itertools.product(rows, rows):
        if a[1] == "train" and b[1] in ("dev", "test") and b[2] in ("s1", "s2") and letters(a[3]) == letters(b[3]) and similarity(a[4], b[4]) >= 0.8:
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [tuple(r) for r in ordered(split_pairs(df, suites, block=block, probe_block=2 * block), "eval_id", "train_id", "item_id").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10
    assert split_pairs(df.limit(0), suites).count() == 0 and split_pairs(df, suites.limit(0)).count() == 0


def test_near_pairs(spark):
    rows, df = _verify(spark, 5)
    good = {r[0]: r for r in rows if r[0] is not None and r[4] is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(good), 2) if letters(good[a][3]) == letters(good[b][3]) and similarity(good[a][4], good[b][4]) >= 0.8}
    got = [tuple(r) for r in near_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    g = {r["item_id"]: r for r in near_groups(df).collect()}
    assert set(g) == set(good)
    for a, b in want:
        assert g[a]["group_id"] == g[b]["group_id"]
    assert near_pairs(df.limit(0)).count() == 0 and near_groups(df.limit(0)).count() == 0


def test_prob_minhash_estimates():
    """The share of equal registers estimates the similarity, weighted and not, and doesn't depend on the batch."""
    rng = np.random.default_rng(2)
    for overlap in (20, 60, 90):
        a = rng.integers(0, 2**48, 110, dtype=np.uint64)
        b = np.concatenate([a[:overlap], rng.integers(0, 2**48, 110 - overlap, dtype=np.uint64)])
        sig = prob_minhash(np.array([0, 110, 220]), np.concatenate([a, b]), registers=2048)
        assert (sig[0] == sig[1]).mean() == pytest.approx(overlap / (220 - overlap), abs=0.05)
    w = np.array([4.0, 1.0, 1.0])
    e = np.array([5, 6, 7], dtype=np.uint64)
    sig = prob_minhash(np.array([0, 3]), e, w, registers=6000)
    assert [(sig[0] == x).mean() for x in e] == pytest.approx([4 / 6, 1 / 6, 1 / 6], abs=0.03)
    # probability Jaccard of {1: 3, 2: 1} and {1: 1, 2: 1, 3: 2}: sum over common d of 1 / sum_k max(x_k / x_d, y_k / y_d)
    pair = prob_minhash(np.array([0, 2, 5]), np.array([1, 2, 1, 2, 3], dtype=np.uint64), np.array([3.0, 1, 1, 1, 2]), registers=20000)
    want = 1 / (1 + 1 + 2) + 1 / (3 + 1 + 2)
    assert (pair[0] == pair[1]).mean() == pytest.approx(want, abs=0.015)
    single = prob_minhash(np.array([0, 3]), e)
    both = prob_minhash(np.array([0, 3, 3, 6]), np.concatenate([e, e]))
    assert (both[0] == single[0]).all() and (both[2] == single[0]).all() and not both[1].any()
    keys = band_keys(both, np.array([1, 1, 2], dtype=np.uint64))
    assert (keys[0] != keys[2]).all() and (sketch(both)[0] == sketch(both)[2]).all()


def test_more_texts_than_owner_bits():
    """Hashes don't depend on how many texts share a batch."""
    many = [f"{i:05x}" for i in range(70_000)]
    start, h = shingles(many)
    assert (np.diff(start) == 1).all() and (h[:100] == shingles(many[:100])[1]).all() and (h[-100:] == shingles(many[-100:])[1]).all()
    i, j, s = prefix_join(many, many[::1000])
    assert sorted(zip(i.tolist(), j.tolist())) == [(1000 * k, k) for k in range(70)] and (s == 1).all()
    assert (jaccard(many, many) == 1).all() and jaccard(many, many[1:] + ["x"]).max() == 0


def test_blocks_are_bounded_where_sizes_tie(spark):
    """Texts of one set size are spread over blocks, and every pair still meets exactly once."""
    rows = [(1, 1, i, 0, f"{i:05d}", 1) for i in range(2000)] + [(1, 1, 5000 + i, 0, "x" * 40 + str(i), 20 + i % 9) for i in range(300)] + [(0, 1, 10_000 + i, 0, f"{i:05d}", 1) for i in range(500)] + [(0, 1, 20_000, 0, "none of these", 9), (1, 2, 1, 0, "alone", 1)]
    docs = spark.createDataFrame(rows, "_role int, ih bigint, th bigint, th2 bigint, text string, n int")
    placed = placed_blocks(docs.drop("text"), docs, 0.8, 100, 200).cache()
    assert placed.where("_role = 1 and length(text) = 5").groupBy("ih", "band", "sub", "part").count().agg(F.max("count")).first()[0] < 180
    assert placed.where("_role = 1").select("ih", "th").distinct().count() == 2300
    a, b = (placed.where(f"_role = {r} and length(text) = 5").select("ih", "band", "sub", "part", F.col("th").alias(x)) for r, x in ((1, "e"), (0, "t")))
    met = a.join(b, ["ih", "band", "sub", "part"])
    assert met.count() == met.select("e", "t").distinct().count() == 2000 * 500
    assert placed.where("_role = 1").groupBy("th").agg(F.countDistinct("band", "sub").alias("k")).where("k > 1").isEmpty()


def test_thresholds_have_bands_or_are_refused():
    assert rows_for(0.8) == 5 and rows_for(0.9) > 5
    for t in (0.5, 0.6, 0.8, 0.95):
        r = rows_for(t)
        assert (1 - t**r) ** (90 // r) <= 0.001
    with pytest.raises(ValueError):
        rows_for(0.05)


def test_bare_text_is_coarser_than_the_collation(spark):
    same = [("caf\u00e9", "cafe\u0301"), ("\u304c", "\u304b\u3099"), ("\ud55c", "\u1112\u1161\u11ab"), ("\u0439", "\u0438\u0306"), ("\ufb01ne", "fine"), ("\u1f02", "\u1f00\u0300")]
    rows = spark.createDataFrame(same, "a string, b string").select(sql_bare(sql_looks(F.col("a"))).alias("a"), sql_bare(sql_looks(F.col("b"))).alias("b")).collect()
    assert [r for r in rows if r["a"] != r["b"]] == []


def test_canonical_member_is_put_out(spark):
    rows = [(1, "pаypal caf\u00e9", None), (2, "paypal cafe\u0301", None), (3, "paypal café", []), (4, "paypal cafe", None), (5, None, None), (6, "ｘ", [("ｋ", None)]), (7, "x", [("k", "")])]
    df = spark.createDataFrame(rows, f"item_id bigint, state string, options {OPTIONS}")
    got = {r["item_id"]: r for r in consistent(df).collect()}
    assert len({got[i]["state"] for i in (1, 2, 3)}) == 1 and got[1]["state"] == "paypal caf\u00e9" and got[4]["state"] == "paypal cafe"
    assert len({(got[i]["state"], str(got[i]["options"])) for i in (6, 7)}) == 1 and got[5]["state"] is None
    summary = {r["item_id"]: (r["spellings"], r["records"]) for r in look_summary(df).collect()}
    assert summary == {2: (3, 3), 7: (2, 2)}
    assert look_summary(df.limit(0)).count() == 0


def test_consistent_options_field_by_field(spark):
    """Characters whose visible form is special in JSON keep the options; nulls and other fields stay as they are."""
    options = [("ａ＂b", "c＼d"), ("x y", " \u0085"), ("k", None), (None, "one\r\ntwo"), None]
    df = spark.createDataFrame([(1, "s", options), (2, "s", [("plain", "one\r\ntwo")]), (3, "s", None), (4, "s", [])], f"item_id bigint, state string, options {OPTIONS}")
    got = {r["item_id"]: r for r in consistent(df).collect()}
    assert [o and tuple(o) for o in got[1]["options"]] == [('a"b', "c\\d"), ("x\ny", "\n\n"), ("k", None), (None, "one\ntwo"), None]
    assert got[1]["changed"] and [tuple(o) for o in got[2]["options"]] == [("plain", "one\ntwo")]
    assert got[3]["options"] is None and got[4]["options"] == [] and not got[4]["changed"]
    assert consistent(df).schema["options"].dataType == df.schema["options"].dataType
