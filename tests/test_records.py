"""Requests, tokenizers, suites, set operations, contamination, ranks and links against plain versions, with odd rows."""

import base64
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import tokens as K
from quillstone.functions.text import norm
from quillstone.operators import contam as C
from quillstone.operators import dedup as D
from quillstone.operators import evals as E
from quillstone.operators import paired as R
from quillstone.operators import policies as L
from quillstone.operators import requests as Q
from quillstone.operators import sampling as S
from quillstone.operators import setops as O
from quillstone.operators import suites as U
from quillstone.operators.graph import components

TEXTS = ["", "  ", " a  b ", "I'm sure we'll  see\n\n ok \t", "日本語のテスト、です。", "x" * 3000, "naïve café — 12,345.67 €", "ab" * 500, "😀 ok", "<s>mask<s> x"]


def test_tokenizers_against_libraries(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    import tiktoken

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
        other, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), K.Tokenizer.from_ranks(P.path(name))
        assert [own.encode(t) for t in TEXTS] == [other.encode_ordinary(t) for t in TEXTS]
    sp, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), K.Tokenizer.from_pieces(P.path("piece_bpe_32k.model"))
    assert [own.encode(t) for t in TEXTS] == [sp.encode(t) for t in TEXTS]
    added = K.Tokenizer.from_ranks(P.path("byte_bpe_50k.tiktoken"), {"<s>": 60000, "<s>mask": 60001})
    assert added.encode("<s>mask<s> x") == [60001, 60000, *added.encode(" x")] and added.encode("<s>mask<s> x", 1) == [60001] and added.encode(None) is None
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = [r["i"] for r in df.select(K.token_ids(F.col("t"), lambda: K.Tokenizer.from_ranks(P.path("byte_bpe_50k.tiktoken")), 7).alias("i")).collect()]
    assert [g and len(g) <= 7 for g in got[5:6]] == [True] and got[-1] is None and got[0] == []


def test_merging_order():
    ranks = {"ab": 1, "bc": 0, "abc": 2, "aa": 3}
    assert K.merged(list("abc"), ranks.get) == ["abc"] and K.merged(list("abd"), ranks.get) == ["ab", "d"] and K.merged(list("aaa"), ranks.get) == ["aa", "a"] and K.merged([], ranks.get) == []


def test_word_pieces_are_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", K.word_pieces(F.col("t")).alias("p")).collect()
    assert all("".join(r["p"]) == r["t"] for r in df) and [r["p"] for r in df if r["t"] == " a  b "] == [[" a", " ", " b", " "]]
    bad = spark.createDataFrame([(b"ok\xff\xc3\xa9",), (None,)], "b binary").select(K.utf8_text(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in bad] == ["ok\ufffd\u00e9", None]


GOOD = {"state": "x", "questions": {"q": {"type": "choice", "instructions": "?", "criteria": ["a", "b", "c"]}}}


@pytest.mark.parametrize("change,status", [
    ({}, 200), ({"ensemble": 8}, 200), ({"ensemble": 9}, 422), ({"ensemble": True}, 422), ({"unknown": 1}, 422), ({"questions": []}, 400), ({"questions": {}}, 422), ({"model": 3}, 422), ({"model": "m" * 257}, 422), ({"adapter": None}, 200),
    ({"min_confidence": 1.5}, 422), ({"min_confidence": True}, 422), ({"max_len": 16}, 422), ({"head_max_len": 8190}, 422), ({"state": "y" * 50_001}, 413), ({"state": None}, 422), ({"state": {"a": [1]}}, 200), ({"ensemble_margin": 7}, 200),
    ({"questions": {"q": {"type": "choice", "instructions": "i" * 16_385, "criteria": ["a"]}}}, 413), ({"questions": {"q" * 257: {"type": "noul", "instructions": ""}}}, 413), ({"questions": {"q": {"type": "odd", "instructions": ""}}}, 422), ({"questions": {"q": {"type": "noul"}}}, 422),
    ({"questions": {"q": {"type": "choice", "instructions": "", "criteria": {"k" * 1025: None}}}}, 413), ({"questions": {"q": {"type": "choice", "instructions": "", "criteria": {"k": "d" * 4097}}}}, 413), ({"questions": {f"q{i}": {"type": "noul", "instructions": ""} for i in range(65)}}, 413),
])
def test_request_statuses(change, status):
    r = Q.parse_request(json.dumps(GOOD | change), False, 1, Q.Limits())
    assert r["http_status"] == status, r
    assert ("detail" in r) == (status != 200)


def test_requests(spark):
    deep = "[" * 80 + "]" * 80
    raw = [json.dumps(GOOD), None, "", "{", '{"a": 1, "a": 2}', deep, "[" * 100_000, json.dumps(GOOD | {"calibrate": True, "ensemble": 2}), json.dumps({"a": list(range(100_001))})]
    got = Q.parse_requests(spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, body string").repartition(2)).orderBy("i").collect()
    assert [r["http_status"] for r in got] == [200, 400, 400, 400, 400, 413, 413, 200, 413]
    assert got[0]["work"] == 1 and got[7]["work"] == 5 and got[0]["states"] == ["x"] and got[0]["max_len"] == 1024 and got[1]["work"] is None
    batch = {"states": ["a", {"b": 1}], "questions": GOOD["questions"]}
    rows = Q.parse_requests(spark.createDataFrame([(json.dumps(batch),), (json.dumps(GOOD),), (json.dumps(batch | {"states": ["a"] * 257}),), (json.dumps(batch | {"states": ["a", None]}),)], "body string"), batch=True, models=2).collect()
    assert [r["http_status"] for r in rows] == [200, 400, 413, 422] and rows[0]["work"] == 4 and rows[0]["states"] == ["a", '{"b": 1}']
    assert Q.parse_request(json.dumps(batch), True, 1, Q.Limits(work=1))["http_status"] == 413 and Q.parse_request(json.dumps(batch), True, 1, Q.Limits(tokens=1000))["http_status"] == 413
    assert Q.parse_request(json.dumps(GOOD), False, 1, Q.Limits(attention_bytes=1000))["http_status"] == 413 and Q.parse_request(json.dumps(GOOD), False, 1, Q.Limits(response_bytes=1000))["http_status"] == 413
    assert Q.parse_requests(spark.createDataFrame([], "body string")).count() == 0


def test_routes(spark):
    models = spark.createDataFrame([("english", 0), ("multilingual", 1)], "model string, position int")
    adapters = spark.createDataFrame([("english", "e1", 1, ["topic"]), ("english", "e0", 0, ["topic"]), ("multilingual", "m", 0, ["emotion"]), ("multilingual", "e1", 1, ["intent"])], "model string, adapter string, position int, categories array<string>")
    rows = [
        (1, ["this is the text of the day and it is fine"], None, None, None), (2, ["это не английский"], None, None, None), (3, ["это"], "english", "auto", "topic"), (4, ["это"], None, "m", None), (5, ["это"], "consensus", "m", None), (6, ["x"], "consensus", "auto", "topic"),
        (7, ["это"], None, "e1", None), (8, ["это"], "english", "nope", None), (9, ["это"], None, "auto", "topic"), (10, ["это"], None, "auto", None), (11, ["это"], "who", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, states array<string>, model string, adapter string, family string")
    got = {r["i"]: (r["served_by"], r["routing"], r["served_adapter"], r["adapter_routing"], r["refused"]) for r in Q.route(df, models, adapters).collect()}
    assert got[1][:4] == ("english", "lang:en", None, "none") and got[2][:2] == ("multilingual", "lang:other") and got[3] == ("english", "requested", "e0", "auto:topic", None)
    assert got[4] == ("multilingual", "adapter", "m", "requested", None) and got[5][0] == "consensus" and got[5][4] and got[6] == ("consensus", "consensus", None, "auto:consensus", None)
    assert got[7] == ("multilingual", "lang:other", "e1", "requested", None) and got[8][2] is None and got[8][4] and got[9][3] == "auto:topic:no-adapter" and got[10][3] == "auto:no-family" and got[11][1] == "lang:other"
    one = Q.route(df, models.where("position = 1"), adapters.limit(0)).collect()
    assert {r["served_by"] for r in one if r["model"] != "consensus"} == {"multilingual"}
    assert Q.route(df, models, adapters, consensus=True).where("i = 1").first()["served_by"] == "consensus"


def test_shared_texts_against_plain_search(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["lamp", "note", "clinic", "手表", "ticket"]) + str(rng.randrange(30))
    pool = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(40)] + [(90, None), (91, " "), (92, "漢字" * 25)]
    docs = []
    for i in range(60):
        base = rng.choice(pool[:40])[1]
        docs.append((i, rng.choice([base, base[3:-2], "pre" + base + " post", base.upper() + "  x", " ".join(word() for _ in range(20))])))
    docs += [(100, None), (101, ""), (102, "前" + "漢字" * 25 + "後"), (103, "漢字" * 21), (104, "x" * 100_000 + pool[3][1]), (0, docs[0][1]), (None, pool[2][1])]
    a = spark.createDataFrame(docs, "doc_id int, text string").withColumns({c: F.lit(1) for c in ("_i", "_t", "_u", "_p", "kind")})
    b = spark.createDataFrame(pool, "item_id int, text string").withColumn("_a", F.lit(1))
    plain = lambda df: [(r[0], r["t"]) for r in df.select(df.columns[0], norm(F.col("text")).alias("t")).collect() if r["t"]]
    want = set()
    for (i, t), (k, u) in itertools.product(plain(a), plain(b)):
        if t == u:
            want.add((i, k, "same"))
        elif len(u) >= 40 and u in t:
            want.add((i, k, "pool_inside"))
        elif len(t) >= 40 and t in u:
            want.add((i, k, "inside_pool"))
    got = [tuple(r) for r in C.shared_texts(a, "doc_id", "text", b, "item_id", "text").collect()]
    assert set(got) == want and len(got) == len(want) and {k for _, _, k in want} == {"same", "pool_inside", "inside_pool"}
    assert C.shared_texts(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0 and C.shared_texts(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def test_guards_and_closed_labels(spark):
    o = "array<struct<key:string,description:string>>"
    rows = [
        (1, "fine text", "Is it joyful?", "joyful", [("joyful", "a"), ("sad", "b")]), (2, "fine text", "Is it joyfully put?", "joyful", [("joyful", "a"), ("sad", "b")]), (3, "great /s", "Which?", "sad", [("joyful", "x"), ("sad", "X ")]), (4, " ", "Which?", "sad", [("a", None), ("A", None)]),
        (5, "as an AI I", "Which?", "x", [("", None), ("b", None)]), (6, "😀", "How do you feel?", "track order now", [("track order now", None), ("b", None)]), (7, "ok", "please Track  order now, or not", "track order now", [("track order now", None), ("b", None)]), (8, None, None, None, None), (9, "ironically", "a.b", "a.bc", [("a.bc", None), ("b", None)]),
    ]
    df = spark.createDataFrame(rows, f"i int, s string, q string, g string, o {o}")
    f = L.generation_faults(F.col("s"), F.col("q"), F.lit("choice"), F.col("g"), F.col("o"), unasked=["how do you feel"])
    got = {r["i"]: set(r["f"]) for r in df.select("i", f.alias("f")).collect()}
    assert got == {1: {"answer_leaked"}, 2: set(), 3: {"cheat", "duplicate_options"}, 4: {"duplicate_options", "empty_state"}, 5: {"meta_phrase", "duplicate_options"}, 6: {"cheat", "unasked"}, 7: {"answer_leaked"}, 8: {"empty_state"}, 9: set()}
    allowed = ["Very Good", "bad"]
    rows = [(1, [("very_good", "x"), ("BAD", None)]), (2, [("very-good ", None), ("Very  good", None)]), (3, [("bad", None)]), (4, [("odd", None)]), (5, []), (6, None)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, f"i int, o {o}").select("i", L.closed_labels(F.col("o"), allowed).alias("c")).collect()}
    assert [x["key"] for x in got[1]["options"]] == allowed and [got[i]["fault"] for i in range(1, 7)] == [None, "duplicate_options", "option_count", "bad_key", "bad_options", "bad_options"]


def test_set_operations(spark):
    a = spark.createDataFrame([(i, "a") for i in range(10)], "id int, x string")
    b = spark.createDataFrame([(100 + i, None) for i in range(5)], "id int, x string")
    m = O.mixture({"b": b, "a": a}, "a", 3, ["id"], "id", 1).orderBy("position").collect()
    assert [r["position"] for r in m] == list(range(15)) and [r["id"] for r in m[:3]] == [0, 1, 2] and {r["id"] for r in m} == {*range(10), *range(100, 105)}
    assert [r["id"] for r in m] == [r["id"] for r in O.mixture({"b": b.repartition(3), "a": a}, "a", 3, ["id"], "id", 1).orderBy("position").collect()]
    assert sorted(r[0] for r in O.banned_texts((spark.createDataFrame([(" A b",), (None,), ("",)], "t string"), "t"), (spark.createDataFrame([("a  B",), ("c",)], "u string"), "u")).collect()) == ["a b", "c"]
    v = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 2), ("x", None)], "v string, k int")
    assert [r[0] for r in O.common_values(v, "v", "k").collect()] == ["x"] and O.common_values(v.limit(0), "v", "k").count() == 0
    up = spark.createDataFrame([(1, " t ", "l"), (2, "u", None)], "k int, t string, l string")
    mine = spark.createDataFrame([(1, "t", "l", 1), (1, "t", "m", 2), (2, "u", None, 3), (None, "t", "l", 4)], "k int, t string, l string, n int")
    assert [r["n"] for r in O.upstream_rows(mine, up, ["k", "t", "l"]).collect()] == [1]
    d = spark.createDataFrame([(1, "safe", "hi", None, "en"), (1, "safe", "ho", None, "en"), (1, "safe", "ho", None, "de"), (1, "bad", "hi", None, "en"), (2, "safe", "hi", None, "en"), (1, "safe", "[REDACTED]", None, "en"), (1, "safe", "hi", 7, "en"), (1, None, "hi", None, "en"), (1, "safe", None, None, "en")], "id int, label string, t string, r int, lang string")
    base = spark.createDataFrame([(1, "safe", "hi"), (1, "safe", "hi")], "id int, label string, t string")
    got = [r["fault"] for r in O.lineage(d, base, "id", "t", "label", "r", F.col("lang") == "en", ["safe", "unsafe"]).orderBy("id", F.col("lang").desc(), "label", "t", "r").collect()]
    assert sorted(map(str, got)) == sorted(["None", "changed", "None", "label", "unknown", "redacted", "redacted", "label", "label"])


def test_suites(spark):
    rows = [(i, ["one", "two", None, "odd"][i % 4], f"text {i}" if i % 9 else " ", "xy"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, label string, text string, lang string")
    s = U.Suite("s", "?", "label", labels=["one", "two"], readings={"one": "the first"}, lang="lang", n=10, per_label=True)
    got = U.suite(df, s, "id").collect()
    assert len(got) == 20 and {r["lang"] for r in got} == {"x", "y"} and all(r["options"] == ["the first", "two"] for r in got)
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in U.suite(df.repartition(5), s, "id").collect())
    per = U.suite(df, U.Suite("s", "?", "label", labels=["one", "two", "odd"], n=9, per_label=True), "id").groupBy("gold").count().collect()
    assert sorted(r["count"] for r in per) == [3, 3, 3]
    assert U.suite(df, U.Suite("s", "?", "label", n=None, skip=30), "id").count() == U.items(df, U.Suite("s", "?", "label"), "id").count() - 30
    number = df.withColumn("label", (F.col("id") % 5).cast("int"))
    assert {r["gold"] for r in U.items(number, U.Suite("n", "?", "label", labels=["a", "b", "c"]), "id").collect()} == {0, 1, 2}
    yes = U.items(number, U.Suite("y", "?", "label", labels=["a", "b", "c"], truth=["c"]), "id").groupBy("gold").count().collect()
    assert {r["gold"] for r in yes} == {0, 1}
    m = U.metadata(U.suite(df, s, "id"), s, "id").collect()
    assert {(r["lang"], r["n"]) for r in m} == {("x", 10), ("y", 10)} and len({r["pool"] for r in m}) == 2
    assert [r["pool"] for r in U.metadata(U.suite(df.repartition(7), s, "id"), s, "id").orderBy("lang").collect()] == [r["pool"] for r in sorted(m, key=lambda r: r["lang"])]
    assert U.suite(df.limit(0), s, "id").count() == 0 and len(U.registry()) == 15


def test_running_ranks_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, w int").withColumn("h", S.seeded(3, "id"))
    got = S.running(df, ["g"], "h", "id", F.col("w"), "r").collect()
    by = {}
    for r in sorted(got, key=lambda r: (str(r["g"]), r["h"])):
        by[r["g"]] = by.get(r["g"], 0) + r["w"]
        assert r["r"] == by[r["g"]]
    assert len(got) == 3000
    dev = S.drop_leaked(spark.createDataFrame([(1, "k"), (1, "m"), (None, "k"), (2, "z"), (2, "k")], "o int, k string"), 1, ["o", "k"], F.col("k"))
    assert sorted((r["split"], r["k"]) for r in dev.collect()) == [("dev", "k"), ("train", "m"), ("train", "z")]


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 5000), ("b", 7), (None, 300)) for v in rng.integers(0, 900, n) / 7] + [("a", None), ("c", 3.0)] + [("d", 5.0)] * 4000
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in E.latency_summary(df, "v", ["g"]).collect()}
    for g in ("a", "b", None, "c", "d"):
        x = np.sort([v for k, v in rows if k == g and v is not None])
        r = got[g]
        assert r["n"] == len(x) and r["min"] == x[0] and r["max"] == x[-1] and r["mean"] == pytest.approx(x.mean())
        assert r["median"] == pytest.approx(np.percentile(x, 50)) and r["p95_linear"] == pytest.approx(np.percentile(x, 95))
        assert r["p50"] == x[int(np.ceil(0.5 * len(x))) - 1] and r["p95"] == x[int(np.ceil(0.95 * len(x) - 1e-9)) - 1]
    low = {r["g"]: r["value"] for r in E.rounded_index_percentile(df, "v", 0.9, ["g"]).collect()}
    assert all(low[g] == sorted(v for k, v in rows if k == g and v is not None)[min(n - 1, int(0.9 * n))] for g, n in (("a", 5000), ("b", 7), ("c", 1)))
    assert E.latency_summary(df.limit(0), "v", ["g"]).count() == 0 and E.latency_summary(df.limit(0), "v").first()["n"] == 0


def test_chains_components_and_rounds(spark):
    n = 2100
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    assert S.keyed(chain, ["a"]).columns == ["_k_a", "b"]
    ids = spark.range(n).withColumnRenamed("id", "x")
    kept = {r["x"] for r in D.greedy_keep(ids, chain, "x").collect()}
    assert kept == set(range(0, n, 2))
    assert {r["x"] for r in D.greedy_keep(ids.limit(40), chain.where("b < 40"), "x", local_edges=5, rounds=2).collect()} == set(range(0, 40, 2))
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_near_links_at_other_thresholds(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lamp", "note", "clinic", "badge", "kettle") for b in range(12)]
    rows, n = [], 0
    for _ in range(120):
        base = [rng.choice(words) for _ in range(20)]
        for k in (0, 2, 4):
            t = list(base)
            for i in rng.sample(range(20), k):
                t[i] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    df = spark.createDataFrame(rows, "id int, t string")
    g = {i: set(t[k : k + 5] for k in range(len(t) - 4)) for i, t in rows}
    for t in (0.6, 0.8):
        want = {(a, b) for a, b in itertools.combinations(range(n), 2) if len(g[a] & g[b]) / len(g[a] | g[b]) >= t and rows[a][1] != rows[b][1]}
        assert {(r["a"], r["b"]) for r in D.near_links(df, "id", "t", t).collect()} == want and len(want) > 20


def test_cosine_links_against_products(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    v = np.concatenate([c + rng.normal(scale=0.25, size=(40, 8)) for c in centre])
    rows = [(i, ["p", "q", None][i % 3], x.tolist()) for i, x in enumerate(v)] + [(900, "p", None), (901, "p", [0.0] * 8), (902, "q", [])]
    df = spark.createDataFrame(rows, "i int, g string, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for t in (0.92, 0.3):
        want = {(a, b) for a, b in itertools.combinations(range(len(v)), 2) if a % 3 == b % 3 and u[a] @ u[b] >= t}
        for size in (4096, 16):
            got = [(r["a"], r["b"]) for r in D.cosine_links(df, "i", "v", t, ["g"], rows=size).collect()]
            assert set(got) == want and len(got) == len(want)
    assert D.cosine_links(df.limit(0), "i", "v").count() == 0


def test_target_temperature_and_bootstrap(spark):
    df = spark.createDataFrame([([2.0, 0.0, 0.0],), ([1.0, 1.0],), (None,)], "logits array<double>")
    t = R.target_temperature(df, 0.9)
    p = lambda z: np.exp(np.array(z) / t) / np.exp(np.array(z) / t).sum()
    assert (p([2.0, 0, 0])[0] + 1.0) / 2 == pytest.approx(0.9, abs=1e-4)
    assert R.target_temperature(df.limit(0), 0.9) is None and R.target_temperature(df, 0.0) == 1e6 and R.target_temperature(df, 1.0) == 1e-6
    b = R.bootstrap_mean(spark.range(4000).selectExpr("cast(id % 7 as double) as v"), "v", 200).first()
    assert b["lo"] < 3 < b["hi"] and b["hi"] - b["lo"] == pytest.approx(2 * 1.96 * 2 / 4000**0.5, rel=0.3)
    assert R.bootstrap_mean(spark.range(0).selectExpr("cast(id as double) as v"), "v", 10).first()["mean"] is None


def test_excluded_records(spark):
    e = spark.createDataFrame([("v5", "Help", None, None), ("v6", "org/a", "x", True), ("v6", "org/b", "x", False)], "registry string, id string, config string, configs_only boolean")
    rows = [(1, "v5", "Helper", None), (2, "v5", "help", None), (3, "v6", "org/a", "x | y"), (4, "v6", "org/a", "y"), (5, "v6", "org/ab", "x"), (6, "v6", "org/b", "q"), (7, None, "org/b", None), (8, "v6", None, "x"), (9, "v6", "org/a", None)]
    df = spark.createDataFrame(rows, "i int, registry string, id string, config string")
    got = {r["i"]: r["excluded"] for r in L.excluded_records(df, e, families=["v5"]).collect()}
    assert {i for i, x in got.items() if x} == {1, 3, 6} and len(got) == 9


def test_command_line(spark, data, tmp_path, capsys):
    from quillstone.__main__ import main

    (tmp_path / "s.json").write_text('{"state_id": "a", "state": "the lamp is broken"}\n{"state_id": "b", "state": null}\n')
    (tmp_path / "q.json").write_text('{"q": {"type": "choice", "instructions": "What?", "criteria": {"lamp": "a lamp", "note": "a note"}}}')
    assert main(["decide", str(tmp_path / "s.json"), str(tmp_path / "q.json"), "--out", str(tmp_path / "out")]) == 0
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r["state_id"], r["answer"]["choice"]) for r in got] == [("a", "lamp")]
    (tmp_path / "bad.json").write_text('{"q": {"type": "odd"}}')
    assert main(["decide", str(tmp_path / "s.json"), str(tmp_path / "bad.json")]) == 2
    assert main(["query", "spread_rows", data, "--rows", "3"]) == 0 and "item_id" in capsys.readouterr().out


def test_positions_across_tasks(spark):
    df = spark.range(5000).selectExpr("case when id % 10 < 8 then 'hot' when id % 10 = 8 then null else 'b' end as g", "-id as o").repartition(7)
    got = S.positions(df, ["g"], ["o"], "p").collect()
    for g, n in (("hot", 4000), (None, 500), ("b", 500)):
        rows = sorted((r["o"], r["p"], r["p_of"]) for r in got if r["g"] == g)
        assert [p for _, p, _ in rows] == list(range(n)) and {k for *_, k in rows} == {n}


def test_words_and_guesses(spark):
    from quillstone.functions.text import guess_lang, word_count

    df = spark.createDataFrame([("\u304b\u3099\u304d",), ("\u1112\u1161\u11ab a",), (None,), ("plain words",)], "t string")
    assert [r["n"] for r in df.select(word_count(F.col("t")).alias("n")).collect()] == [2, 2, None, 2]
    t = spark.createDataFrame([("the cat and the dog are in the house",), ("это русский текст о доме",)], "t string")
    for names, want in ((None, ["en", "ru"]), (["de", "ru"], ["", "ru"]), (["en"], ["en", ""]), ([], ["", ""])):
        assert [r["g"] for r in t.select(guess_lang(F.col("t"), names).alias("g")).collect()] == want
