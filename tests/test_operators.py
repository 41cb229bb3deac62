import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import adapters as A
from quillstone.operators import contam as C
from quillstone.operators import decide as D
from quillstone.operators import dedup as U
from quillstone.operators import evals as E
from quillstone.operators import paired as R
from quillstone.operators import policies as L
from quillstone.operators import quality as Q
from quillstone.operators import sampling as S
from quillstone.operators.graph import components

QUESTIONS = {"c": {"type": "choice", "instructions": "which", "criteria": {"cat": "a cat", "dog": None}}, "s": {"type": "score", "instructions": "how", "criteria": ["low", "high"]}, "n": {"type": "yes_no", "instructions": "is it", "criteria": {"True": "a cat"}}}


@pytest.mark.parametrize("q,why", [
    (5, "object"), ({"type": "x", "instructions": ""}, "type"), ({"type": "choice"}, "instructions"), ({"type": "choice", "instructions": "", "criteria": {}}, "label"),
    ({"type": "choice", "instructions": "", "criteria": [["a"]]}, "scalars"), ({"type": "score", "instructions": "", "criteria": ["a", None]}, "description"),
    ({"type": "noul", "instructions": "", "criteria": {"maybe": "x"}}, "true and false"), ({"type": "choice", "instructions": "", "criteria": ["a"], "labels": {}}, "noul"),
    ({"type": "noul", "instructions": "", "labels": {"true": "y", "false": " y "}}, "different"),
])
def test_invalid_questions(q, why):
    with pytest.raises(D.QuestionError, match=why):
        D.parse_questions({"q": q})


def test_options():
    c, s, n = D.parse_questions(QUESTIONS)
    assert c.options == ["cat: a cat", "dog"] and c.labels == ["cat", "dog"]
    assert s.options == ["level 0: low", "level 1: high"]
    assert n.options == [f"false: {D.NO}", "true: a cat"]
    assert D.Question.parse("q", {"type": "choice", "instructions": "", "criteria": [True, None, 1, True]}).labels == ["true", "null", "1"]


def test_decide(spark):
    states = spark.createDataFrame([(1, "a cat sat"), (2, "a dog"), (3, None), (4, "")], "state_id int, state string")
    q = D.question_frame(spark, QUESTIONS)
    r = {(x["state_id"], x["qid"]): x for x in D.decide(states, q, min_confidence=0.9).collect()}
    assert {k for k, _ in r} == {1, 2, 4}
    assert r[1, "c"]["answer"]["choice"] == "cat" and r[2, "c"]["answer"]["choice"] in ("cat", "dog")
    assert r[4, "c"]["answer"]["confidence"] == 0.0 and r[4, "c"]["answer"]["choice"] == "cat"
    assert r[1, "n"]["answer"]["noul"] > 0.5 and r[1, "c"]["escalate"] in (True, False)
    # a deterministic scorer doesn't mind the order of options, so an ensemble agrees with one view
    many = {(x["state_id"], x["qid"]): x for x in D.decide(states, q, n=4).collect()}
    for k in r:
        assert many[k]["answer"]["choice"] == r[k]["answer"]["choice"]
        assert many[k]["answer"]["answer_confidence"] == pytest.approx(r[k]["answer"]["answer_confidence"], abs=1e-4)
    g = D.gather(D.decide(states, q)).where("state_id = 1").select(F.map_keys("answers").alias("k")).first()
    assert g["k"] == ["c", "s", "n"]


def test_scorer_sees_rotations(spark):
    """A scorer that prefers the first option: rotating cancels its bias."""
    first = D.FunctionScorer(lambda s, o: [[1.0 if i == 0 else 0.0 for i in range(len(x))] for x in o])
    states = spark.createDataFrame([(1, "x")], "state_id int, state string")
    q = D.question_frame(spark, {"q": {"type": "choice", "instructions": "", "criteria": ["a", "b", "c"]}})
    one = D.decide(states, q, first).first()["answer"]["probabilities"]
    three = D.decide(states, q, first, n=3).first()["answer"]["probabilities"]
    assert one["a"] > one["b"] and three["a"] == three["b"] == three["c"]
    flat = D.decide(states, q, first, calibrated=True).first()["answer"]["probabilities"]
    assert flat["a"] == flat["b"] == flat["c"]


def test_layout_and_validation(spark):
    df = spark.createDataFrame([("h1 h2 h3", [["o1"], ["o2", "o3"]], ["s%d" % i for i in range(30)])], "h string, o array<array<string>>, s array<string>")
    t, m, ok = D.layout(F.split("h", " "), F.col("o"), F.col("s"), 20, 40, F.lit(False))
    r = df.select(t.alias("t"), m.alias("m"), ok.alias("ok")).first()
    assert r["t"][:11] == ["[CLS]", "h1", "h2", "h3", "[SEP]", "[MASK]", "o1", "[MASK]", "o2", "o3", "[SEP]"] and len(r["t"]) == 20 and r["t"][-1] == "[SEP]" and r["t"][11] == "s0"
    assert r["m"] == [5, 7] and r["ok"]
    t, _, _ = D.layout(F.split("h", " "), F.col("o"), F.col("s"), 20, 40, F.lit(True))
    assert df.select(t.alias("t")).first()["t"][-2] == "s29"


def test_families(spark):
    rows = [("q", "What topic is it?", "topic"), ("mood", "topic", "emotion"), ("q", "topic or intent", None), ("q", "nothing", None)]
    got = spark.createDataFrame(rows, "i string, t string, w string").select(D.question_family(F.col("i"), F.col("t")).alias("f"), "w").collect()
    assert all(r["f"] == r["w"] for r in got)


def test_components_and_greedy(spark):
    rng = random.Random(1)
    for n, m in ((12, 8), (40, 30), (40, 60)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        df = spark.createDataFrame([*edges, (0, 0), (None, 3)], "a int, b int")
        got = {r["node"]: r["component"] for r in components(df).collect()}
        near = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in edges:
                near[a] = near[b] = near[a] | near[b]
        assert got == {x: min(near[x]) for e in edges for x in e}
        kept = set()
        for i in range(n):
            if not any((min(i, j), max(i, j)) in edges for j in kept):
                kept.add(i)
        ids = spark.createDataFrame([(i,) for i in range(n)], "id int")
        assert {r["id"] for r in U.greedy_keep(ids, df.where("a is not null"), "id").collect()} == kept
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_near_and_exact_duplicates(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta", "theta", "lambda"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base[:6])] + [(200 + i, "  " + t.upper()) for i, t in enumerate(base[:3])] + [(300, None), (301, ""), (302, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    grams = {i: {" ".join(t.lower().split())[k : k + 5] for k in range(len(" ".join(t.split())) - 4)} for i, t in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(i for i in grams if i < 200), 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    got = {(r["a"], r["b"]) for r in U.near_links(df, "id", "text").collect()}
    assert got == want and len(want) == 6
    c = {r["id"]: r for r in U.near_classes(df, "id", "text").collect()}
    assert c[200]["class_id"] == 0 and c[200]["copies"] == 2 and c[100]["class_id"] == 0 and c[100]["links"] == 1 and c[11]["links"] == 0
    assert {r["id"] for r in U.keep_first(df, [F.col("text")], ["id"]).collect()} == {i for i, _ in rows} - {302}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6))
    v[30:] = v[:30] + rng.normal(scale=0.2, size=(30, 6))
    rows = [(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, 0, None), (91, 0, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id int, g int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if a % 2 == b % 2 and u[a] @ u[b] >= 0.92}
    assert {(r["a"], r["b"]) for r in U.cosine_links(df, "id", "v", 0.92, ["g"]).collect()} == want and want
    k = u[::2] @ u[::2].T / 30
    e = np.clip(np.linalg.eigvalsh(k), 1e-15, None)
    got = {r["g"]: r["vendi"] for r in U.vendi_score(df.where("id < 60"), "v", ["g"]).collect()}
    assert got[0] == pytest.approx(np.exp(-(e * np.log(e)).sum()), rel=1e-6)


def test_containment(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear near the river"
    docs = spark.createDataFrame([(1, "Intro. " + long + " outro"), (2, long.upper()), (3, long[20:70]), (4, "nothing"), (5, None), (6, "")], "doc int, text string")
    ban = spark.createDataFrame([(7, long), (8, "short"), (9, None)], "item int, text string")
    got = {(r["doc"], r["item"], r["kind"]) for r in C.contained(docs, "doc", "text", ban, "item", "text").collect()}
    assert got == {(1, 7, "contains"), (2, 7, "exact"), (3, 7, "contains")}
    assert {r["doc"] for r in C.exclude_texts(docs, "text", ban, "text").collect()} == {1, 3, 4, 5, 6}
    assert C.contained(docs, "doc", "text", ban.limit(0), "item", "text").count() == 0
    states = spark.createDataFrame([(1, '{"a": ["%s"]}' % long), (2, "x")], "id int, state string")
    assert [tuple(r) for r in C.nested_overlap(states, "id", "state", ban, "text").collect()] == [(1, 1)]


def test_metrics(spark):
    rows = [("a", [0.9, 0.1], 0), ("a", [0.4, 0.6], 0), ("b", [0.2, 0.3, 0.5], 2), ("b", None, 1), ("b", [1.0, 0.0], None)]
    m = {r["s"]: r for r in E.cell_metrics(spark.createDataFrame(rows, "s string, p array<double>, gold int"), ["s"]).collect()}
    assert m["a"]["n"] == 2 and m["a"]["accuracy"] == 0.5
    assert m["a"]["brier"] == pytest.approx((0.02 + 0.72) / 2) and m["a"]["ece"] == pytest.approx((0.1 + 0.6) / 2)
    b = E.balanced_accuracy(spark.createDataFrame([(0, 0), (0, 0), (1, 0), (None, 1), (1, 1)], "pred int, gold int"), []).first()
    assert b["balanced_accuracy"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    v = E.performance_verdict(spark.createDataFrame([("x", i, 1.0, 1.5) for i in range(5)] + [("y", i, 1.0, 1.0 + 0.01 * (-1) ** i) for i in range(5)], "k string, run int, old double, new double"), ["k"])
    assert {r["k"]: r["verdict"] for r in v.collect()} == {"x": "slower", "y": "same"}


def test_paired(spark):
    a = spark.createDataFrame([("s", "en", i, f"h{i}", 0, 0 if i < 8 else 1) for i in range(10)] + [("s", "en", 20, "z", 0, 0)], "suite string, lang string, i int, item string, gold int, pred int")
    b = spark.createDataFrame([("s", "en", i, f"h{i}", 0, 0 if i != 3 else 1) for i in range(10)] + [("s", "en", 21, "z", 0, 0)], "suite string, lang string, i int, item string, gold int, pred int")
    p = R.pair_runs(a, b)
    assert {r["problem"]: r["count"] for r in p.groupBy("problem").count().collect()} == {None: 10, "missing in base": 1, "missing in other": 1}
    c = R.with_tests(R.paired_cells(p, ["suite"])).first()
    assert (c["n"], c["lost"], c["gained"], c["changed"]) == (10, 1, 2, 3)
    assert c["p_mcnemar"] == pytest.approx(1.0) and c["d"] == pytest.approx(0.1)
    h = R.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", order=["k"])
    assert {r["k"]: round(r["p_holm"], 9) for r in h.collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    boot = R.bootstrap_mean(spark.range(200).selectExpr("cast(id as double) as v"), "v", 300).first()
    assert boot["lo"] < 99.5 < boot["hi"] and boot["hi"] - boot["lo"] < 25


def test_sampling(spark):
    rows = [(i, "g", "hot" if i < 50 else f"k{i}") for i in range(100)] + [(200 + i, "one", "only") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, g string, k string")
    kept = S.cap_share(df, ["g"], "k", 0.1, "id", 1)
    assert kept.where("k = 'hot'").count() == 10 and kept.where("g = 'one'").count() == 10 and kept.count() == 70
    assert S.cap_share(df, ["g"], "k", 0.1, "id", 1, trim_only_key=True).where("g = 'one'").count() == 1
    r = S.round_robin(df, ["g", "k"], 5, "id", 1)
    assert r.count() == 5 and {x["k"] for x in r.collect()} >= {"hot"}
    small = S.round_robin(df, ["g"], 6, "id", 1).groupBy("g").count().collect()
    assert {x["g"]: x["count"] for x in small} == {"g": 3, "one": 3}
    o = sorted(x["id"] for x in S.offset_sample(spark.range(1000).select(F.col("id").cast("int").alias("id")), ["id"], 10, 3).collect())
    assert [x // 100 for x in o] == list(range(10))
    assert [x["id"] for x in S.spread_sample(spark.range(100), ["id"], 7).orderBy("id").collect()] == [int(i * 100 / 7) for i in range(7)]
    a = S.apportion(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int"), ["k"], "n", 100)
    assert {x["k"]: x["quota"] for x in a.collect()} == {"a": 34, "b": 33, "c": 33}
    dev = S.split_dev(df.withColumn("t", F.concat(F.lit("t"), (F.col("id") % 30).cast("string"))), "g", F.col("t"), 0.2, 1)
    assert dev.groupBy("t").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    leak = S.drop_leaked(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "i int, t string"), 2, "i", F.col("t"))
    assert {x["i"]: x["split"] for x in leak.collect()} == {1: "dev", 2: "dev", 4: "train"}


def test_policies(spark):
    p = spark.createDataFrame([("MIT, apache-2.0",), ("mit, gpl",), ("",), (None,)], "l string").select(L.permissive(F.col("l")).alias("k")).collect()
    assert [r["k"] for r in p] == [True, False, False, False]
    fam = spark.createDataFrame([("a",), ("a/b",), ("c",)], "family string")
    src = spark.createDataFrame([("a/x",), ("a/b/y",), ("c",), ("cc",), (None,)], "src string")
    assert {r["src"] for r in L.one_family(src, "src", fam).collect()} == {"a/x", "c"}
    assert {r["src"] for r in L.exclude_prefixes(src, "src", fam.withColumnRenamed("family", "prefix")).collect()} == {"cc", None}
    v = spark.createDataFrame([("1.2.3",), ("2.0",), ("x",)], "v string").select(L.version_affected(F.col("v"), [("1.0", "2.0")]).alias("k")).collect()
    assert [r["k"] for r in v] == [True, False, True]
    t = spark.createDataFrame([([1.0, 3.0], ["a", "b"], "choice"), ([0.3], ["f", "t"], "noul"), ([0.0, 0.0], ["a", "b"], "choice"), ([1.0, 1.0], ["a", "a"], "choice")], "t array<double>, o array<string>, k string").select(L.soft_target(F.col("t"), F.col("o"), F.col("k")).alias("x")).collect()
    assert [r["x"] for r in t] == [[0.25, 0.75], [0.7, 0.3], None, None]


def test_quality(spark):
    b = Q.position_balance(spark.createDataFrame([("s", i % 2, 2) for i in range(40)] + [("u", 0, 2)] * 40 + [("few", 0, 2)], "s string, p int, k int"), ["s"], "p", "k")
    got = {r["s"]: r for r in b.collect()}
    assert got["s"]["chi_square"] == 0 and got["s"]["p_value"] == 1.0 and got["u"]["chi_square"] == 40 and got["u"]["p_value"] < 1e-8 and got["few"]["chi_square"] is None
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in Q.latest(log, ["k"], ["t"]).collect()} == {1: "b", 2: "c"}
    f = Q.fingerprint(log, [], F.to_json(F.struct("k", "v"))).first()["fingerprint"]
    assert f == Q.fingerprint(log.orderBy(F.desc("t")), [], F.to_json(F.struct("k", "v"))).first()["fingerprint"]
    assert f != Q.fingerprint(log.where("t = 1"), [], F.to_json(F.struct("k", "v"))).first()["fingerprint"]


def test_adapters(spark):
    d = spark.createDataFrame([("good", "a", "b", "entailment", 0.9), ("", "a", "b", "neutral", 0.5)], "t string, p string, h string, l string, v double").withColumn("lang", F.lit("en"))
    n = A.nli(d, "p", "h", "l", "src").collect()
    assert len(n) == 4 and {r["qtype"] for r in n} == {"choice", "noul"} and all(sum(r["target"]) == 1 for r in n)
    s = A.similarity(d, "p", "h", "v", "src").collect()
    assert sorted(r["qtype"] for r in s) == ["noul", "score", "score"]
    assert A.always(d, "t", "?", "src").count() == 1
    tr = A.translations(spark.createDataFrame([({"en": "hi", "de": "hallo"},)], "m map<string,string>"), "m", "src").collect()
    assert {(r["state"], r["options"][r["target"].index(1.0)]) for r in tr} == {("hi", "en"), ("hallo", "de")}
    many = A.always(spark.createDataFrame([(f"text {i}",) for i in range(30)], "t string").withColumn("lang", F.lit("en")), "t", "?", "src")
    assert A.drop_constant(many, ["src"]).count() == 0
    c = A.conversation_state(spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "a")], "c int, t int, r string, x string"), "c", "t", "r", "x").first()
    assert c["state"] == "system: a\nuser: b"


def test_near_links_at_other_thresholds(spark):
    """No pair at the threshold is lost, whatever the threshold; pairs of 60 % are no chance hits."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for i in range(150):
        w = [word() for _ in range(40)]
        v = list(w)
        for k in rng.sample(range(40), 6):
            v[k] = word()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in rows}
    for t in (0.6, 0.8):
        want = {(i, i + 1) for i in range(0, 300, 2) if len(grams[i] & grams[i + 1]) >= t * len(grams[i] | grams[i + 1])}
        assert {(r["a"], r["b"]) for r in U.near_links(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", t).collect()} == want
        assert (len(want) > 100) == (t == 0.6)
    assert U.band_rows(0.8) == 5 and U.band_count(0.8, 5) == 35 and U.sketch_least(0.8) > U.sketch_least(0.6)
