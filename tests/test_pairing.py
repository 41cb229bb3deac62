from pyspark.sql import functions as F

from quillstone.operators import pairing as J


def test_turns(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("m", 1)], "key string, i int")
    b = spark.createDataFrame([("k", "x", 1), ("k", "y", 2)], "key string, v string, j int")
    got = {(r["key"], r["i"]): r["v"] for r in J.consume_once(a, b, ["key"], ["i"], ["j"]).collect()}
    assert got == {("k", 1): "x", ("k", 2): "y", ("k", 3): None, ("m", 1): None}


def test_offsets_and_contexts(spark):
    df = spark.createDataFrame([("g", i, f"t{i}") for i in range(5)] + [("one", 0, "alone")], "g string, i int, t string")
    assert {(r["a"], r["b"]) for r in J.half_offset_pairs(df, ["g"], ["i"], "t").collect()} == {(f"t{i}", f"t{(i + 2) % 5}") for i in range(5)}
    q = spark.createDataFrame([("s1", "q1", "c1", 1), ("s1", "q2", "c1b", 2), ("s2", "q3", "c2", 1), ("s3", "q4", "c3", 1)], "story string, q string, c string, i int")
    assert {tuple(r) for r in J.foreign_contexts(q, "story", "q", "c", ["i"]).collect()} == {("q1", "c2"), ("q2", "c2"), ("q3", "c3"), ("q4", "c1")}
    assert J.foreign_contexts(q.where("story = 's1'"), "story", "q", "c", ["i"]).count() == 0


def test_packing(spark):
    df = spark.range(300).select((F.col("id") % 97 * 11 + 1).cast("int").alias("n")).repartition(3)
    got = J.pack(df, "n", 8, 4096).groupBy("batch").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"), F.min("n").alias("low")).collect()
    assert sum(r["k"] for r in got) == 300
    assert all(r["k"] <= 8 and (r["k"] == 1 or r["k"] * r["top"] <= 4096 * 1.1) and r["top"] <= r["low"] * 1.1 + 1 for r in got)


def test_scores_accounting_categories(spark):
    df = spark.createDataFrame([("s", "b", 1.0, None), ("s", "a", 1.0, 0.0), ("s", "c", 3.0, 1.0)], "g string, name string, x double, y double")
    assert [r["name"] for r in J.top_scored(df, ["g"], {"x": 1.0, "y": -1.0}, "name", 2).orderBy(F.desc("score"), "name").collect()] == ["c", "a"]
    rows = spark.createDataFrame([("p",), ("p",), ("q",), ("r",), (None,)], "src string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "source string")
    got = {(r["class"], r["source"], r["n"]) for r in J.source_accounting(rows, "src", names("p"), names("p", "q")).collect()}
    assert got == {("chosen", "p", 2), ("other", "q", 1), ("unknown", "r", 1), ("unknown", None, 1)}
    c = spark.createDataFrame([("Safety; nli",), ("topic",), (None,)], "c string").select(J.has_category(F.col("c"), "nli", "pii").alias("k")).collect()
    assert [r["k"] for r in c] == [True, False, False]


def test_records_logs_intervals(spark):
    cells = spark.createDataFrame([("a", "en", 0.5), ("a", "de", 0.7), ("b", "en", 1.0)], "suite string, lang string, accuracy double")
    suites = spark.createDataFrame([("a",), ("b",), ("c",)], "suite string")
    r = {(x["kind"], x["suite"], x["lang"]): x["accuracy"] for x in J.evaluation_records(cells, suites, ["accuracy"]).collect()}
    assert r["macro", "a", "macro"] == 0.6 and r["skipped", "c", None] is None and len(r) == 6
    log = spark.createDataFrame([("max diff 0.5",), ("max diff 2.5 then max diff 1",), ("none",)], "line string")
    assert J.scraped_metrics(log, "line", {"diff": r"max diff ([0-9.]+)"}).first()["diff"] == 2.5
    d = J.difference_interval(spark.createDataFrame([(100, 0.0, 0.0, 0, 0), (100, 0.1, 0.02, 1, 11)], "n int, d double, se double, lost int, gained int")).collect()
    assert 0.03 < d[0]["hi"] < 0.04 and abs(d[1]["lo"] - (0.1 - 0.0392)) < 1e-9
