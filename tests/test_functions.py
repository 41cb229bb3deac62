import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import probability as P
from quillstone.functions import text as X
from quillstone.functions.languages import language_code, language_code_py
from quillstone.functions import tails as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("  A  b\n", "a b"), ("", ""), (None, None), ("x\x1cy", "x y"), ("　", "")])
def test_norm(spark, text, want):
    assert one(spark, text, X.norm) == want


@pytest.mark.parametrize("text,want", [("two words", 2), ("", 0), ("   ", 0), ("漢字 and かな", 5), ("한글", 2)])
def test_word_count(spark, text, want):
    assert one(spark, text, X.word_count) == want


def test_scripts_and_languages(spark):
    rows = [("Der Hund und die Katze, nicht ich", "de"), ("Это простое предложение", "ru"), ("これはペンです、たぶん", "ja"), ("你好世界这是一个测试句子", "zh"), ("abc", ""), ("the dog and the cat is here", "en"), ("مرحبا بالعالم", "ar")]
    got = spark.createDataFrame(rows, "t string, w string").select("t", "w", X.guess_lang(F.col("t")).alias("g")).collect()
    for r in got:
        assert r["g"] == r["w"], r
    assert one(spark, "ab", X.script_family) is None
    assert spark.createDataFrame([("Это текст", "ru"), ("text only", "ru"), ("ab", "en")], "t string, l string").select(X.language_ok(F.col("t"), F.col("l")).alias("k")).collect() == [(True,), (False,), (False,)]


@pytest.mark.parametrize("text,want", [("please send it to the office", True), ("café crème brûlée à la carte", False), ("ok", True), ("", False), ("lorem ipsum dolor sit amet consectetur", False)])
def test_looks_english(spark, text, want):
    assert one(spark, text, X.looks_english) is want


def test_tokens_and_grams(spark):
    assert one(spark, "Hello, big World 42!", lambda c: X.tokens(c, F.lit("en"))) == ["hello", "big", "world", "42"]
    assert one(spark, "私は、猫", lambda c: X.first_prefix(c, F.lit("ja"))) == "私は猫"
    assert one(spark, "ABCDEF", X.char_ngrams) == ["abcde", "bcdef"]
    assert one(spark, "abc", X.char_ngrams) == ["abc"]
    assert one(spark, "", X.char_ngrams) == []
    s = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r["j"] for r in s] == [1.0, 0.0, 1 / 3]


def test_json_functions(spark):
    assert one(spark, '{"b": ["x", {"c": "y"}], "a": 1}', X.nested_strings) == ["x", "y"]
    assert one(spark, "plain", X.nested_strings) == ["plain"]
    assert one(spark, '{"b": 1.50, "a": "é"}', X.canonical_json) == '{"a":"é","b":1.5}'
    assert one(spark, "{bad", X.canonical_json) is None
    assert one(spark, '{"b":1,"a":[2]}', X.python_json) == '{"b": 1, "a": [2]}'
    assert one(spark, "{'a': (1, 2)}", X.literal_json) == '{"a": [1, 2]}'
    assert one(spark, '<think>no</think>```json\n{"k": 1}\n```', X.repaired_json) == '{"k": 1}'
    assert one(spark, '{"a": {"b": "x"}}', lambda c: X.has_key(c, "b")) is True
    assert one(spark, '[{"text": "x", "id": "q"}, "y"]', X.flatten_text) == "x\ny"
    assert one(spark, '{"a": "x", "n": 2}', lambda c: X.content_free(c, F.lit("N/A"))) == '{"a": "N/A", "n": 2}'
    assert one(spark, 1e-5, X.python_float, "double") == "1e-05"


def test_labels(spark):
    assert one(spark, "SomeLabel_name", X.human) == "some label name"
    assert one(spark, "A-b c!", X.squash) == "abc"
    assert one(spark, "hi [MASK] there", X.scrub) == "hi   there"
    assert one(spark, "is it {focus} or {none}?", lambda c: X.fill(c, {"focus": F.lit("art")})) == "is it art or {none}?"
    assert one(spark, "req-1.a", X.valid_request_id) is True
    assert one(spark, "", X.valid_request_id) is False


@pytest.mark.parametrize("label,want", [("en", "en"), ("EN_gb", "en"), ("English", "en"), ("eng", "en"), ("pt-BR", "pt"), ("und", None), ("", None), (None, None), ("xx", None), (" zho ", "zh"), ("unknown", None)])
def test_language_code(spark, label, want):
    assert one(spark, label, language_code) == want
    assert language_code_py(label) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-20, 20), min_size=1, max_size=6), min_size=1, max_size=5))
def test_probabilities(spark, rows):
    z = F.col("z")
    p = P.softmax(z, 2.0)
    got = spark.createDataFrame([(r,) for r in rows], "z array<double>").select("z", p.alias("p"), P.confidence(p).alias("c"), P.argmax(z).alias("a"), P.margin(p).alias("m"), P.expectation(p).alias("e"), P.log_softmax(z).alias("l")).collect()
    for r in got:
        e = [math.exp((x - max(r["z"])) / 2) for x in r["z"]]
        want = [x / sum(e) for x in e]
        assert r["p"] == pytest.approx(want)
        assert r["a"] == r["z"].index(max(r["z"]))
        k = len(want)
        c = 1.0 if k < 2 else max(0.0, min(1.0, 1 + sum(x * math.log(max(x, 1e-12)) for x in want) / math.log(k)))
        assert r["c"] == pytest.approx(c, abs=1e-9)
        s = sorted(want, reverse=True)
        assert r["m"] == pytest.approx(s[0] - s[1] if k > 1 else s[0])
        assert r["e"] == pytest.approx(sum(i * x for i, x in enumerate(want)))
        assert math.fsum(map(math.exp, r["l"])) == pytest.approx(1)


def test_rounding_and_temperatures(spark):
    got = spark.createDataFrame([(0.12345,), (0.12355,), (-0.00005,)], "x double").select(P.round4(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [0.1234, 0.1236, 0.0]  # halves to even, as far as doubles have halves
    t = spark.createDataFrame([(0.1,), (9.0,), (1.3,), (float("nan"),), (float("inf"),), (None,)], "t double").select(P.clamp_temperature(F.col("t")).alias("y")).collect()
    assert [r["y"] for r in t] == [0.5, 5.0, 1.3, 1.0, 1.0, 1.0]
    b = spark.createDataFrame([(2,), (3,), (6,), (11,)], "k int").select(P.temperature_bucket(F.lit("choice"), F.col("k")).alias("y")).collect()
    assert [r["y"] for r in b] == ["choice:2", "choice:3-5", "choice:6-10", "choice:11+"]


def test_exact_tests():
    """Against whole-number sums, and hand-computed cases of a one-sided and two-sided paired test."""
    for n in (1, 2, 7, 30, 400):
        k = np.arange(n + 2)
        want = [sum(math.comb(n, i) for i in range(j, n + 1)) / 2**n for j in k.tolist()]
        assert T.binomial_tail(n, k) == pytest.approx(want, rel=1e-11)
    for p in (0.01, 0.3, 0.97):
        assert T.binomial_tail(12, np.arange(14), p) == pytest.approx([sum(math.comb(12, i) * p**i * (1 - p) ** (12 - i) for i in range(k, 13)) for k in range(14)], rel=1e-11)
    assert [float(T.binomial_tail(b + c, b)) for b, c in ((0, 0), (0, 5), (5, 0), (1, 0), (4, 1), (80, 20))] == pytest.approx([1, 1, 1 / 32, 1 / 2, 6 / 32, sum(math.comb(100, k) for k in range(21)) / 2**100])
    assert T.sign_test([0, 1, 5, 3], [0, 5, 1, 3]) == pytest.approx([1, 14 / 64, 14 / 64, 1])
    began = time.time()
    big = T.sign_test(np.array([500_000, 499_000, 490_000]), np.array([500_000, 501_000, 510_000]))
    # the normal approximation with a continuity correction is good to a few digits here
    assert big[:2] == pytest.approx([1, math.erfc((1000 - 0.5) / math.sqrt(500_000))], rel=1e-3) and 0 < big[2] < 1e-80 and time.time() - began < 1
    assert T.chi_square_tail([1, 1, 2, 3, 4, 2, 0, 1.5], [1.0, 16.0, 6.0, 0.0, 5.0, -1, 1, 1])[:5] == pytest.approx([math.erfc(math.sqrt(0.5)), math.erfc(math.sqrt(8.0)), math.exp(-3), 1.0, math.exp(-2.5) * 3.5], rel=1e-12)
    assert np.isnan(T.chi_square_tail([2, 0, 1.5], [-1.0, 1, 1])).all() and float(T.chi_square_tail(300, 300)) == pytest.approx(0.4891, abs=1e-3)
    assert T.least_significant_loss(100, 0, 0.05) is None and T.least_significant_loss(100, 3, 0.05) is None
    assert T.least_significant_loss(100, 10, 0.05) == pytest.approx(0.08)
    for d in range(5, 60):
        k = next(k for k in range(d + 1) if sum(math.comb(d, i) for i in range(k, d + 1)) / 2**d <= 0.05)
        assert T.least_significant_loss(200, d, 0.05) == pytest.approx((2 * k - d) / 200)
    assert T.zero_event_half_width(0) == 1.0 and T.zero_event_half_width(100) == pytest.approx(1 - 0.025 ** (1 / 100))
