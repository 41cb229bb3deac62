"""Metrics, paired comparisons and label reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import probability as P
from quillstone.functions.languages import language_code
from quillstone.operators import decide as D
from quillstone.operators import evals as E
from quillstone.operators import paired as R
from quillstone.operators import pairing as J
from quillstone.operators import quality as Q
from quillstone.plans.decisions import _soft
from quillstone.plans.text import _CODE, _TOK
from quillstone.session import table

KEYS = ["suite", "lang", "i"]


def _preds(s: SparkSession, d: str) -> DataFrame:
    return R.once(table(s, d, "prediction_items"), ["model", *KEYS], ["item", "gold", "pred"])


def _pairs(s: SparkSession, d: str) -> DataFrame:
    p = _preds(s, d)
    return R.pair_runs(p.where("model = 'base'").drop("model"), p.where("model = 'multilingual'").drop("model"))


def accuracy_by_cell(s: SparkSession, d: str) -> DataFrame:
    return E.accuracy(_preds(s, d), ["model", "suite", "lang"]).select("model", "suite", "lang", "n", F.round("accuracy", 9).alias("accuracy"))


def balanced_by_suite(s: SparkSession, d: str) -> DataFrame:
    return E.balanced_accuracy(_preds(s, d), ["model", "suite"]).select("model", "suite", "classes", F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


def macro_accuracy(s: SparkSession, d: str) -> DataFrame:
    m = E.macro_average(E.accuracy(_preds(s, d), ["model", "suite", "lang"]), ["suite"], ["accuracy"], ["model"])
    return m.select("model", "cells", F.round("accuracy", 9).alias("accuracy"))


def _probabilities(s: SparkSession, d: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    rows = table(s, d, "verify").select("suite", "type", F.col("state"), F.transform("options", lambda o: F.concat_ws(" ", o["key"], o["description"])).alias("options"), (F.array_position(keys, F.col("gold")) - 1).cast("int").alias("gold"))
    rows = D.LexicalScorer().logits(rows.where("gold >= 0"))
    return rows.withColumn("p", P.softmax(F.col("logits"), 1.0))


def calibration_metrics(s: SparkSession, d: str) -> DataFrame:
    m = E.cell_metrics(_probabilities(s, d), ["suite"])
    return m.select("suite", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "nll", "brier", "ece")))


def coverage_curve(s: SparkSession, d: str) -> DataFrame:
    p = _probabilities(s, d).select(F.round(F.array_max("p"), 6).alias("c"), (P.argmax(F.col("p")) == F.col("gold")).alias("ok"))
    c = E.coverage_curve(p, "c", "ok", [0.0, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
    return c.select("threshold", "kept", "escalated", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


def difficulty_shares(s: SparkSession, d: str) -> DataFrame:
    p = _probabilities(s, d).select("suite", F.round(F.array_max("p"), 6).alias("c"), (P.argmax(F.col("p")) == F.col("gold")).alias("ok"))
    q = Q.difficulty(p, ["suite"], F.col("ok"), F.col("c"), 0.4)
    return q.select("suite", "n", F.round("trivial", 9).alias("trivial"), F.round("confidently_wrong", 9).alias("confidently_wrong"))


def joined_predictions(s: SparkSession, d: str) -> DataFrame:
    """Evaluation items with the prediction of each model beside them; a missing one is wrong."""
    items = table(s, d, "verify").where("split in ('dev', 'test')").select("id", "suite").distinct()
    p = _preds(s, d).groupBy(F.col("item").alias("id"), "suite")
    wide = p.pivot("model", ["base", "multilingual"]).agg(F.max((F.col("pred") == F.col("gold")).cast("int")))
    j = items.join(wide, ["id", "suite"], "left")
    right = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint")
    return j.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), right(F.col("base")).alias("base"), right(F.col("multilingual")).alias("multilingual"))


def paired_runs(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count("gold").alias("with_gold"))


def paired_cells(s: SparkSession, d: str) -> DataFrame:
    c = R.paired_cells(_pairs(s, d), ["suite", "lang"])
    return c.select("suite", "lang", "n", "lost", "gained", "changed", *(F.round(x, 9).alias(x) for x in ("base", "other", "d", "se")))


def mcnemar_by_suite(s: SparkSession, d: str) -> DataFrame:
    c = R.with_tests(R.paired_cells(_pairs(s, d), ["suite"]))
    return c.select("suite", "n", "lost", "gained", *(F.round(x, 9).alias(x) for x in ("p_mcnemar", "p_drop", "p_gain")))


def holm_by_suite(s: SparkSession, d: str) -> DataFrame:
    c = R.with_tests(R.paired_cells(_pairs(s, d), ["suite"]))
    h = R.holm(c, "p_mcnemar", order=["suite"])
    return h.select("suite", F.round("p_mcnemar", 9).alias("p"), F.round("p_mcnemar_holm", 9).alias("p_holm"))


def capability_tests(s: SparkSession, d: str) -> DataFrame:
    cap = F.when(F.col("suite").isin("emotion", "sentiment", "sarcasm"), "tone").when(F.col("suite").isin("safety", "urgency"), "risk").otherwise("content")
    c = R.capabilities(_pairs(s, d), cap)
    return c.select("capability", "n", "lost", "gained", F.round("d", 9).alias("d"), "underpowered", "regressed", "improved")


def promotion_verdict(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    caps = R.capabilities(pairs, F.col("suite"))
    fam = R.pooled_family(R.paired_cells(pairs, ["suite", "lang"]).withColumn("family", F.lit("all")), ["family"])
    return R.verdict(caps, fam)


def pooled_difference(s: SparkSession, d: str) -> DataFrame:
    cells = R.paired_cells(_pairs(s, d), ["suite", "lang"]).withColumn("family", F.lit("all"))
    a = R.pooled_family(cells, ["family"]).withColumn("weights", F.lit("rows"))
    b = R.pooled_family(cells, ["family"], "suite").withColumn("weights", F.lit("suites"))
    return a.unionByName(b).select("weights", "cells", F.round("d", 9).alias("d"), F.round("se", 9).alias("se"))


def seed_comparison(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of both models by suite and language as paired values."""
    c = table(s, d, "categories_multilingual").where("accuracy is not null and lang <> 'macro'").groupBy("suite", "lang").pivot("model", ["base", "multilingual"]).agg(F.max("accuracy"))
    out = R.paired_by_seed(c.where("base is not null and multilingual is not null"), "suite", "base", "multilingual")
    return out.select(F.round("mean_difference", 9).alias("mean_difference"), "wins", "losses", "ties", F.round("p_sign", 9).alias("p_sign"))


def evaluation_records(s: SparkSession, d: str) -> DataFrame:
    cells = E.accuracy(_preds(s, d).where("model = 'base'"), ["suite", "lang"]).select("suite", "lang", "accuracy")
    r = J.evaluation_records(cells, table(s, d, "verify").select("suite"), ["accuracy"])
    return r.select("kind", "suite", "lang", F.round("accuracy", 9).alias("accuracy"))


def difference_intervals(s: SparkSession, d: str) -> DataFrame:
    c = J.difference_interval(R.paired_cells(_pairs(s, d), ["suite"]))
    return c.select("suite", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def suite_mismatch(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("suite").distinct()
    c = table(s, d, "categories_multilingual").select("suite").where("suite is not null").distinct()
    return v.exceptAll(c).withColumn("only_in", F.lit("items")).union(c.exceptAll(v).withColumn("only_in", F.lit("metrics")))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    m = E.latency_summary(table(s, d, "events"), "value", ["event_type"])
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), "min", "max", "p50", "p95", F.round("median", 6).alias("median"), F.round("p95_linear", 6).alias("p95_linear"))


def floor_percentile(s: SparkSession, d: str) -> DataFrame:
    return E.floor_index_percentile(table(s, d, "events"), "value", 0.95, ["event_type"])


def value_histogram(s: SparkSession, d: str) -> DataFrame:
    return E.fixed_histogram(table(s, d, "events"), "value", [5, 10, 25, 50, 100, 250], ["event_type"])


def value_drift(s: SparkSession, d: str) -> DataFrame:
    m = E.drift(table(s, d, "events"), "ts", "value", 86400)
    return m.select(*(F.round(c, 6).alias(c) for c in ("first_median", "last_median", "first_p95", "last_p95")), "median_ok", "p95_ok")


def position_balance(s: SparkSession, d: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    v = table(s, d, "verify").select("suite", F.size("options").alias("k"), F.when(F.array_position(keys, F.col("gold")) > 0, F.array_position(keys, F.col("gold")) - 1).alias("pos"))
    b = Q.position_balance(v, ["suite"], "pos", "k")
    return b.select("suite", "k", "n", F.round("chi_square", 6).alias("chi_square"))


def balance_p_values(s: SparkSession, d: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    v = table(s, d, "verify").select("suite", F.size("options").alias("k"), F.when(F.array_position(keys, F.col("gold")) > 0, F.array_position(keys, F.col("gold")) - 1).alias("pos"))
    return Q.position_balance(v, ["suite"], "pos", "k").select("suite", "k", F.round("p_value", 9).alias("p_value"))


def position_bins(s: SparkSession, d: str) -> DataFrame:
    keys = F.transform("options", lambda o: o["key"])
    v = table(s, d, "verify").select("type", F.size("options").alias("k"), F.when(F.array_position(keys, F.col("gold")) > 0, F.array_position(keys, F.col("gold")) - 1).alias("pos"))
    return Q.position_histogram(v, ["type"], "pos", "k")


def distinct_bigrams(s: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(language_code(F.col("lang")), F.lit("en"))
    q = Q.distinct_n(table(s, d, "verify"), ["suite"], "instructions", code, 2)
    return q.select("suite", "distinct", "total", F.round("distinct_n", 9).alias("distinct_n"))


def common_openings(s: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(language_code(F.col("lang")), F.lit("en"))
    q = Q.top_prefix(table(s, d, "verify"), ["suite"], "instructions", code)
    return q.select("suite", "n", "prefix", "count", F.round("share", 9).alias("share"))


def reused_keys(s: SparkSession, d: str) -> DataFrame:
    q = Q.key_reuse(table(s, d, "verify").where("type = 'choice'"), F.transform("options", lambda o: o["key"]))
    return q.select("key", "n", F.round("share", 9).alias("share"))


def closed_labels(s: SparkSession, d: str) -> DataFrame:
    return Q.label_sets(table(s, d, "verify"), ["suite", "type"], F.transform("options", lambda o: o["key"]))


def constant_labels(s: SparkSession, d: str) -> DataFrame:
    q = Q.constant_labels(table(s, d, "verify"), ["suite"], "gold", 0.4)
    return q.select("suite", "n", "gold", F.round("share", 9).alias("share"))


def label_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return Q.vocabulary(table(s, d, "verify"), ["suite"], "gold", 3)


def sample_fingerprints(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "verify").select("suite", "item_id", "state", "instructions", "gold")
    return Q.fingerprint(v, ["suite"], F.concat_ws("\x1f", F.col("item_id").cast("string"), *(F.coalesce(c, F.lit("\x1e")) for c in ("state", "instructions", "gold"))))


_P = "p AS (SELECT model, suite, lang, i, m.item AS item, m.gold AS gold, m.pred AS pred FROM (SELECT model, suite, lang, i, min({'a': item IS NULL, 'b': gold IS NULL, 'c': pred IS NULL, 'item': item, 'gold': gold, 'pred': pred}) AS m FROM prediction_items GROUP BY ALL))"
_J = _P + """, a AS (SELECT *, 1 AS f FROM p WHERE model = 'base'), b AS (SELECT *, 1 AS f FROM p WHERE model = 'multilingual'),
    j AS (SELECT coalesce(a.suite, b.suite) AS suite, coalesce(a.lang, b.lang) AS lang, coalesce(a.gold, b.gold) AS gold, a.pred AS bp, b.pred AS op,
        CASE WHEN a.f IS NULL THEN 'missing in base' WHEN b.f IS NULL THEN 'missing in other' WHEN a.item <> b.item THEN 'item differs' WHEN a.gold IS DISTINCT FROM b.gold THEN 'gold differs' END AS problem
        FROM a FULL JOIN b ON a.suite = b.suite AND a.lang = b.lang AND a.i = b.i),
    r AS (SELECT *, coalesce(bp = gold, false)::INT AS x, coalesce(op = gold, false)::INT AS y FROM j WHERE problem IS NULL AND gold IS NOT NULL)"""
_CELL = "count(*) AS n, count(*) FILTER (WHERE y < x) AS lost, count(*) FILTER (WHERE y > x) AS gained"
_CH = "count(*) FILTER (WHERE bp IS DISTINCT FROM op) AS changed"
_SE = "coalesce(sqrt(var_samp(y - x) / count(*)), 0.0)"
_Z = "WITH v AS (SELECT suite, list_distinct(regexp_extract_all(lower(state), '[a-z0-9]+')) AS w, list_transform(options, lambda o: concat_ws(' ', o.key, o.description)) AS o, list_position(list_transform(options, lambda o: o.key), gold) AS g FROM verify), z AS (SELECT suite, g, list_transform(o, lambda x: len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+')), w))::DOUBLE) AS l FROM v WHERE g > 0), pp AS (SELECT suite, g, " + _soft("l") + " AS p FROM z), q AS (SELECT suite, g, p, round(list_max(p), 6) AS c, (list_position(p, list_max(p)) = g)::INT AS ok FROM pp)"
_TAIL = lambda n, k: f"CASE WHEN {k} <= 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0)))), 0.0) END"
_TESTED = f"t AS (SELECT *, least(1.0, 2 * ({_TAIL('(lost + gained)', 'greatest(lost, gained)')})) AS p_mcnemar, {_TAIL('(lost + gained)', 'lost')} AS p_drop, {_TAIL('(lost + gained)', 'gained')} AS p_gain FROM c)"
_HOLM = lambda p, key: f"max(least(1.0, ((SELECT count(*) FROM t) - r_{p} + 1) * {p})) OVER (ORDER BY {p}, {key} ROWS UNBOUNDED PRECEDING) AS {p}_holm"
_RANK = lambda p, key: f"row_number() OVER (ORDER BY {p}, {key}) AS r_{p}"
_CAPS = lambda key: f"k AS (SELECT *, {_RANK('p_drop', key)}, {_RANK('p_gain', key)} FROM t), h AS (SELECT *, {_HOLM('p_drop', key)}, {_HOLM('p_gain', key)} FROM k), v AS (SELECT *, n < 200 AS underpowered, (d < 0 AND p_drop_holm <= 0.05) OR d < -0.02 AS regressed, d > 0 AND p_gain_holm <= 0.05 AS improved FROM h)"
_BY = lambda key: f"c AS (SELECT {key}, {_CELL}, avg(y - x) AS d FROM r GROUP BY 1)"
#: erfc by the mean of exp(-z^2 / sin^2) over a quarter turn; the rest by the recurrence in the degrees of freedom.
_CHI = "CASE WHEN k < 2 THEN NULL WHEN (k - 1) % 2 = 0 THEN exp(-x / 2) * coalesce(list_sum(list_transform(range(0, (k - 1) // 2), lambda j: exp(j * ln(greatest(x / 2, 1e-300)) - lgamma(j + 1.0)))), 0) ELSE list_avg(list_transform(range(0, 2000), lambda j: exp(-x / 2 / pow(sin((j + 0.5) * pi() / 4000), 2)))) + coalesce(list_sum(list_transform(range(1, (k - 2) // 2 + 1), lambda j: exp((j - 0.5) * ln(greatest(x / 2, 1e-300)) - x / 2 - lgamma(j + 0.5)))), 0) END"
_POS = "WITH v AS (SELECT suite, type, len(options) AS k, list_position(list_transform(options, lambda o: o.key), gold) AS pos FROM verify)"

ALL = {
    "accuracy_by_cell": (accuracy_by_cell, f"WITH {_P} SELECT model, suite, lang, count(*) AS n, round(avg(coalesce(pred = gold, false)::INT), 9) AS accuracy FROM p WHERE gold IS NOT NULL GROUP BY ALL"),
    "balanced_by_suite": (balanced_by_suite, f"WITH {_P}, r AS (SELECT model, suite, gold, avg(coalesce(pred = gold, false)::INT) AS r FROM p WHERE gold IS NOT NULL GROUP BY ALL) SELECT model, suite, count(*) AS classes, round(avg(r), 9) AS balanced_accuracy FROM r GROUP BY ALL"),
    "macro_accuracy": (macro_accuracy, f"WITH {_P}, c AS (SELECT model, suite, lang, avg(coalesce(pred = gold, false)::INT) AS a FROM p WHERE gold IS NOT NULL GROUP BY ALL), t AS (SELECT model, suite, avg(a) AS a FROM c GROUP BY ALL) SELECT model, count(*) AS cells, round(avg(a), 9) AS accuracy FROM t GROUP BY model"),
    "calibration_metrics": (calibration_metrics, _Z + ", b AS (SELECT suite, least(14, floor(list_max(p) * 15)) AS bin, count(*) AS n, sum(ok) AS ok, sum(list_max(p)) AS c, sum(-ln(greatest(p[g], 1e-12))) AS nll, sum(list_sum(list_transform(p, lambda x, i: pow(x - (i = g)::INT, 2)))) AS b FROM q GROUP BY ALL) SELECT suite, sum(n)::BIGINT AS n, round(sum(ok) / sum(n), 6) AS accuracy, round(sum(nll) / sum(n), 6) AS nll, round(sum(b) / sum(n), 6) AS brier, round(sum(abs(c - ok)) / sum(n), 6) AS ece FROM b GROUP BY suite"),
    "coverage_curve": (coverage_curve, _Z + ", t(threshold) AS (VALUES (0.0::DOUBLE), (0.2), (0.3), (0.4), (0.5), (0.7), (0.9)) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE c >= threshold) AS kept, count(*) FILTER (WHERE c < threshold) AS escalated, round(count(*) FILTER (WHERE c >= threshold) / count(*), 9) AS coverage, round(avg(ok) FILTER (WHERE c >= threshold), 9) AS accuracy FROM q, t GROUP BY threshold"),
    "difficulty_shares": (difficulty_shares, _Z + " SELECT suite, count(*) AS n, round(count(*) FILTER (WHERE ok = 1 AND c >= 0.4) / count(*), 9) AS trivial, round(count(*) FILTER (WHERE ok = 0 AND c >= 0.4) / count(*), 9) AS confidently_wrong FROM q GROUP BY suite"),
    "joined_predictions": (joined_predictions, f"WITH {_P}, w AS (SELECT item AS id, suite, max((pred = gold)::INT) FILTER (WHERE model = 'base') AS b, max((pred = gold)::INT) FILTER (WHERE model = 'multilingual') AS m FROM p GROUP BY ALL), i AS (SELECT DISTINCT id, suite FROM verify WHERE split IN ('dev', 'test')) SELECT i.suite, count(*) AS items, coalesce(sum(b), 0)::BIGINT AS base, coalesce(sum(m), 0)::BIGINT AS multilingual FROM i LEFT JOIN w ON w.id = i.id AND w.suite = i.suite GROUP BY i.suite"),
    "paired_runs": (paired_runs, f"WITH {_J} SELECT problem, count(*) AS n, count(gold) AS with_gold FROM j GROUP BY problem"),
    "paired_cells": (paired_cells, f"WITH {_J} SELECT suite, lang, {_CELL}, {_CH}, round(avg(x), 9) AS base, round(avg(y), 9) AS other, round(avg(y - x), 9) AS d, round({_SE}, 9) AS se FROM r GROUP BY ALL"),
    "mcnemar_by_suite": (mcnemar_by_suite, f"WITH {_J}, {_BY('suite')}, {_TESTED} SELECT suite, n, lost, gained, round(p_mcnemar, 9) AS p_mcnemar, round(p_drop, 9) AS p_drop, round(p_gain, 9) AS p_gain FROM t"),
    "holm_by_suite": (holm_by_suite, f"WITH {_J}, {_BY('suite')}, {_TESTED}, k AS (SELECT *, {_RANK('p_mcnemar', 'suite')} FROM t), h AS (SELECT *, {_HOLM('p_mcnemar', 'suite')} FROM k) SELECT suite, round(p_mcnemar, 9) AS p, round(p_mcnemar_holm, 9) AS p_holm FROM h"),
    "capability_tests": (capability_tests, f"WITH {_J}, " + _BY("CASE WHEN suite IN ('emotion', 'sentiment', 'sarcasm') THEN 'tone' WHEN suite IN ('safety', 'urgency') THEN 'risk' ELSE 'content' END AS capability") + f", {_TESTED}, {_CAPS('capability')} SELECT capability, n, lost, gained, round(d, 9) AS d, underpowered, regressed, improved FROM v"),
    "promotion_verdict": (promotion_verdict, f"WITH {_J}, {_BY('suite')}, {_TESTED}, {_CAPS('suite')}, m AS (SELECT avg(d) AS d, sqrt(sum(se * se)) / count(*) AS se FROM (SELECT avg(y - x) AS d, {_SE} AS se FROM r GROUP BY suite, lang)), o AS (SELECT count(*) FILTER (WHERE regressed) AS regressions, count(*) FILTER (WHERE improved) AS improvements FROM v) SELECT regressions, improvements, CASE WHEN regressions > 0 OR d + 2 * se < 0 THEN 'reject' WHEN improvements > 0 OR d - 2 * se > 0 THEN 'promote' ELSE 'keep' END AS verdict FROM o, m"),
    "pooled_difference": (pooled_difference, f"WITH {_J}, c AS (SELECT suite, lang, avg(y - x) AS d, {_SE} AS se FROM r GROUP BY ALL), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER () AS wr, 1.0::DOUBLE / count(*) OVER (PARTITION BY suite) / (SELECT count(DISTINCT suite) FROM c) AS ws FROM c) SELECT 'rows' AS weights, count(*) AS cells, round(sum(wr * d), 9) AS d, round(sqrt(sum(pow(wr * se, 2))), 9) AS se FROM w UNION ALL SELECT 'suites', count(*), round(sum(ws * d), 9), round(sqrt(sum(pow(ws * se, 2))), 9) FROM w"),
    "seed_comparison": (seed_comparison, f"WITH w AS (SELECT suite, lang, max(accuracy) FILTER (WHERE model = 'base') AS b, max(accuracy) FILTER (WHERE model = 'multilingual') AS m FROM categories_multilingual WHERE accuracy IS NOT NULL AND lang <> 'macro' GROUP BY ALL), c AS (SELECT avg(m - b) AS d, count(*) FILTER (WHERE m > b) AS wins, count(*) FILTER (WHERE m < b) AS losses, count(*) FILTER (WHERE m = b) AS ties FROM w WHERE b IS NOT NULL AND m IS NOT NULL) SELECT round(d, 9) AS mean_difference, wins, losses, ties, round(least(1.0, 2 * ({_TAIL('(wins + losses)', 'greatest(wins, losses)')})), 9) AS p_sign FROM c"),
    "evaluation_records": (evaluation_records, f"WITH {_P}, c AS (SELECT suite, lang, avg(coalesce(pred = gold, false)::INT) AS a FROM p WHERE gold IS NOT NULL AND model = 'base' GROUP BY ALL) SELECT 'cell' AS kind, suite, lang, round(a, 9) AS accuracy FROM c UNION ALL SELECT 'macro', suite, 'macro', round(avg(a), 9) FROM c GROUP BY suite UNION ALL SELECT DISTINCT 'skipped', suite, NULL, NULL::DOUBLE FROM verify WHERE suite NOT IN (SELECT suite FROM c)"),
    "difference_intervals": (difference_intervals, f"WITH {_J}, c AS (SELECT suite, {_CELL}, avg(y - x) AS d, {_SE} AS se FROM r GROUP BY suite), h AS (SELECT *, sqrt(pow(1.96 * se, 2) + CASE WHEN lost + gained = 0 THEN pow(1 - pow(0.025, 1.0 / n), 2) ELSE 0 END) AS w FROM c) SELECT suite, round(d - w, 9) AS lo, round(d + w, 9) AS hi FROM h"),
    "suite_mismatch": (suite_mismatch, "SELECT DISTINCT suite, 'items' AS only_in FROM verify WHERE suite NOT IN (SELECT suite FROM categories_multilingual WHERE suite IS NOT NULL) UNION ALL SELECT DISTINCT suite, 'metrics' FROM categories_multilingual WHERE suite IS NOT NULL AND suite NOT IN (SELECT suite FROM verify WHERE suite IS NOT NULL)"),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95_linear FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "floor_percentile": (floor_percentile, "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = floor(0.95 * (n - 1))"),
    "value_histogram": (value_histogram, "WITH b(le, v) AS (VALUES ('5', 5), ('10', 10), ('25', 25), ('50', 50), ('100', 100), ('250', 250), ('+Inf', NULL)) SELECT event_type, le, count(value) FILTER (WHERE v IS NULL OR value <= v) AS n FROM events, b GROUP BY ALL"),
    "value_drift": (value_drift, "WITH e AS (SELECT value, epoch_us(ts) / 1e6 AS t, min(epoch_us(ts)) OVER () / 1e6 AS a, max(epoch_us(ts)) OVER () / 1e6 AS b FROM events), m AS (SELECT quantile_cont(value, 0.5) FILTER (WHERE t <= a + 86400) AS fm, quantile_cont(value, 0.5) FILTER (WHERE t >= b - 86400) AS lm, quantile_cont(value, 0.95) FILTER (WHERE t <= a + 86400) AS fp, quantile_cont(value, 0.95) FILTER (WHERE t >= b - 86400) AS lp FROM e) SELECT round(fm, 6) AS first_median, round(lm, 6) AS last_median, round(fp, 6) AS first_p95, round(lp, 6) AS last_p95, lm <= fm * 1.5 AS median_ok, lp <= fp * 1.5 AS p95_ok FROM m"),
    "position_balance": (position_balance, _POS + ", c AS (SELECT suite, k, pos, count(*) AS c FROM v WHERE pos > 0 GROUP BY ALL) SELECT suite, k::INT AS k, sum(c)::BIGINT AS n, round(CASE WHEN sum(c) / k >= 5 THEN sum(c * c) / (sum(c) / k) - sum(c) END, 6) AS chi_square FROM c GROUP BY suite, k"),
    "balance_p_values": (balance_p_values, _POS + f", c AS (SELECT suite, k, pos, count(*) AS c FROM v WHERE pos > 0 GROUP BY ALL), x AS (SELECT suite, k::INT AS k, CASE WHEN sum(c) / k >= 5 THEN (sum(c * c) / (sum(c) / k) - sum(c))::DOUBLE END AS x FROM c GROUP BY suite, k) SELECT suite, k, round({_CHI}, 9) AS p_value FROM x"),
    "position_bins": (position_bins, _POS + " SELECT type, least(4, floor((pos - 1) * 5 / greatest(1, k - 1)))::INT AS bin, count(*) AS n FROM v WHERE pos > 0 GROUP BY ALL"),
    "distinct_bigrams": (distinct_bigrams, f"WITH a AS (SELECT suite, instructions, coalesce({_CODE}, 'en') AS code FROM verify v), b AS (SELECT suite, {_TOK} AS t FROM a), g AS (SELECT suite, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) AS g FROM b) SELECT suite, count(DISTINCT g) AS distinct, count(*) AS total, round(count(DISTINCT g) / count(*), 9) AS distinct_n FROM g GROUP BY suite"),
    "common_openings": (common_openings, f"WITH a AS (SELECT suite, instructions, coalesce({_CODE}, 'en') AS code FROM verify v), b AS (SELECT suite, CASE WHEN code IN ('ja', 'zh') THEN array_to_string(({_TOK})[1:3], '') ELSE array_to_string(({_TOK})[1:3], ' ') END AS prefix FROM a), c AS (SELECT suite, prefix, count(*) AS c FROM b GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY suite) AS n, row_number() OVER (PARTITION BY suite ORDER BY CASE WHEN prefix = '' THEN 1 ELSE 0 END, c DESC, prefix) AS r FROM c) SELECT suite, n::BIGINT AS n, prefix, c AS count, round(c / n, 9) AS share FROM r WHERE r = 1"),
    "reused_keys": (reused_keys, "WITH v AS (SELECT list_distinct(list_transform(options, lambda o: o.key)) AS k FROM verify WHERE type = 'choice'), u AS (SELECT unnest(k) AS key FROM v) SELECT key, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 9) AS share FROM u GROUP BY key ORDER BY n DESC, key LIMIT 20"),
    "closed_labels": (closed_labels, "SELECT suite, type, count(DISTINCT list_sort(list_transform(options, lambda o: o.key))) AS sets, count(*) AS n, count(DISTINCT list_sort(list_transform(options, lambda o: o.key))) = 1 AS closed FROM verify GROUP BY ALL"),
    "constant_labels": (constant_labels, "WITH c AS (SELECT suite, gold, count(*) AS c FROM verify WHERE gold IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY suite) AS n, row_number() OVER (PARTITION BY suite ORDER BY c DESC, gold DESC) AS r FROM c) SELECT suite, n::BIGINT AS n, gold, round(c / n, 9) AS share FROM r WHERE r = 1 AND n >= 20 AND c / n >= 0.4"),
    "label_vocabulary": (label_vocabulary, "SELECT suite, gold, n, rank::INT AS rank FROM (SELECT suite, gold, count(*) AS n, row_number() OVER (PARTITION BY suite ORDER BY count(*) DESC, gold) AS rank FROM verify WHERE gold IS NOT NULL GROUP BY suite, gold) WHERE rank <= 3"),
    "sample_fingerprints": (sample_fingerprints, "WITH h AS (SELECT suite, sha256(concat_ws(chr(31), item_id::VARCHAR, coalesce(state, chr(30)), coalesce(instructions, chr(30)), coalesce(gold, chr(30)))) AS h FROM verify) SELECT suite, count(*) AS n, sha256(concat_ws('|', sum(('0x' || substring(h, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substring(h, 13, 12))::BIGINT)::VARCHAR, count(*)::VARCHAR)) AS fingerprint FROM h GROUP BY suite"),
}
