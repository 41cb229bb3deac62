"""Accuracy and calibration metrics of predictions, from rows with probabilities or with predicted positions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import probability as P

BINS = 15


def hit(pred: Column, gold: Column) -> Column:
    """Whether a prediction is right; a missing one is wrong, a missing gold has no value."""
    return F.when(gold.isNotNull(), F.coalesce(pred == gold, F.lit(False)).cast("int"))


def cell_metrics(df: DataFrame, by: Sequence[str], p: str = "p", gold: str = "gold") -> DataFrame:
    """n, accuracy, NLL, Brier score and ECE (15 equal bins) per cell from rows with an array of probabilities.

    Rows of different widths pool by row count; ECE needs only the top probability and correctness.
    """
    top = F.array_max(p)
    rows = df.where(F.col(gold).isNotNull() & F.col(p).isNotNull()).select(*by, (P.argmax(F.col(p)) == F.col(gold)).cast("double").alias("_ok"), top.alias("_c"), P.nll(F.col(p), F.col(gold)).alias("_nll"), P.brier(F.col(p), F.col(gold)).alias("_b"), F.least(F.lit(BINS - 1), F.floor(top * BINS)).alias("_bin"))
    bins = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("ok"), F.sum("_c").alias("c"), F.sum("_nll").alias("nll"), F.sum("_b").alias("b"))
    n = F.sum("n")
    return bins.groupBy(*by).agg(n.alias("n"), (F.sum("ok") / n).alias("accuracy"), (F.sum("nll") / n).alias("nll"), (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("ok"))) / n).alias("ece"))


def accuracy(df: DataFrame, by: Sequence[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    rows = df.where(F.col(gold).isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit(F.col(pred), F.col(gold))).alias("accuracy"))


def balanced_accuracy(df: DataFrame, by: Sequence[str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Mean recall over the gold options that occur."""
    recall = df.where(F.col(gold).isNotNull()).groupBy(*by, gold).agg(F.avg(hit(F.col(pred), F.col(gold))).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"), F.count(F.lit(1)).alias("classes"))


def macro_average(cells: DataFrame, inner: Sequence[str], metrics: Sequence[str], outer: Sequence[str] = ()) -> DataFrame:
    """Unweighted means of cell metrics per ``inner``, then over those per ``outer``."""
    first = cells.groupBy(*outer, *inner).agg(*(F.avg(m).alias(m) for m in metrics))
    return first.groupBy(*outer).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("cells"))


def coverage_curve(df: DataFrame, confidence: str, correct: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: rows kept and escalated, coverage and accuracy of the kept; one scan, conditional sums."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        kept = F.col(confidence) >= t
        aggs += [F.count_if(kept).alias(f"k{i}"), F.sum(F.when(kept, F.col(correct).cast("int"))).alias(f"c{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("kept"), (F.col("n") - F.col(f"k{i}")).alias("escalated"), (F.col(f"k{i}") / F.col("n")).alias("coverage"), F.when(F.col(f"k{i}") > 0, F.col(f"c{i}") / F.col(f"k{i}")).alias("accuracy")) for i, t in enumerate(thresholds)))
    return one.select(F.inline(rows))


def fixed_histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of values up to each bound and without bound, as in a metrics exposition."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("all")]
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def order_statistics(df: DataFrame, value: str, by: Sequence[str], positions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column per name): the values at 0-based positions of each group's sorted values; exact.

    ``positions`` maps names to expressions of the group size. Values are counted first, then cut into ranges at approximate
    quantiles; only the ranges that hold a position are sorted, so no task holds a group. Null values take no part.
    """
    keys = list(by)
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("_g", F.to_json(F.struct(*keys)) if keys else F.lit(""))
    size = per.groupBy("_g").agg(F.sum("_c").alias("n"), F.percentile_approx("_v", [i / 256 for i in range(1, 256)], 4096).alias("_cuts"))
    placed = per.join(size, "_g").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    counts = placed.groupBy("_g", "_b").agg(F.sum("_c").alias("_m"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("bigint").alias("at")) for k, f in positions.items())))
    held = counts.withColumn("_base", before).withColumn("w", want).where("w.at >= _base and w.at < _base + _m").select("_g", "_b", "_base", F.col("w.name").alias("name"), F.col("w.at").alias("at"))
    inner = placed.join(held.select("_g", "_b").distinct(), ["_g", "_b"], "left_semi")
    inner = inner.withColumn("_end", F.sum("_c").over(Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = inner.join(held, ["_g", "_b"]).where("at >= _base + _end - _c and at < _base + _end")
    return found.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in positions))


def _linear(q: float) -> dict[str, Callable[[Column], Column]]:
    """The two positions between which a percentile is interpolated."""
    return {f"lo{q}": lambda n: F.floor(F.lit(q) * (n - 1)), f"hi{q}": lambda n: F.ceil(F.lit(q) * (n - 1))}


def _between(q: float) -> Column:
    at = F.lit(q) * (F.col("n") - 1)
    return F.col(f"`lo{q}`") + (at - F.floor(at)) * (F.col(f"`hi{q}`") - F.col(f"`lo{q}`"))


def latency_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, extremes, nearest-rank percentiles (p50, p95) and interpolated ones (median, p95_linear)."""
    keys = list(by)
    nearest = lambda q: lambda n: F.ceil(F.lit(q) * n) - 1
    at = order_statistics(df, value, keys, {"min": lambda n: F.lit(0), "max": lambda n: n - 1, "p50": nearest(0.5), "p95": nearest(0.95)} | _linear(0.5) | _linear(0.95))
    at = at.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "n", "min", "max", "p50", "p95", _between(0.5).alias("median"), _between(0.95).alias("p95_linear"))
    mean = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))
    same = [mean[k].eqNullSafe(at[f"_k_{k}"]) for k in keys] or [F.lit(True)]
    return mean.join(at, same).select(*keys, "n", "mean", "min", "max", "p50", "p95", "median", "p95_linear")


def throughput_summary(df: DataFrame, ts: str, value: str, size: str, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, kind, n, mean, ..., per_second): latencies of short and long requests apart (``size`` up to ``limit`` or above), and how many end a second."""
    rows = df.withColumn("kind", F.when(F.col(size) <= limit, "short").otherwise("long"))
    keys = [*by, "kind"]
    span = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max(ts).cast("double") - F.min(ts).cast("double")).alias("_s"))
    rate = span.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.when(F.col("_s") > 0, F.col("_n") / F.col("_s")).alias("per_second"))
    out = latency_summary(rows, value, keys)
    return out.join(rate, [out[k].eqNullSafe(rate[f"_k_{k}"]) for k in keys]).drop(*(f"_k_{k}" for k in keys))


def floor_index_percentile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The value at position floor(q * (n - 1)) of the sorted values."""
    return order_statistics(df, value, by, {"value": lambda n: F.floor(F.lit(q) * (n - 1))}).drop("n")


def rounded_index_percentile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The value at position min(n - 1, floor(q * n)) of the sorted values."""
    return order_statistics(df, value, by, {"value": lambda n: F.least(n - 1, F.floor(F.lit(q) * n))}).drop("n")


def drift(df: DataFrame, ts: str, value: str, seconds: int = 3600, tolerance: float = 1.5) -> DataFrame:
    """Medians and 95th percentiles of the first and last ``seconds`` of a log, and whether the growth is tolerable."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    span = F.expr(f"interval {seconds} seconds")
    rows = df.crossJoin(F.broadcast(ends))  # one row
    first, last = F.col(ts) <= F.col("a") + span, F.col(ts) >= F.col("b") - span
    tagged = rows.select(F.col(value).alias("v"), F.explode(F.array_compact(F.array(F.when(first, "first"), F.when(last, "last")))).alias("end"))
    at = order_statistics(tagged, "v", ["end"], _linear(0.5) | _linear(0.95)).select("end", _between(0.5).alias("median"), _between(0.95).alias("p95"))
    m = at.agg(*(F.max(F.when(F.col("end") == e, F.col(k))).alias(f"{e}_{k}") for k in ("median", "p95") for e in ("first", "last")))
    return m.withColumn("median_ok", F.col("last_median") <= F.col("first_median") * tolerance).withColumn("p95_ok", F.col("last_p95") <= F.col("first_p95") * tolerance)


def performance_verdict(df: DataFrame, by: Sequence[str], run: str = "run", old: str = "old", new: str = "new", tolerance: float = 0.03) -> DataFrame:
    """slower, faster or same: the median relative change beyond max(tolerance, 3 noise), and all runs on one side."""
    d = df.withColumn("_d", (F.col(new) - F.col(old)) / F.col(old))
    mid = d.groupBy(*by).agg(F.median("_d").alias("change"), F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.count(F.lit(1)).alias("runs"))
    noise = d.join(mid, list(by)).groupBy(*by).agg(F.median(F.abs(F.col("_d") - F.col("change"))).alias("noise"))
    out = mid.join(noise, list(by))
    limit = F.greatest(F.lit(tolerance), 3 * F.col("noise"))
    verdict = F.when((F.col("change") > limit) & (F.col("lo") > 0), "slower").when((F.col("change") < -limit) & (F.col("hi") < 0), "faster").otherwise("same")
    return out.select(*by, "runs", "change", "noise", verdict.alias("verdict"))
