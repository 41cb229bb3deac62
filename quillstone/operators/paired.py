"""Paired comparison of two runs: McNemar, exact tails, Holm, capability pooling and a promotion verdict."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quillstone.functions.tails import binomial_tail, chi_square_tail, sign_test
from quillstone.operators.evals import hit

ALPHA = 0.05


def _double(f, *cols: Column) -> Column:
    """A numpy function of numeric columns, batch by batch; null where an argument is null."""

    @F.pandas_udf(DoubleType())
    def run(*args: pd.Series) -> pd.Series:
        x = pd.concat([a.astype("float64") for a in args], axis=1)
        out = pd.Series(np.nan, index=x.index, dtype="float64")
        known = x.notna().all(axis=1)
        if known.any():
            out[known] = f(*(x.loc[known].iloc[:, i].to_numpy() for i in range(len(args))))
        return out.astype(object).where(out.notna(), None).astype("float64")

    return run(*(c.cast("double") for c in cols))


def mcnemar_p(b: Column, c: Column) -> Column:
    return _double(sign_test, b, c)


def upper_half_p(n: Column, k: Column) -> Column:
    return _double(binomial_tail, n, k)


def chi_square_p(df: Column, statistic: Column) -> Column:
    return _double(chi_square_tail, df, statistic)


def once(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key of a prediction table with repeated rows: the least values, nulls last."""
    return df.groupBy(*keys).agg(F.min(F.struct(*(F.col(v).isNull().alias(f"_{v}") for v in values), *values)).alias("_m")).select(*keys, *(F.col(f"_m.{v}").alias(v) for v in values))


def pair_runs(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("suite", "lang", "i")) -> DataFrame:
    """Rows of both runs side by side: gold, base_pred, other_pred and ``problem``.

    ``problem`` is null, or says that a row is missing on one side or that items or golds differ.
    """
    a = base.select(*keys, F.col("item").alias("item_a"), F.col("gold").alias("gold_a"), F.col("pred").alias("base_pred"), F.lit(True).alias("_a"))
    b = other.select(*keys, F.col("item").alias("item_b"), F.col("gold").alias("gold_b"), F.col("pred").alias("other_pred"), F.lit(True).alias("_b"))
    problem = F.when(F.col("_a").isNull(), "missing in base").when(F.col("_b").isNull(), "missing in other").when(F.col("item_a") != F.col("item_b"), "item differs").when(~F.col("gold_a").eqNullSafe(F.col("gold_b")), "gold differs")
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("gold_a", "gold_b").alias("gold"), "base_pred", "other_pred", problem.alias("problem"))


def paired_cells(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per cell: n, both accuracies, mean difference and its standard error, discordant counts, changed rows."""
    ok = pairs.where(F.col("problem").isNull() & F.col("gold").isNotNull())
    x, y = hit(F.col("base_pred"), F.col("gold")), hit(F.col("other_pred"), F.col("gold"))
    rows = ok.select(*by, x.alias("x"), y.alias("y"), (~F.col("base_pred").eqNullSafe(F.col("other_pred"))).alias("ch")).withColumn("d", F.col("y") - F.col("x"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("base"), F.avg("y").alias("other"), F.avg("d").alias("d"),
        F.coalesce(F.sqrt(F.var_samp("d") / F.count(F.lit(1))), F.lit(0.0)).alias("se"),
        F.count_if(F.col("d") < 0).alias("lost"), F.count_if(F.col("d") > 0).alias("gained"), F.count_if("ch").alias("changed"),
    )


def with_tests(cells: DataFrame) -> DataFrame:
    """Adds the two-sided McNemar p and one-sided p of a drop and of a gain."""
    n = F.col("lost") + F.col("gained")
    return cells.withColumns({"p_mcnemar": mcnemar_p(F.col("lost"), F.col("gained")), "p_drop": upper_half_p(n, F.col("lost")), "p_gain": upper_half_p(n, F.col("gained"))})


def holm(df: DataFrame, p: str, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``<p>_holm``: the running maximum of min(1, (m - rank + 1) p) in ascending p.

    The rows are tests of a family, one per cell, not data: a single window over them is small.
    """
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(1)])))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn(f"{p}_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def capabilities(pairs: DataFrame, capability: Column, tolerance: float = 0.02, tolerances: Mapping[str, float] | None = None, alpha: float = ALPHA, least: int = 200) -> DataFrame:
    """Cells pooled by capability: tests, Holm-adjusted, and whether the capability regressed."""
    cells = with_tests(paired_cells(pairs.withColumn("capability", capability), ["capability"]))
    cells = holm(holm(cells, "p_drop", order=["capability"]), "p_gain", order=["capability"])
    own = F.element_at(F.create_map(*(x for k, v in tolerances.items() for x in (F.lit(k), F.lit(float(v))))), F.col("capability")) if tolerances else F.lit(None).cast("double")
    tol = F.coalesce(own, F.lit(tolerance))
    return cells.withColumns({
        "underpowered": F.col("n") < least,
        "regressed": ((F.col("d") < 0) & (F.col("p_drop_holm") <= alpha)) | (F.col("d") < -tol),
        "improved": (F.col("d") > 0) & (F.col("p_gain_holm") <= alpha),
    })


def pooled_family(cells: DataFrame, family: Sequence[str], suite: str | None = None) -> DataFrame:
    """Weighted mean and standard error of cell differences: rows weigh equally, or suites do and rows within them."""
    if suite is None:
        n = cells.groupBy(*family).agg(F.count(F.lit(1)).alias("_n"))
        rows = cells.join(n, list(family)).withColumn("_w", F.lit(1.0) / F.col("_n"))
    else:
        per = cells.groupBy(*family, suite).agg(F.count(F.lit(1)).alias("_n"))
        suites = per.groupBy(*family).agg(F.count(F.lit(1)).alias("_s"))
        rows = cells.join(per, [*family, suite]).join(suites, list(family)).withColumn("_w", F.lit(1.0) / F.col("_s") / F.col("_n"))
    return rows.groupBy(*family).agg(F.sum(F.col("_w") * F.col("d")).alias("d"), F.sqrt(F.sum(F.pow(F.col("_w") * F.col("se"), 2))).alias("se"), F.count(F.lit(1)).alias("cells"))


def verdict(capability_rows: DataFrame, family: DataFrame, z: float = 2.0) -> DataFrame:
    """One row: promote, reject or keep, with the number of regressed and improved capabilities."""
    c = capability_rows.agg(F.count_if("regressed").alias("regressions"), F.count_if("improved").alias("improvements"))
    f = family.agg(F.max(F.col("d") - z * F.col("se")).alias("best"), F.min(F.col("d") + z * F.col("se")).alias("worst"))
    say = F.when((F.col("regressions") > 0) | (F.col("worst") < 0), "reject").when((F.col("improvements") > 0) | (F.col("best") > 0), "promote").otherwise("keep")
    return c.crossJoin(f).select("regressions", "improvements", say.alias("verdict"))  # one row each


def paired_by_seed(df: DataFrame, seed: str, a: str, b: str) -> DataFrame:
    """Mean paired difference, wins, losses, ties and the two-sided sign test."""
    d = F.col(b) - F.col(a)
    out = df.agg(F.avg(d).alias("mean_difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    return out.withColumn("p_sign", mcnemar_p(F.col("losses"), F.col("wins")))


def bootstrap_mean(df: DataFrame, value: str, resamples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean and bootstrap interval by Poisson weights.

    Each row has a weight in each resample, drawn from a generator seeded by the row's value and its place among equal values of its
    task; weighted sums are kept per task, so one row per task and no row per resample travels. Null values take no part; an empty table has nulls.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, wv, turn = np.zeros(resamples), np.zeros(resamples), 0
        for b in batches:
            v = b["v"].to_numpy()
            for c in range(0, len(v), 2048):
                part = v[c : c + 2048]
                key = int(np.bitwise_xor.reduce(part.view(np.uint64))) if len(part) else 0
                draw = np.random.default_rng([seed, turn, key]).poisson(1.0, (len(part), resamples))
                w += draw.sum(axis=0)
                wv += part @ draw
                turn += 1
        if turn:
            yield pd.DataFrame({"w": [w], "wv": [wv]})

    parts = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).mapInPandas(sums, "w array<double>, wv array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("w", "wv"))).groupBy("pos").agg((F.sum("col.wv") / F.sum("col.w")).alias("m"))
    tail = (1 - level) / 2
    return each.agg(F.avg("m").alias("mean"), F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))


def probability_temperature(rows: DataFrame, z: str = "logits", gold: str = "gold", bounds: tuple[float, float] = (0.5, 5.0), grid: int = 64) -> float | None:
    """The temperature of least NLL within bounds: one aggregation over a grid, one over a finer one; None below 10 rows."""
    from quillstone.functions import probability as P

    def best(ts: list[float]) -> tuple[float, int]:
        aggs = [F.avg(P.nll(P.softmax(F.col(z), t), F.col(gold))).alias(f"t{i}") for i, t in enumerate(ts)]
        r = rows.where(F.col(gold).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        return (0.0, 0) if r["n"] < 10 else (min(ts, key=lambda t: r[f"t{ts.index(t)}"]), r["n"])

    lo, hi = bounds
    coarse = [lo * (hi / lo) ** (i / 15) for i in range(16)]
    t, n = best(coarse)
    if not n:
        return None
    i = coarse.index(t)
    a, b = coarse[max(0, i - 1)], coarse[min(15, i + 1)]
    return best([a * (b / a) ** (j / (grid // 4 - 1)) for j in range(grid // 4)])[0]


def target_temperature(rows: DataFrame, target: float, z: str = "logits", bounds: tuple[float, float] = (1e-6, 1e6), passes: int = 6, grid: int = 32) -> float | None:
    """The temperature at which the mean probability of the best options is ``target``; ties share theirs.

    That mean falls with the temperature, so each pass evaluates a grid of them in one aggregation and goes on between two. Beyond the bounds
    the nearer bound is taken; None without rows.
    """
    from quillstone.functions import probability as P

    low, high = bounds
    top = F.array_max(z)
    ties = F.size(F.filter(z, lambda x: x == top))
    for _ in range(passes):
        ts = [low * (high / low) ** (i / (grid - 1)) for i in range(grid)]
        mass = [F.avg(F.array_max(P.softmax(F.col(z), t)) * ties).alias(f"t{i}") for i, t in enumerate(ts)]
        r = rows.where(F.col(z).isNotNull() & (F.size(z) > 0)).agg(F.count(F.lit(1)).alias("n"), *mass).first()
        if not r["n"]:
            return None
        above = [i for i in range(grid) if r[f"t{i}"] > target]
        if not above:
            return ts[0]
        if above[-1] == grid - 1:
            return ts[-1]
        low, high = ts[above[-1]], ts[above[-1] + 1]
    return math.sqrt(low * high)
