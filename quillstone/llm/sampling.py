"""Samples that match target category proportions: exponential tilting, then the pivotal method.

Expected rows per category are ``start * exp(lambda . x)`` within bounds, calibrated by Newton iterations on the
dual to the margins of the targets: the total, each language and each value of ``gold``. Rows of one category
share ``x``, so the moments of all rows are category counts, aggregated once and distributedly; each iteration
works on the category table. Lower bounds are what a category needs as far as it has it (floors included), upper
bounds what there is: a category whose calibration saturates below its target is a gap, and what it lacks goes to the
same language and the same ``gold`` elsewhere, so that the sample has its full size whenever rows suffice.

The pivotal method draws with exactly these probabilities: two undecided rows of a category meet, one
takes over as much probability as fits and the other is decided. Every task does this over its own
rows and leaves at most one undecided row per category; those few meet again per category, and the last one of each
category meets those of the others, so that the size is exact, too. Random numbers are hashes of row ids and a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.languages import language_code
from quillstone.llm.shingles import mix
from quillstone.session import cut


def calibrate(start: np.ndarray, features: np.ndarray, totals: np.ndarray, low: np.ndarray, high: np.ndarray, soft: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Rows per category, ``start * exp(features @ lambda)`` within [low, high], whose feature totals are ``totals``.

    Newton's method with step halving on the dual, whose gradient is the difference of totals and whose Hessian is made
    of the categories that no bound holds. ``soft`` gives a feature whose total may be out of reach a small quadratic
    price on its multiplier: its total is then met as far as the bounds and the other features allow.
    """
    start, totals = np.asarray(start, dtype=float), np.asarray(totals, dtype=float)
    price = np.zeros(features.shape[1]) if soft is None else np.asarray(soft, dtype=float)
    some = (start > 0) & (high > 0)
    begin = np.log(np.where(some, start, 1.0))
    lo, hi = (np.log(np.maximum(np.where(some, x, 1.0), 1e-300)) for x in (np.minimum(low, high), high))

    def rows(lam: np.ndarray) -> np.ndarray:
        return np.where(some, np.exp(np.clip(begin + features @ lam, lo, hi)), 0.0)

    def dual(lam: np.ndarray) -> float:
        e = begin + features @ lam
        inner = np.clip(e, lo, hi)
        return float((np.where(some, np.exp(inner) * (1 + e - inner), 0.0)).sum() - totals @ lam + (price * lam * lam).sum() / 2)

    lam = np.zeros(features.shape[1])
    scale = max(1.0, float(np.abs(totals).max(initial=0.0)))
    for _ in range(steps):
        x, e = rows(lam), begin + features @ lam
        gradient = features.T @ x - totals + price * lam
        if np.abs(gradient).max(initial=0.0) < 1e-9 * scale:
            break
        free = np.where((e > lo) & (e < hi), x, 0.0)
        # a little of the bounded categories keeps the system solvable where bounds hold all of a feature
        hessian = (features.T * (free + 1e-6 * scale / max(1, len(x)))) @ features + np.diag(price)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        now, size, slope = dual(lam), 1.0, float(gradient @ step)
        while size > 1e-6 and dual(lam - size * step) > now - 1e-4 * size * slope:
            size /= 2
        if size <= 1e-6:
            break
        lam = lam - size * step
    return rows(lam)


class _Pivot:
    """At most one undecided row per category."""

    def __init__(self) -> None:
        self.open: dict[int, tuple[int, float]] = {}
        self.taken: list[int] = []

    def add(self, cat: int, row: int, p: float, u: float) -> None:
        """Row with probability p; u is its own random number."""
        if p >= 1 - 1e-12:
            self.taken.append(row)
            return
        if p <= 1e-12:
            return
        if cat not in self.open:
            self.open[cat] = (row, p)
            return
        other, q = self.open.pop(cat)
        s = p + q
        if s < 1:  # one of them is out, the other goes on with the sum
            keep = row if u < p / s else other
            self.open[cat] = (keep, s)
        else:  # one of them is in, the other goes on with the rest
            inside, rest = (row, other) if u < (1 - q) / (2 - s) else (other, row)
            self.taken.append(inside)
            if s - 1 > 1e-12:
                self.open[cat] = (rest, s - 1)


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) * 2.0**-53


class CategorySample:
    """A sample of a share of all rows whose categories have given target shares.

    ``sample`` holds (id, lang, gold), ``report`` one row per target category, both lazy.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, size: int | None = None, id_col: str = "item_id", lang: str = "lang", gold: str = "gold", share: str = "share", min_rows: str = "min_rows", seed: int = 11):
        """Plan a sample of ``size`` rows, a tenth of all (rounded down) if not given.

        A row belongs to the category of the language that its label names, in whatever spelling, and of its
        ``gold``; rows with null or meaningless labels belong to none, rows with a null id count but cannot be drawn. Null shares and floors count as 0;
        repeated targets count once (the greatest share); an empty table reports every target as not met
        unless nothing is asked for.
        """
        self.spark, self.id_col, self.seed = rows.sparkSession, id_col, seed
        self.rows = rows.select(F.col(id_col).cast("bigint").alias("_id"), language_code(F.col(lang)).alias("lang"), F.col(gold).alias("gold"))
        wanted = targets.select(F.col(lang).alias("lang"), language_code(F.col(lang)).alias("code"), F.col(gold).alias("gold"), F.coalesce(F.col(share), F.lit(0.0)).alias("share"), F.coalesce(F.col(min_rows), F.lit(0)).alias("floor")).where("lang is not null and gold is not null")
        best: dict[tuple, tuple] = {}
        for r in wanted.collect():
            key = (r["code"] or r["lang"], r["gold"])
            best[key] = max(best.get(key, (-1.0, 0, "")), (r["share"], r["floor"], r["lang"]))
        self.cats = sorted(best)
        index = {c: i for i, c in enumerate(self.cats)}
        keys = [x for c, i in index.items() for x in (F.lit(f"{c[0]}\n{c[1]}"), F.lit(i))]
        cat = F.element_at(F.create_map(*keys), F.concat_ws("\n", "lang", "gold")) if keys else F.lit(None).cast("int")
        self.keyed = self.rows.select("_id", F.when(F.col("lang").isNotNull() & F.col("gold").isNotNull(), cat).alias("_c"))
        counts = {r["_c"]: r["n"] for r in self.keyed.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        self.size = total // 10 if size is None else size
        self.have = np.array([counts.get(i, 0) for i in range(len(self.cats))], dtype=float)
        self.share = np.array([best[c][0] for c in self.cats])
        self.floor = np.array([best[c][1] for c in self.cats], dtype=float)
        self.names = [best[c][2] for c in self.cats]
        self.target = np.maximum(self.floor, self.share * self.size)
        self.planned = self._plan() if len(self.cats) else np.zeros(0)
        self.p = np.divide(self.planned, self.have, out=np.zeros(len(self.cats)), where=self.have > 0)

    def _plan(self) -> np.ndarray:
        """Rows to draw of each category."""
        have, target = self.have, self.target
        need = np.minimum(have, target)
        if need.sum() > self.size:  # floors ask for more than there is room for: categories above theirs give way
            need = np.where(have < target, have, np.minimum(have, self.floor))
        by = [np.array([c[k] == v for c in self.cats], dtype=float) for k in (0, 1) for v in sorted({c[k] for c in self.cats})]
        features = np.column_stack([np.ones(len(self.cats)), *by])
        totals = features.T @ self.share * self.size
        totals[0] = max(min(self.size, have.sum()), need.sum())
        soft = np.full(len(totals), 0.1 * max(1, self.size))
        soft[0] = 0.0
        rows = calibrate(np.maximum(target, 1e-6), features, totals, need, have, soft)
        return np.where(np.abs(rows - have) <= 1e-9 * have, have, rows)  # logarithms leave a rounding error at the bound

    def sample(self) -> DataFrame:
        """(id, lang, gold) of the rows drawn."""
        p, seed = self.p, self.seed

        def draw(pdf: pd.DataFrame, pivot: _Pivot) -> None:
            u = _uniform(pdf["_id"].to_numpy(), seed)
            for cat, row, prob, x in zip(pdf["_c"].tolist(), pdf["_id"].tolist(), pdf["_p"].tolist(), u.tolist()):
                pivot.add(cat, row, prob, x)

        def undecided(pivot: _Pivot) -> pd.DataFrame:
            return pd.DataFrame([(r, c, q) for c, (r, q) in pivot.open.items()], columns=["_id", "_c", "_p"])

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivot = _Pivot()
            for b in batches:
                draw(b.assign(_p=p[b["_c"].to_numpy()]), pivot)
                yield pd.DataFrame({"_id": pivot.taken, "_c": -1, "_p": 1.0})
                pivot.taken = []
            yield undecided(pivot)

        def second(g: pd.DataFrame) -> pd.DataFrame:  # a row per task
            pivot = _Pivot()
            draw(g.sort_values("_id"), pivot)
            return pd.concat([pd.DataFrame({"_id": pivot.taken, "_c": -1, "_p": 1.0}), undecided(pivot)])

        def last(g: pd.DataFrame) -> pd.DataFrame:  # a row per category
            pivot = _Pivot()
            draw(g.sort_values("_c").assign(_c=0), pivot)
            for row, q in pivot.open.values():  # the fraction of a row that is left
                if _uniform(np.array([row]), seed + 1)[0] < q:
                    pivot.taken.append(row)
            return pd.DataFrame({"_id": pivot.taken})

        kind = "_id bigint, _c int, _p double"
        step = cut(self.keyed.where("_c is not null and _id is not null").mapInPandas(first, kind))
        rest = cut(step.where("_c >= 0").groupBy("_c").applyInPandas(second, kind))
        ids = step.where("_c < 0").select("_id").unionByName(rest.where("_c < 0").select("_id")).unionByName(rest.where("_c >= 0").groupBy().applyInPandas(last, "_id bigint"))
        return self.rows.join(ids, "_id", "left_semi").select(F.col("_id").alias(self.id_col), "lang", "gold")

    def report(self) -> DataFrame:
        """(lang, gold, share, min_rows, target, available, planned, sampled, share_reached, met) per target category.

        ``planned`` is what calibration gives, ``share_reached`` the share among the rows drawn. A category is not met
        where all its rows are taken and its target is still above them.
        """
        drawn = {(r["lang"], r["gold"]): r["n"] for r in self.sample().groupBy("lang", "gold").agg(F.count(F.lit(1)).alias("n")).collect()} if len(self.cats) else {}
        whole = sum(drawn.values())
        out = []
        for i, c in enumerate(self.cats):
            n, planned = drawn.get(c, 0), float(self.planned[i])
            saturated = planned >= self.have[i]
            out.append((self.names[i], c[1], float(self.share[i]), int(self.floor[i]), float(self.target[i]), int(self.have[i]), planned, n, n / whole if whole else 0.0, not (saturated and planned < self.target[i] - 1e-9)))
        return self.spark.createDataFrame(out, "lang string, gold string, share double, min_rows int, target double, available bigint, planned double, sampled bigint, share_reached double, met boolean")
