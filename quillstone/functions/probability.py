"""Option scores, probabilities and confidence as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPERATURE_BOUNDS = (0.5, 5.0)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: expressions in lambdas would otherwise be repeated per use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def round4(x: Column) -> Column:
    """Four decimals, halves to even."""
    return F.rint(x * 10000.0) / 10000.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    n = norm2(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def clamp_temperature(t: Column) -> Column:
    """Within bounds; 1 where not finite."""
    t = t.cast("double")
    bad = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    return F.when(bad, 1.0).otherwise(F.least(F.lit(TEMPERATURE_BOUNDS[1]), F.greatest(F.lit(TEMPERATURE_BOUNDS[0]), t)))


def temperature_bucket(qtype: Column, k: Column) -> Column:
    """``type:size`` with sizes 2, 3-5, 6-10 and 11+."""
    return F.concat(qtype, F.lit(":"), F.when(k <= 2, "2").when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+"))


def softmax(z: Column, t: Column | float = 1.0) -> Column:
    t = F.lit(t) if isinstance(t, (int, float)) else t
    scaled = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
    return let(let(z, scaled), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(z: Column) -> Column:
    def one(v: Column) -> Column:
        lse = let(F.array_max(v), lambda top: top + F.ln(total(F.transform(v, lambda x: F.exp(x - top)))))
        return let(lse, lambda s: F.transform(v, lambda x: x - s))

    return let(z, one)


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda x: -x * F.ln(F.least(F.lit(1.0), F.greatest(x, F.lit(1e-12))))))


def confidence(p: Column) -> Column:
    """1 minus the entropy's share of its maximum, within 0 and 1; 1 for a single option."""

    def one(v: Column) -> Column:
        c = F.lit(1.0) - entropy(v) / F.ln(F.size(v).cast("double"))
        return F.when(F.size(v) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))

    return let(p, one)


def expectation(p: Column) -> Column:
    """Mean level, levels counted from 0."""
    return total(F.transform(p, lambda x, i: x * i))


def argmax(p: Column) -> Column:
    """0-based position of the greatest value, the first of equals."""
    return let(p, lambda v: F.array_position(v, F.array_max(v)).cast("int") - 1)


def margin(p: Column) -> Column:
    """Greatest minus second greatest; a single option has its own value."""
    return let(F.sort_array(p, asc=False), lambda s: F.when(F.size(s) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(F.get(s, F.lit(0))))


def action_features(p: Column) -> Column:
    """Top value, margin, entropy's share and number of options over 255."""
    k = F.size(p)
    return F.struct(F.array_max(p).alias("top1"), margin(p).alias("margin"), F.when(k > 1, entropy(p) / F.ln(k.cast("double"))).otherwise(0.0).alias("entropy"), (k / 255.0).alias("options"))


def nll(p: Column, gold: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, gold), F.lit(1e-12)))


def brier(p: Column, gold: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - (i == gold).cast("double"), 2)))


def rotation(a: Column, r: Column) -> Column:
    """The array that starts at position ``r`` and wraps."""
    return let(a, lambda v: F.transform(v, lambda _, i: F.get(v, ((i + r) % F.size(v)).cast("int"))))
