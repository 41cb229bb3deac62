"""Caps, seeded strata, spreads and splits. Draws are hash ranks: the same rows for the same seed in any layout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.session import cut


def seeded(seed: int | str, *cols: str | Column) -> Column:
    """A hexadecimal rank: SHA-256 of the seed and columns on lines."""
    return F.sha2(F.concat_ws("\n", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols)), 256)


def same(left: DataFrame, right: DataFrame, columns: Sequence[str], prefix: str = "_k_") -> Column:
    """Equality of columns with their prefixed counterparts; nulls are equal."""
    return reduce(lambda x, y: x & y, (left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in columns))


def keyed(df: DataFrame, columns: Sequence[str], prefix: str = "_k_") -> DataFrame:
    """The same rows with prefixed key columns, for :func:`same`."""
    return df.select(*(F.col(c).alias(f"{prefix}{c}") if c in columns else F.col(c) for c in df.columns))


def running(df: DataFrame, by: Sequence[str], rank: str, id_col: str, weight: Column | None = None, name: str = "_r") -> DataFrame:
    """Adds the running sum of a weight (of 1 by default, hence the position) of each group in the order of a hexadecimal hash.

    Sums per 4096 hash buckets come first, so that no task sorts more than a bucket of a group, however large the group is.
    """
    rows = df.withColumns({"_w": F.lit(1) if weight is None else weight, "_b": F.conv(F.substring(rank, 1, 3), 16, 10).cast("int")})
    per = rows.groupBy(*by, "_b").agg(F.sum("_w").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = keyed(per.select(*by, "_b", before.alias("_base")), [*by, "_b"])
    inner = rows.withColumn("_in", F.sum("_w").over(Window.partitionBy(*by, "_b").orderBy(rank, id_col).rowsBetween(Window.unboundedPreceding, 0)))
    return inner.join(base, same(inner, base, [*by, "_b"])).withColumn(name, F.col("_in") + F.col("_base")).select(*df.columns, name)


def cap_share(df: DataFrame, group: Sequence[str], key: str, share: float, id_col: str, seed: int | str, salt: str = "", trim_only_key: bool = False) -> DataFrame:
    """Keeps of each key at most max(1, floor(share * n)) rows of its group, the least in seeded order.

    A group with one key is left alone unless ``trim_only_key``. Sizes are counted before the cap; null keys are a key.
    """
    by = [*group, key]
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    size = keyed(per.groupBy(*group).agg(F.sum("_all").alias("_n"), F.count(F.lit(1)).alias("_k")), group)
    limit = F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-9))
    keep = F.when((F.col("_k") == 1) & F.lit(not trim_only_key), F.col("_all")).otherwise(F.least(F.col("_all"), limit))
    plan = keyed(per.join(size, same(per, size, group)).select(*by, keep.alias("_keep"), "_all"), by)
    rows = df.join(plan, same(df, plan, by)).select(*df.columns, "_keep", "_all")
    # only groups that lose rows are ranked
    tight = rows.where(F.col("_keep") < F.col("_all")).withColumn("_h", seeded(seed, F.concat(F.lit(salt), F.concat_ws("/", *group)), id_col))
    kept = running(tight, by, "_h", id_col).where(F.col("_r") <= F.col("_keep"))
    return rows.where(F.col("_keep") >= F.col("_all")).select(df.columns).unionByName(kept.select(df.columns))


def per_group(df: DataFrame, group: Sequence[str], n: int, id_col: str, seed: int | str) -> DataFrame:
    """Up to ``n`` rows of each group, the least in seeded order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(seeded(seed, id_col), id_col))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, buckets: Sequence[str], n: int, id_col: str, seed: int | str, within: Sequence[str] = (), weights: Column | None = None) -> DataFrame:
    """``n`` rows per ``within``, drawn in turn from its buckets; a bucket of weight w gives w rows a turn.

    A row's turn is its seeded rank in the bucket over the weight; the first ``n`` in order of (turn, bucket) are
    the draw. No bucket gives more than ``n`` rows, so ranks are cut there before the second window.
    """
    w = Window.partitionBy(*within, *buckets).orderBy("_h", id_col)
    rows = df.withColumn("_h", seeded(seed, id_col)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    turn = F.col("_r") if weights is None else F.ceil(F.col("_r") / weights)
    order = Window.partitionBy(*(within or [F.lit(1)])).orderBy(turn, *buckets, "_r")
    return rows.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= n).drop("_h", "_r", "_p")


def indexed(df: DataFrame, order: Sequence[str], name: str = "_i") -> DataFrame:
    """Adds 0-based positions in a total order: ranges are sorted in parallel, their sizes give the offsets.

    The sorted ranges are written to the shared folder, so offsets fit the rows whatever is lost later.
    """
    spark = df.sparkSession
    parts = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("lo")).orderBy("_part").collect()
    total, rows = 0, []
    for r in sizes:
        rows.append((r["_part"], total - r["lo"]))
        total += r["n"]
    shift = spark.createDataFrame(rows, "_part int, _off bigint")
    return parts.join(F.broadcast(shift), "_part").withColumn(name, F.col("_m") + F.col("_off")).drop("_part", "_m", "_off")  # one row per partition


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_at") -> DataFrame:
    """Adds 0-based positions within groups: one parallel sort by group and order, less the position of each group's first row.

    Unlike a window it lets a group span many tasks. Groups of nulls are groups; ``order`` should be total.
    """
    rows = indexed(df, [*by, *order], name)
    first = keyed(rows.groupBy(*by).agg(F.min(name).alias("_first"), F.count(F.lit(1)).alias(f"{name}_of")), by)
    return rows.join(first, same(rows, first, by)).withColumn(name, F.col(name) - F.col("_first")).select(*df.columns, name, f"{name}_of")


def offset_sample(df: DataFrame, order: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, one at a seeded position of each of ``n`` equal stretches of a total order."""
    rows = indexed(df, order)
    total = rows.count()
    if total <= n:
        return rows.drop("_i")
    stratum = F.floor(F.col("_i") * n / total)
    lo, hi = F.ceil(stratum * total / n), F.ceil((stratum + 1) * total / n)
    pick = lo + F.pmod(F.conv(F.substring(seeded(seed, stratum), 1, 12), 16, 10).cast("bigint"), hi - lo)
    return rows.where(F.col("_i") == pick).drop("_i")


def block_sample(df: DataFrame, order: Sequence[str], n: int, blocks: int, least: int = 25) -> DataFrame:
    """``blocks`` evenly spaced runs of consecutive rows, ``n`` rows in all, at least ``least`` a run."""
    rows = indexed(df, order)
    total = rows.count()
    size = max(least, n // max(1, blocks))
    step = max(size, total // max(1, blocks))
    return rows.where((F.col("_i") % step < size) & (F.floor(F.col("_i") / step) < blocks)).drop("_i")


def spread_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Rows at positions ``int(k * total / n)``."""
    rows = indexed(df, order)
    total = rows.count()
    if total <= n:
        return rows.drop("_i")
    return rows.where(F.floor((F.col("_i") * n + n - 1) / total) * total <= F.col("_i") * n + n - 1).where(F.col("_i") == F.floor(F.floor((F.col("_i") * n + n - 1) / total) * total / n)).drop("_i")


def apportion(df: DataFrame, by: Sequence[str], weight: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``: (by, quota); one row per category, ties by name."""
    w = Window.partitionBy(F.lit(1))
    exact = df.withColumn("_e", F.col(weight) * total / F.sum(weight).over(w)).withColumn("_f", F.floor("_e"))
    left = exact.withColumn("_l", F.lit(total) - F.sum("_f").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_e") - F.col("_f")), *by))
    return left.withColumn("quota", (F.col("_f") + (rank <= F.col("_l")).cast("int")).cast("bigint")).drop("_e", "_f", "_l")


def temperature_budget(df: DataFrame, by: Sequence[str], n: str, budget: int, t: float) -> DataFrame:
    """(by, n, want, passes, rest): ``budget`` times n^(1/t) shares, at least 1 each; whole passes and a remainder."""
    w = F.pow(F.col(n), 1.0 / t)
    share = w / F.sum(w).over(Window.partitionBy(F.lit(1)))  # one row per category
    want = F.greatest(F.lit(1), F.rint(share * budget)).cast("bigint")
    return df.withColumn("want", want).withColumn("passes", F.floor(F.col("want") / F.col(n))).withColumn("rest", F.col("want") % F.col(n))


def resample(df: DataFrame, plan: DataFrame, by: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Rows repeated as a budget plan says: every row ``passes`` times, the least ``rest`` once more; adds ``pass``."""
    rows = running(df.join(plan.select(*by, "passes", "rest"), list(by)).withColumn("_h", seeded(seed, id_col)), by, "_h", id_col)
    times = F.col("passes") + (F.col("_r") <= F.col("rest")).cast("int")
    return rows.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_r", "_h", "passes", "rest")


def split_dev(df: DataFrame, source: str, key: Column, share: float, seed: int | str) -> DataFrame:
    """Adds ``split``: dev for whole keys, in seeded order per source, while their rows stay within the share; else train.

    A key is dev in all sources or in none.
    """
    rows = df.withColumn("_key", F.sha2(key, 256))
    per = rows.groupBy(source, "_key").agg(F.count(F.lit(1)).alias("_c")).withColumn("_h", seeded(seed, "_key"))
    size = keyed(per.groupBy(source).agg(F.sum("_c").alias("_n")), [source])
    run = running(per, [source], "_h", "_key", F.col("_c"), "_run")
    dev = run.join(size, same(run, size, [source])).where(F.col("_run") <= F.floor(F.col("_n") * share)).select("_key").distinct().withColumn("_dev", F.lit(True))
    return rows.join(dev, "_key", "left").withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).drop("_key", "_dev")


def drop_leaked(df: DataFrame, n_dev: int, order: Sequence[str], key: Column) -> DataFrame:
    """The first ``n_dev`` rows in a total order are dev; later rows with the key of a dev row are dropped. Adds ``split``.

    Every row is either among the first or later: positions are counted, so ties and null orders lose none; null keys match none.
    """
    rows = indexed(df.withColumn("_key", key), [F.col(c).asc_nulls_last() for c in order], "_i")
    dev = rows.where(F.col("_i") < n_dev)
    train = rows.where(F.col("_i") >= n_dev).join(dev.select("_key").distinct(), "_key", "left_anti")
    tagged = lambda d, x: d.select(*df.columns, F.lit(x).alias("split"))
    return tagged(dev, "dev").unionByName(tagged(train, "train"))


def common_keys(df: DataFrame, key: str, part: str, parts: int, label: str | None = None) -> DataFrame:
    """Keys present in all ``parts`` parts, with equal labels if given: a parallel corpus."""
    aggs = [F.countDistinct(part).alias("_n")] + ([F.countDistinct(label).alias("_l")] if label else [])
    out = df.groupBy(key).agg(*aggs).where(F.col("_n") == parts)
    return (out.where("_l <= 1") if label else out).select(key)
