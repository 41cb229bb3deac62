"""Blocks of documents in which all pairs of allowed sizes meet, with a bounded number of shingles each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut, small

#: Groups whose cuts are broadcast at most.
GROUPS = 20_000


def placed_blocks(sizes: DataFrame, docs: DataFrame, t: float, block: int, probe_block: int, steps: int = 64, least: int = 1, upward: bool = False) -> DataFrame:
    """(ih, band, sub, part and the columns of ``docs``): the documents at every block that they take part in.

    ``sizes`` holds (ih, _role, n) of each document, ``docs`` also th, by which they are spread.

    Bands are cut at quantiles of the set sizes of role 1 (``steps`` to choose from), weighted by shingles; a band that still has more than
    ``block`` of them, as where sizes tie, is spread over ``sub`` by hash. Documents of role 0 go to all subs of a band, spread over
    ``part``. A document weighs ``least`` shingles or more. With ``upward``, documents of role 0 meet no smaller ones.
    """
    edges = ", ".join(f"{i / steps}D" for i in range(1, steps))
    is_eval = F.col("_role") == 1
    band = lambda n: F.expr(f"size(filter(cuts, c -> c < {n}))")
    weight = F.greatest(F.col("n"), F.lit(least)).cast("long")
    hist = cut(sizes.groupBy("ih", "n").agg(F.sum(F.when(is_eval, weight).otherwise(0)).alias("e"), F.sum(F.when(is_eval, 0).otherwise(weight)).alias("p")))
    groups = hist.groupBy("ih").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.expr(f"percentile(n, array({edges}), e)").alias("q")).where("e > 0 and p > 0")
    groups = groups.withColumns({"blocks": F.ceil(F.col("e") / block).cast("int"), "parts": F.ceil(F.col("p") / probe_block).cast("int")})
    groups = groups.withColumn("bands", F.least(F.col("blocks"), F.lit(steps)))
    cuts = f"case when bands <= 1 then cast(array() as array<double>) else array_distinct(transform(sequence(1, bands - 1), i -> element_at(q, cast(ceil(i * {steps} / bands) as int)))) end"
    groups = groups.withColumn("cuts", F.expr(cuts)).select("ih", "parts", "cuts")
    filled = hist.where("e > 0").join(groups, "ih").groupBy("ih", band("n").alias("band")).agg(F.ceil(F.sum("e") / block).cast("int").alias("of"))
    subs = filled.groupBy("ih").agg(F.map_from_entries(F.collect_list(F.struct("band", "of"))).alias("subs"))
    placed = docs.join(small(cut(groups.join(subs, "ih")), GROUPS), "ih")
    lo = F.when(is_eval, band("n")).otherwise(band("n" if upward else f"floor(n * {t} - 1e-6)"))
    hi = F.when(is_eval, band("n")).otherwise(band(f"ceil(n / {t} + 1e-6)"))
    salt = lambda of: F.pmod(F.xxhash64("th", F.lit(7)), of).cast("int")
    placed = placed.withColumns({"band": F.explode(F.sequence(lo, hi)), "_part": salt(F.col("parts"))})
    placed = placed.withColumn("of", F.expr("try_element_at(subs, band)")).where("of is not null")  # no evaluation text in the band otherwise
    placed = placed.withColumn("sub", F.explode(F.when(is_eval, F.array(salt(F.col("of")))).otherwise(F.sequence(F.lit(0), F.col("of") - 1))))
    placed = placed.withColumn("part", F.explode(F.when(is_eval, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("_part"))))
    # a join by group leaves all blocks of a group in one task, and that would be enough for what follows; adaptive execution
    # would join small blocks with much work
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("band", "sub", "part", *docs.columns).repartition(tasks, "ih", "band", "sub", "part")
