"""Streams: request batches by compatibility key, running metrics, late provenance rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: What requests must agree in to be scored together.
COMPATIBLE = ("questions", "max_len", "head_max_len", "adapter", "ensemble", "ensemble_margin", "calibrate", "return_logits", "min_confidence", "lang")


def requests(spark, path: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """New request files of a folder; ``files`` per batch is the admission limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def compatibility_key(columns: Sequence[str]) -> Column:
    """A hash of the fields that requests of one pass share."""
    return F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns if c in COMPATIBLE))


def drop_expired(df: DataFrame, deadline: str, now: Column | None = None) -> DataFrame:
    """Requests whose deadline isn't past; those without one stay."""
    return df.where(F.col(deadline).isNull() | (F.col(deadline) > (F.current_timestamp() if now is None else now)))


def numbered(rows: DataFrame, keys: Sequence[str], most: int, order: str) -> DataFrame:
    """Adds ``_pass``: rows of equal keys are scored together, at most ``most`` in a pass."""
    key = compatibility_key(keys) if keys else F.lit(0).cast("bigint")
    keyed = rows.withColumn("_key", key)
    i = F.row_number().over(Window.partitionBy("_key").orderBy(order)) - 1  # one micro-batch
    return keyed.withColumn("_pass", F.concat_ws("-", F.hex("_key"), F.floor(i / most).cast("string"))).drop("_key")


def micro_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, every: str = "2 milliseconds", deadline: str | None = None, once: bool = False, most: int = 0, order: str | None = None) -> StreamingQuery:
    """Scores each batch, partitioned by compatibility key, and writes its answers to the partition of its epoch; restarts resume from ``checkpoint``.

    A replayed epoch overwrites its own partition and nothing else, so answers are there once. With ``most`` and ``order``, rows are scored in passes
    of at most so many compatible requests (column ``_pass``).
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = drop_expired(batch, deadline) if deadline else batch
        keys = [c for c in rows.columns if c in COMPATIBLE]
        if most and order:
            rows = numbered(rows, keys, most, order).repartition("_pass")
        elif keys:
            rows = rows.withColumn("_key", compatibility_key(keys)).repartition("_key")
        score(rows.drop("_key")).write.mode("overwrite").parquet(f"{sink}/_epoch={epoch}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def windowed_metrics(stream: DataFrame, ts: str, by: Sequence[str], value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and extremes per tumbling window, for rows at most ``late`` behind; works on tables, too."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), *by, "n", "total", "least", "most")


def sessions(stream: DataFrame, ts: str, by: Sequence[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a key without a longer pause as sessions."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("events")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def observed(df: DataFrame, name: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Named running metrics beside a query, without another pass."""
    return df.observe(name, *(c.alias(k) for k, c in metrics.items()))
