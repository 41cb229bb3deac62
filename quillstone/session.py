"""Session defaults and the shared folder for cut lineages."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with this library's defaults."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quillstone")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``. Only a local session may do without and gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstone-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that :func:`small` broadcasts at most.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows by count; beyond that the join shuffles. For narrow, cut tables."""
    return F.broadcast(df) if df.count() <= rows else df


def widened(df: DataFrame) -> DataFrame:
    """A scan with much work a row, over all cores even if its files are few; left alone if it has as many splits as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes that a task of a large exchange should read.
TASK_BYTES = 8_000_000


@contextmanager
def partitions_for(spark: SparkSession, size: int) -> Iterator[None]:
    """Within, exchanges have enough partitions for ``size`` bytes in all, and never fewer than configured; for eager work such as :func:`cut`."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), -(-size // TASK_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """A cut table of few bytes but much work a row, by ``key`` over as many tasks as keep cores busy; adaptive execution would leave it in one."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(most, -(-df.count() // rows))), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
