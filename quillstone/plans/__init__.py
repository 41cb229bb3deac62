"""Named queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text", "decisions", "corpus", "evaluation", "records")


@cache
def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for m in MODULES:
        out |= import_module(f"quillstone.plans.{m}").ALL
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
