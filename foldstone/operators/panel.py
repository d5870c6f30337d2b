"""Panels: a long table as a time by key grid, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(frame: DataFrame, key: str, universe: list, value: str, clock: str = "ts") -> DataFrame:
    """One row a timestamp, one column a key of ``universe`` (null: no row).  (ts, key) must be unique."""
    return frame.groupBy(clock).pivot(key, universe).agg(F.first(value))


def unpivot(grid: DataFrame, universe: list, key: str, value: str, clock: str = "ts") -> DataFrame:
    long = grid.unpivot([clock], [F.col(f"`{u}`") for u in universe], "__key", value)
    return long.where(F.col(value).isNotNull()).select(clock, F.col("__key").alias(key), value)


def duplicates(frame: DataFrame, key: str, clock: str = "ts") -> DataFrame:
    return frame.groupBy(clock, key).count().where("count > 1")


def unknown(frame: DataFrame, key: str, universe: DataFrame) -> DataFrame:
    return frame.select(key).distinct().join(universe, key, "left_anti")
