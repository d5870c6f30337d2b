"""What a fit or a feature may see: reveal lags, blanking, purge counts; and the probes that prove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.sources.frame import ROW, in_segments


def known_before(at_ts, at_row: int, lag: str | int | None, *, day_idx: str = "day_idx", at_day: int | None = None) -> Column:
    """Whether a row's label is known at a row: lag None, an interval such as ``INTERVAL '2' DAY``, or dates with rows."""
    if at_ts is None:
        return F.col(ROW) < at_row
    now = F.lit(at_ts).cast("timestamp_ntz")
    if lag is None:
        return F.col("ts") < now
    if isinstance(lag, int):
        return F.col(day_idx) <= F.lit(at_day - lag)
    return F.col("ts") <= now - F.expr(lag)


def masked(frame: DataFrame, target: str, known: Column) -> DataFrame:
    """The target is null where it isn't known yet."""
    return frame.withColumn(target, F.when(known, F.col(target)))


def train_view(frame: DataFrame, train: list[tuple[int, int]], keep: tuple[str, ...] = (ROW, "ts")) -> DataFrame:
    """Every row, with all columns but the clock blank outside the train segments."""
    seen = in_segments(train)
    return frame.select(*[F.col(c) if c in keep else F.when(seen, F.col(c)).alias(c) for c in frame.columns])


def probe(full: DataFrame, prefix: DataFrame, column: str, rtol: float = 1e-9) -> DataFrame:
    """Compare a feature with its recomputation on a prefix: first moved row, moved and compared rows, worst, scale.

    A row moved if the values differ by more than ``rtol`` of the largest finite value, or one of them is null.
    """
    nan = lambda c: F.when(~F.isnan(c), c)
    both = prefix.select(ROW, nan(F.col(column)).alias("q")).join(full.select(ROW, nan(F.col(column)).alias("p")), ROW)
    scale = both.agg(F.coalesce(F.max(F.abs("p")), F.lit(0.0)).alias("scale"))
    moved = F.coalesce(F.abs(F.col("p") - F.col("q")) > rtol * F.col("scale"), F.col("p").isNull() != F.col("q").isNull())
    return both.crossJoin(F.broadcast(scale)).withColumn("m", moved).agg(F.min(F.when(F.col("m"), F.col(ROW))).alias("first_moved"), F.count_if("m").alias("moved"), F.count("*").alias("compared"), F.max(F.abs(F.col("p") - F.col("q"))).alias("worst"), F.max("scale").alias("scale"))


def overlap(train: list[tuple[int, int]], test: tuple[int, int]) -> bool:
    return any(lo < test[1] and test[0] < hi for lo, hi in train)


def not_finite(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias("not_finite"), F.count("*").alias("n"))
