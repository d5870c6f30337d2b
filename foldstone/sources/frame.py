"""Frozen ordered tables: rows numbered by a total order, kept as Parquet sorted by the number.

Numbering sorts by ranges of the whole order, so no task sees more than its range however few dates there are: the
sorted ranges are written once, their sizes give each its first row, and a row's number is that plus its place.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW = "row_id"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where it is unset, one of this machine in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foldstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str], name: str = ROW) -> DataFrame:
    """``df`` with its 0-based position in ``order``, a total order (nulls first)."""
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__p", 33)
    sizes = [(r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    starts, first = [], 0
    for k, n in sizes:  # one for each range, not for each row
        starts.append((k, first))
        first += n
    firsts = F.broadcast(df.sparkSession.createDataFrame(starts, "__k long, __first long"))
    return placed.join(firsts, part == F.col("__k")).withColumn(name, F.col("__first") + F.col("__p") - F.shiftleft(part, 33)).drop("__p", "__k", "__first")


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the order of their clock."""
    return number_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), ["ts", "event_id"])


def save(frame: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet sorted by row, so that row ranges prune files and row groups."""
    ranged = frame.repartitionByRange(partitions, ROW) if partitions else frame.repartitionByRange(ROW)
    ranged.sortWithinPartitions(ROW).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def matrix(frame: DataFrame, columns: list[str], segments: list[tuple[int, int]] | None = None) -> DataFrame:
    """(row_id, values): the columns of each row as one array of their common type."""
    rows = frame if segments is None else frame.where(in_segments(segments))
    return rows.select(ROW, F.array(*columns).alias("values"))


def attach(frame: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """``frame`` with columns of a feature table, row by row; a name that is there already is refused."""
    if twice := sorted(set(columns) & set(frame.columns)):
        raise ValueError(f"columns {twice} are there already")
    return frame.join(features.select(ROW, *columns), ROW, "left")


def middle_stamp(frame: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: the first row of the middle distinct timestamp of rows lo to hi."""
    each = frame.where((F.col(ROW) >= lo) & (F.col(ROW) < hi)).groupBy("ts").agg(F.min(ROW).alias(ROW))
    numbered = number_rows(each, [ROW], "k")
    return numbered.where(F.col("k") == F.lit(each.count() // 2)).select(ROW)


def row_date(frame: DataFrame, row: int) -> DataFrame:
    """One row: the date of a row; -1 is the last."""
    if row < 0:
        return frame.agg(F.to_date(F.max_by("ts", ROW)).alias("day"))
    return frame.where(F.col(ROW) == row).select(F.to_date("ts").alias("day"))


def date_starts(frame: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(day, first_row, n) of each date in rows lo to hi."""
    rows = frame.where(F.col(ROW) >= lo) if hi is None else frame.where((F.col(ROW) >= lo) & (F.col(ROW) < hi))
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.min(ROW).alias("first_row"), F.count("*").alias("n"))


def date_span(frame: DataFrame) -> DataFrame:
    """One row: the first date, and the day after the last."""
    return frame.agg(F.to_date(F.min("ts")).alias("first_day"), F.date_add(F.to_date(F.max("ts")), 1).alias("after_last"))


def upto(frame: DataFrame, cut: int) -> DataFrame:
    """The first ``cut`` rows."""
    return frame.where(F.col(ROW) < cut)


def in_segments(segments: list[tuple[int, int]], row: str = ROW) -> Column:
    """Whether a row lies in one of the half-open ranges; literals, so it is pushed down to the scan."""
    out = F.lit(False)
    for lo, hi in segments:
        out = out | ((F.col(row) >= lo) & (F.col(row) < hi))
    return out


def segments_in_order(frame: DataFrame, segments: list[tuple[int, int]], visible: int | None = None) -> DataFrame:
    """Rows of the ranges with ``place``, their position in the concatenation in the order given."""
    parts, base = [], 0
    for lo, hi in segments:
        if lo < 0 or hi < lo or (visible is not None and hi > visible):
            raise ValueError(f"no such rows: {lo}..{hi}")
        parts.append(frame.where((F.col(ROW) >= lo) & (F.col(ROW) < hi)).withColumn("place", F.col(ROW) - lo + base))
        base += hi - lo
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_of(frame: DataFrame, when: str) -> DataFrame:
    """One row: the first row whose clock is at or after ``when``, else the number of rows."""
    return frame.agg(F.coalesce(F.min(F.when(F.col("ts") >= F.lit(when).cast("timestamp_ntz"), F.col(ROW))), F.count("*")).alias(ROW))


def stamps(frame: DataFrame) -> DataFrame:
    """(ts, first_row, next_row, day_idx) of each distinct timestamp; day_idx ranks the dates that have rows."""
    each = frame.groupBy("ts").agg(F.min(ROW).alias("first_row"), (F.max(ROW) + 1).alias("next_row")).withColumn("day", F.to_date("ts"))
    days = each.select("day").distinct().withColumn("day_idx", F.dense_rank().over(W.orderBy("day")).cast("long") - 1)
    return each.join(days, "day").drop("day")


def clock_faults(frame: DataFrame) -> DataFrame:
    """Numbers of null and of unsorted timestamps; both must be 0.  Rows are compared within chunks and across their ends."""
    chunk = F.floor(F.col(ROW) / 1_000_000)
    ends = frame.select(chunk.alias("c"), "ts", ROW).groupBy("c").agg(F.min_by("ts", ROW).alias("first"), F.max_by("ts", ROW).alias("last"))
    inside = frame.withColumn("prev", F.lag("ts").over(W.partitionBy(chunk).orderBy(ROW))).agg(F.count_if(F.col("ts").isNull()).alias("null_ts"), F.count_if(F.col("prev") > F.col("ts")).alias("unsorted"))
    across = ends.withColumn("prev", F.lag("last").over(W.orderBy("c"))).agg(F.count_if(F.col("prev") > F.col("first")).alias("across"))
    return inside.crossJoin(across).select("null_ts", (F.col("unsorted") + F.col("across")).alias("unsorted"))
