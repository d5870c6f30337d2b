"""Site-relative line de-duplication.

A line is boilerplate of a host if it stands on more than ``max_ratio`` of the host's pages and on at least
``min_pages`` of them.  Lines are compared without the blanks around them, by a 64-bit hash; each page counts once
for a line it repeats.  Blank lines are neither counted nor dropped.

Only (host, hash) pairs are shuffled, with map-side counts; texts never are, as long as the boilerplate table has
at most ``most_broadcast`` lines (it has at most lines-per-page / max_ratio for each host).  Beyond that, texts are
joined by salted host.

Edge cases: null text stays null with no lines; null hosts form one host; a page whose lines all go keeps an empty
text; repeated rows are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import shuffled, small_enough, stored

_BLANK = " \t\r"
_SALTS = 64


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def boilerplate(pages: DataFrame, *, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line_hash, pages, host_pages) of each boilerplate line."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: _bare(x) != "")
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_bare(x))))
    counted = pages.select(F.col(host_col).alias("host"), F.explode_outer(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(hashes, F.array().cast("array<bigint>")))).alias("line_hash"))
    counts = stored(counted.groupBy("host", "line_hash").count().where(F.col("line_hash").isNull() | (F.col("count") >= min_pages)), "lines")
    totals = counts.where(F.col("line_hash").isNull()).select(F.col("host").alias("h"), F.col("count").alias("host_pages"))
    common = counts.where(F.col("line_hash").isNotNull()).join(totals, F.col("host").eqNullSafe(F.col("h")))
    return common.where(F.col("count") > F.col("host_pages") * F.lit(max_ratio)).select("host", "line_hash", F.col("count").alias("pages"), "host_pages")


def dedup_lines(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5, most_broadcast: int = 1_000_000, names: tuple[str, str] = ("n_lines", "dropped_lines")) -> DataFrame:
    """``pages`` with the boilerplate lines of each host cut from the text; adds line counts under ``names`` (or replaces them)."""
    n_lines, dropped = names
    bad = stored(boilerplate(pages, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages), "boilerplate")
    sets = bad.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line_hash").alias("__bad"))
    if small_enough(bad, most_broadcast):
        joined = pages.join(F.broadcast(sets), F.col(host_col).eqNullSafe(F.col("__host")), "left")
    else:
        salted = sets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        left = pages.withColumn("__own", F.pmod(F.xxhash64(F.col(text_col)), F.lit(_SALTS)).cast("int"))
        joined = left.join(shuffled(salted), F.col(host_col).eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains("__bad", F.xxhash64(_bare(x))))
    joined = joined.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept))
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.withColumn(n_lines, total).withColumn(dropped, F.when(F.col("__kept").isNull(), 0).otherwise(F.col(n_lines) - F.size("__kept")).cast("long")).withColumn(text_col, F.when(F.col(dropped) > 0, F.array_join("__kept", "\n")).otherwise(F.col(text_col))).drop("__host", "__bad", "__kept")
