"""Fits by sufficient statistics, predictions, scores by fold and pooled, and paired comparisons of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.operators.splits import Fold, Refused, floors
from foldstone.sources.frame import ROW, stored

RESAMPLES, SEED, MOST_BLOCKS = 1000, 0, 5_000_000


def folds_frame(spark, folds: list[Fold]) -> DataFrame:
    rows = [(i, f.label, [tuple(t) for t in f.train], tuple(f.test)) for i, f in enumerate(folds)]
    return spark.createDataFrame(rows, "fold int, label string, train array<struct<lo:long,hi:long>>, test struct<lo:long,hi:long>")


def test_rows(frame: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows of the test ranges with their fold: an array of literals exploded, no join."""
    row = F.col(ROW)
    hits = F.array(*[F.when((row >= f.test[0]) & (row < f.test[1]), F.lit(i)) for i, f in enumerate(folds)])
    return frame.withColumn("fold", F.explode(F.array_compact(hits)))


def train_stats(frame: DataFrame, folds: list[Fold], **aggs: Column) -> DataFrame:
    """(fold, aggregates) over each fold's train rows in one pass, without repeating rows by fold.

    The ends of all segments cut the table into blocks; aggregates must be sums, taken once a block, then added up for
    the blocks inside each fold's segments.
    """
    cuts = sorted({e for f in folds for s in f.train for e in s})
    row = F.col(ROW)
    block = F.lit(0)
    for k, c in enumerate(cuts):
        block = F.when(row >= c, F.lit(k + 1)).otherwise(block)
    sums = frame.groupBy(block.alias("block")).agg(*[a.alias(n) for n, a in aggs.items()])
    inside = F.array(*[F.when(F.col("block").isin([k + 1 for k, c in enumerate(cuts) if any(lo <= c < hi for lo, hi in f.train)]), F.lit(i)) for i, f in enumerate(folds)])
    return sums.withColumn("fold", F.explode(F.array_compact(inside))).groupBy("fold").agg(*[F.sum(n).alias(n) for n in aggs])


def fit_mean(frame: DataFrame, folds: list[Fold], y: str) -> DataFrame:
    return train_stats(frame, folds, s=F.sum(y), n=F.count(y)).select("fold", (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"))


def fit_ridge(frame: DataFrame, folds: list[Fold], x: str, y: str, alpha: float) -> DataFrame:
    """Slope through the origin: sum(xy) / (sum(xx) + alpha)."""
    s = train_stats(frame, folds, xy=F.sum(F.col(x) * F.col(y)), xx=F.sum(F.col(x) * F.col(x)))
    return s.select("fold", (F.col("xy") / (F.col("xx") + alpha)).alias("slope"))


def score_folds(series: DataFrame, column: str) -> DataFrame:
    """Mean of a series by fold (null fold: pooled over all rows), in one pass."""
    return series.rollup("fold").agg(F.avg(column).alias("value"), F.count(column).alias("n"))


def mean_blend(members: DataFrame, *keys: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def rank_blend(oof: DataFrame, test: DataFrame) -> DataFrame:
    """Each member's test prediction as its share of out-of-fold predictions at or below it, averaged over members.

    Predictions of one value are counted first, and the running counts are taken within ranges of values and across
    their ends, so no task sees all of a member.
    """
    marked = oof.select("member", "prediction", F.lit(1).alias("o")).union(test.select("member", "prediction", F.lit(0)))
    values = marked.groupBy("member", "prediction").agg(F.sum("o").alias("o"))
    ranged = stored(values.repartitionByRange("member", "prediction").withColumn("part", F.spark_partition_id()), "ranks")
    ends = ranged.groupBy("member", "part").agg(F.sum("o").alias("s"))
    before = ends.select("member", "part", F.coalesce(F.sum("s").over(W.partitionBy("member").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(W.partitionBy("member")).alias("n"))
    within = F.sum("o").over(W.partitionBy("member", "part").orderBy("prediction").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = ranged.withColumn("within", within).join(F.broadcast(before), ["member", "part"])
    share = ranks.select("member", "prediction", ((F.col("before") + F.col("within")) / F.nullif("n", F.lit(0))).alias("share"))
    return test.join(share, ["member", "prediction"]).groupBy(ROW).agg(F.avg("share").alias("prediction"))


def stratified_order(frame: DataFrame, y: str, row: str = ROW, seed: int = 0) -> DataFrame:
    """Positions that spread each class evenly: by rank in class / class size (``share``), then class."""
    by = W.partitionBy(y).orderBy(F.xxhash64(F.lit(seed), row), row)
    size = frame.groupBy(y).agg(F.count("*").alias("__n")).withColumnRenamed(y, "__y")
    ranked = frame.withColumn("__r", F.row_number().over(by) - 1).join(F.broadcast(size), F.col(y).eqNullSafe(F.col("__y")))
    return ranked.withColumn("share", F.col("__r") / F.col("__n")).drop("__r", "__n", "__y")


@dataclass(frozen=True)
class Paired:
    n: int
    pooled_delta: float | None
    se_iid: float | None
    se_block: float | None
    fold_deltas: dict[int, float | None]


def exact_sums(d: DataFrame, fold: str, column: str) -> dict[int, Fraction]:
    """The exact sum of a column of doubles by fold, in whatever order rows come; null and non-finite values don't count.

    A double is a whole number of 53 bits times a power of two, so whole numbers are added up for each power, in two
    parts that don't overflow a long; at most some two thousand powers of a fold go to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(k, 1 << 16)
                m, e = np.frexp(part.column(1).to_numpy(zero_copy_only=False))
                whole = (m * 2.0**53).astype(np.int64)
                keys, at = np.unique(np.stack([part.column(0).to_numpy(zero_copy_only=False), e]), axis=1, return_inverse=True)
                sums = [np.bincount(at.ravel(), weights=x, minlength=keys.shape[1]).astype(np.int64) for x in (whole >> 27, whole & ((1 << 27) - 1))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*keys, *sums)], ["fold", "power", "high", "low"])

    finite = d.where(F.col(fold).isNotNull() & (F.abs(column) < float("inf"))).select(F.col(fold).cast("long"), F.col(column).cast("double"))
    sums = finite.mapInArrow(run, "fold long, power long, high long, low long").groupBy("fold", "power").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict[int, Fraction] = {}
    for r in sums.collect():
        out[r["fold"]] = out.get(r["fold"], Fraction()) + ((r["high"] << 27) + r["low"]) * Fraction(2) ** (r["power"] - 53)
    return out


def paired(a: DataFrame, b: DataFrame, column: str, block_rows: int | None = None, resamples: int = RESAMPLES, seed: int = SEED) -> Paired:
    """Row-paired difference of two series (fold, unit, column): its sum, the sum's standard errors, and sums by fold.

    The errors are sqrt(n) times the sample deviation, and by a block bootstrap the deviation of resampled sums; a null
    value makes a sum null.  Sums are exact and rounded once, so they don't depend on the order of rows.  A resample is drawn at a time, so the driver holds one row of draws and the block sums, of
    which there may be ``MOST_BLOCKS``.
    """
    mark = F.lit(True)
    both = a.select("fold", "unit", F.col(column).alias("x"), mark.alias("in_a")).join(b.select("fold", "unit", F.col(column).alias("y"), mark.alias("in_b")), ["fold", "unit"], "full")
    d = both.withColumn("d", F.col("x") - F.col("y"))
    total = d.agg(F.count("*").alias("n"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("lost"), F.count("d").alias("known"), F.sum("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    if total["lost"]:
        raise Refused("the series cover other rows")
    if not total["n"]:
        raise Refused("the series have no rows")
    whole = total["known"] == total["n"]
    exact = exact_sums(d, "fold", "d")
    once = lambda m, of: float(of) if m is not None and math.isfinite(m) else m
    by_fold = {r["fold"]: once(r["m"], exact.get(r["fold"], 0)) if r["k"] == r["n"] else None for r in d.groupBy("fold").agg(F.sum("d").alias("m"), F.count("d").alias("k"), F.count("*").alias("n")).orderBy("fold").collect()}
    se_block = None
    if block_rows is not None and whole:
        floors(block_rows=(block_rows, 1))
        blocks = -(-total["n"] // block_rows)
        if blocks > MOST_BLOCKS:
            raise Refused(f"{blocks} blocks, at most {MOST_BLOCKS}: take longer ones")
        sums = np.array([r["s"] for r in block_sums(d, block_rows).orderBy("block").collect()])
        rng = np.random.default_rng(seed)
        se_block = float(np.std([sums[rng.integers(0, len(sums), len(sums))].sum() for _ in range(resamples)], ddof=1))
    error = math.sqrt(total["n"]) * total["s"] if whole and total["s"] is not None else None
    return Paired(total["n"], once(total["m"], sum(exact.values())) if whole else None, error, se_block, by_fold)


def block_sums(d: DataFrame, block_rows: int) -> DataFrame:
    """Sums of ``d`` over blocks of consecutive rows in the order of (fold, unit); units are numbered from 0 by fold."""
    size = d.groupBy("fold").agg((F.max("unit") + 1).alias("size"))
    base = size.withColumn("base", F.coalesce(F.sum("size").over(W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("fold", "base")
    return d.join(F.broadcast(base), "fold").groupBy(F.floor((F.col("base") + F.col("unit")) / block_rows).alias("block")).agg(F.sum("d").alias("s"))


def paired_sets(values: DataFrame, ours: list[str], theirs: list[str], direction: str | None = None) -> DataFrame:
    """Set means by fold (pipeline, fold, value), paired: n_folds, delta_mean, delta_std, t, wins, fold_deltas in order of fold.

    Refused: an empty set, a pipeline without values, and pipelines whose values are not of the same folds.
    """
    if not ours or not theirs:
        raise Refused("a comparison needs a pipeline on each side")
    mine = values.where(F.col("value").isNotNull() & F.col("pipeline").isin([*ours, *theirs]))
    folds = {r["pipeline"]: sorted(r["f"]) for r in mine.groupBy("pipeline").agg(F.collect_set("fold").alias("f")).collect()}
    if missing := sorted(set([*ours, *theirs]) - set(folds)):
        raise Refused(f"no values of {missing}")
    if len({tuple(f) for f in folds.values()}) > 1:
        raise Refused(f"the pipelines' folds differ: {folds}")
    side = F.when(F.col("pipeline").isin(ours), "a").otherwise("b")
    means = mine.withColumn("side", side).groupBy("fold").pivot("side", ["a", "b"]).agg(F.avg("value"))
    d = means.select("fold", (F.col("a") - F.col("b")).alias("d"))
    won = F.lit(None).cast("long") if direction not in ("max", "min") else F.count_if(F.col("d") > 0 if direction == "max" else F.col("d") < 0)
    out = d.agg(F.count("d").alias("n_folds"), F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_std"), won.alias("wins"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "d"))), lambda x: x["d"]).alias("fold_deltas"))
    return out.withColumn("t", F.col("delta_mean") * F.sqrt("n_folds") / F.nullif(F.col("delta_std"), F.lit(0.0)))
