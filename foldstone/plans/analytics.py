"""Questions to the log: paired scores, compared sets of pipelines, stitched predictions, costs of fits and ranges of facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.operators import scoring
from foldstone.operators.splits import Refused
from foldstone.plans import views
from foldstone.sources.frame import ROW
from foldstone.sources.log import EventLog


@dataclass(frozen=True)
class Predictions:
    values: DataFrame  # fold, row_id, prediction
    ranges: tuple[tuple[int, int], ...]
    score: str
    ids: tuple[str, ...]


def _score(log: EventLog, id: str) -> dict:
    if not log.has(id):
        raise Refused(f"no score {id}")
    return log.event(id)


def _tests(log: EventLog, score: str) -> list[tuple[int, int]]:
    declared = log.latest("evaluation_declared", key=_score(log, score)["stream"])
    return [tuple(f["test"]) for f in declared["payload"]["folds"]]


def covered(tests: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The rows that folds test, as merged ranges; folds that are not in the order of rows are refused."""
    out: list[tuple[int, int]] = []
    for lo, hi in tests:
        if out and lo < out[-1][1]:
            raise Refused("the folds are not in the order of rows")
        out = [*out[:-1], (out[-1][0], hi)] if out and lo == out[-1][1] else [*out, (lo, hi)]
    return out


def series_of(spark: SparkSession, log: EventLog, score: str, column: str) -> DataFrame:
    """(fold, unit, column) with units numbered in the order of folds over all of them, so that twins with other folds pair."""
    s = spark.read.parquet(log.table("series", score))
    if column not in s.columns:
        raise Refused(f"score {score} holds {s.columns}, not {column}")
    return s.select("fold", "unit", column)


def paired(spark: SparkSession, log: EventLog, a: str, b: str, column: str, block_rows: int | None = None) -> scoring.Paired:
    """Row-paired scores of one dataset over the same rows."""
    of = [log.latest("evaluation_declared", key=_score(log, s)["stream"])["payload"]["dataset"] for s in (a, b)]
    if of[0] != of[1]:
        raise Refused("the scores are of different datasets")
    if _tests(log, a) != _tests(log, b) and covered(_tests(log, a)) != covered(_tests(log, b)):
        raise Refused("the scores cover different rows")
    x, y = (series_of(spark, log, s, column) for s in (a, b))
    if _tests(log, a) != _tests(log, b):  # the same units under other folds take the first score's
        y = y.drop("fold").join(x.select("fold", "unit"), "unit")
    return scoring.paired(x, y, column, block_rows)


def fold_values(spark: SparkSession, log: EventLog, evaluation: str, metric: str) -> DataFrame:
    """(pipeline, fold, value, direction) of the latest score of each pipeline."""
    views.register(spark, log.events(spark))
    latest = spark.table("score_latest").where(F.col("evaluation") == evaluation).select("score", "seq")
    return spark.table("score_fold").where(F.col("metric") == metric).join(latest, "score").select("pipeline", "fold", "value", "direction", "seq")


def paired_sets(spark: SparkSession, log: EventLog, evaluation: str, metric: str, ours: list[str], theirs: list[str]) -> DataFrame:
    values = fold_values(spark, log, evaluation, metric)
    newest = values.agg(F.max_by("direction", "seq")).first()[0]
    return scoring.paired_sets(values.withColumn("fold", F.col("fold").cast("int")).select("pipeline", "fold", "value"), ours, theirs, newest)


def predictions(spark: SparkSession, log: EventLog, evaluation: str, pipeline: str) -> Predictions:
    """The predictions of a pipeline's latest score, stitched in the order of folds."""
    found = [e for e in log.scan("score_recorded", stream=evaluation) if e["payload"]["pipeline"] == pipeline]
    if not found:
        raise Refused(f"pipeline {pipeline} has no score under {evaluation}")
    of = sorted(found[-1]["payload"]["predictions"].items(), key=lambda x: int(x[0]))
    out = None
    for k, i in of:
        own = spark.read.parquet(log.table("predictions", i)).withColumn("fold", F.lit(int(k)))
        out = own if out is None else out.unionByName(own)
    return Predictions(out.select("fold", ROW, "prediction"), tuple(tuple(log.event(i)["payload"]["range"]) for _, i in of), found[-1]["id"], tuple(i for _, i in of))


def fit_costs(spark: SparkSession) -> DataFrame:
    """(score, fits, seconds) over the registered views: a fit that several members share counts once."""
    return spark.table("score_fit").groupBy("score").agg(F.count("*").alias("fits"), F.sum("duration_s").alias("seconds"))


def fact_ranges(spark: SparkSession) -> DataFrame:
    """(score, fact, least, most) of the numbers among the facts that fits keep."""
    facts = spark.table("event_fit").select(F.col("id").alias("fit"), F.from_json("facts", "map<string,string>").alias("facts"))
    each = spark.table("score_fit").select("score", "fit").join(facts, "fit").select("score", F.explode("facts").alias("fact", "v"))
    return each.withColumn("v", F.expr("try_cast(v AS DOUBLE)")).where("v IS NOT NULL").groupBy("score", "fact").agg(F.min("v").alias("least"), F.max("v").alias("most"))


def facts_of(spark: SparkSession) -> DataFrame:
    """(score, facts): the facts of all a score's fits, as one JSON array in the order of fits."""
    own = spark.table("score_fit").select("score", "fit").join(spark.table("event_fit").select(F.col("id").alias("fit"), "facts"), "fit")
    return own.groupBy("score").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fit", "facts"))), lambda x: F.coalesce(x["facts"], F.lit("null"))), ","), F.lit("]")).alias("facts"))
