"""Slots of a small experiment: functions over DataFrames, for the tests of runs."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.operators.splits import BlockedKFold
from foldstone.plans.experiment import Evaluation, Pipeline, Scorer, mean_blend
from foldstone.sources.dataset import record


def ingest(spark, log, rows="600"):
    df = spark.range(int(rows)).selectExpr("id AS k", "CAST(pmod(xxhash64(id), 1000) AS DOUBLE) / 1000 AS x", "0.5 * pmod(xxhash64(id), 1000) / 1000 + CAST(pmod(xxhash64(id, 1), 1000) AS DOUBLE) / 1000 AS y", "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ '2025-01-01 00:00:00') AS ts")
    return record(log, df, order=["ts", "k"], source="small", targets=["y"])


def fit_slope(view, params):
    s = view.frame.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx")).first()
    return {"slope": s["xy"] / (s["xx"] + params.get("alpha", 0.0))}


def predict_slope(model, frame, rows):
    return frame.where(F.col("row_id") >= rows[0]).select("row_id", (F.col("x") * model["slope"]).alias("prediction"))


def fit_mean(view, params):
    return view.frame.agg(F.avg("y")).first()[0]


def predict_mean(model, frame, rows):
    return frame.where(F.col("row_id") >= rows[0]).select("row_id", F.lit(model).alias("prediction"))


def predict_leak(model, frame, rows):
    return frame.where(F.col("row_id") >= rows[0]).select("row_id", F.avg("x").over(W.partitionBy(F.lit(1))).alias("prediction"))


def fit_broken(view, params):
    raise RuntimeError("no fit")


def fit_weight(view, params, members):
    both = members[0].join(members[1].withColumnRenamed("prediction", "q"), "row_id").join(view.frame.select("row_id", "y"), "row_id")
    s = both.agg(F.sum((F.col("y") - F.col("q")) * (F.col("prediction") - F.col("q"))).alias("a"), F.sum((F.col("prediction") - F.col("q")) ** 2).alias("b")).first()
    return {"w": s["a"] / s["b"]}


def predict_weight(model, frame, rows, members):
    return members[0].join(members[1].withColumnRenamed("prediction", "q"), "row_id").select("row_id", (F.col("prediction") * model["w"] + F.col("q") * (1 - model["w"])).alias("prediction"))


def clip(predictions, frame, rows, config):
    return predictions.withColumn("prediction", F.least("prediction", F.lit(config["most"])))


def lagged(frame):
    return frame.select("row_id", F.lag("x").over(W.partitionBy(F.lit(1)).orderBy("row_id")).alias("before"))


def ahead(frame):
    return frame.select("row_id", F.lead("x").over(W.partitionBy(F.lit(1)).orderBy("row_id")).alias("after"))


def series(rows, params):
    return rows.select(F.col("row_id").alias("unit"), ((F.col("y") - F.col("prediction")) ** 2).alias("se"))


def metrics():
    return {"mse": F.avg("se")}


SLOPE, MEAN = Pipeline("slope", fit_slope, predict_slope), Pipeline("mean", fit_mean, predict_mean)
BLEND, LEARNT = mean_blend("blend", (SLOPE, MEAN)), Pipeline("learnt", fit_weight, predict_weight, members=(SLOPE, MEAN))
PIPELINES = [SLOPE, MEAN]


def evaluations(dataset):
    return [Evaluation(dataset, BlockedKFold(3), Scorer(series, metrics, {"mse": "min"}), "kfold")]
