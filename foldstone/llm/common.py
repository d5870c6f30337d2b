"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator whose contract counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); where it is unset, one of this machine in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foldstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_in(text: Column) -> Column:
    """Number of words in ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows: the proof asked for before a broadcast."""
    return df.limit(most_rows + 1).count() <= most_rows


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never sent whole.

    Spark tells sizes from compressed files and takes an explode to give a row for each row, so left to itself it may
    send what the driver can't hold.
    """
    return df.hint("merge")


def sent_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` as the side of a join: broadcast if it has at most ``most_rows`` rows, else shuffled."""
    return F.broadcast(df) if small_enough(df, most_rows) else shuffled(df)
