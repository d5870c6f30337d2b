"""Operators on small tables, the log, and every registered query against its SQL."""

import datetime as dt
import math
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foldstone.functions.identity import chunk_digests, table_id, ulid
from foldstone.operators import panel, scoring, visibility
from foldstone.operators.clock import FrameClock
from foldstone.operators.splits import Clock
from foldstone.plans import views
from foldstone.queries import QUERIES, SQL
from foldstone.sources import frame as fr
from foldstone.sources.log import EventLog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6) if all(isinstance(x, float) for x in a) else a == b or all(x == pytest.approx(y, rel=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, key long, px double")


def test_panel(spark):
    d1, d2 = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    f = _frame(spark, [(0, d1, 1, 10.0), (1, d1, 2, 20.0), (2, d2, 1, 11.0)])
    grid = panel.pivot(f, "key", [1, 2], "px")
    assert [tuple(r)[1:] for r in grid.orderBy("ts").collect()] == [(10.0, 20.0), (11.0, None)]
    assert sorted(r["px"] for r in panel.unpivot(grid, [1, 2], "key", "px").collect()) == [10.0, 11.0, 20.0]
    assert panel.duplicates(f.union(f), "key").count() == 3
    assert panel.unknown(f, "key", spark.createDataFrame([(1,)], "key long")).collect()[0]["key"] == 2


def test_clocks_agree(spark):
    ts = [dt.datetime(2025, 1, 1) + dt.timedelta(hours=8 * (i // 3)) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(ts)), "row_id long, ts timestamp_ntz")
    a, b = Clock.of_values(ts), FrameClock(frame)
    for row in (1, 7, 30, 59):
        assert a.snap(row) == b.snap(row) and a.back(row, 2) == b.back(row, 2)
        assert a.forward(a.snap(row), 2) == b.forward(b.snap(row), 2)
        for lag in (None, 1, dt.timedelta(hours=20)):
            assert a.known(row, lag) == b.known(row, lag)
    assert fr.clock_faults(frame.withColumn("row_id", F.lit(59) - F.col("row_id"))).first()["unsorted"] == 19


def test_probe_tolerance(spark):
    full = spark.createDataFrame(list(enumerate([1.0, -2.0, 4.0, None])), "row_id long, f double")
    near = lambda e: full.withColumn("f", F.col("f") + e)
    assert visibility.probe(near(1e-10), full, "f").first()["moved"] == 0
    moved = visibility.probe(full, near(1e-6), "f").first()
    assert (moved["moved"], moved["first_moved"], moved["scale"]) == (3, 0, 4.0)


def test_paired(spark):
    a = spark.createDataFrame([(i // 50, i % 50, float(i % 7)) for i in range(200)], "fold int, unit int, v double")
    b = a.withColumn("v", F.col("v") - 1.0)
    p = scoring.paired(a, b, "v", block_rows=10)
    assert p.n == 200 and p.pooled_delta == pytest.approx(200.0) and p.se_iid == pytest.approx(0.0) and p.se_block == pytest.approx(0.0) and len(p.fold_deltas) == 4
    with pytest.raises(ValueError):
        scoring.paired(a, b.where("fold < 3"), "v")


def test_paired_is_of_sums(spark):
    x = np.random.default_rng(3).normal(1.5, 1.0, 200)
    a = spark.createDataFrame([(i // 50, i % 50, float(v)) for i, v in enumerate(x)], "fold int, unit int, v double")
    p = scoring.paired(a, a.withColumn("v", F.lit(0.0)), "v", block_rows=15)
    sums = np.add.reduceat(x, np.arange(0, 200, 15))
    draws = np.random.default_rng(0).integers(0, len(sums), (1000, len(sums)))
    assert p.pooled_delta == pytest.approx(x.sum()) and p.se_iid == pytest.approx(np.sqrt(200) * x.std(ddof=1)) and p.se_block == pytest.approx(sums[draws].sum(axis=1).std(ddof=1))
    assert list(p.fold_deltas.values()) == pytest.approx(np.add.reduceat(x, [0, 50, 100, 150]).tolist())
    holed = a.withColumn("v", F.when(F.col("unit") != 3, F.col("v")))
    assert scoring.paired(holed, a, "v").pooled_delta is None


def test_paired_sums_are_exact(spark):
    """However rows are dealt, the sums are those of math.fsum."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-12, 17, 3000), [1e16, 1.0, -1e16, 5e-324, 0.0, -2.5e300, 2.5e300]])
    a = spark.createDataFrame([(i % 3, i // 3, float(v)) for i, v in enumerate(x)], "fold int, unit int, v double")
    zero = a.withColumn("v", F.lit(0.0))
    for parts in (1, 7):
        p = scoring.paired(a.repartition(parts, "unit"), zero, "v")
        assert p.pooled_delta == math.fsum(x) and p.fold_deltas == {k: math.fsum(x[k::3]) for k in range(3)}
    assert scoring.paired(a.withColumn("v", F.lit(float("inf"))), zero, "v").pooled_delta == float("inf")


def test_identity(spark):
    f = spark.createDataFrame([(0, None), (1, ""), (2, "x")], "row_id long, c string")
    g = spark.createDataFrame([(0, ""), (1, ""), (2, "x")], "row_id long, c string")
    one = lambda d, n: chunk_digests(d.repartition(n), ["c"], "row_id").first()["digest"]
    assert one(f, 3) == one(f, 1) != one(g, 1)
    assert table_id(f, ["c"], "row_id", {"a": 1}) != table_id(f, ["c"], "row_id", {"a": 2})
    ids = [ulid() for _ in range(100)]
    assert ids == sorted(set(ids))


def test_log(spark, tmp_path):
    log = EventLog(str(tmp_path))
    assert log.append("pipeline_declared", "p", "p", {"name": "a", "x": float("nan")}, id="one")
    assert not log.append("pipeline_declared", "p", "p", {"name": "b"}, id="one")
    log.append("score_recorded", "v", "s1", {"pipeline": "p", "sealed": True}, id="s1")
    assert not log.append("score_recorded", "v", "s1", {"pipeline": "p", "sealed": True}, id="s1")
    with pytest.raises(ValueError, match="sealed"):
        log.append("score_recorded", "v", "s2", {"pipeline": "p", "sealed": True}, id="s2")
    threads = [threading.Thread(target=lambda k=k: [log.append("note_recorded", "", "", {"text": str(i), "about": []}, id=f"n{i}") for i in range(5)]) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert log.note("hello", ["p"], "idea")
    with pytest.raises(ValueError):
        log.note("hello", [], "Bad Tag")
    assert log.get_blob(log.put_blob(b"abc")) == b"abc"
    events = log.events(spark)
    seqs = sorted(r["seq"] for r in events.collect())
    assert len(seqs) == len(set(seqs)) == 8
    views.register(spark, events)
    assert spark.sql("select * from note_about").collect()[0]["about"] == "p"
    assert spark.sql("select name from event_pipeline").collect()[0]["name"] == "a"


def test_null_fold_and_offset(spark):
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate((1.0, None, 4.0, 9.0))], "pipeline string, fold int, value double")
    r = v.agg(F.count("value").alias("n"), F.stddev_samp("value").alias("s")).first()
    assert r["n"] == 3 and r["s"] == pytest.approx(4.0414518843)
    both = v.union(v.withColumn("pipeline", F.lit("b")).withColumn("value", F.lit(0.0)))
    with pytest.raises(ValueError, match="folds differ"):
        scoring.paired_sets(both, ["a"], ["b"])
    out = scoring.paired_sets(both.where("fold <> 1"), ["a"], ["b"], "max").first()
    assert out["n_folds"] == 3 and out["wins"] == 3 and out["fold_deltas"] == [1.0, 4.0, 9.0]
    assert scoring.paired_sets(both.where("fold = 0"), ["a"], ["b"]).first()["t"] is None
