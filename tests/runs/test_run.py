"""Runs over a recorded table: work counts, refusals, and what the log answers after."""

import datetime as dt

import small_project as small
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone import cli
from foldstone.functions.identity import code_key, git_blob
from foldstone.operators import guards
from foldstone.operators.splits import Clock, Fold, Holdout, Refused, WalkForward
from foldstone.plans import analytics, views
from foldstone.plans.experiment import Evaluation, Pipeline, Scorer
from foldstone.plans.run import run, why
from foldstone.sources import dataset as ds
from foldstone.sources import formats
from foldstone.sources.log import EventLog


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    log = EventLog(str(tmp_path_factory.mktemp("ledger")), "ann")
    small.ingest(spark, log)
    return log


def counts(r):
    return (r.fits, r.predictions, r.scores)


def test_work_counts(spark, log):
    """A run computes what the log lacks; a rerun writes nothing; a dry run counts the same and writes nothing."""
    (e,) = small.evaluations(ds.resolve(log))
    before = len(log.scan())
    assert counts(run(spark, log, e, small.PIPELINES, dry=True)) == (6, 6, 2) and len(log.scan()) == before
    first = run(spark, log, e, small.PIPELINES)
    assert counts(first) == (6, 6, 2) and not first.failed
    before = len(log.scan())
    again = run(spark, log, e, small.PIPELINES)
    assert counts(again) == (0, 0, 0) and (again.fits_reused, again.predictions_reused, again.scores_reused) == (6, 6, 2) and len(log.scan()) == before
    clipped = Pipeline("clipped", small.fit_slope, small.predict_slope, postprocess=small.clip, postprocess_config={"most": 0.4})
    r = run(spark, log, e, [clipped], probe=False)
    assert counts(r) == (0, 3, 1) and r.fits_reused == 3 and r.predictions_reused == 3
    blend = run(spark, log, e, [*small.PIPELINES, small.BLEND], probe=False)
    assert counts(blend) == (0, 3, 1)
    found = analytics.predictions(spark, log, e.id, small.BLEND.id)
    assert found.values.count() == 600 and found.ranges == ((0, 200), (200, 400), (400, 600))


def test_learnt_blend(spark, log):
    """A fold takes the fit, its two members' and those of their five out-of-fold blocks."""
    e = Evaluation(ds.resolve(log), Holdout(0.5), Scorer(small.series, small.metrics, {"mse": "min"}), "half")
    learnt = run(spark, log, e, [small.LEARNT], probe=False)
    assert not learnt.failed and counts(learnt) == (1 + 2 + 2 * 5, 1 + 2 + 2 * 5, 1)


def test_questions_to_the_log(spark, log):
    (e,) = small.evaluations(ds.resolve(log))
    run(spark, log, e, small.PIPELINES, probe=False)
    views.register(spark, log.events(spark))
    board = {r["name"]: r for r in spark.sql("select * from board").collect()}
    assert board["slope"]["rank"] >= 1 and board["slope"]["n_folds"] == 3
    a, b = board["slope"]["score"], board["mean"]["score"]
    p = analytics.paired(spark, log, a, b, "se", block_rows=20)
    x, y = ({r["unit"]: r["se"] for r in spark.read.parquet(log.table("series", s)).collect()} for s in (a, b))
    d = np.array([x[k] - y[k] for k in range(600)])
    assert p.pooled_delta == pytest.approx(d.sum()) and p.se_iid == pytest.approx(np.sqrt(600) * d.std(ddof=1)) and len(p.fold_deltas) == 3
    sets = analytics.paired_sets(spark, log, e.id, "mse", [small.SLOPE.id], [small.MEAN.id]).first()
    assert sets["n_folds"] == 3 and sets["fold_deltas"] == pytest.approx((d.reshape(3, 200).mean(axis=1)).tolist())
    assert {r["fits"] for r in analytics.fit_costs(spark).where(F.col("score").isin(a, b)).collect()} == {3}
    with pytest.raises(Refused, match="no values"):
        analytics.paired_sets(spark, log, e.id, "mse", ["nobody"], [small.MEAN.id])
    assert analytics.covered([(0, 5), (5, 9), (12, 14)]) == [(0, 9), (12, 14)]
    with pytest.raises(Refused):
        analytics.covered([(5, 9), (0, 5)])
    assert log.sql(spark, "select name from event_pipeline where id = :id", {"id": small.SLOPE.id}) == [{"name": "slope"}]
    assert why(log, "fit_computed", {"label": "block 0", "train": "other"}) == ["train"]


def test_failures_and_leaks(spark, log):
    (e,) = small.evaluations(ds.resolve(log))
    broken, leaky = Pipeline("broken", small.fit_broken, small.predict_mean), Pipeline("leaky", small.fit_mean, small.predict_leak)
    r = run(spark, log, e, [broken, leaky, small.MEAN])
    assert set(r.failed) == {"broken", "leaky"} and "read past row" in r.failed["leaky"] and r.scores_reused == 1
    assert {x["key"] for x in log.scan("pipeline_failed")} == {broken.id, leaky.id}
    good, bad = Pipeline("lag", small.fit_mean, small.predict_mean, features=(small.lagged,)), Pipeline("lead", small.fit_mean, small.predict_mean, features=(small.ahead,))
    r = run(spark, log, e, [good, bad])
    assert set(r.failed) == {"lead"} and "read past row" in r.failed["lead"]
    kept = log.latest("features_computed")["payload"]
    assert kept["columns"] == ["before"] and 5 <= len(kept["probe_rows"]) <= 10
    with pytest.raises(Refused):
        Pipeline("none", predict=small.predict_mean)
    with pytest.raises(ValueError):
        Pipeline("lambda", lambda v, p: 0, small.predict_mean)


def test_records(spark, tmp_path):
    log = EventLog(str(tmp_path), "ann")
    with pytest.raises(Refused):
        ds.resolve(log)
    own = small.ingest(spark, log, "100")
    assert small.ingest(spark, log, "100") == own and len(log.scan("dataset_recorded")) == 1
    df = spark.read.parquet(log.table("rows", own)).drop("row_id")
    with pytest.raises(Refused, match="another recipe"):
        ds.record(log, df, order=["ts", "k"], source="other", targets=["y"])
    sealed = ds.record(log, df, order=["ts", "k"], source="sealed", targets=["y"], reveal={"y": dt.timedelta(minutes=2)}, sealed_from="2025-01-01T01:00:00", auxiliary_rows=10)
    data = ds.load(log, spark, sealed)
    assert (data.sealed_from, data.head, data.targets, data.rows) == (60, 10, {"y": dt.timedelta(minutes=2)}, 100) and data.columns() == ["k", "x", "y"]
    assert ds.resolve(log, "sealed") == sealed == ds.resolve(log, sealed[:8])
    with pytest.raises(Refused):
        ds.resolve(log)
    for wrong in ({"targets": []}, {"targets": ["y"], "sealed_from": 0}, {"targets": ["y"], "auxiliary_rows": 100}, {"targets": ["y"], "reveal": {"y": 0}}):
        with pytest.raises(Refused):
            ds.record(log, df, order=["ts", "k"], source="wrong", **wrong)
    with pytest.raises(KeyError):
        ds.record(log, df, order=["ts", "k"], source="wrong", targets=["z"])
    assert ds.visible(data, data.clock(), 50, 40).where("y is not null").count() == 39
    scorer = Scorer(small.series, small.metrics, {"mse": "min"})
    e = Evaluation(sealed, WalkForward(60, 40, 40, embargo_rows=1, min_folds=1), scorer, "final", sealed=True)
    assert not run(spark, log, e, [small.MEAN], probe=False).failed and run(spark, log, e, [small.MEAN], probe=False).scores_reused == 1
    with pytest.raises(Refused, match="not known yet"):
        run(spark, log, Evaluation(sealed, Holdout(60), scorer, sealed=True), [small.MEAN])
    with pytest.raises(Refused, match="sealed"):
        run(spark, log, Evaluation(sealed, Holdout(60), scorer), [small.MEAN])
    other = EventLog(str(tmp_path), "bob")
    assert ds.resolve(other, "sealed") == sealed


def test_guards():
    fold = lambda train, test: Fold("f", train, test)
    with pytest.raises(Refused, match="trains on rows"):
        guards.refuse_overlap([fold(((0, 10),), (5, 12))])
    with pytest.raises(Refused, match="only train"):
        guards.refuse_head([fold(((0, 10),), (10, 12))], 11)
    clock = Clock.of_values([dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i // 2) for i in range(400)])
    with pytest.raises(Refused, match="1 folds.*198 to 199; purge 2"):
        guards.refuse_unrevealed(clock, {"y": dt.timedelta(minutes=2)}, [fold(((0, 200),), (200, 250))])
    guards.refuse_sealed([fold(((0, 5),), (10, 15)), fold(((0, 15),), (15, 20))], 10, True)
    for folds, sealed_from, sealed in (([fold(((0, 5),), (9, 15))], 10, True), ([fold(((0, 5),), (9, 15))], 10, False), ([fold(((0, 15),), (15, 20))], 10, True), ([fold(((0, 5),), (5, 7))], None, True)):
        with pytest.raises(Refused):
            guards.refuse_sealed(folds, sealed_from, sealed)
    with pytest.raises(Refused):
        guards.finite_metrics("m", {"a": float("nan")})
    with pytest.raises(Refused):
        guards.refuse_moved("v", [1], [2])
    assert guards.cuts([0, 5, 10, 15], [0, 10], 0, 20) == sorted(set(guards.cuts([0, 5, 10, 15], [0, 10], 0, 20))) and guards.cuts([0], [0], 0, 5) == []


def test_formats(spark, tmp_path):
    a = {"w": np.arange(6.0).reshape(2, 3), "b": np.array(2.0)}
    back = formats.arrays_load(formats.arrays_save(a))
    assert all(np.array_equal(a[k], back[k]) and a[k].shape == back[k].shape for k in a)
    z = formats.zip_save({"m": ("json", b"{}"), "a": ("arrays", b"x")})
    assert z == formats.zip_save({"a": ("arrays", b"x"), "m": ("json", b"{}")}) and formats.zip_load(z) == {"m": b"{}", "a": b"x"} and formats.zip_formats(z) == {"m": "json", "a": "arrays"}
    assert [formats.format_of(v).name for v in (a, {"x": 1.5}, (1, 2), 0.25)] == ["arrays", "json", "pickle", "json"] and not formats.KNOWN["pickle"].portable
    formats.predictions_save(spark.range(5).selectExpr("id as row_id", "id * 0.5 as prediction"), str(tmp_path / "p"))
    assert formats.predictions_load(spark, str(tmp_path / "p")).count() == 5
    with pytest.raises(Refused, match="first at row 2"):
        guards.one_per_row("p", spark.range(3).selectExpr("id as row_id", "if(id < 2, 0D, double('nan')) as prediction"), (0, 3))
    with pytest.raises(Refused, match="one a row"):
        guards.one_per_row("p", spark.range(3).selectExpr("id as row_id", "0D as prediction"), (0, 4))


def test_code_keys():
    one = 'import os\nimport sys\ndef f(x: int) -> int:\n    """Doc."""\n    return x + 1  # note\n'
    assert code_key(one) == code_key("import sys\nimport os\n\n\ndef f(x):\n    return (x + 1)\n") != code_key(one.replace("+ 1", "+ 2"))
    assert git_blob(b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("FOLDSTONE_ACTOR", raising=False)
    root = ["--root", str(tmp_path)]
    assert cli.main([*root, "note", "hi"]) == 2
    monkeypatch.setenv("FOLDSTONE_ACTOR", "ann")
    assert cli.main([*root, "ingest", "small_project", "60"]) == 0
    assert cli.main(["run", "small_project", "--dry-run", *root]) == 0 and "fits 6 (+0)" in capsys.readouterr().out
    assert cli.main([*root, "note", "about nothing", "--about", "nobody"]) == 1
    assert cli.main([*root, "note", "about it", "--tag", "idea", "--about", EventLog(str(tmp_path)).scan("dataset_recorded")[0]["id"]]) == 0
