"""Runs: compute only what the log lacks, refuse leaks, and append every result as an event.

Fits, predictions and scores have ids made of all they depend on; what the log has under its id is taken from there.
A pipeline that fails is recorded, and the others go on.  A dry run computes the same ids and counts, and writes nothing.
"""

from __future__ import annotations

import datetime as dt
import importlib.metadata
import platform
import socket
import subprocess
import time
import traceback
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.identity import code_keys, content_hash, path_of, ulid
from foldstone.operators import guards, visibility
from foldstone.operators.splits import Clock, Fold, Refused, oof_folds
from foldstone.plans.experiment import Evaluation, Pipeline
from foldstone.sources import formats
from foldstone.sources import frame as fr
from foldstone.sources.dataset import Dataset, load, visible
from foldstone.sources.frame import ROW
from foldstone.sources.log import EventLog


@dataclass
class Report:
    """How much was computed and how much was there."""

    fits: int = 0
    fits_reused: int = 0
    predictions: int = 0
    predictions_reused: int = 0
    features: int = 0
    features_reused: int = 0
    scores: int = 0
    scores_reused: int = 0
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def computed(self) -> int:
        return self.fits + self.predictions + self.features + self.scores


@dataclass(frozen=True)
class FitView:
    """What a fit sees: rows up to the end of its train rows, blank outside them; and its fold."""

    frame: DataFrame
    train: tuple[tuple[int, int], ...]
    head: int
    prepared: Any = None


def provenance() -> dict:
    """Commit, whether files differ from it, interpreter, host and library versions."""
    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    diff = git("diff", "HEAD")
    return {"git": {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain")), "diff": content_hash(diff) if diff else None}, "host": {"name": socket.gethostname(), "python": platform.python_version(), "machine": platform.machine()}, "resolution": {n: importlib.metadata.version(n) for n in ("pyspark", "numpy", "pyarrow")}}


class Run:
    def __init__(self, spark: SparkSession, log: EventLog, evaluation: Evaluation, *, dry: bool = False, root: Path | None = None, probe: bool = True):
        self.spark, self.log, self.evaluation, self.dry, self.root, self.probe = spark, log, evaluation, dry, root, probe
        self.data: Dataset = load(log, spark, evaluation.dataset)
        self.clock: Clock = self.data.clock(getattr(evaluation.split, "group", None))
        self.folds: list[Fold] = evaluation.split.folds(self.clock)
        guards.refuse_overlap(self.folds)
        guards.refuse_head(self.folds, self.data.head)
        guards.refuse_sealed(self.folds, self.data.sealed_from, evaluation.sealed)
        guards.refuse_unrevealed(self.clock, self.data.targets, self.folds)
        self.report, self.id, self.planned = Report(), ulid(), set()
        self.env = content_hash(provenance()["resolution"])
        self.frames: dict[tuple, DataFrame] = {}
        self.models: dict[str, Any] = {}

    # ---- ids and what is there

    def _there(self, id: str, kind: str) -> bool:
        """Whether this was computed before, here or in an earlier run; counts it."""
        if id in self.planned:
            return True
        if self.log.has(id):
            self.planned.add(id)
            setattr(self.report, f"{kind}_reused", getattr(self.report, f"{kind}_reused") + 1)
            return True
        self.planned.add(id)
        setattr(self.report, kind, getattr(self.report, kind) + 1)
        return False

    def _keys(self, *functions) -> dict:
        return {"code_keys": code_keys([f for f in functions if f is not None], self.root), "env_lock": self.env}

    # ---- features

    def _feature(self, f) -> str:
        """Compute a feature function once for the dataset, probe it on prefixes, keep its columns; gives their id."""
        id = content_hash({"dataset": self.data.id, "function": path_of(f), **self._keys(f)})
        if self._there(id, "features") or self.dry:
            return id
        began = time.time()
        hidden = [t for t, lag in self.data.targets.items() if lag is None]
        seen = self.data.frame.drop(*hidden)
        out = f(seen)
        columns = [c for c in out.columns if c != ROW]
        path = self.log.table("features", id)
        if not self.log.has_table(path):
            fr.save(out.select(ROW, *columns), path)
        kept = self.spark.read.parquet(path)
        cuts: list[int] = []
        if self.probe:
            sixths = [round(i * self.data.rows / 6) for i in range(1, 6)]
            for lo in sixths:
                for cut in guards.probe_cuts(self.data.frame, lo, self.data.rows):
                    if cut in cuts:
                        continue
                    cuts.append(cut)
                    prefix = f(visible(self.data, self.clock, cut, cut - 1).drop(*hidden))
                    for c in columns:
                        self._refuse_moved(f"feature {path_of(f)}.{c}", kept, prefix, c, cut)
        hashes = [[c, dict(kept.dtypes)[c], kept.agg(F.bit_xor(F.xxhash64(ROW, c))).first()[0]] for c in columns]
        self.log.append("features_computed", self.data.id, id, {"run": self.id, "features": path_of(f), "columns": columns, "columns_id": content_hash(hashes), "probe_rows": sorted(cuts), "duration_s": time.time() - began, "blob": {"sha": id, "format": "parquet"}}, id=id)
        return id

    def _refuse_moved(self, who: str, full: DataFrame, prefix: DataFrame, column: str, cut: int) -> None:
        moved = visibility.probe(full.where(F.col(ROW) < cut), prefix, column).first()
        if moved["moved"] or moved["compared"] < min(cut, full.where(F.col(ROW) < cut).count()):
            raise Refused(f"{who} read past row {cut}: {moved['moved']} of {moved['compared']} rows moved, the first {moved['first_moved']}, by {moved['worst']} of {moved['scale']}")

    def _columns_id(self, p: Pipeline) -> str | None:
        ids = [self._feature(f) for f in p.inherited]
        if not ids:
            return None
        return content_hash([self.log.event(i)["payload"]["columns_id"] if self.log.has(i) else i for i in ids])

    def _frame(self, p: Pipeline, upto: int, at: int | None, blank: tuple | None = None) -> DataFrame:
        """The rows a slot sees, with its features attached; targets known at ``at`` (None: as they are)."""
        frame = fr.upto(self.data.frame, upto) if at is None else visible(self.data, self.clock, upto, at)
        for f in p.inherited:
            e = self.log.event(self._feature(f))
            frame = fr.attach(frame, self.spark.read.parquet(self.log.table("features", e["key"])), e["payload"]["columns"])
        return frame if blank is None else visibility.train_view(frame, list(blank))

    # ---- fits and predictions

    def fit(self, p: Pipeline, fold: Fold) -> str:
        members = [self.fit(m, fold) for m in p.members]
        columns = self._columns_id(p)
        extra = ({"members": members} if members else {}) | ({"features": columns} if columns else {})
        if p.stateless:
            return content_hash({"stateless": True} | extra)
        oof = [[self.predict(m, g) for g in self._oof(fold)] for m in p.members] if p.learns else []
        train = [list(s) for s in fold.train]
        id = content_hash({"dataset": self.data.id, "pipeline": p.fit_declaration(), "train": train, **self._keys(p.fit, p.prepare)} | extra | ({"member_predictions": oof} if oof else {}))
        if self._there(id, "fits") or self.dry:
            return id
        began = time.time()
        view = FitView(self._frame(p, max(hi for _, hi in fold.train), None, fold.train), fold.train, self.data.head)
        if p.prepare is not None:
            view = FitView(view.frame, view.train, view.head, p.prepare(view))
        given = [[self.log.table("predictions", i) for i in ids] for ids in oof]
        model = p.fit(view, p.params, [self.spark.read.parquet(*paths) for paths in given]) if p.learns else p.fit(view, p.params)
        kind = formats.format_of(model)
        data = kind.save(model)
        kept = kind.load(data)
        first = fold.test
        if not p.members:  # what is read back predicts as what was fitted
            a, b = (self._predicted(p, m, first, []) for m in (model, kept))
            moved = visibility.probe(a, b, "prediction").first()
            if moved["moved"]:
                raise Refused(f"pipeline {p.name}: its model predicts otherwise once it is kept and read, from row {moved['first_moved']}")
        self.log.append("fit_computed", self.data.id, id, {"pipeline": p.id, "run": self.id, "train": train, "label": fold.label, "duration_s": time.time() - began, "model": {"sha": self.log.put_blob(data), "format": kind.name, "portable": kind.portable}, **self._keys(p.fit, p.prepare)} | extra, id=id)
        return id

    def _oof(self, fold: Fold) -> list[Fold]:
        gaps = {k: getattr(self.evaluation.split, k, 0) for k in ("embargo_rows", "embargo_timestamps")}
        return oof_folds(self.clock, list(fold.train), lags=tuple(lag for lag in self.data.targets.values() if lag is not None), **gaps)

    def _model(self, id: str) -> Any:
        if id not in self.models:
            at = self.log.event(id)["payload"]["model"]
            self.models[id] = formats.KNOWN[at["format"]].load(self.log.get_blob(at["sha"]))
        return self.models[id]

    def _predicted(self, p: Pipeline, model: Any, rows: tuple[int, int], members: list[DataFrame], upto: int | None = None) -> DataFrame:
        frame = self._frame(p, rows[1] if upto is None else upto, rows[0])
        args = [model, frame, rows] + ([members] if p.members else []) + ([p.predict_config] if p.predict_config is not None else [])
        return p.predict(*args)

    def predict(self, p: Pipeline, fold: Fold) -> str:
        fit = self.fit(p, fold)
        members = [self.predict(m, fold) for m in p.members]
        lo, hi = fold.test
        raw = content_hash({"fit": fit, "range": [lo, hi], "predict": path_of(p.predict), **self._keys(p.predict)} | ({"members": members} if members else {}) | ({"predict_config": p.predict_config} if p.predict_config is not None else {}))
        about = {"fit": fit, "range": [lo, hi], "fold": fold.label} | ({"members": members} if members else {})
        if not self._there(raw, "predictions") and not self.dry:
            of = [self.spark.read.parquet(self.log.table("predictions", m)) for m in members]
            model = None if p.stateless else self._model(fit)
            out = self._predicted(p, model, (lo, hi), of)
            self._keep(raw, out, (lo, hi), p, about | ({"predict_config": p.predict_config} if p.predict_config is not None else {}))
            if self.probe and not members:
                for cut in guards.probe_cuts(self.data.frame, lo, hi):
                    part = self._predicted(p, model, (lo, hi), of, upto=cut).where(F.col(ROW) < cut)
                    self._refuse_moved(f"predict of {p.name}", self.spark.read.parquet(self.log.table("predictions", raw)), part, "prediction", cut)
            self.log.append("predictions_computed", self.data.id, raw, about | {"blob": {"sha": raw, "format": "parquet"}}, id=raw)
        if p.postprocess is None:
            return raw
        own = content_hash({"raw": raw, "postprocess": path_of(p.postprocess), "postprocess_config": p.postprocess_config, **self._keys(p.postprocess)})
        if not self._there(own, "predictions") and not self.dry:
            out = p.postprocess(self.spark.read.parquet(self.log.table("predictions", raw)), self._frame(p, hi, lo), (lo, hi), p.postprocess_config)
            self._keep(own, out, (lo, hi), p, about)
            self.log.append("predictions_computed", self.data.id, own, about | {"raw": raw, "postprocess": path_of(p.postprocess), "blob": {"sha": own, "format": "parquet"}}, id=own)
        return own

    def _keep(self, id: str, out: DataFrame, rows: tuple[int, int], p: Pipeline, about: dict) -> None:
        path = self.log.table("predictions", id)
        if not self.log.has_table(path):
            formats.predictions_save(out.where((F.col(ROW) >= rows[0]) & (F.col(ROW) < rows[1])), path)
        guards.one_per_row(f"predictions of {p.name}, {about['fold']}", self.spark.read.parquet(path), rows)

    # ---- scores

    def score(self, p: Pipeline) -> str:
        e, s = self.evaluation, self.evaluation.scorer
        ids = [self.predict(p, f) for f in self.folds]
        id = content_hash({"evaluation": e.id, "pipeline": p.id, "predictions": sorted(ids), "directions": s.directions, **self._keys(s.series, s.metrics)})
        if self._there(id, "scores") or self.dry:
            return id
        series = None
        for k, (f, i) in enumerate(zip(self.folds, ids)):
            rows = self.data.frame.where((F.col(ROW) >= f.test[0]) & (F.col(ROW) < f.test[1])).join(self.spark.read.parquet(self.log.table("predictions", i)), ROW)
            own = s.series(rows, s.params).withColumn("fold", F.lit(k))
            series = own if series is None else series.unionByName(own)
        path = self.log.table("series", id)
        if not self.log.has_table(path):
            series.write.parquet(path)
        kept = self.spark.read.parquet(path)
        guards.series_columns(f"series of {p.name}", kept)
        found = {r["fold"]: r.asDict() for r in kept.rollup("fold").agg(F.count("*").alias("__n"), *[c.alias(n) for n, c in s.metrics().items()]).collect()}
        named = {k: guards.finite_metrics(f"{p.name}, {'all folds' if k is None else self.folds[k].label}", {n: v for n, v in r.items() if n not in ("fold", "__n")}) for k, r in found.items()}
        self.log.append("score_recorded", e.id, id, {
            "pipeline": p.id, "run": self.id, "predictions": {str(k): i for k, i in enumerate(ids)}, "folds": [{"fold": str(k), "label": f.label, "metrics": named[k]} for k, f in enumerate(self.folds)],
            "aggregate": named[None], "directions": s.directions, "series": {"sha": id, "format": "parquet", "fold_rows": [found[k]["__n"] for k in range(len(self.folds))]}, "sealed": e.sealed,
        }, id=id)
        return id

    def declare(self, pipelines: list[Pipeline]) -> None:
        e = self.evaluation
        folds = [{"index": k, "label": f.label, "train": [list(s) for s in f.train], "test": list(f.test)} for k, f in enumerate(self.folds)]
        if before := self.log.latest("evaluation_declared", key=e.id):
            guards.refuse_moved(e.name or e.id, before["payload"]["folds"], folds)
        if self.dry:
            return
        every, todo = [], list(pipelines)
        while todo:
            p = todo.pop()
            every.append(p)
            todo += p.members
        for p in every:
            self.log.append("pipeline_declared", p.id, p.id, {"name": p.name, "declaration": p.declaration(), "params": p.params}, id=content_hash([p.id, p.name]))
        self.log.append("evaluation_declared", e.id, e.id, {"name": e.name, "dataset": e.dataset, "declaration": e.declaration(), "metrics": e.scorer.directions, "folds": folds}, id=content_hash([e.id, e.name]))


def run(spark: SparkSession, log: EventLog, evaluation: Evaluation, pipelines: list[Pipeline], *, dry: bool = False, root: Path | None = None, probe: bool = True) -> Report:
    """Score the pipelines under the evaluation.  A run that finds everything there appends nothing, not even itself."""
    names = [p.name for p in pipelines]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise Refused(f"two pipelines are called {twice}")
    r = Run(spark, log, evaluation, dry=dry, root=root, probe=probe)
    if evaluation.sealed:  # before any fit
        for p in pipelines:
            held = [e for e in log.scan("score_recorded", stream=evaluation.id) if e["payload"]["pipeline"] == p.id]
            planned = Run(spark, log, evaluation, dry=True, root=root, probe=False).score(p)
            if held and held[-1]["id"] != planned:
                raise Refused(f"pipeline {p.name} was scored on the sealed rows before, with another result")
    quiet = Run(spark, log, evaluation, dry=True, root=root, probe=False)
    for p in pipelines:
        quiet.score(p)
    r.declare(pipelines)
    if dry:
        return quiet.report
    named = [{"id": p.id, "name": p.name} for p in pipelines]
    last = log.latest("run_started", stream=evaluation.id)
    if quiet.report.computed or last is None or last["payload"]["pipelines"] != named:
        log.append("run_started", evaluation.id, r.id, provenance() | {"pipelines": named}, id=r.id)
    for p in pipelines:
        try:
            r.score(p)
        except Exception as error:
            r.report.failed[p.name] = f"{type(error).__name__}: {error}"
            log.append("pipeline_failed", evaluation.id, p.id, {"run": r.id, "pipeline": p.id, "error": r.report.failed[p.name][:2000], "traceback": traceback.format_exc()[-8000:]})
    return r.report


def why(log: EventLog, kind: str, inputs: dict[str, Any]) -> list[str]:
    """Which inputs moved since the nearest earlier computation of this kind: the least moved, the newest of those."""
    best: tuple[int, int, list[str]] | None = None
    for e in log.scan(kind)[-64:]:
        moved = sorted(k for k, v in inputs.items() if e["payload"].get(k) != v)
        if best is None or (len(moved), -e["seq"]) < best[:2]:
            best = (len(moved), -e["seq"], moved)
    return best[2] if best else sorted(inputs)


def stamp() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
