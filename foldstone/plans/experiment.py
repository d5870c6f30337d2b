"""Declarations: pipelines, scorers and evaluations.  What changes a result is hashed into their ids; names are not.

Slots are functions of modules over DataFrames:

* features: ``f(frame) -> DataFrame`` of row_id and columns; the frame holds no target without a reveal lag;
* prepare: ``p(view) -> value``, fit: ``fit(view, params[, members]) -> model``;
* predict: ``predict(model, frame, rows[, config]) -> DataFrame`` of row_id and prediction;
* postprocess: ``post(predictions, frame, rows, config) -> DataFrame`` likewise;
* series: ``series(frame with prediction, params) -> DataFrame`` of unit and numbers; metrics: name -> aggregate of them.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.functions.identity import content_hash, path_of
from foldstone.operators.splits import Refused
from foldstone.sources.frame import ROW


def _path(f: Callable | None) -> str | None:
    return None if f is None else path_of(f)


@dataclass(frozen=True)
class Pipeline:
    name: str
    fit: Callable | None = None
    predict: Callable | None = None
    features: tuple[Callable, ...] = ()
    prepare: Callable | None = None
    postprocess: Callable | None = None
    postprocess_config: dict = field(default_factory=dict)
    predict_config: dict | None = None
    params: dict = field(default_factory=dict)
    members: tuple[Pipeline, ...] = ()

    def __post_init__(self):
        if self.predict is None:
            raise Refused(f"pipeline {self.name} has no predict")
        if self.fit is None and not self.members:
            raise Refused(f"pipeline {self.name} has neither fit nor members")
        if self.learns and not self.members:
            raise Refused(f"pipeline {self.name}: its fit takes members and there are none")
        for f in (self.fit, self.predict, self.prepare, self.postprocess, *self.features):
            _path(f)

    @property
    def stateless(self) -> bool:
        return self.fit is None

    @property
    def learns(self) -> bool:
        """Whether the fit takes the members' out-of-fold predictions."""
        return self.fit is not None and len(inspect.signature(self.fit).parameters) > 2

    @property
    def inherited(self) -> tuple[Callable, ...]:
        """Its features; a blend without any has those that all its members share."""
        if self.features or not self.members:
            return self.features
        each = {m.inherited for m in self.members}
        return each.pop() if len(each) == 1 else ()

    def declaration(self) -> dict:
        full = {"fit": _path(self.fit), "predict": _path(self.predict), "features": [_path(f) for f in self.features], "prepare": _path(self.prepare), "postprocess": _path(self.postprocess), "postprocess_config": self.postprocess_config, "predict_config": self.predict_config, "params": self.params, "members": [m.declaration() for m in self.members]}
        return {k: v for k, v in full.items() if v not in (None, [], {})}

    def fit_declaration(self) -> dict:
        return {k: v for k, v in self.declaration().items() if k in ("fit", "prepare", "params", "features", "members")}

    @property
    def id(self) -> str:
        return content_hash(self.declaration())


@dataclass(frozen=True)
class Scorer:
    series: Callable
    metrics: Callable[[], dict[str, Column]]
    directions: dict[str, str] = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        _path(self.series)
        if odd := {d for d in self.directions.values() if d not in ("max", "min")}:
            raise Refused(f"directions are max or min, not {sorted(odd)}")


@dataclass(frozen=True)
class Evaluation:
    dataset: str
    split: Any
    scorer: Scorer
    name: str = ""
    sealed: bool = False

    def declaration(self) -> dict:
        """Directions and names are not in it, as they don't change a value."""
        split = {"type": type(self.split).__name__} | {k: v for k, v in vars(self.split).items() if v is not None}
        return {"dataset": self.dataset, "split": split, "series": _path(self.scorer.series), "metrics": _path(self.scorer.metrics), "scorer_params": self.scorer.params} | ({"sealed": True} if self.sealed else {})

    @property
    def id(self) -> str:
        return content_hash(self.declaration())


def mean_predict(model, frame: DataFrame, rows: tuple[int, int], members: list[DataFrame]) -> DataFrame:
    """The mean of the members' predictions."""
    every = members[0].select(ROW, "prediction")
    for m in members[1:]:
        every = every.union(m.select(ROW, "prediction"))
    return every.groupBy(ROW).agg(F.avg("prediction").alias("prediction"))


def mean_blend(name: str, members: tuple[Pipeline, ...]) -> Pipeline:
    return Pipeline(name, predict=mean_predict, members=members)
