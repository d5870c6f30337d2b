"""Recorded tables: frozen rows with named targets, reveal lags, a sealed tail and a head that only trains.

The rows are Parquet under the log's folder, sorted by row, so prefixes and segments prune; the log's event holds the
rest.  The id is a hash of the rows and of what is declared about them.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.identity import canonical, code_keys, path_of, table_id
from foldstone.operators.clock import FrameClock
from foldstone.operators.splits import Clock, Refused, as_date
from foldstone.sources import frame as fr
from foldstone.sources.frame import ROW
from foldstone.sources.log import EventLog

Lag = dt.timedelta | int | None
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass(frozen=True)
class Dataset:
    id: str
    source: str
    frame: DataFrame
    rows: int
    targets: dict[str, Lag]
    sealed_from: int | None = None
    head: int = 0

    def clock(self, group: str | None = None) -> Clock:
        if "ts" in self.frame.columns:
            return FrameClock(self.frame, head=self.head, group=group)
        return Clock(self.rows, head=self.head)

    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c not in (ROW, "ts")]


def lag_text(lag: Lag) -> float | dict[str, int] | None:
    """A lag as it is kept: seconds, or a number of dates."""
    if lag is None:
        return None
    if isinstance(lag, dt.timedelta):
        if lag < dt.timedelta():
            raise ValueError(f"a reveal lag can't be negative: {lag}")
        return lag.total_seconds()
    if isinstance(lag, bool) or not isinstance(lag, int):
        raise TypeError(f"a reveal lag is a time or a number of dates, not {lag!r}")
    if lag < 1:
        raise Refused("a lag in dates is at least 1")
    return {"dates": lag}


def lag_of(kept) -> Lag:
    return None if kept is None else kept["dates"] if isinstance(kept, dict) else dt.timedelta(seconds=kept)


def _sealed(clock: Clock, sealed_from: int | str | None) -> int | None:
    if sealed_from is None:
        return None
    row = clock.index_of(as_date(sealed_from)) if isinstance(sealed_from, str) and len(sealed_from) <= 10 else clock.index_of(dt.datetime.fromisoformat(sealed_from)) if isinstance(sealed_from, str) else clock.snap(sealed_from)
    if not 0 < row < clock.n:
        raise Refused(f"sealed_from {sealed_from!r} is row {row} of {clock.n}: both sides need rows")
    return row


def _head(clock: Clock, rows: int, sealed: int | None) -> int:
    if isinstance(rows, bool) or not isinstance(rows, int):
        raise TypeError(f"auxiliary rows are a number of rows, not {rows!r}")
    head, end = clock.snap(rows), clock.n if sealed is None else sealed
    if not 0 <= head < end:
        raise Refused(f"{rows} auxiliary rows leave none to judge before row {end}")
    return head


def record(log: EventLog, df: DataFrame, *, order: list[str], source: str, targets: list[str], params: dict | None = None, reveal: dict[str, Lag] | None = None, sealed_from: int | str | None = None, auxiliary_rows: int = 0, steps: tuple = ()) -> str:
    """Freeze ``df`` in ``order`` (``ts``, if it has one, first) and append its event; the same rows record nothing new."""
    reveal = dict(reveal or {})
    if not targets:
        raise Refused("a dataset names at least one target")
    if missing := [t for t in targets if t not in df.columns]:
        raise KeyError(f"no such targets: {missing}")
    if text := [t for t in targets if dict(df.dtypes)[t] not in NUMBERS]:
        raise TypeError(f"targets are numbers: {text}")
    if wide := [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]:
        raise Refused(f"a column has one value a row: {wide}")
    if ROW in df.columns:
        raise Refused(f"{ROW} is a reserved name")
    if odd := sorted(set(reveal) - set(targets)):
        raise KeyError(f"reveal names no target: {odd}")
    timed = "ts" in df.columns
    if reveal and not timed:
        raise ValueError("a reveal lag needs timestamps")
    if timed and order[0] != "ts":
        raise Refused("rows with timestamps are ordered by them first")
    frame = fr.number_rows(df, order)
    n = frame.count()
    if not n:
        raise ValueError("a dataset has at least one row")
    clock = FrameClock(frame) if timed else Clock(n)
    sealed = _sealed(clock, sealed_from)
    head = _head(clock, auxiliary_rows, sealed)
    lags = {t: lag_text(reveal.get(t)) for t in targets}
    recipe = {"source": source, "params": params or {}, "targets": lags} | ({"steps": [[path_of(s), code_keys([s])] for s in steps]} if steps else {})
    about = {"targets": lags} | ({} if sealed is None else {"sealed_from": sealed}) | ({"auxiliary_rows": head} if head else {})
    own = table_id(frame, [c for c in frame.columns if c != ROW], ROW, about)
    if before := log.latest("dataset_recorded", key=own):
        if canonical(before["payload"]["recipe"]) != canonical(recipe):
            raise Refused(f"the rows of {own} are recorded under another recipe")
        return own
    path = log.table("rows", own)
    if not log.has_table(path):
        fr.save(frame, path)
    span = fr.date_span(frame).first() if timed else None
    window = [str(span["first_day"]), str(span["after_last"])] if span else None
    log.append("dataset_recorded", own, own, {"source": source, "window": window, "recipe": recipe, "rows": n, "sealed_from": sealed, "auxiliary_rows": head, "blob": {"sha": own, "format": "parquet"}}, id=own)
    return own


def load(log: EventLog, spark: SparkSession, id: str) -> Dataset:
    e = log.latest("dataset_recorded", key=id)
    if e is None:
        raise Refused(f"no dataset {id}")
    p = e["payload"]
    return Dataset(id, p["source"], fr.load(spark, log.table("rows", id)), p["rows"], {t: lag_of(x) for t, x in p["recipe"]["targets"].items()}, p["sealed_from"], p["auxiliary_rows"])


def resolve(log: EventLog, selector: str | None = None) -> str:
    """One dataset's id from a source, an id or the start of one; without any, the newest of the only source."""
    rows = [(e["key"], e["payload"]["source"], e["actor"]) for e in log.scan("dataset_recorded")]
    if selector is None:
        if len({s for _, s, _ in rows}) != 1:
            raise Refused(f"{len({s for _, s, _ in rows})} sources; name one: {json.dumps(sorted({s for _, s, _ in rows}))}")
        selector = rows[-1][1]
    named = [r for r in rows if r[1] == selector]
    if len({a for _, _, a in named}) > 1:
        named = [r for r in named if r[2] == log.actor]
        if not named:
            raise Refused(f"{selector} names datasets of several actors, none of {log.actor}")
    if named:
        return named[-1][0]
    found = [i for i, _, _ in rows if i.startswith(selector)]
    if len(found) != 1:
        raise Refused(f"{selector}: {len(found)} matches {found}")
    return found[0]


def visible(data: Dataset, clock: Clock, upto: int, at: int) -> DataFrame:
    """Rows before ``upto`` with targets blank where they are not known at row ``at``."""
    out = fr.upto(data.frame, upto)
    for t, lag in data.targets.items():
        out = out.withColumn(t, F.when(F.col(ROW) < clock.known(at, lag), F.col(t)))
    return out
