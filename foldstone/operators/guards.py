"""Refusals: what a split, a fit, a prediction or a score may not do.  Decisions are driver logic on folds and counts."""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.functions.identity import content_hash
from foldstone.operators.splits import Clock, Fold, Refused
from foldstone.sources.frame import ROW

Lag = dt.timedelta | int | None


def cuts(stamps: list[int], opens: list[int], lo: int, hi: int) -> list[int]:
    """Two rows at which a probe cuts rows lo to hi: after the open of a date, and at any timestamp, both drawn by a hash.

    ``stamps`` and ``opens`` are the first rows of the timestamps and of the dates; a range of one timestamp has none.
    """
    inside = [lo, *[r for r in stamps if lo < r < hi]]
    if len(inside) < 2:
        return []
    begun = [r for r in opens if lo <= r < inside[-1]] or [lo]
    after = [inside[bisect_right(inside, r)] for r in begun]
    draw = int(content_hash([lo, hi]), 16)
    return sorted({after[draw % len(after)], inside[1:][(draw >> 32) % (len(inside) - 1)]})


def probe_cuts(frame: DataFrame, lo: int, hi: int) -> list[int]:
    """``cuts`` of a frame's clock (of its rows, without one): counts and two look-ups, never the timestamps."""
    n, draw = hi - lo, int(content_hash([lo, hi]), 16)
    if "ts" not in frame.columns:
        return cuts(list(range(lo, hi)), [], lo, hi) if n <= 2 else sorted({lo + 1, lo + 1 + (draw >> 32) % (n - 1)})
    rows = frame.where((F.col(ROW) >= lo) & (F.col(ROW) < hi))
    stamps = rows.groupBy("ts").agg(F.min(ROW).alias("r"))
    distinct = stamps.count()
    if distinct < 2:
        return []
    last = stamps.agg(F.max("r")).first()[0]
    before = frame.where(F.col(ROW) == lo - 1).select(F.to_date("ts")).collect()
    days = rows.groupBy(F.to_date("ts").alias("day")).agg(F.min(ROW).alias("r")).orderBy("r").collect()
    opens = [d["r"] for d in days if d["r"] < last and not (before and d["day"] == before[0][0])] or [lo]
    first = opens[draw % len(opens)]
    after = stamps.where(F.col("r") > first).agg(F.min("r")).first()[0]
    from foldstone.sources.frame import number_rows

    inner = number_rows(stamps, ["r"], "k").where(F.col("k") == F.lit(1 + (draw >> 32) % (distinct - 1))).first()["r"]
    return sorted({after, inner})


def refuse_overlap(folds: list[Fold]) -> None:
    for f in folds:
        for lo, hi in f.train:
            if lo < f.test[1] and f.test[0] < hi:
                raise Refused(f"fold {f.label} trains on rows {lo} to {hi} and tests rows {f.test[0]} to {f.test[1]}")


def refuse_unrevealed(clock: Clock, targets: dict[str, Lag], folds: list[Fold]) -> None:
    """Refuse folds that train on rows before their test whose label isn't known at its start; says what to purge."""
    late: list[tuple[int, str, str, int, int]] = []
    for f in folds:
        for name, lag in targets.items():
            known = clock.known(f.test[0], lag)
            rows = [(max(lo, known), min(hi, f.test[0])) for lo, hi in f.train if max(lo, known) < min(hi, f.test[0])]
            if rows:
                late.append((sum(b - a for a, b in rows), f.label, name, rows[0][0], rows[-1][1] - 1))
    if late:
        n, label, name, first, last = max(late)
        raise Refused(f"{len(late)} folds train on labels that are not known yet; the worst, {label}: {name} of rows {first} to {last}; purge {n} more rows")


def refuse_head(folds: list[Fold], head: int) -> None:
    for f in folds:
        if f.test[0] < head:
            raise Refused(f"fold {f.label} tests rows {f.test[0]} to {f.test[1]}, within the {head} rows that only train")


def refuse_sealed(folds: list[Fold], sealed_from: int | None, sealed: bool) -> None:
    """The sealed tail is tested by a sealed evaluation only, which tests nothing else; and trained on only once tested."""
    if sealed_from is None:
        if sealed:
            raise Refused("a sealed evaluation needs a table with a sealed tail")
        return
    tested: list[tuple[int, int]] = []
    for f in folds:
        lo, hi = f.test
        if sealed and lo < sealed_from:
            raise Refused(f"fold {f.label} of a sealed evaluation tests rows {lo} to {hi}, before the sealed row {sealed_from}")
        if not sealed and hi > sealed_from:
            raise Refused(f"fold {f.label} tests rows {lo} to {hi}, beyond the sealed row {sealed_from}")
        for a, b in f.train:
            at = max(a, sealed_from)
            for x, y in sorted(tested):
                if x <= at:
                    at = max(at, y)
            if b > sealed_from and at < b:
                raise Refused(f"fold {f.label} trains on row {at}, beyond the sealed row {sealed_from} and not tested before")
        if sealed:
            tested.append(f.test)


def refuse_moved(label: str, before: list, now: list) -> None:
    if before != now:
        raise Refused(f"evaluation {label} was declared with other folds")


def one_per_row(who: str, output: DataFrame, rows: tuple[int, int], column: str = "prediction") -> DataFrame:
    """``output`` if it has each row of the range once, and finite numbers; else the first fault is named."""
    if ROW not in output.columns or column not in output.columns:
        raise Refused(f"{who}: columns {ROW} and {column} are needed, got {output.columns}")
    lo, hi = rows
    c, r = F.col(column).cast("double"), F.col(ROW)
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    per = output.agg(F.count("*").alias("n"), F.count_distinct(ROW).alias("d"), F.min(ROW).alias("lo"), F.max(ROW).alias("hi"), F.count_if(bad).alias("bad"), F.min(F.when(bad, r)).alias("first")).first()
    if (per["n"], per["d"]) != (hi - lo, hi - lo) or (hi > lo and (per["lo"], per["hi"]) != (lo, hi - 1)):
        raise Refused(f"{who}: {per['n']} rows of {per['lo']} to {per['hi']} for rows {lo} to {hi}; one a row is needed")
    if per["bad"]:
        raise Refused(f"{who}: {per['bad']} values are not finite, the first at row {per['first']}")
    return output


def series_columns(who: str, series: DataFrame) -> list[str]:
    """The numeric columns of a series with a unit a row; an empty one, or one without numbers, is refused."""
    columns = [c for c, kind in series.dtypes if c not in ("unit", "fold") and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if "unit" not in series.columns or not columns:
        raise Refused(f"{who}: a series has unit and at least one number, got {series.columns}")
    if not series.limit(1).count():
        raise Refused(f"{who}: a series has at least one row")
    return columns


def finite_metrics(who: str, metrics: dict[str, object]) -> dict[str, float]:
    bad = sorted(k for k, v in metrics.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v))
    if bad:
        raise Refused(f"{who}: metrics {bad} are not finite numbers")
    return {k: float(v) for k, v in metrics.items()}
