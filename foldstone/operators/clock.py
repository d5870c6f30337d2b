"""A clock that looks things up in the table itself, so that only dates, never timestamps, come to the driver."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.operators.splits import Clock, Refused
from foldstone.sources.frame import ROW, stored


class FrameClock(Clock):
    """Answers as ``Clock`` does, from rows and clock stored once as Parquet sorted by row, so each look-up is a pruned scan.

    ``prefetch`` answers many snaps in one job.  Rows without a timestamp are refused.
    """

    def __init__(self, frame: DataFrame, head: int = 0, group: str | None = None):
        kept = frame.select(ROW, "ts", *([F.col(group).alias("g")] if group else []))
        self.frame = stored(kept.repartitionByRange(ROW).sortWithinPartitions(ROW), "clock")
        days = self.frame.groupBy(F.to_date("ts").alias("d")).agg(F.min(ROW).alias("r"), F.count("*").alias("n")).orderBy("d").collect()
        if any(r["d"] is None for r in days):
            raise Refused("rows without a timestamp")
        super().__init__(sum(r["n"] for r in days), head=head)
        self.days, self.starts = [r["d"] for r in days], [r["r"] for r in days]
        self.group = group
        self.snapped: dict[int, int] = {}
        self.ts = [dt.datetime.combine(self.days[-1], dt.time())] if days else []
        if group:
            self._one_run_each()

    def grouped(self, column: str | None) -> Clock:
        if column != self.group:
            raise Refused(f"the clock holds groups of {self.group}, not {column}")
        return self

    def _one_run_each(self) -> None:
        runs = self.frame.groupBy("g").agg((F.max(ROW) - F.min(ROW) + 1 - F.count("*")).alias("gap"))
        broken = runs.where("gap > 0").select(F.col("g").alias("h"))
        if broken.limit(1).count():
            rows = self.frame.join(broken, F.col("g").eqNullSafe(F.col("h")))
            again = rows.withColumn("prev", F.lag(ROW).over(W.partitionBy("g").orderBy(ROW))).where(F.col(ROW) - F.col("prev") > 1).agg(F.min(ROW)).first()[0]
            raise Refused(f"a group of {self.group} comes back at row {again}")

    def prefetch(self, rows: list[int]) -> None:
        rows = sorted({r for r in rows if 0 < r < self.n} - set(self.snapped))
        if not rows:
            return
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            of = self.frame.where(F.col(ROW).isin(some))
            key = "g" if self.group else "ts"
            wanted = of.select(F.col(ROW).alias("asked"), F.col(key).alias("k"))
            firsts = self.frame.join(F.broadcast(wanted.select("k").distinct()), F.col(key).eqNullSafe(F.col("k")), "left_semi").groupBy(F.col(key).alias("f")).agg(F.min(ROW).alias("first"))
            got = wanted.join(firsts, F.col("k").eqNullSafe(F.col("f"))).select("asked", "first").collect()
            if self.group:  # then to the first row of the timestamp
                plain = self._first_of_stamps([r["first"] for r in got])
                self.snapped |= {r["asked"]: plain[r["first"]] for r in got}
            else:
                self.snapped |= {r["asked"]: r["first"] for r in got}

    def _first_of_stamps(self, rows: list[int]) -> dict[int, int]:
        of = self.frame.where(F.col(ROW).isin(sorted(set(rows)))).select(F.col(ROW).alias("asked"), F.col("ts").alias("k"))
        firsts = self.frame.join(F.broadcast(of.select("k").distinct()), F.col("ts") == F.col("k"), "left_semi").groupBy(F.col("ts").alias("f")).agg(F.min(ROW).alias("first"))
        return {r["asked"]: r["first"] for r in of.join(firsts, F.col("k") == F.col("f")).collect()}

    def dates(self) -> list[dt.date]:
        return self.days

    def index_of(self, when: dt.date) -> int:
        if isinstance(when, dt.datetime) and when.time() != dt.time():
            found = self.frame.where(F.col("ts") >= F.lit(when)).agg(F.min(ROW)).first()[0]
            return self.n if found is None else found
        day = when.date() if isinstance(when, dt.datetime) else when
        k = bisect_left(self.days, day)
        return self.starts[k] if k < len(self.days) else self.n

    def _ts(self, row: int) -> dt.datetime:
        return self.frame.where(F.col(ROW) == row).select("ts").first()[0]

    def snap(self, row: int) -> int:
        if not 0 < row < self.n:
            return row
        self.prefetch([row])
        return self.snapped[row]

    def back(self, row: int, stamps: int) -> int:
        if not stamps or row <= 0:
            return max(row, 0)
        found = self.frame.where(F.col(ROW) < row).groupBy("ts").agg(F.min(ROW).alias("r")).orderBy(F.col("r").desc()).limit(stamps).collect()
        return found[-1]["r"] if len(found) == stamps else 0

    def forward(self, row: int, stamps: int) -> int:
        if not stamps or row >= self.n:
            return min(row, self.n)
        found = self.frame.where(F.col(ROW) >= row).groupBy("ts").agg(F.min(ROW).alias("r")).orderBy("r").limit(stamps + 1).collect()
        return found[-1]["r"] if len(found) == stamps + 1 else self.n

    def known(self, at: int, lag: dt.timedelta | int | None) -> int:
        if at >= self.n:
            at = self.n - 1
        if at < 0:
            return 0
        if isinstance(lag, int):
            k = self.days.index(self._ts(at).date()) - lag
            return 0 if k < 0 else self.starts[k + 1] if k + 1 < len(self.starts) else self.n
        now = self._ts(at)
        if lag is None:
            return self.frame.where(F.col("ts") == F.lit(now)).agg(F.min(ROW)).first()[0]
        found = self.frame.where(F.col("ts") > F.lit(now - lag)).agg(F.min(ROW)).first()[0]
        return self.n if found is None else found
