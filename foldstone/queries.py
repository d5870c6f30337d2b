"""Registered queries of the engine's own operators over the whole test tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.functions.identity import chunk_digests
from foldstone.operators import panel, scoring, splits, visibility
from foldstone.operators.clock import FrameClock
from foldstone.plans import views
from foldstone.plans.experiment import Evaluation, Pipeline, Scorer
from foldstone.plans.run import run
from foldstone.sources import frame as fr
from foldstone.sources.dataset import record
from foldstone.sources.frame import ROW
from foldstone.sources.log import EventLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_EVENTS = "WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events), n AS (SELECT count(*) AS n FROM events)"
_ORDERS = "WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders), n AS (SELECT count(*) AS n FROM orders)"


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return wrap


def _events(spark, d) -> DataFrame:
    return fr.events_frame(spark, d)


def _orders(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").alias("ts"))
    return fr.number_rows(o, ["ts", "o_orderkey"])


def _fold_rows(spark, folds: list[splits.Fold]) -> DataFrame:
    rows = [(i, f.label, k, lo, hi, f.test[0], f.test[1]) for i, f in enumerate(folds) for k, (lo, hi) in enumerate(f.train)]
    return spark.createDataFrame(rows, "fold long, label string, segment long, train_lo long, train_hi long, test_lo long, test_hi long")


# ---- ordered rows -------------------------------------------------------------------------------------------------


@query(f"{_EVENTS} SELECT row_id, event_id, ts FROM e")
def row_index(spark, d):
    return _events(spark, d).select(ROW, "event_id", "ts")


@query(f"{_EVENTS} SELECT row_id, event_id, value FROM e WHERE row_id < (SELECT n // 3 FROM n)")
def prefix_view(spark, d):
    e = _events(spark, d)
    return fr.upto(e, spark.read.parquet(f"{d}/events.parquet").count() // 3).select(ROW, "event_id", "value")


@query(f"{_EVENTS}, s AS (SELECT n // 2 AS lo, n // 2 + n // 10 AS hi, 0 AS base FROM n UNION ALL SELECT n // 10, n // 5, n // 10 FROM n) SELECT row_id, CAST(row_id - lo + base AS BIGINT) AS place, value FROM e JOIN s ON row_id >= lo AND row_id < hi")
def segment_filter(spark, d):
    n = spark.read.parquet(f"{d}/events.parquet").count()
    return fr.segments_in_order(_events(spark, d), [(n // 2, n // 2 + n // 10), (n // 10, n // 5)]).select(ROW, "place", "value")


@query(f"{_EVENTS} SELECT coalesce(min(row_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-11'), count(*)) AS row_id FROM e")
def index_of_date(spark, d):
    return fr.index_of(_events(spark, d), "2024-01-11")


@query(f"{_ORDERS} SELECT CAST(ts AS DATE) AS day, min(row_id) AS first_row, count(*) AS n FROM o GROUP BY 1")
def date_starts(spark, d):
    return fr.date_starts(_orders(spark, d))


@query(f"{_ORDERS} SELECT ts, min(row_id) AS first_row, max(row_id) + 1 AS next_row, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS day_idx FROM o GROUP BY ts")
def stamps_dim(spark, d):
    return fr.stamps(_orders(spark, d))


@query(f"{_EVENTS}, p AS (SELECT ts, lag(ts) OVER (ORDER BY row_id) AS prev FROM e) SELECT count(*) FILTER (WHERE ts IS NULL) AS null_ts, count(*) FILTER (WHERE prev > ts) AS unsorted FROM p")
def clock_check(spark, d):
    return fr.clock_faults(_events(spark, d))


@query(f"{_ORDERS} SELECT CAST(min(ts) AS DATE) AS first_day, CAST(CAST(max(ts) AS DATE) + INTERVAL 1 DAY AS DATE) AS after_last FROM o")
def date_span(spark, d):
    return fr.date_span(_orders(spark, d))


@query(f"{_EVENTS} SELECT row_id, CAST(user_id AS DOUBLE) AS a, value AS b FROM e WHERE row_id < 500")
def matrix_rows(spark, d):
    """Asked for 500 rows, as a segment is what the operator takes."""
    m = fr.matrix(_events(spark, d), ["user_id", "value"], [(0, 500)])
    return m.select(ROW, F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))


@query(f"{_ORDERS}, s AS (SELECT ts, min(row_id) AS r FROM o, n WHERE row_id >= n // 4 GROUP BY ts), k AS (SELECT r, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS m FROM s) SELECT r AS row_id FROM k WHERE k = m // 2")
def middle_stamp(spark, d):
    o = fr.stored(_orders(spark, d), "orders")
    n = o.count()
    return fr.middle_stamp(o, n // 4, n)


@query(f"{_ORDERS} SELECT CAST(max(ts) AS DATE) AS day FROM o")
def row_date_last(spark, d):
    return fr.row_date(_orders(spark, d), -1)


@query(f"{_EVENTS} SELECT row_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY row_id) AS prev FROM e")
def feature_attach(spark, d):
    e = fr.stored(_events(spark, d), "events")
    lagged = e.select(ROW, F.lag("value").over(W.partitionBy("user_id").orderBy(ROW)).alias("prev"))
    return fr.attach(e.select(ROW, "event_id"), lagged, ["prev"])


# ---- splits -------------------------------------------------------------------------------------------------------

_FOLD_COLUMNS = "CAST(fold AS BIGINT) AS fold, label, CAST(segment AS BIGINT) AS segment, CAST(train_lo AS BIGINT) AS train_lo, CAST(train_hi AS BIGINT) AS train_hi, CAST(test_lo AS BIGINT) AS test_lo, CAST(test_hi AS BIGINT) AS test_hi"
_SNAP = "(SELECT min(row_id) FROM o WHERE ts = (SELECT ts FROM o WHERE row_id = {0}))"


@query(f"{_ORDERS}, c AS (SELECT min(p.row_id) AS cut FROM o p WHERE p.ts = (SELECT q.ts FROM o q, n WHERE q.row_id = n // 10 * 7)) SELECT 0::BIGINT AS fold, 'holdout' AS label, 0::BIGINT AS segment, 0::BIGINT AS train_lo, cut AS train_hi, cut + 10 AS test_lo, n AS test_hi FROM c, n")
def holdout_folds(spark, d):
    clock = FrameClock(_orders(spark, d))
    return _fold_rows(spark, splits.Holdout(clock.n // 10 * 7, 10).folds(clock))


@query(f"""{_ORDERS}, s AS (SELECT ts, min(row_id) AS first FROM o GROUP BY ts),
b AS (SELECT i, CASE WHEN i = 0 THEN 0 WHEN i = 4 THEN n ELSE (SELECT first FROM s WHERE s.ts = (SELECT ts FROM o WHERE row_id = CAST(round_even(i * n / 4.0, 0) AS BIGINT))) END AS b FROM range(5) r(i), n),
f AS (SELECT x.i AS fold, x.b AS lo, y.b AS hi FROM b x JOIN b y ON y.i = x.i + 1),
t AS (SELECT fold, lo, hi, 0 AS a, lo - 20 AS z FROM f UNION ALL SELECT fold, lo, hi, hi + 20, n FROM f, n)
SELECT CAST(fold AS BIGINT) AS fold, 'block ' || fold AS label, row_number() OVER (PARTITION BY fold ORDER BY a) - 1 AS segment, CAST(a AS BIGINT) AS train_lo, CAST(z AS BIGINT) AS train_hi, CAST(lo AS BIGINT) AS test_lo, CAST(hi AS BIGINT) AS test_hi FROM t WHERE a < z""")
def blocked_kfold(spark, d):
    return _fold_rows(spark, splits.BlockedKFold(4, embargo_rows=20).folds(FrameClock(_orders(spark, d))))


def _walk_sql(horizon: int, rolling: bool) -> str:
    start = "greatest(cutoff - 5 - n // 4, 0)" if rolling else "0"
    return f"""{_EVENTS}, c AS (SELECT n // 5 + i * (n // 10) AS cutoff, i, n FROM range(20) r(i), n WHERE n // 5 + i * (n // 10) + {horizon} * (n // 10) <= n)
SELECT CAST(i AS BIGINT) AS fold, 'row ' || cutoff AS label, 0::BIGINT AS segment, CAST({start} AS BIGINT) AS train_lo, CAST(cutoff - 5 AS BIGINT) AS train_hi, CAST(cutoff + {horizon - 1} * (n // 10) AS BIGINT) AS test_lo, CAST(cutoff + {horizon} * (n // 10) AS BIGINT) AS test_hi FROM c"""


def _walk(spark, d, horizon=1, rolling=False):
    e = _events(spark, d)
    clock = FrameClock(e)
    n = clock.n
    return _fold_rows(spark, splits.WalkForward(n // 5, n // 10, n // 10, embargo_rows=5, horizon=horizon, max_train_rows=n // 4 if rolling else None).folds(clock))


@query(_walk_sql(1, False))
def walk_forward(spark, d):
    return _walk(spark, d)


@query(_walk_sql(2, False))
def walk_forward_horizon2(spark, d):
    return _walk(spark, d, horizon=2)


@query(_walk_sql(1, True))
def walk_forward_rolling(spark, d):
    return _walk(spark, d, rolling=True)


@query(f"""{_ORDERS}, bd AS (SELECT i, CAST(DATE '1997-01-01' + to_months(CAST(i AS INT)) AS DATE) AS day FROM range(600) r(i) WHERE CAST(DATE '1997-01-01' + to_months(CAST(i AS INT)) AS DATE) <= DATE '1999-01-15'),
x AS (SELECT i, day, coalesce((SELECT min(row_id) FROM o WHERE ts >= day), n) AS row FROM bd, n),
s AS (SELECT ts, min(row_id) AS first, row_number() OVER (ORDER BY ts) AS k FROM o GROUP BY ts),
f AS (SELECT a.i, a.day, a.row AS cut, b.row AS lo, c.row AS hi FROM x a JOIN x b ON b.i = a.i JOIN x c ON c.i = a.i + 1 WHERE a.i % 3 = 0 AND a.i < (SELECT count(*) FROM bd) - 1)
SELECT row_number() OVER (ORDER BY i) - 1 AS fold, CAST(day AS VARCHAR) AS label, 0::BIGINT AS segment, 0::BIGINT AS train_lo, (SELECT first FROM s WHERE k = (SELECT k FROM s WHERE first = cut) - 2) AS train_hi, lo AS test_lo, hi AS test_hi FROM f""")
def calendar_month_walk(spark, d):
    split = splits.CalendarWalkForward("1997-01-01", "month", step=3, embargo_timestamps=2, end="1999-01-15")
    return _fold_rows(spark, split.folds(FrameClock(_orders(spark, d))))


@query(f"""{_EVENTS}, bd AS (SELECT CAST(ts AS DATE) AS day, min(row_id) AS row, row_number() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1),
stop AS (SELECT coalesce(min(row_id), (SELECT n FROM n)) AS row FROM e WHERE ts >= TIMESTAMP '2024-01-25'),
x AS (SELECT i, day, row FROM bd UNION ALL SELECT (SELECT count(*) FROM bd), DATE '2024-01-25', row FROM stop)
SELECT a.i AS fold, CAST(a.day AS VARCHAR) AS label, 0::BIGINT AS segment, coalesce((SELECT min(row_id) FROM e WHERE CAST(ts AS DATE) = (SELECT q FROM (SELECT DISTINCT CAST(ts AS DATE) AS q FROM e WHERE ts < a.day ORDER BY q DESC LIMIT 7) ORDER BY q LIMIT 1)), 0) AS train_lo, a.row AS train_hi, b.row AS test_lo, c.row AS test_hi
FROM x a JOIN x b ON b.i = a.i JOIN x c ON c.i = a.i + 1""")
def calendar_day_walk(spark, d):
    split = splits.CalendarWalkForward("2024-01-10", "day", end="2024-01-25", train_units=7)
    return _fold_rows(spark, split.folds(FrameClock(_events(spark, d))))


@query(f"{_ORDERS}, c AS (SELECT n - n // 5 AS row FROM n), a AS (SELECT min(p.row_id) AS cut FROM o p WHERE p.ts = (SELECT q.ts FROM o q, c WHERE q.row_id = c.row)), x AS (SELECT cut, (SELECT min(row_id) FROM o WHERE ts = (SELECT ts FROM o, a WHERE row_id = a.cut - 30)) AS train_hi FROM a) SELECT 0::BIGINT AS train_lo, train_hi, cut AS valid_lo, n AS valid_hi FROM x, n")
def inner_split(spark, d):
    clock = FrameClock(_orders(spark, d))
    ((lo, hi),), (a, b) = splits.inner_split(clock, [(0, clock.n)], clock.n // 5, embargo_rows=30)
    return spark.createDataFrame([(lo, hi, a, b)], "train_lo long, train_hi long, valid_lo long, valid_hi long")


@query(f"""{_ORDERS}, s AS (SELECT ts, min(row_id) AS first FROM o GROUP BY ts),
b AS (SELECT i, CASE WHEN i = 0 THEN 0 WHEN i = 5 THEN n ELSE (SELECT first FROM s WHERE s.ts = (SELECT ts FROM o WHERE row_id = CAST(round_even(i * n / 5.0, 0) AS BIGINT))) END AS b FROM range(6) r(i), n),
f AS (SELECT x.i AS fold, x.b AS lo, y.b AS hi FROM b x JOIN b y ON y.i = x.i + 1),
t AS (SELECT fold, lo, hi, 0 AS a, lo AS z FROM f UNION ALL SELECT fold, lo, hi, hi, n FROM f, n)
SELECT CAST(fold AS BIGINT) AS fold, 'oof ' || fold AS label, row_number() OVER (PARTITION BY fold ORDER BY a) - 1 AS segment, CAST(a AS BIGINT) AS train_lo, CAST(z AS BIGINT) AS train_hi, CAST(lo AS BIGINT) AS test_lo, CAST(hi AS BIGINT) AS test_hi FROM t WHERE a < z""")
def oof_blocks(spark, d):
    clock = FrameClock(_orders(spark, d))
    return _fold_rows(spark, splits.oof_folds(clock, [(0, clock.n)]))


@query(f"""{_EVENTS}, u AS (SELECT user_id AS g, ts, event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS row_id FROM events),
s AS (SELECT g, min(row_id) AS first FROM u GROUP BY g),
b AS (SELECT i, CASE WHEN i = 0 THEN 0 WHEN i = 3 THEN n ELSE (SELECT first FROM s WHERE s.g = (SELECT g FROM u WHERE row_id = CAST(round_even(i * n / 3.0, 0) AS BIGINT))) END AS b FROM range(4) r(i), n),
f AS (SELECT x.i AS fold, x.b AS lo, y.b AS hi FROM b x JOIN b y ON y.i = x.i + 1),
t AS (SELECT fold, lo, hi, 0 AS a, lo AS z FROM f UNION ALL SELECT fold, lo, hi, hi, n FROM f, n)
SELECT CAST(fold AS BIGINT) AS fold, 'block ' || fold AS label, row_number() OVER (PARTITION BY fold ORDER BY a) - 1 AS segment, CAST(a AS BIGINT) AS train_lo, CAST(z AS BIGINT) AS train_hi, CAST(lo AS BIGINT) AS test_lo, CAST(hi AS BIGINT) AS test_hi FROM t WHERE a < z""")
def blocked_kfold_grouped(spark, d):
    rows = fr.number_rows(spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").alias("at"), "event_id"), ["user_id", "at", "event_id"])
    stamped = rows.select(ROW, "user_id", F.timestamp_add("MILLISECOND", F.col(ROW), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    return _fold_rows(spark, splits.BlockedKFold(3, group="user_id").folds(FrameClock(stamped, group="user_id")))


# ---- visibility ---------------------------------------------------------------------------------------------------

_AT = "a AS (SELECT ts AS at_ts FROM e, n WHERE row_id = n // 2)"


def _at(e: DataFrame):
    n = e.count()
    return n // 2, e.where(F.col(ROW) == n // 2).select("ts").first()[0]


@query(f"{_EVENTS}, {_AT} SELECT row_id, CASE WHEN ts < at_ts THEN value END AS value FROM e, a")
def reveal_none(spark, d):
    e = _events(spark, d)
    row, ts = _at(e)
    return visibility.masked(e, "value", visibility.known_before(ts, row, None)).select(ROW, "value")


@query(f"{_EVENTS}, {_AT} SELECT row_id, CASE WHEN ts <= at_ts - INTERVAL 36 HOUR THEN value END AS value FROM e, a")
def reveal_interval(spark, d):
    e = _events(spark, d)
    row, ts = _at(e)
    return visibility.masked(e, "value", visibility.known_before(ts, row, "INTERVAL '36' HOUR")).select(ROW, "value")


@query(f"{_EVENTS}, {_AT}, k AS (SELECT *, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS day_idx FROM e) SELECT row_id, CASE WHEN day_idx <= (SELECT max(day_idx) FROM k WHERE CAST(ts AS DATE) = CAST(at_ts AS DATE)) - 2 THEN value END AS value FROM k, a")
def reveal_dates(spark, d):
    e = _events(spark, d)
    row, _ = _at(e)
    known = FrameClock(e).known(row, 2)
    return visibility.masked(e, "value", F.col(ROW) < known).select(ROW, "value")


@query(f"{_EVENTS}, s AS (SELECT *, (row_id < n // 5 OR (row_id >= n // 2 AND row_id < n // 10 * 6)) AS seen FROM e, n) SELECT row_id, ts, CASE WHEN seen THEN value END AS value, CASE WHEN seen THEN event_type END AS event_type FROM s")
def train_blanking(spark, d):
    e = _events(spark, d)
    n = e.count()
    return visibility.train_view(e.select(ROW, "ts", "value", "event_type"), [(0, n // 5), (n // 2, n // 10 * 6)])


@query(f"{_EVENTS}, f AS (SELECT i AS fold, n // 5 + i * (n // 5) AS cut FROM range(4) r(i), n), t AS (SELECT fold, cut, (SELECT ts FROM e WHERE row_id = cut) AS at_ts FROM f) SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (WHERE ts > at_ts - INTERVAL 12 HOUR) AS unrevealed FROM t JOIN e ON row_id < cut GROUP BY fold")
def unrevealed_count(spark, d):
    e = _events(spark, d)
    clock = FrameClock(e)
    cuts = [clock.n // 5 + i * (clock.n // 5) for i in range(4)]
    return spark.createDataFrame([(i, c - clock.known(c, dt.timedelta(hours=12))) for i, c in enumerate(cuts)], "fold long, unrevealed long")


# ---- panel --------------------------------------------------------------------------------------------------------

_DAILY = "SELECT CAST(ts AS DATE) AS ts, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"
_KINDS = ["click", "error", "purchase", "signup", "view"]


def _daily(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("ts"), "event_type").agg(F.round(F.sum("value"), 4).alias("v"))


@query(f"WITH p AS ({_DAILY}) SELECT ts, {', '.join(f'''max(v) FILTER (WHERE event_type = '{k}') AS "{k}"''' for k in _KINDS)} FROM p GROUP BY ts")
def panel_pivot(spark, d):
    return panel.pivot(_daily(spark, d), "event_type", _KINDS, "v")


@query(_DAILY)
def panel_unpivot(spark, d):
    return panel.unpivot(panel.pivot(_daily(spark, d), "event_type", _KINDS, "v"), _KINDS, "event_type", "v")


@query(f"WITH p AS ({_DAILY}) SELECT ts, event_type, round(v - avg(v) OVER (PARTITION BY ts), 3) AS v FROM p")
def panel_demean(spark, d):
    return _daily(spark, d).withColumn("v", F.round(F.col("v") - F.avg("v").over(W.partitionBy("ts")), 3))


# ---- features and probes ------------------------------------------------------------------------------------------


@query(f"{_EVENTS} SELECT row_id, lag(value) OVER (PARTITION BY user_id ORDER BY row_id) AS prev FROM e")
def feature_lag(spark, d):
    return _events(spark, d).select(ROW, F.lag("value").over(W.partitionBy("user_id").orderBy(ROW)).alias("prev"))


def _causal(e: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return e.select(ROW, F.avg("value").over(w).alias("f"))


def _day_mean(e: DataFrame) -> DataFrame:
    return e.select(ROW, F.avg("value").over(W.partitionBy("user_id", F.to_date("ts"))).alias("f"))


@query(f"{_EVENTS} SELECT row_id, round(sum(value) OVER w, 2) AS total, count(value) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def feature_causal(spark, d):
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    return _events(spark, d).select(ROW, F.round(F.sum("value").over(w), 2).alias("total"), F.count("value").over(w).alias("n"))


@query(f"{_EVENTS} SELECT CAST(NULL AS BIGINT) AS first_moved, 0::BIGINT AS moved, (SELECT n // 3 FROM n) AS compared")
def probe_ok(spark, d):
    e = _events(spark, d)
    return visibility.probe(_causal(e), _causal(fr.upto(e, e.count() // 3)), "f").select("first_moved", "moved", "compared")


@query(f"""{_EVENTS}, p AS (SELECT row_id, avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS p FROM e), q AS (SELECT row_id, avg(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS q FROM e WHERE row_id < (SELECT n // 3 FROM n))
SELECT min(row_id) FILTER (WHERE abs(p - q) > 1e-9 * (SELECT max(abs(p)) FROM p JOIN q USING (row_id))) AS first_moved, count(*) FILTER (WHERE abs(p - q) > 1e-9 * (SELECT max(abs(p)) FROM p JOIN q USING (row_id))) AS moved, count(*) AS compared FROM q JOIN p USING (row_id)""")
def probe_leak(spark, d):
    e = _events(spark, d)
    return visibility.probe(_day_mean(e), _day_mean(fr.upto(e, e.count() // 3)), "f").select("first_moved", "moved", "compared")


# ---- fits, blends, scores -----------------------------------------------------------------------------------------

_FOLDS = "f AS (SELECT i AS fold, n // 5 + i * (n // 5) AS cut, n // 5 + (i + 1) * (n // 5) AS hi FROM range(4) r(i), n)"
_MEAN = f"{_EVENTS}, {_FOLDS}, m AS (SELECT fold, avg(value) AS mean FROM f JOIN e ON row_id < cut GROUP BY fold), t AS (SELECT f.fold, row_id, user_id, value, mean FROM f JOIN e ON row_id >= cut AND row_id < hi JOIN m ON m.fold = f.fold)"


def _setup(spark, d):
    e = _events(spark, d)
    n = spark.read.parquet(f"{d}/events.parquet").count()
    return e, splits.WalkForward(n // 5, n // 5, n // 5).folds(splits.Clock(n))


def _predicted(spark, d) -> DataFrame:
    e, folds = _setup(spark, d)
    return scoring.test_rows(e, folds).join(F.broadcast(scoring.fit_mean(e, folds, "value")), "fold")


@query(f"{_MEAN} SELECT CAST(fold AS BIGINT) AS fold, round(mean, 6) AS mean FROM m")
def fit_mean_by_fold(spark, d):
    e, folds = _setup(spark, d)
    return scoring.fit_mean(e, folds, "value").select(F.col("fold").cast("long"), F.round("mean", 6).alias("mean"))


@query(f"{_EVENTS}, {_FOLDS} SELECT CAST(fold AS BIGINT) AS fold, round(sum(user_id * value) / (sum(user_id * user_id) + 10.0), 8) AS slope FROM f JOIN e ON row_id < cut GROUP BY fold")
def fit_ridge_by_fold(spark, d):
    e, folds = _setup(spark, d)
    return scoring.fit_ridge(e, folds, "user_id", "value", 10.0).select(F.col("fold").cast("long"), F.round("slope", 8).alias("slope"))


@query(f"{_MEAN} SELECT row_id, round(least(greatest(mean + (user_id % 7) - 3, 40.0), 60.0), 6) AS prediction FROM t")
def postprocess_clip(spark, d):
    p = _predicted(spark, d)
    return p.select(ROW, F.round(F.least(F.greatest(F.col("mean") + F.col("user_id") % 7 - 3, F.lit(40.0)), F.lit(60.0)), 6).alias("prediction"))


def _members(spark, d):
    p = _predicted(spark, d)
    a = p.select(F.lit("a").alias("member"), "fold", ROW, "mean", F.col("mean").alias("prediction"))
    return a.unionByName(p.select(F.lit("b").alias("member"), "fold", ROW, "mean", F.col("user_id").cast("double").alias("prediction")))


@query(f"{_MEAN} SELECT row_id, round((mean + user_id) / 2, 6) AS prediction FROM t")
def mean_blend(spark, d):
    return scoring.mean_blend(_members(spark, d), ROW).select(ROW, F.round("prediction", 6).alias("prediction"))


@query(f"{_EVENTS}, o AS (SELECT user_id::DOUBLE AS p FROM e, n WHERE row_id < n // 2), k AS (SELECT p, count(*) AS c FROM o GROUP BY p), q AS (SELECT DISTINCT user_id FROM e), g AS (SELECT user_id, coalesce((SELECT sum(c) FROM k WHERE p <= user_id), 0) AS below FROM q) SELECT row_id, round(below / (SELECT count(*) FROM o)::DOUBLE, 8) AS prediction FROM e JOIN g USING (user_id), n WHERE row_id >= n // 2")
def rank_blend(spark, d):
    e = _events(spark, d).select(F.lit("u").alias("member"), ROW, F.col("user_id").cast("double").alias("prediction"))
    half = spark.read.parquet(f"{d}/events.parquet").count() // 2
    return scoring.rank_blend(fr.upto(e, half).drop(ROW), e.where(F.col(ROW) >= half)).select(ROW, F.round("prediction", 8).alias("prediction"))


@query(f"{_MEAN} SELECT CAST(fold AS BIGINT) AS fold, round(avg((value - mean) * (value - mean)), 4) AS value, count(*) AS n FROM t GROUP BY ROLLUP (fold)")
def score_by_fold(spark, d):
    s = _predicted(spark, d).withColumn("se", (F.col("value") - F.col("mean")) ** 2)
    return scoring.score_folds(s, "se").select(F.col("fold").cast("long"), F.round("value", 4).alias("value"), "n")


@query(f"{_MEAN}, d AS (SELECT fold, (value - mean) * (value - mean) - (value - user_id) * (value - user_id) AS d FROM t) SELECT count(*) AS n, round(sum(d), 3) AS pooled_delta, round(sqrt(count(*)) * stddev_samp(d), 4) AS se_iid, (SELECT string_agg(CAST(CAST(round(s) AS BIGINT) AS VARCHAR), ',' ORDER BY fold) FROM (SELECT fold, sum(d) AS s FROM d GROUP BY fold)) AS fold_deltas FROM d")
def paired_rows(spark, d):
    p = fr.stored(_predicted(spark, d).withColumn("unit", F.col(ROW)), "pairs")
    a = p.select("fold", "unit", ((F.col("value") - F.col("mean")) ** 2).alias("x"))
    b = p.select("fold", "unit", ((F.col("value") - F.col("user_id")) ** 2).alias("x"))
    got = scoring.paired(a, b, "x")
    return spark.createDataFrame([(got.n, round(got.pooled_delta, 3), round(got.se_iid, 4), ",".join(str(int(Decimal(v).to_integral_value(ROUND_HALF_UP))) for v in got.fold_deltas.values()))], "n long, pooled_delta double, se_iid double, fold_deltas string")


@query(f"{_MEAN} SELECT (fold * (SELECT n // 5 FROM n) + row_id - (SELECT min(row_id) FROM t u WHERE u.fold = t.fold)) // 64 AS block, round(sum(value - mean), 4) AS s FROM t GROUP BY 1")
def block_sums(spark, d):
    p = _predicted(spark, d).withColumn("d", F.col("value") - F.col("mean"))
    first = W.partitionBy("fold")
    units = p.withColumn("unit", F.col(ROW) - F.min(ROW).over(first)).select("fold", "unit", "d")
    return scoring.block_sums(units, 64).select("block", F.round("s", 4).alias("s"))


@query(f"{_MEAN}, v AS (SELECT fold, avg((value - mean) * (value - mean)) AS a1, avg(abs(value - mean)) AS a2, avg(abs(value - user_id)) AS b1 FROM t GROUP BY fold), x AS (SELECT fold, (a1 + a2) / 2 - b1 AS d FROM v) SELECT count(d) AS n_folds, round(avg(d), 6) AS delta_mean, round(stddev_samp(d), 6) AS delta_std, round(avg(d) * sqrt(count(d)) / nullif(stddev_samp(d), 0), 6) AS t, count(*) FILTER (WHERE d < 0) AS wins, string_agg(CAST(round(d, 3) AS VARCHAR), ',' ORDER BY fold) AS fold_deltas FROM x")
def paired_sets(spark, d):
    p = _predicted(spark, d).groupBy("fold").agg(F.avg((F.col("value") - F.col("mean")) ** 2).alias("a1"), F.avg(F.abs(F.col("value") - F.col("mean"))).alias("a2"), F.avg(F.abs(F.col("value") - F.col("user_id"))).alias("b1"))
    v = p.unpivot(["fold"], ["a1", "a2", "b1"], "pipeline", "value")
    out = scoring.paired_sets(v, ["a1", "a2"], ["b1"], "min")
    return out.select("n_folds", *[F.round(c, 6).alias(c) for c in ("delta_mean", "delta_std", "t")], "wins", F.array_join(F.transform("fold_deltas", lambda x: F.round(x, 3).cast("string")), ",").alias("fold_deltas"))


@query(f"{_ORDERS} SELECT row_id, sha256('v' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || 'v' || length(o_orderstatus) || ':' || o_orderstatus) AS h FROM o")
def row_hash(spark, d):
    cell = lambda c: F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
    return _orders(spark, d).select(ROW, F.sha2(F.concat(cell("o_orderkey"), cell("o_orderstatus")), 256).alias("h"))


@query(f"{_ORDERS}, h AS (SELECT row_id, sha256('v' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || 'v' || length(o_orderstatus) || ':' || o_orderstatus) AS h FROM o) SELECT row_id // 1000 AS chunk, sha256(string_agg(h, '' ORDER BY row_id)) AS digest FROM h GROUP BY 1")
def content_hash_chunks(spark, d):
    return chunk_digests(_orders(spark, d), ["o_orderkey", "o_orderstatus"], ROW)


@query("SELECT l.label, count(*) AS n, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM (SELECT e.label, toxic FROM embeddings e JOIN labels ON vec_id = doc_id) l GROUP BY l.label")
def class_counts(spark, d):
    j = spark.read.parquet(f"{d}/embeddings.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), F.col("vec_id") == F.col("doc_id"))
    return j.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


# ---- runs ---------------------------------------------------------------------------------------------------------


def run_fit_mean(view, params):
    return view.frame.agg(F.avg("value")).first()[0]


def run_predict_mean(model, frame, rows):
    return frame.where(F.col(ROW) >= rows[0]).select(ROW, F.lit(model).alias("prediction"))


def run_series(rows, params):
    return rows.select(F.col(ROW).alias("unit"), ((F.col("value") - F.col("prediction")) ** 2).alias("se"))


def run_metrics():
    return {"mse": F.avg("se")}


@query(f"""{_EVENTS}, b AS (SELECT i, CAST(round_even(i * n / 3.0, 0) AS BIGINT) AS b FROM range(4) r(i), n), f AS (SELECT x.i AS fold, x.b AS lo, y.b AS hi FROM b x JOIN b y ON y.i = x.i + 1),
m AS (SELECT fold, lo, hi, avg(value) AS mean FROM f JOIN e ON row_id < lo OR row_id >= hi GROUP BY ALL), s AS (SELECT fold, avg((value - mean) * (value - mean)) AS v FROM m JOIN e ON row_id >= lo AND row_id < hi GROUP BY fold)
SELECT CAST(fold AS VARCHAR) AS fold, 'block ' || fold AS label, 'mse' AS metric, round(v, 4) AS value, 3::BIGINT AS fits, 3::BIGINT AS predictions, 0::BIGINT AS computed_again FROM s""")
def run_fold_scores(spark, d):
    """Records the events, runs a pipeline over three blocks twice, and reads its scores back from the log."""
    with tempfile.TemporaryDirectory() as root:
        log = EventLog(root, "query")
        events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "user_id", "value")
        own = record(log, events, order=["ts", "event_id"], source="events", targets=["value"])
        mean = Pipeline("mean", run_fit_mean, run_predict_mean)
        e = Evaluation(own, splits.BlockedKFold(3), Scorer(run_series, run_metrics, {"mse": "min"}), "kfold")
        first, again = run(spark, log, e, [mean], probe=False), run(spark, log, e, [mean], probe=False)
        views.register(spark, log.events(spark))
        got = spark.table("score_fold").select("fold", "label", "metric", F.round("value", 4).alias("value")).collect()
    rows = [(*r, first.fits, first.predictions, again.computed) for r in got]
    return spark.createDataFrame(rows, "fold string, label string, metric string, value double, fits long, predictions long, computed_again long")


# ---- the log's views ----------------------------------------------------------------------------------------------

#: A log made from the orders, the same text for both engines: two datasets, three pipelines, two evaluations, scores
#: by month of order as folds, a rerun, a sealed evaluation, failures before and after a score, notes, and a blend.
_V = "CAST(CAST(round({}) AS BIGINT) AS {s})"
_LOG = """
WITH m AS (SELECT k AS pipeline, CAST(o_orderkey % 3 AS INT) AS fold,
  avg(abs(o_totalprice - 200000 - 10000 * k)) AS err, sum(CASE WHEN o_custkey % (k + 2) = 0 THEN 1 ELSE 0 END) AS hits
  FROM orders, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) p GROUP BY k, CAST(o_orderkey % 3 AS INT)),
s AS (SELECT pipeline, string_agg('{"fold":"' || CAST(fold AS {s}) || '","label":"block ' || CAST(fold AS {s}) || '","metrics":{"mae":' || CAST(CAST(round(err) AS BIGINT) AS {s}) || ',"hit.rate":' || CASE WHEN fold = 1 AND pipeline = 2 THEN 'null' ELSE CAST(CAST(hits AS BIGINT) AS {s}) END || '}}', ',') AS folds,
  CAST(CAST(round(avg(err)) AS BIGINT) AS {s}) AS mae, CAST(CAST(sum(hits) AS BIGINT) AS {s}) AS hits FROM m GROUP BY pipeline),
ev AS (
SELECT 1 AS seq, 'ds1' AS id, 'dataset_recorded' AS type, 'ds1' AS stream, 'ds1' AS key, '{"source":"orders","window":["1995-01-01","2001-08-01"],"rows":15000,"recipe":{"source":"orders","params":{"a":1},"targets":{"price":null}},"sealed_from":12000,"blob":{"sha":"b1","format":"parquet"}}' AS payload
UNION ALL SELECT 2, 'e2', 'pipeline_declared', 'p0', 'p0', '{"name":"mean","params":{},"declaration":{"fit":"mean"}}'
UNION ALL SELECT 3, 'e3', 'pipeline_declared', 'p1', 'p1', '{"name":"shift","params":{"k":1},"declaration":{"fit":"shift"}}'
UNION ALL SELECT 4, 'e4', 'pipeline_declared', 'p2', 'p2', '{"name":"blend","params":{},"declaration":{"members":["p0","p1"]}}'
UNION ALL SELECT 5, 'e5', 'evaluation_declared', 'v1', 'v1', '{"name":"kfold","dataset":"ds1","metrics":{"mae":"min","hit.rate":"max"},"declaration":{"sealed":false,"split":{"n":3}},"folds":[]}'
UNION ALL SELECT 6, 'e6', 'evaluation_declared', 'v2', 'v2', '{"name":"kfold","dataset":"ds1","metrics":{"mae":"min","hit.rate":"max"},"declaration":{"sealed":true,"split":{"n":3}},"folds":[]}'
UNION ALL SELECT 7, 'r1', 'run_started', 'v1', 'r1', '{"git":{"commit":"c1","dirty":false},"host":{"gpu":null},"pipelines":[{"id":"p0","name":"mean"},{"id":"p1","name":"shift"},{"id":"p2","name":"blend"}]}'
UNION ALL SELECT 8, 'x1', 'pipeline_failed', 'v1', 'p0', '{"run":"r1","pipeline":"p0","error":"ValueError"}'
UNION ALL SELECT 9, 'f0', 'fit_computed', 'ds1', 'f0', '{"pipeline":"p0","run":"r1","label":"block 0","duration_s":1.5,"model":{"sha":"m0","format":"arrays","portable":true}}'
UNION ALL SELECT 10, 'f1', 'fit_computed', 'ds1', 'f1', '{"pipeline":"p1","run":"r1","label":"block 0","duration_s":2.5,"model":{"sha":"m1","format":"arrays","portable":true}}'
UNION ALL SELECT 11, 'f2', 'fit_computed', 'ds1', 'f2', '{"pipeline":"p2","run":"r1","label":"block 0","duration_s":0.25,"members":["f0","f1"]}'
UNION ALL SELECT 12, 'q0', 'predictions_computed', 'ds1', 'q0', '{"fit":"f0","fold":"0","range":[0,5000],"blob":{"sha":"b2"}}'
UNION ALL SELECT 13, 'q1', 'predictions_computed', 'ds1', 'q1', '{"fit":"f1","fold":"0","range":[0,5000],"blob":{"sha":"b3"}}'
UNION ALL SELECT 14, 'q2', 'predictions_computed', 'ds1', 'q2', '{"fit":"f2","fold":"0","range":[0,5000],"members":["q0","q1"],"blob":{"sha":"b4"}}'
UNION ALL SELECT 20 + pipeline, 'sc' || CAST(pipeline AS {s}), 'score_recorded', 'v1', 'sc' || CAST(pipeline AS {s}), '{"pipeline":"p' || CAST(pipeline AS {s}) || '","run":"r1","predictions":{"0":"q' || CAST(pipeline AS {s}) || '"},"directions":{"mae":"min","hit.rate":"max"},"folds":[' || folds || '],"aggregate":{"mae":' || mae || ',"hit.rate":' || hits || '},"series":{"sha":"z","fold_rows":[5000,5000,5000]}}' FROM s
UNION ALL SELECT 30, 'r2', 'run_started', 'v2', 'r2', '{"git":{"commit":"c2","dirty":true},"pipelines":[{"id":"p1","name":"mean"}]}'
UNION ALL SELECT 31, 'sc9', 'score_recorded', 'v2', 'sc9', '{"pipeline":"p1","run":"r2","predictions":{"0":"q1"},"directions":{"mae":"max"},"sealed":true,"folds":[' || folds || '],"aggregate":{"mae":' || mae || '},"series":{"sha":"y","fold_rows":[1]}}' FROM s WHERE pipeline = 1
UNION ALL SELECT 32, 'x2', 'pipeline_failed', 'v1', 'p1', '{"run":"r1","pipeline":"p1","error":"KeyError"}'
UNION ALL SELECT 33, 'n1', 'note_recorded', '', 'idea', '{"text":"look at p1","about":["p1","sc1"],"tag":"idea"}'
UNION ALL SELECT 34, 'w1', 'features_computed', 'ds1', 'w1', '{"pipeline":"p1","run":"r1","columns":["lag"],"columns_id":"h","probe_rows":[10,20],"duration_s":0.5,"blob":{"sha":"b9"}}')
SELECT CAST(seq AS BIGINT) AS seq, id, type, stream, key, CAST(seq AS DOUBLE) AS at, 'ann' AS actor, 'host' AS host, payload FROM ev
"""


def _log(spark, d) -> None:
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    views.register(spark, fr.stored(spark.sql(_LOG.replace("{s}", "STRING")).coalesce(1), "log"))


_J = lambda p, of="payload": f"json_extract_string({of}, '$.{p}')"
_ONE = {
    "run_pipeline": f"SELECT seq, id AS run, stream AS evaluation, json_extract_string(p, '$.id') AS pipeline, json_extract_string(p, '$.name') AS name FROM (SELECT *, unnest(CAST(json_extract(payload, '$.pipelines') AS JSON[])) AS p FROM event WHERE type = 'run_started')",
    "event_pipeline": f"SELECT key AS id, arg_max({_J('name')}, seq) AS name FROM event WHERE type = 'pipeline_declared' GROUP BY key",
    "event_evaluation": f"SELECT key AS id, arg_max({_J('name')}, seq) AS name, arg_max({_J('dataset')}, seq) AS dataset FROM event WHERE type = 'evaluation_declared' GROUP BY key",
    "pipeline_current": "SELECT r.* FROM run_pipeline r WHERE NOT EXISTS (SELECT 1 FROM run_pipeline q WHERE q.evaluation = r.evaluation AND q.name = r.name AND q.seq > r.seq)",
    "named": f"SELECT {_J('dataset')} AS dataset, {_J('name')} AS name, key AS evaluation, seq FROM event WHERE type = 'evaluation_declared' UNION ALL SELECT {_J('dataset', 'd.payload')}, {_J('name', 'd.payload')}, r.stream, r.seq FROM event r JOIN event d ON d.type = 'evaluation_declared' AND d.key = r.stream WHERE r.type = 'run_started'",
    "evaluation_current": "SELECT dataset, name, arg_max(evaluation, seq) AS evaluation, max(seq) AS seq FROM named WHERE name <> '' GROUP BY dataset, name",
    "score_fold": f"SELECT id AS score, stream AS evaluation, {_J('pipeline')} AS pipeline, json_extract_string(f, '$.fold') AS fold, json_extract_string(f, '$.label') AS label, metric, TRY_CAST(json_extract_string(f, '$.metrics.\"' || metric || '\"') AS DOUBLE) AS value, json_extract_string(payload, '$.directions.\"' || metric || '\"') AS direction FROM (SELECT *, unnest(json_keys(f, '$.metrics')) AS metric FROM (SELECT *, unnest(CAST(json_extract(payload, '$.folds') AS JSON[])) AS f FROM event WHERE type = 'score_recorded'))",
    "score_aggregate": f"SELECT e.*, n_folds, fold_mean, fold_std FROM (SELECT id AS score, stream AS evaluation, {_J('pipeline')} AS pipeline, metric, json_extract_string(payload, '$.directions.\"' || metric || '\"') AS direction, CAST(json_extract_string(payload, '$.aggregate.\"' || metric || '\"') AS DOUBLE) AS pooled FROM (SELECT *, unnest(json_keys(payload, '$.aggregate')) AS metric FROM event WHERE type = 'score_recorded')) e JOIN (SELECT score, metric, count(value) AS n_folds, avg(value) AS fold_mean, stddev_samp(value) AS fold_std FROM score_fold GROUP BY ALL) f ON f.score = e.score AND f.metric = e.metric",
    "score_latest": f"SELECT l.stream AS evaluation, e.name AS evaluation_name, l.pipeline, p.name, e.dataset, 'orders' AS source, l.actor, l.id AS score, {_J('run', 'l.payload')} AS run, l.seq, l.at, CASE WHEN EXISTS (SELECT 1 FROM pipeline_current c WHERE c.evaluation = l.stream AND c.pipeline = l.pipeline) AND (e.name = '' OR EXISTS (SELECT 1 FROM evaluation_current v WHERE v.evaluation = l.stream)) THEN 1 ELSE 0 END AS current FROM (SELECT *, {_J('pipeline')} AS pipeline FROM event WHERE type = 'score_recorded') l JOIN event_pipeline p ON p.id = l.pipeline JOIN event_evaluation e ON e.id = l.stream WHERE l.seq = (SELECT max(q.seq) FROM event q WHERE q.type = 'score_recorded' AND q.stream = l.stream AND {_J('pipeline', 'q.payload')} = l.pipeline)",
    "board": "SELECT source, evaluation_name, name, metric, direction, CASE WHEN direction IN ('max', 'min') AND fold_mean IS NOT NULL THEN rank() OVER (PARTITION BY evaluation, metric ORDER BY CASE direction WHEN 'max' THEN -fold_mean ELSE fold_mean END NULLS LAST) END AS rank, round(fold_mean, 4) AS fold_mean, round(fold_std, 4) AS fold_std, n_folds, pooled, current, pipeline, score FROM (SELECT l.*, a.metric, first_value(a.direction) OVER (PARTITION BY l.evaluation, a.metric ORDER BY l.seq DESC) AS direction, a.fold_mean, a.fold_std, a.n_folds, a.pooled FROM score_latest l JOIN score_aggregate a ON a.score = l.score)",
    "pair_fold": "SELECT a.evaluation, a.metric, a.fold, a.pipeline, b.pipeline AS reference, a.value - b.value AS delta, CAST(CASE a.direction WHEN 'max' THEN a.value > b.value WHEN 'min' THEN a.value < b.value END AS BIGINT) AS win, a.score, b.score AS reference_score FROM (SELECT l.evaluation, l.pipeline, s.* EXCLUDE (evaluation, pipeline) FROM score_latest l JOIN score_fold s ON s.score = l.score) a JOIN score_fold b ON b.evaluation = a.evaluation AND b.fold = a.fold AND b.metric = a.metric AND b.pipeline <> a.pipeline",
    "head_to_head": "SELECT metric, pipeline, reference, count(delta) AS n_folds, round(avg(delta), 4) AS delta_mean, round(stddev_samp(delta), 4) AS delta_std, CAST(sum(win) AS BIGINT) AS wins, round(avg(delta) * sqrt(count(delta)) / nullif(stddev_samp(delta), 0), 4) AS t, (SELECT pooled FROM score_aggregate x WHERE x.score = h.score AND x.metric = h.metric) - (SELECT pooled FROM score_aggregate y WHERE y.score = h.reference_score AND y.metric = h.metric) AS pooled_delta FROM pair_fold h GROUP BY metric, pipeline, reference, score, reference_score",
}


def _view_sql(select: str) -> str:
    return "WITH event AS (" + _LOG.replace("{s}", "VARCHAR") + ")" + "".join(f", {k} AS ({v})" for k, v in _ONE.items()) + " " + select


def view(select: str, spark_select: str | None = None):
    """A query over the views, in the same words for both engines unless a second text is given."""
    def wrap(f):
        def run(spark, d, text=spark_select or select):
            _log(spark, d)
            return spark.sql(text)

        QUERIES[f.__name__] = run
        SQL[f.__name__] = _view_sql(select)
        return run

    return wrap


@view("SELECT * FROM board", "SELECT source, evaluation_name, name, metric, direction, rank, round(fold_mean, 4) AS fold_mean, round(fold_std, 4) AS fold_std, n_folds, pooled, current, pipeline, score FROM board")
def board(spark, d): ...


@view("SELECT score, evaluation, pipeline, fold, label, metric, value, direction FROM score_fold")
def score_fold(spark, d): ...


@view("SELECT score, metric, direction, pooled, n_folds, round(fold_mean, 4) AS fold_mean, round(fold_std, 4) AS fold_std FROM score_aggregate")
def score_aggregate(spark, d): ...


@view("SELECT evaluation, evaluation_name, pipeline, name, dataset, source, actor, score, run, seq, current FROM score_latest")
def score_latest(spark, d): ...


@view("SELECT evaluation, metric, fold, pipeline, reference, delta, win, score, reference_score FROM pair_fold")
def pair_fold(spark, d): ...


@view("SELECT * FROM head_to_head", "SELECT metric, pipeline, reference, n_folds, round(delta_mean, 4) AS delta_mean, round(delta_std, 4) AS delta_std, wins, round(t, 4) AS t, pooled_delta FROM head_to_head")
def head_to_head(spark, d): ...


@view("SELECT evaluation, name, pipeline, run, seq FROM pipeline_current")
def pipeline_current(spark, d): ...


@view("SELECT dataset, name, evaluation, seq FROM evaluation_current")
def evaluation_current(spark, d): ...


@view("SELECT seq, run, evaluation, pipeline, name FROM run_pipeline")
def run_pipeline(spark, d): ...


@view(f"SELECT f.seq, f.id, f.stream AS evaluation, f.key AS pipeline, {_J('error', 'f.payload')} AS error FROM event f WHERE f.type = 'pipeline_failed' AND NOT EXISTS (SELECT 1 FROM event s WHERE s.type = 'score_recorded' AND s.stream = f.stream AND {_J('pipeline', 's.payload')} = f.key AND s.seq > f.seq)", "SELECT seq, id, evaluation, pipeline, error FROM event_failure")
def failure_anti(spark, d): ...


@view(f"SELECT seq, id AS note, key AS tag, {_J('text')} AS text, unnest(CAST(json_extract(payload, '$.about') AS VARCHAR[])) AS about FROM event WHERE type = 'note_recorded'", "SELECT seq, note, tag, text, about FROM note_about")
def note_about(spark, d): ...


@view(f"SELECT id, {_J('source')} AS source, {_J('window[0]')} AS span_start, CAST({_J('sealed_from')} AS BIGINT) AS sealed_from, 0::BIGINT AS auxiliary_rows, CAST({_J('rows')} AS BIGINT) AS rows, {_J('blob.sha')} AS blob FROM event WHERE type = 'dataset_recorded'", "SELECT id, source, span_start, sealed_from, auxiliary_rows, rows, blob FROM event_dataset")
def event_dataset(spark, d): ...


@view(f"SELECT id, evaluation, {_J('git.commit')} AS code_commit FROM (SELECT *, stream AS evaluation FROM event) WHERE type = 'run_started'", "SELECT id, evaluation, code_commit FROM event_run")
def event_run(spark, d): ...


@view(f"SELECT id, {_J('pipeline')} AS pipeline, {_J('columns_id')} AS columns_id, CAST({_J('duration_s')} AS DOUBLE) AS duration_s FROM event WHERE type = 'features_computed'", "SELECT id, pipeline, columns_id, duration_s FROM event_feature")
def event_feature(spark, d): ...


@view(f"SELECT id, {_J('pipeline')} AS pipeline, {_J('model.sha')} AS model, CAST({_J('duration_s')} AS DOUBLE) AS duration_s FROM event WHERE type = 'fit_computed'", "SELECT id, pipeline, model, duration_s FROM event_fit")
def event_fit(spark, d): ...


@view(f"SELECT id, {_J('fit')} AS fit, CAST({_J('range[0]')} AS BIGINT) AS range_start, CAST({_J('range[1]')} AS BIGINT) AS range_end FROM event WHERE type = 'predictions_computed'", "SELECT id, fit, range_start, range_end FROM event_prediction")
def event_prediction(spark, d): ...


@view("SELECT * FROM (VALUES ('sc0', 'f0'), ('sc1', 'f1'), ('sc2', 'f0'), ('sc2', 'f1'), ('sc2', 'f2'), ('sc9', 'f1')) t(score, fit)", "SELECT score, fit FROM score_fit")
def score_fit(spark, d): ...


@view("SELECT id, name FROM event_pipeline")
def event_pipeline(spark, d): ...


@view("SELECT id, name, dataset FROM event_evaluation")
def event_evaluation(spark, d): ...


@view(f"SELECT s.id, s.stream AS evaluation, v.dataset, {_J('pipeline', 's.payload')} AS pipeline, {_J('run', 's.payload')} AS run FROM event s LEFT JOIN event_evaluation v ON v.id = s.stream WHERE s.type = 'score_recorded'", "SELECT id, evaluation, dataset, pipeline, run FROM event_score")
def event_score(spark, d): ...
