"""Command line: ingest a table, run experiments, write a note.

``python -m foldstone.cli [--root DIR] ingest MODULE [ARG ..] | run MODULE .. [--dataset S] [--dry-run] | note TEXT [--tag T] [--about ID ..]``

An ingest module has ``ingest(spark, log, *args) -> id``; an experiment module has ``PIPELINES`` and
``evaluations(dataset_id) -> list[Evaluation]``.  FOLDSTONE_ACTOR says who acts.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from foldstone.operators.splits import Refused
from foldstone.plans import views
from foldstone.plans.run import run
from foldstone.sources.dataset import resolve
from foldstone.sources.log import EventLog


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foldstone")
    top.add_argument("--root", default="ledger")
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("ingest")
    one.add_argument("module")
    one.add_argument("args", nargs="*")
    two = verbs.add_parser("run")
    two.add_argument("modules", nargs="+")
    two.add_argument("--dataset")
    two.add_argument("--dry-run", action="store_true")
    three = verbs.add_parser("note")
    three.add_argument("text")
    three.add_argument("--tag", default="")
    three.add_argument("--about", nargs="*", default=[])
    for p in (one, two, three):
        p.add_argument("--root", default=argparse.SUPPRESS)
    a = top.parse_args(argv)
    actor = os.environ.get("FOLDSTONE_ACTOR")
    if not actor:
        print("set FOLDSTONE_ACTOR to who acts", file=sys.stderr)
        return 2
    log = EventLog(a.root, actor)
    try:
        if a.verb == "note":
            log.note(a.text, a.about, a.tag, strict=True)
            return 0
        spark = _session()
        if a.verb == "ingest":
            print(importlib.import_module(a.module).ingest(spark, log, *a.args))
            return 0
        dataset, failed = resolve(log, a.dataset), 0
        merged: dict[str, tuple] = {}
        for name in a.modules:
            m = importlib.import_module(name)
            for e in m.evaluations(dataset):
                merged.setdefault(e.id, (e, []))[1].extend(m.PIPELINES)
        for e, pipelines in merged.values():
            r = run(spark, log, e, pipelines, dry=a.dry_run)
            failed += len(r.failed)
            print(f"{e.name or e.id}: fits {r.fits} (+{r.fits_reused}), predictions {r.predictions} (+{r.predictions_reused}), scores {r.scores} (+{r.scores_reused})")
            for p, why in r.failed.items():
                print(f"  {p} failed: {why}", file=sys.stderr)
        if not a.dry_run and not failed:
            views.register(spark, log.events(spark))
            for r in spark.sql("SELECT evaluation_name, metric, rank, name, fold_mean, pooled FROM board WHERE current = 1 ORDER BY evaluation_name, metric, rank, name").collect():
                print(f"{r['evaluation_name']} {r['metric']} {r['rank']} {r['name']} {r['fold_mean']:.4f} {r['pooled']:.4f}")
        return 1 if failed else 0
    except (Refused, ValueError, KeyError) as error:
        print(f"refused: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
