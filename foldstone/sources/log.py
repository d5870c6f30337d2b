"""Append-only event log: one JSON file an event, named by its id and created exclusively, read with Spark."""

from __future__ import annotations

import fcntl
import hashlib
import json
import math
import os
import re
import socket
import time
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from foldstone.functions.identity import canonical, ulid

EVENT = "seq long, id string, type string, stream string, key string, at double, actor string, host string, payload string"
TYPES = ("dataset_recorded", "pipeline_declared", "evaluation_declared", "run_started", "features_computed", "fit_computed", "predictions_computed", "score_recorded", "pipeline_failed", "note_recorded")


def _finite(v):
    """Non-finite numbers become null."""
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_finite(x) for x in v]
    return None if isinstance(v, float) and not math.isfinite(v) else v


class EventLog:
    def __init__(self, root: str, actor: str = "anonymous"):
        self.root, self.actor = Path(root), actor
        for d in ("events", "blobs/sha256", "sealed"):
            (self.root / d).mkdir(parents=True, exist_ok=True)

    def _create(self, path: Path, data: bytes) -> bool:
        """Whether the file was created; False if it is there already.  Readers never see a part of it."""
        tmp = path.with_name(f".{path.name}.{ulid()}")
        with tmp.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, path)
            return True
        except FileExistsError:
            return False
        finally:
            tmp.unlink()

    def append(self, type: str, stream: str, key: str, payload: dict, *, id: str | None = None) -> bool:
        """Append an event; an id that is there already is left as it is.  A second sealed score is refused."""
        if type not in TYPES:
            raise ValueError(f"no such event type: {type}")
        id = id or ulid()
        path = self.root / "events" / f"{quote(id, safe='')}.json"
        if path.exists():
            return False
        if type == "score_recorded" and payload.get("sealed"):
            claim = self.root / "sealed" / hashlib.sha256(canonical([stream, payload.get("pipeline")]).encode()).hexdigest()
            if not self._create(claim, id.encode()) and claim.read_text() != id:
                raise ValueError("the sealed rows were scored before, with another result")
        with (self.root / "seq").open("a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            seq = int(f.read() or 0) + 1
            event = {"seq": seq, "id": id, "type": type, "stream": stream, "key": key, "at": time.time(), "actor": self.actor, "host": socket.gethostname(), "payload": canonical(_finite(payload))}
            f.truncate(0)
            f.write(str(seq))
            f.flush()
            os.fsync(f.fileno())  # before the event: a crash leaves a gap, never a number twice
            return self._create(path, (json.dumps(event) + "\n").encode())

    def note(self, text: str, about: list[str], tag: str = "", strict: bool = False) -> bool:
        if not text.strip() or not re.fullmatch(r"[a-z0-9_-]*", tag):
            raise ValueError("a note needs a text, and a tag of a-z, 0-9, _ and -")
        if unknown := sorted(set(about) - {x for e in self.scan() for x in (e["id"], e["key"])}) if strict else []:
            raise ValueError(f"a note is about what the log has, not {unknown}")
        return self.append("note_recorded", "", tag, {"text": text, "about": about, "tag": tag})

    def scan(self, type: str | None = None, *, stream: str | None = None, key: str | None = None) -> list[dict]:
        """The control plane's own look at the log: events in order of seq, with their payload read."""
        got = [json.loads(p.read_text()) for p in (self.root / "events").glob("*.json") if not p.name.startswith(".")]
        fits = [e for e in got if (type is None or e["type"] == type) and (stream is None or e["stream"] == stream) and (key is None or e["key"] == key)]
        return [e | {"payload": json.loads(e["payload"])} for e in sorted(fits, key=lambda e: e["seq"])]

    def latest(self, type: str, *, stream: str | None = None, key: str | None = None) -> dict | None:
        found = self.scan(type, stream=stream, key=key)
        return found[-1] if found else None

    def event(self, id: str) -> dict:
        """The event of this id; one that isn't there is an error."""
        path = self.root / "events" / f"{quote(id, safe='')}.json"
        if not path.exists():
            raise KeyError(f"no event {id}")
        e = json.loads(path.read_text())
        return e | {"payload": json.loads(e["payload"])}

    def has(self, id: str) -> bool:
        return (self.root / "events" / f"{quote(id, safe='')}.json").exists()

    def table(self, kind: str, id: str) -> str:
        """Where the log keeps a table."""
        return f"file://{self.root.resolve()}/{kind}/{id}"

    def has_table(self, path: str) -> bool:
        return Path(path.removeprefix("file://"), "_SUCCESS").exists()

    def sql(self, spark: SparkSession, query: str, args: list | dict | None = None) -> list[dict]:
        """Rows of a query over the log's views, with parameters."""
        from foldstone.plans import views

        views.register(spark, self.events(spark))
        return [r.asDict() for r in spark.sql(query, args).collect()]

    def put_blob(self, data: bytes) -> str:
        sha = hashlib.sha256(data).hexdigest()
        self._create(self.root / "blobs/sha256" / sha, data)
        return sha

    def get_blob(self, sha: str) -> bytes:
        return (self.root / "blobs/sha256" / sha).read_bytes()

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(EVENT).json(f"file://{self.root.resolve()}/events")
