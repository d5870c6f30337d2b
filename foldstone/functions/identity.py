"""Content ids: canonical JSON, hashes of declarations, of ordered tables by chunks, and monotonic ULIDs."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import os
import sys
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_last = [0]


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:16]


def ulid() -> str:
    """26 characters that sort by time; never the same or smaller one twice in a process."""
    now = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10))
    _last[0] = now if now > _last[0] else _last[0] + 1
    return "".join(_CROCKFORD[_last[0] >> 5 * k & 31] for k in range(25, -1, -1))


def chunk_digests(frame: DataFrame, columns: list[str], row: str, chunk: int = 1000) -> DataFrame:
    """(chunk, digest): SHA-256 over each chunk's rows in order.  Null and empty differ; partitioning doesn't matter."""
    cell = lambda c: F.coalesce(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    line = frame.select(F.col(row).alias("r"), F.floor(F.col(row) / chunk).alias("chunk"), F.sha2(F.concat(*[cell(c) for c in columns]), 256).alias("h"))
    return line.groupBy("chunk").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def table_id(frame: DataFrame, columns: list[str], row: str, recipe: dict) -> str:
    """Id of an ordered table: chunk digests, then groups of them, so the driver sees one hash for a million rows."""
    chunks = chunk_digests(frame, columns, row)
    top = chunks.groupBy(F.floor(F.col("chunk") / 1000).alias("g")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"]), ""), 256).alias("d"))
    kinds = {c: dict(frame.dtypes)[c] for c in columns}
    return content_hash({"rows": [r["d"] for r in top.orderBy("g").collect()], "kinds": kinds, "recipe": recipe})


def git_blob(data: bytes) -> str:
    """The SHA-1 under which git keeps these bytes."""
    return hashlib.sha1(b"blob " + str(len(data)).encode() + b"\0" + data).hexdigest()


def path_of(function: Callable) -> str:
    """module.name of a function that can be found again by it."""
    name = getattr(function, "__qualname__", "")
    if not name or "<" in name or "." in name:
        raise ValueError(f"{function!r} is not a function of a module")
    return f"{function.__module__}.{name}"


class _Bare(ast.NodeTransformer):
    """Takes out what doesn't change what code does: docstrings and annotations."""

    def _plain(self, node):
        self.generic_visit(node)
        if node.body and isinstance(node.body[0], ast.Expr) and isinstance(getattr(node.body[0], "value", None), ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        return node

    def visit_FunctionDef(self, node):
        node.returns = None
        return self._plain(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Module(self, node):
        node = self._plain(node)
        loads = [n for n in node.body if isinstance(n, (ast.Import, ast.ImportFrom))]
        node.body = sorted(loads, key=ast.dump) + [n for n in node.body if n not in loads]
        return node

    def visit_ClassDef(self, node):
        return self._plain(node)

    def visit_arg(self, node):
        node.annotation = None
        return node

    def visit_AnnAssign(self, node):
        self.generic_visit(node)
        node.annotation = ast.Constant(None)
        return node


def code_key(source: str) -> str:
    """A hash of code that comments, layout, docstrings, annotations and the order of imports leave as it is."""
    return hashlib.sha256(ast.dump(_Bare().visit(ast.parse(source))).encode()).hexdigest()[:16]


def closure(functions: Iterable[Callable], root: Path) -> list[ModuleType]:
    """The modules under ``root`` that the functions' modules reach by their global names."""
    todo = [sys.modules[f.__module__] for f in functions if f.__module__ in sys.modules]
    found: dict[str, ModuleType] = {}
    while todo:
        m = todo.pop()
        file = getattr(m, "__file__", None)
        if m.__name__ in found or not file or not Path(file).resolve().is_relative_to(root.resolve()):
            continue
        found[m.__name__] = m
        for v in list(vars(m).values()):
            other = v if isinstance(v, ModuleType) else sys.modules.get(getattr(v, "__module__", None) or "")
            if other is not None:
                todo.append(other)
    return [found[k] for k in sorted(found)]


def code_keys(functions: Iterable[Callable], root: Path | None = None) -> dict[str, str]:
    """Module -> key of its code, for the modules that the functions reach under ``root`` (their own folder)."""
    functions = [f for f in functions if f is not None]
    files = [Path(inspect.getfile(f)).resolve().parent for f in functions]
    out: dict[str, str] = {}
    for f, own in zip(functions, files):
        out |= {m.__name__: code_key(Path(m.__file__).read_text()) for m in closure([f], root or own)}
    return dict(sorted(out.items()))
