"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions in
time linear in the features, by the sum-of-squares identity.  Words are hashed into 2**14 buckets with their
normalised counts; the dense features are shares of character classes, word and line statistics and log sizes.

It is fitted on at most ``most_rows`` labelled documents (least keyed hash of the id; a documented bound), by Adam on
the log loss, seeded; every document is scored over its whole text.

Edge cases: null text is an empty one, and gets a score like any other; conflicting or repeated labels of a document
count as rows each; null labels are ignored; with no labels or one class, scores are the smoothed share of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 14
_CLASS = np.zeros(256, np.int64)
for _c, _k in ((b" \t\n\r\x0b\x0c", 1), (b"0123456789", 2), (b".,;:!?'\"-()", 3), (b"#$%&*+/<=>@[\\]^_`{|}~", 4)):
    _CLASS[list(_c)] = _k
_CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 5, 6, 7
DENSE = 18


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and the dense features."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    dense = np.zeros(DENSE)
    if not words:
        dense[0] = 1.0
        return np.zeros(0, np.int64), np.zeros(0), dense
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    counts = np.bincount(hashed & (WORDS - 1), minlength=WORDS)
    at = counts.nonzero()[0]
    x = np.log1p(counts[at])
    x /= np.sqrt((x * x).sum())
    shares = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = raw.split(b"\n")
    dense[1:9] = shares
    dense[9] = np.log1p(len(words)) / 8
    dense[10] = np.log1p(len(lines)) / 6
    dense[11] = lengths.mean() / 10
    dense[12] = lengths.std() / 10
    dense[13] = len(set(words)) / len(words)
    dense[14] = len(set(lines)) / len(lines)
    dense[15] = min(1.0, len(words) / len(lines) / 40)
    dense[16] = (lengths == 1).mean()
    dense[17] = np.mean(hashed[1:] == hashed[:-1]) if len(words) > 1 else 0.0
    return at, x, dense


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # (WORDS + DENSE,)
    v: np.ndarray  # (WORDS + DENSE, rank)
    mean: np.ndarray
    scale: np.ndarray

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, x, dense = features(text)
        return np.concatenate([at, np.arange(WORDS, WORDS + DENSE)]), np.concatenate([x, np.clip((dense - self.mean) / self.scale, -4, 4)])

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        return float(self.bias + self.w[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(*self.encode(text)), -35, 35))))


def fit(texts: list[str | None], labels: list[int], *, rank: int = 4, epochs: int = 6, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Adam on the log loss, one mini-batch of 32 documents a step."""
    n, size = len(texts), WORDS + DENSE
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (n + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)), np.zeros(DENSE), np.ones(DENSE))
    if n == 0 or y.min() == y.max():
        machine.v[:] = 0
        return machine
    rows = [features(t) for t in texts]
    dense = np.array([r[2] for r in rows])
    machine.mean, machine.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    dense = np.clip((dense - machine.mean) / machine.scale, -4, 4)
    tail = np.arange(WORDS, size)
    encoded = [(np.concatenate([a, tail]), np.concatenate([x, d])) for (a, x, _), d in zip(rows, dense)]
    params = [machine.w, machine.v]
    m = [np.zeros_like(p) for p in params]
    s = [np.zeros_like(p) for p in params]
    mb = sb = 0.0
    t = 0
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            at = np.concatenate([encoded[k][0] for k in chunk])
            x = np.concatenate([encoded[k][1] for k in chunk])
            starts = np.cumsum([0] + [len(encoded[k][0]) for k in chunk])
            row = np.repeat(np.arange(len(chunk)), np.diff(starts))
            vx = machine.v[at] * x[:, None]
            total = np.add.reduceat(vx, starts[:-1], axis=0)
            z = machine.bias + np.add.reduceat(machine.w[at] * x, starts[:-1]) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts[:-1]))
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[chunk]) / len(chunk)
            ids, inverse = np.unique(at, return_inverse=True)
            gx = g[row] * x
            gw = np.bincount(inverse, gx, len(ids)) + decay * machine.w[ids]
            gv = np.zeros((len(ids), machine.v.shape[1]))
            np.add.at(gv, inverse, gx[:, None] * (total[row] - vx))
            gv += decay * machine.v[ids]
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, grad in ((0, gw), (1, gv)):
                m[k][ids] = 0.9 * m[k][ids] + 0.1 * grad
                s[k][ids] = 0.999 * s[k][ids] + 0.001 * grad * grad
                params[k][ids] -= step * m[k][ids] / (np.sqrt(s[k][ids]) + 1e-8)
            mb, sb = 0.9 * mb + 0.1 * g.sum(), 0.999 * sb + 0.001 * g.sum() ** 2
            machine.bias -= step * mb / (np.sqrt(sb) + 1e-8)
    return machine


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000) -> Machine:
    """Fit on the ``most_rows`` labelled documents with the least keyed hash of their id."""
    order = F.xxhash64(F.lit("quality"), F.col(id_col))
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), order.alias("__o")).orderBy("__o", "__id", "__y").limit(most_rows)
    marks: dict[int, list[int]] = {}
    for r in chosen.collect():
        marks.setdefault(r["__id"], []).append(r["__y"])
    rows = docs.where(F.col(id_col).isin(list(marks))).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).collect()
    rows = sorted(((r["__id"], r["__t"] or "") for r in rows))
    pairs = [(t, y) for i, t in rows for y in marks[i]]
    return fit([t for t, _ in pairs], [y for _, y in pairs])


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, between 0 and 1; a column of this name is replaced."""
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    place = docs.columns.index(text_col)
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [known.value.score(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)
