"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

Rows are hashed to shards of about ``shard_rows``; a shard's index is one row of flat arrays (vectors, neighbours of
each layer, ids in a member list), written to the shared folder, so it can be kept and searched again.  Nearness is
the inner product: graphs are built on vectors padded to one length, where the order by inner product and by distance
agree.  Equal vectors are one node whose members are all their ids, so thousands of copies neither break the graph nor
hide behind each other.  Insertion and search run for a block of vectors at a time, in numpy.

Queries visit every shard, in blocks, and each shard returns its k best with scores in double precision on the
original vectors; a window merges them.  Every row is indexed; recall is measured in the tests and the README.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and null ids take no part;
vectors are compared with those of the same length only; of the vectors of one length under one id the least, by
components, counts, so an id is met once; a query never meets its own id; fewer than k candidates: all; ties go to the smaller id; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.llm.common import stored

DEGREE, UPPER, EF_BUILD, STEP = 32, 16, 48, 4
INDEX = "dim int, shard int, nodes int, vectors binary, ids binary, offsets binary, layers array<struct<members:binary,links:binary>>"


def _beam(q: np.ndarray, entry: np.ndarray, x: np.ndarray, links: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes (block, ef) of one layer for each vector of ``q``, best first, -1 padded, and their inner products."""
    n, width = len(q), links.shape[1]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # the pad, -1
    rows = np.arange(n)
    ids = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", q, x[entry]), False
    seen[rows, entry] = True
    live = rows
    while len(live):
        pick = np.where(done[live], -np.inf, sims[live])
        at = np.argpartition(-pick, STEP - 1, axis=1)[:, :STEP] if ef > STEP else np.argsort(-pick, axis=1)
        open_ = np.take_along_axis(~done[live], at, 1)
        node = np.where(open_, np.take_along_axis(ids[live], at, 1), -1)
        done[live[:, None], at] = True
        near = np.where(node[:, :, None] >= 0, links[node], -1)
        for w in range(node.shape[1]):
            old = seen[live[:, None], near[:, w]]
            seen[live[:, None], near[:, w]] = True
            near[:, w][old] = -1
        near = near.reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("ij,ij->i", q[live[r]], x[near[r, c]])
        all_s = np.concatenate([sims[live], new], axis=1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[live] = np.take_along_axis(all_s, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], axis=1), best, 1)
        live = live[~done[live].all(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _choose(cand: np.ndarray, sims: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """The neighbours to keep: best first, those nearer to the vector than to one already kept, then the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    n, m = cand.shape
    real = cand >= 0
    if m <= width:
        return np.concatenate([np.where(real, cand, -1), np.full((n, width - m), -1, cand.dtype)], axis=1)
    v = x[cand]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, m), bool)
    for k in range(m):
        clash = (kept & (between[:, k, :] >= sims[:, k, None])).any(axis=1)
        kept[:, k] = real[:, k] & ~clash & (kept.sum(axis=1) < width)
    rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)) * m + np.arange(m), axis=1)[:, :width]
    return np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(cand, rank, 1), -1)


def _add_links(links: np.ndarray, x: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Append ``new[i]`` to the list of ``to[i]``; lists that overflow are chosen anew."""
    width = links.shape[1]
    fresh = ~(links[to] == new[:, None]).any(axis=1)
    to, new = to[fresh], new[fresh]
    if not len(to):
        return
    order = np.lexsort((-np.einsum("ij,ij->i", x[to], x[new]), to))
    to, new = to[order], new[order]
    owners, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    keep = rank < width
    extra = np.full((len(owners), min(width, int(count.max()))), -1, links.dtype)
    extra[np.repeat(np.arange(len(owners)), count)[keep], rank[keep]] = new[keep]
    for k in range(0, len(owners), 2048):
        own = owners[k : k + 2048]
        cand = np.concatenate([links[own], extra[k : k + 2048]], axis=1)
        sims = np.where(cand >= 0, np.einsum("ik,ijk->ij", x[own], x[cand]), -np.inf).astype(np.float32)
        links[own] = _choose(cand, sims, x, width)


def build_layers(x: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(members, links)], top layer first; links index the whole shard and are flat, -1 padded."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(UPPER)).astype(int), 6)
    order = np.lexsort((np.arange(n), -level))
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(int(level[order[0]]), -1, -1):
        members = order[: int((level >= at).sum())]
        links = np.full((n + 1, DEGREE if at == 0 else UPPER), -1, np.int32)
        done = 0
        while done < len(members):
            block = members[done : done + (64 if not done else min(1024, done))]
            q = x[block]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            own = np.argsort(-near, axis=1)[:, : min(links.shape[1], len(block) - 1)] if len(block) > 1 else np.zeros((1, 0), int)
            cand, sims = block[own].astype(np.int32), np.take_along_axis(near, own, 1)
            if done:
                entry = descend(q, x, layers) if layers else np.full(len(block), members[0])
                ids, s = _beam(q, entry, x, links, EF_BUILD)
                cand, sims = np.concatenate([ids, cand], axis=1), np.concatenate([s, sims], axis=1)
            if cand.shape[1]:
                links[block] = _choose(cand, sims, x, links.shape[1])
                r, c = np.nonzero(links[block] >= 0)
                _add_links(links, x, links[block][r, c].astype(np.int64), block[r])
            done += len(block)
        layers.append((members, links))
    return layers


def descend(q: np.ndarray, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The entry node below ``layers`` for each vector."""
    entry = np.full(len(q), layers[0][0][0])
    for _, links in layers:
        entry = _beam(q, entry, x, links, 8)[0][:, 0].astype(np.int64)
    return entry


def _padded(x: np.ndarray) -> np.ndarray:
    """Vectors scaled and padded so that all have length 1."""
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    x = x / norms.max()
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (norms / norms.max()) ** 2))[:, None]], axis=1).astype(np.float32)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    fine = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).withColumn("dim", F.size("v"))


def shard_counts(rows: DataFrame, shard_rows: int) -> dict[int, int]:
    """Shards for each vector length."""
    return {r["dim"]: -(-r["count"] // shard_rows) for r in rows.groupBy("dim").count().collect()}


def _by_dim(shards: dict[int, int]):
    return F.element_at(F.create_map(*[F.lit(k) for pair in shards.items() for k in pair]), F.col("dim"))


def build_index(rows: DataFrame, *, id_col: str, vector_col: str, shard_rows: int = 8192) -> tuple[DataFrame, dict[int, int]]:
    """One row of flat arrays per shard, stored; and the number of shards by vector length."""
    valid = _valid(rows, id_col, vector_col)
    shards = shard_counts(valid, shard_rows)
    if not shards:
        return rows.sparkSession.createDataFrame([], INDEX), shards
    placed = valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), _by_dim(shards)).cast("int"))

    def one(part: pa.Table) -> pa.Table:
        dim, shard = part["dim"][0].as_py(), part["shard"][0].as_py()
        ids = part["vec_id"].to_numpy()
        v = part["v"].combine_chunks()
        v = (pa.chunked_array(v) if not isinstance(v, pa.ChunkedArray) else v)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in v.chunks]).reshape(-1, dim)
        order = np.lexsort((*flat.T[::-1], ids))
        order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
        ids, flat = ids[order], flat[order]
        nodes, inverse = np.unique(flat, axis=0, return_inverse=True)
        by = np.lexsort((ids, inverse.ravel()))
        members, owner = ids[by], inverse.ravel()[by]
        offsets = np.searchsorted(owner, np.arange(len(nodes) + 1)).astype(np.int64)
        layers = [{"members": m.astype(np.int32).tobytes(), "links": links.tobytes()} for m, links in build_layers(_padded(nodes))]
        layer = pa.struct([("members", pa.binary()), ("links", pa.binary())])
        kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("nodes", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("offsets", pa.binary()), ("layers", pa.list_(pa.field("element", layer)))])
        return pa.table({"dim": [dim], "shard": [shard], "nodes": [len(nodes)], "vectors": [nodes.tobytes()], "ids": [members.astype(np.int64).tobytes()], "offsets": [offsets.tobytes()], "layers": [layers]}, schema=kinds)

    return stored(placed.groupBy("dim", "shard").applyInArrow(one, INDEX), "hnsw"), shards


class _Shard:
    def __init__(self, row: dict):
        n = row["nodes"]
        self.v = np.frombuffer(row["vectors"], np.float64).reshape(n, row["dim"])
        self.x = _padded(self.v)
        self.ids, self.offsets = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)
        self.layers = [(np.frombuffer(l["members"], np.int32), np.frombuffer(l["links"], np.int32).reshape(n + 1, -1)) for l in row["layers"]]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, int, float]]:
        scaled = np.concatenate([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        entry = descend(scaled, self.x, self.layers[:-1]) if len(self.layers) > 1 else np.full(len(q), self.layers[0][0][0])
        found, _ = _beam(scaled, entry, self.x, self.layers[-1][1], ef)
        for i in range(len(q)):
            nodes = found[i][found[i] >= 0]
            exact = self.v[nodes] @ q[i]
            best: list[tuple[float, int]] = []
            for s, node in sorted(zip(exact.tolist(), nodes.tolist()), key=lambda p: -p[0]):
                if len(best) >= k and s < best[k - 1][0]:
                    break
                ids = self.ids[self.offsets[node] : min(self.offsets[node + 1], self.offsets[node] + k + 1)].tolist()
                best += [(s, j) for j in ids if j != qid[i]]
                best.sort(key=lambda p: (-p[0], p[1]))
            yield from ((int(qid[i]), j, s) for s, j in best[:k])


def search(index: DataFrame, shards: dict[int, int], queries: DataFrame, *, id_col: str, vector_col: str, k: int = 20, ef: int = 128, block: int = 512, task_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; at least 2 k nodes are kept open.

    A task gets one shard, a bounded row, and about ``task_queries`` queries: the shard is sent to as many tasks as that takes.
    """
    spark, ef = index.sparkSession, max(ef, 2 * k)
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _valid(queries, id_col, vector_col).groupBy(F.col("vec_id").alias("qid")).agg(F.min("v").alias("qv")).withColumn("dim", F.size("qv"))
    asked = stored(asked.where(F.col("dim").isin(list(shards))), "hnsw-queries")
    salts = -(-asked.count() // task_queries) or 1
    asked = asked.withColumn("salt", F.pmod(F.xxhash64(F.lit("block"), "qid"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), _by_dim(shards) - 1)))
    sent = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = sent.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    placed = both.repartition("dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and shard is not None:
                got = list(shard.search(np.array([h[0] for h in held]), np.array([h[1] for h in held], np.float64), k, ef))
                held.clear()
                cols = list(zip(*got)) if got else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            qids, qvs = batch.column("qid"), batch.column("qv")
            for i in range(batch.num_rows):
                if kinds[i] == 0:
                    yield from flush()
                    shard = _Shard({name: batch.column(name)[i].as_py() for name in ("dim", "nodes", "vectors", "ids", "offsets", "layers")})
                else:
                    held.append((qids[i].as_py(), qvs[i].as_py()))
                    if len(held) >= block:
                        yield from flush()
        yield from flush()

    found = placed.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
