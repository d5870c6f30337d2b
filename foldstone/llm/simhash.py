"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half the hashes of the text's word shingles, repeats
counted.  Covering masks (Pagh 2016): each bit position gets a non-zero vector of radius + 1 bits, and table v keeps
the positions whose vector has odd parity with v.  Any radius positions span less than the whole space, so some v is
orthogonal to all of them: every pair within the radius agrees in some table, without exception.

Components within radius 2 need no pairs: two fingerprints are within 2 bits if and only if the balls of radius 1
around them meet, so each fingerprint that shares a bucket with another is linked to the least owner of each of its 65
ball members.  A bucket of thousands costs 65 rows each, never thousands squared.

``near_duplicates`` serves five-word shingles and a Jaccard similarity of 0.8.  Candidates come first from covering
tables over ``prints`` fingerprints of the set of two-word shingles (which an edit moves least): each text is paired
with the first of its bucket, so a family of thousands puts out its members and not its pairs.  The pairs they don't
join come from an exact prefix join: with the shingles of every set in one order, two sets at the similarity share one
of their first n - ceil(similarity * n) + 1, so no linked pair is missed.  The order is rare first, by frequencies in
a sample of texts: it decides what the join costs and never what it finds.  Pairs of that join first meet as counts of
their shingles by bits of their hashes, which bound from above what two sets share: only pairs that can't have the
similarity go.  Every other candidate pair of distinct texts is confirmed on its whole sets of five-word shingles.  Texts
are known by 64-bit hashes of their words.

Edge cases: null and wordless texts have fingerprint 0, linked like any other; texts shorter than a shingle count as
one; a null id takes part and, if alone, has a null component; repeated rows, and different texts under one id, are
documents of their own; empty tables give none.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import sent_if_small, shuffled, stored
from foldstone.llm.graph import components

_CHUNK = 1 << 16
_SAMPLE = 40_000_000  # bytes of text whose shingles are counted for the order of the prefix join
_SPARSEST = 16  # and at least one text of so many
_MOST_COUNTED = 500_000  # shingles of 16 bytes that go to the driver
_MOST_HELD = 4_000_000  # shingle hashes that a task keeps
_MOST_BROADCAST = 500_000  # rows of up to three longs; a table of them takes a few hundred bytes a row of the driver's memory
_HOT = 4096  # members of a bucket from which it is dealt to several


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of the text with A-Z lower-cased, in order."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[k : k + _CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def _remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent set of hashes made from one (0: the hashes themselves)."""
    if not k:
        return hashes
    h = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long)."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(x.as_py(), width, seed)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return thin.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 5) -> list[int]:
    """2**(radius+1) - 1 masks, as signed 64-bit integers, with the covering guarantee for ``radius``."""
    vectors = list(range(1, 1 << (radius + 1)))
    random.Random(seed).shuffle(vectors)
    of = [vectors[i % len(vectors)] for i in range(bits)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = reduce(lambda m, i: m | ((v & of[i]).bit_count() & 1) << i, range(bits), 0)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def _tables(fps: DataFrame, radius: int, *more: Column) -> Column:
    """One key for each covering table: a hash of the table's number and the masked fingerprint."""
    return F.explode(F.transform(F.array(*[F.lit(m) for m in covering_masks(radius)]), lambda m, t: F.xxhash64(t, m.bitwiseAND(F.col("fp")), *more)))


def links_within_two(fps: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints whose components are those of all pairs within 2 bits."""
    distinct = stored(fps.select("fp").distinct(), "fps")
    keyed = distinct.select(_tables(distinct, 2).alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("key")
    near = keyed.join(shuffled(shared), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    balls = stored(near.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("ball")), "balls")
    owners = balls.groupBy("ball").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most").select("ball", "least")
    return balls.join(shuffled(owners), "ball").where("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): links at 2 or fewer differing bits, component = least doc_id reachable."""
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "simhash")
    linked = components(links_within_two(fps))
    owner = fps.groupBy("fp").agg(F.min("doc_id").alias("own"))
    rooted = owner.join(shuffled(linked), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    # Fingerprints without a link keep their own id; only linked ones need the second join.
    of = rooted.where(F.col("node").isNotNull()).join(shuffled(least), "root").select("fp", "component_id").union(rooted.where(F.col("node").isNull()).select("fp", "own"))
    return fps.join(shuffled(of), "fp").select("doc_id", "fp", "component_id")


def star_pairs(reps: DataFrame, *, radius: int, most_bits: int) -> DataFrame:
    """(a, b) of nodes: each with the first of every covering bucket it is in, if they differ in at most ``most_bits``.

    ``reps`` has (node, fps: one or more fingerprints).
    """
    each = reps.select("node", F.posexplode("fps").alias("print", "fp"))
    keyed = each.select(_tables(each, radius, F.col("print")).alias("key"), "node", "fp")
    first = keyed.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", F.col("p.node").alias("a"), F.col("p.fp").alias("of"))
    near = keyed.join(shuffled(first), "key").where((F.col("node") != F.col("a")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("of"))) <= most_bits))
    return near.select("a", F.col("node").alias("b")).distinct()


def _bucket_pairs(keyed: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 512) -> DataFrame:
    """(a, b) with a < b of nodes of different roots in one bucket of ``keyed`` (key, node, root, more whole numbers) for which ``near`` holds.

    ``near`` gets the columns of the one side and of the other, which broadcast against each other.
    """
    width = len(keyed.columns)
    sorted_ = keyed.repartition("key").sortWithinPartitions("key")

    def within(r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        r = r[:, np.argsort(r[2], kind="stable")]
        n = r.shape[1]
        for p in range(0, n, block):
            for q in range(p, n, block):
                if r[2, p] == r[2, min(q + block, n) - 1]:
                    continue  # all of one root
                ok = near(r[:, p : p + block, None], r[:, None, q : q + block])
                x, y = np.nonzero(np.triu(ok, 1) if p == q else ok)
                if len(x):
                    a, b = r[1, p + x], r[1, q + y]
                    yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, out_a)) >= least and out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                out_a.clear(), out_b.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """All buckets of ``rows``, which are complete: short runs by lag, long ones by block."""
            key, i = rows[:2]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            sizes = np.diff(cuts)
            lag, most = 1, int(min(sizes.max(initial=0), 64))
            short = np.repeat(sizes <= 64, sizes)
            at = np.flatnonzero(short & np.repeat(sizes > 1, sizes))
            last = np.repeat(cuts[1:], sizes)
            while len(at) and lag < most:
                at = at[at + lag < last[at]]
                x, y = at, at + lag
                ok = near(rows[:, x], rows[:, y])
                if ok.any():
                    out_a.append(np.minimum(i[x[ok]], i[y[ok]]))
                    out_b.append(np.maximum(i[x[ok]], i[y[ok]]))
                    yield from flush(50_000)
                lag += 1
            for k in np.flatnonzero(sizes > 64):
                for a, b in within(rows[:, cuts[k] : cuts[k + 1]]):
                    out_a.append(a)
                    out_b.append(b)
                    yield from flush(50_000)

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(width)])
            # Only the last key may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left")) if rows.shape[1] else 0
            if cut:
                yield from whole(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            if rows.shape[1]:
                held.append(rows[:, cut:])
        if held:
            yield from whole(np.concatenate(held, axis=1))
        yield from flush(1)

    return sorted_.mapInArrow(run, "a long, b long").where("a != b").distinct()


def _node(text: bytes | None) -> int:
    """What a text is known by: XXH64 of its words, signed."""
    h = xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _sketch(hashes: np.ndarray) -> bytes | None:
    """How many of the hashes have each value of their low bits, with about 2 to 4 for each; None if a count exceeds a byte."""
    buckets = max(64, 1 << (max(len(hashes) - 1, 1) // 4).bit_length())
    counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _may_have(x: bytes | None, y: bytes | None, similarity: float) -> bool:
    """Whether sets with these sketches may have the similarity: they share no more than the lesser counts."""
    if x is None or y is None:
        return True
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    b = b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)
    most = int(np.minimum(a, b).sum())
    return most >= similarity * (int(a.sum(dtype=np.int64)) + int(b.sum()) - most) - 1e-6


def _frequencies(thin: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the shingles found in two or more sampled texts, their counts, and how many texts one sampled stands for.

    The most frequent ``_MOST_COUNTED`` go to the driver, as Arrow columns and without a sort.
    """
    size = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = max(1, min(_SPARSEST, size // _SAMPLE))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x.as_py(), width)).view(np.int64))], ["h"])

    counts = thin.where(F.pmod(F.xxhash64(F.lit("often"), "raw"), F.lit(every)) == 0).mapInArrow(sets, "h long").groupBy("h").count().where("count > 1")
    counts = stored(counts, "counts")
    least, room = 1, _MOST_COUNTED
    for often, n in sorted(map(tuple, counts.groupBy("count").agg(F.count("*")).collect()), reverse=True):
        if n > room:
            least = often
            break
        room -= n
    top = counts.where(F.col("count") > least).union(counts.where((F.col("count") == least) & (F.lit(least) > 1)).limit(room)).toArrow()
    hashes, n = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order], every


def prefix_pairs(thin: DataFrame, classes: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """(a, b) with a < b of nodes in different components that may have the similarity: all pairs that have it, and others.

    ``thin`` has (raw, text), ``classes`` (raw, node, root).  A common shingle counts only where what follows it in both sets still
    allows the similarity.  Buckets that look large in the sample are dropped if all their members have one root, else
    dealt by node into blocks, one bucket for each two.  Classes are as many as the texts, so they are never sent whole.
    """
    sent = thin.sparkSession.sparkContext.broadcast(_frequencies(thin, width))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, every = sent.value
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.unique(shingle_hashes(x.as_py(), width))
                if not len(s):
                    continue
                often = np.zeros(len(s), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[place] == s, counts[place], 0)
                first = np.argsort(often, kind="stable")[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
                blocks = np.maximum(-(-often[first] * every // _HOT), 1)
                for column, value in zip(out, (i, len(s), s[first].view(np.int64), blocks.astype(np.int32) if (blocks > 1).any() else None, _sketch(s))):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], ["raw", "n", "keys", "blocks", "sketch"])

    rows = thin.mapInArrow(prefixed, "raw long, n int, keys array<bigint>, blocks array<int>, sketch binary").join(shuffled(classes), "raw")
    rows = stored(rows.select("node", "root", "n", "keys", "blocks", "sketch"), "prefixes")
    each = rows.select("node", "root", "n", "blocks", F.posexplode("keys").alias("at", "key")).select("key", "node", "root", "n", "at", F.coalesce(F.get("blocks", F.col("at")), F.lit(1)).alias("blocks"))
    hot = stored(each.where("blocks > 1"), "hot")
    mixed = hot.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("other")
    dealt = hot.join(shuffled(mixed), "key", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("key"), "node", "root", "n", "at")
    share = similarity / (1 + similarity)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x[2] != y[2]) & (np.minimum(x[3] - x[4], y[3] - y[4]) >= share * (x[3] + y[3]) - 1e-6)

    def may_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_may_have(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    met = _bucket_pairs(each.where("blocks = 1").drop("blocks").union(dealt), near)
    sketch = lambda of: shuffled(rows.select(F.col("node").alias(of), F.col("sketch").alias(f"of_{of}")))
    return met.join(sketch("b"), "b").join(sketch("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(may_have, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, prints: int = 2, radius: int = 3, most_bits: int = 16) -> DataFrame:
    """(doc_id, raw, component_id, keep): texts linked at Jaccard >= ``similarity`` of their ``width``-word shingle sets.

    Texts with the same words are one node; links are found between nodes only.  ``raw`` is a hash of id and text;
    ``keep`` marks the rows of the least id (null ids last) of each component.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("raw"), F.col(text_col).cast("binary").alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = [], []
            for x in batch.column(2):
                text = x.as_py()
                hashes = np.unique(shingle_hashes(text, 2))
                nodes.append(_node(text))
                fps.append([majority(_remixed(hashes, k)) for k in range(prints)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "raw", "node", "fps"])

    all_ = stored(thin.mapInArrow(printed, "doc_id long, raw long, node long, fps array<bigint>"), "prints")
    reps = stored(all_.groupBy("node").agg(F.min("raw").alias("raw"), F.first("fps").alias("fps"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("least"), F.count("*").alias("rows")), "reps")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of the similarity, on whole sets; those of the last texts are kept, as a text comes in many pairs."""
        held: dict[int, np.ndarray] = {}

        def shingles(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in held:
                while sum(map(len, held.values())) > _MOST_HELD:
                    held.pop(next(iter(held)))
                held[node] = np.unique(shingle_hashes(text.as_py(), width))
            return held[node]

        for batch in batches:
            ok = []
            for a, b, of_a, of_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = shingles(a, of_a), shingles(b, of_b)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(shared >= similarity * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        """(u, v): links of at least the similarity that give all components of the pairs."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(shuffled(reps.select("node", "raw")), "node")
        # Texts are sent to their pairs, as they compress better than hashes of their shingles.
        held = stored(thin.join(sent_if_small(wanted, _MOST_BROADCAST), "raw").select("node", "text"), "texts")
        texts = lambda of: shuffled(held.select(F.col("node").alias(of), F.col("text").alias(f"t{of}")))

        def confirmed(some: DataFrame) -> DataFrame:
            return some.join(texts("b"), "b").join(texts("a"), "a").select("a", "b", "ta", "tb").mapInArrow(alike, "a long, b long").distinct()

        # First each text against its least partner; then only pairs that those links don't join already, so that a family
        # of thousands costs its members and not its pairs.
        stars = stored(confirmed(pairs.groupBy("b").agg(F.min("a").alias("a"))), "stars")
        root = lambda of: shuffled(stars.select(F.col("b").alias(f"of_{of}"), F.col("a").alias(f"root_{of}")))
        rest = pairs.join(root("a"), F.col("a") == F.col("of_a"), "left").join(root("b"), F.col("b") == F.col("of_b"), "left")
        rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(shuffled(stars), ["a", "b"], "left_anti")
        return stored(stars.union(confirmed(rest)).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    close = links(stored(star_pairs(reps, radius=radius, most_bits=most_bits), "pairs"))
    roots = components(close).withColumnRenamed("node", "of")
    classes = stored(reps.join(shuffled(roots), F.col("node") == F.col("of"), "left").select("raw", "node", F.coalesce("root", "node").alias("root")), "classes")
    far = links(stored(prefix_pairs(thin.select("raw", "text"), classes, width=width, similarity=similarity), "pairs"))
    linked = components(close.union(far)).withColumnRenamed("node", "of")
    of = reps.join(shuffled(linked), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = of.groupBy("root").agg(F.min("least").alias("first"))
    own = of.join(shuffled(first), "root").select("node", "first")
    return all_.join(shuffled(own), "node").select("doc_id", "raw", F.col("first.doc_id").alias("component_id"), (F.col("raw") == F.col("first.raw")).alias("keep"))


def keep_one(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of least id: other rows go by id and text, and a row repeated whole stays once."""
    raws = groups.groupBy("raw").agg(F.first("keep").alias("keep"), F.count("*").alias("n"))
    raws = stored(raws.where(~F.col("keep") | (F.col("n") > 1)).select(F.col("raw").alias("__r"), "keep"), "gone")
    gone, again = raws.where(~F.col("keep")).select("__r"), raws.where("keep").select("__r")
    fits = lambda df: sent_if_small(df, _MOST_BROADCAST)
    keyed = docs.withColumn("__raw", F.xxhash64(id_col, text_col))
    kept = keyed.join(fits(gone), F.col("__raw") == F.col("__r"), "left_anti")
    if again.limit(1).count():
        once = kept.join(fits(again), F.col("__raw") == F.col("__r"), "left_semi").dropDuplicates(["__raw"])
        kept = kept.join(fits(again), F.col("__raw") == F.col("__r"), "left_anti").unionByName(once)
    return kept.drop("__raw")
