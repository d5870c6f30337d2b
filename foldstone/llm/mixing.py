"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a capacity of ``max_epochs`` times its size.  The level L solves
``sum(min(weight * L, capacity)) = budget``: sources are clamped at their capacity and the excess goes to the
others in proportion to their weights, until none is above.  Ordered by capacity/weight, the clamped sources form
a prefix, so L is the maximum over k of (budget - capacities before k) / (weights from k on); no iteration.

Documents are then repeated ``floor(target / size)`` times, and the rest is a seeded sample without replacement:
documents in the order of a keyed hash are taken once more while the middle of the document lies below the rest.
With 4096 hash buckets per source, only the bucket where the rest ends is sorted, so no task sees a whole source.

The hash is of id and text, so rows that share an id (or have none) are spread like any other; then id, size and a
hash of all columns decide.  What ties even there are copies of one row: they are counted, not sorted, and where the
rest ends among them just so many are taken, so a source's words differ from its target by at most half the size of
one document (half of its ``max_epochs`` + 1, if it is clamped).

Edge cases: a null text has size 0; null sources form one source, the last; sources of size 0 get target 0; the result
is the same for any input order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstone.llm.common import sent_if_small, shuffled, small_enough, stored, words_in

_BUCKET = 1 << 40
_PART = 10_000


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """Weights given in turn to the sources in code point order, null last.  One row per source: a small table."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``, whose sum is ``share`` of all sizes if feasible."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = sources.withColumn("cap", cap).withColumn("level", left / weight)
    filled = filled.withColumn("level", F.max("level").over(every))
    return filled.withColumn("target", F.greatest(F.lit(0.0), F.least("cap", F.col("weight") * F.col("level")))).drop("cap", "level")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """52 bits of a keyed hash of id and text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), blank(doc_id.cast("string")), F.lit(":"), blank(F.md5(text)))), 1, 13), 16, 10).cast("long")


def _key(size: Column, doc_id: Column, text: Column, every: list[str], seed: int) -> Column:
    """The sampling order: a keyed hash, then id, size and a hash of all columns for ties."""
    return F.struct(order_key(doc_id, text, seed).alias("u"), doc_id.cast("string").alias("id"), size.alias("n"), F.xxhash64(*every).alias("r"))


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, most_broadcast: int = 500_000) -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and copies; columns of these names are replaced.

    A source's decision is one row: whole repetitions, and the last document of the order that is taken once more.
    Only the bucket in which that one lies is sorted; texts stay where they are, as the decisions are broadcast (beyond
    ``most_broadcast`` sources: joined by salted source).
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    every = docs.columns
    key = _key(F.col("size"), F.col(id_col), F.col(text_col), [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"], seed)
    thin = docs.withColumn("size", words_in(F.col(text_col))).select(F.col(source_col).alias("source"), key.alias("k"))
    thin = stored(thin.groupBy("source", "k").agg(F.count("*").alias("m")), "mix")
    bucket = F.floor(F.col("k.u") / _BUCKET).cast("int")
    words = F.col("k.n") * F.col("m")
    buckets = stored(thin.groupBy("source", bucket.alias("b")).agg(F.sum(words).alias("bucket_size")), "mix-buckets")
    targets = water_fill(cyclic_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stored(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    ahead = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    own = targets.select(F.col("source").alias("s"), "rest")
    cut = placed.join(own, F.col("source").eqNullSafe(F.col("s"))).where(F.col("ahead") + F.col("bucket_size") > F.col("rest"))
    cut = cut.groupBy("source").agg(F.min_by(F.struct("b", "ahead", "rest"), "b").alias("c")).select(F.col("source").alias("s"), "c.*")
    cut = sent_if_small(stored(cut, "mix-cut"), most_broadcast)
    inside = W.partitionBy("s").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    edge = thin.withColumn("own_b", bucket).join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("own_b") == F.col("b")))
    start = F.col("ahead") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    # Of a key's m copies those are in whose middle lies below the rest.
    fits = F.least("m", F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("start") - F.col("k.n") / 2.0) / F.col("k.n")) + 1)).cast("long")
    edge = edge.withColumn("start", start).withColumn("in", F.when(F.col("k.n") > 0, fits).otherwise(0))
    taken = F.struct("k", "in", (F.col("in") < F.col("m")).alias("part"))
    last = edge.groupBy(F.col("s").alias("e")).agg(F.max(F.when(F.col("in") > 0, taken)).alias("last"), F.first("b").alias("cut"))
    plan = targets.join(last, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("__s"), "source_size", "target", F.col("whole").alias("__whole"), F.col("last.k").alias("__last"), F.col("last.in").alias("__in"), F.coalesce("last.part", F.lit(False)).alias("__part"), F.col("cut").alias("__cut"))
    plan = stored(plan, "mix-plan")
    sized = docs.withColumn("size", words_in(F.col(text_col)))
    if small_enough(plan, most_broadcast):
        joined = sized.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("__s")))
    else:
        salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = sized.withColumn("__own", F.pmod(F.xxhash64(id_col, text_col), F.lit(64)).cast("int")).join(shuffled(salted), F.col(source_col).eqNullSafe(F.col("__s")) & (F.col("__own") == F.col("__salt"))).drop("__own", "__salt")
    joined = joined.withColumn("__k", key)
    of = F.floor(F.col("__k.u") / _BUCKET)
    more = F.coalesce((of < F.col("__cut")) | ((of == F.col("__cut")) & (F.col("__k") <= F.col("__last"))), F.lit(False))
    copies = lambda once: F.when(F.col("size") > 0, F.col("__whole") + once.cast("long")).otherwise(0).cast("long")
    if plan.where("__part").limit(1).count():
        # Copies of one row at the edge are collapsed, and laid out again with the first of them taken.
        tied = F.col("__part") & (F.col("__k") == F.col("__last"))
        shared = [*every, "size", "source_size", "target", "__whole", "__in"]
        groups = joined.where(tied).groupBy(*shared).agg(F.count("*").alias("__m"))
        first = W.partitionBy(source_col).orderBy(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]).rowsBetween(W.unboundedPreceding, -1)
        groups = groups.withColumn("__from", F.coalesce(F.sum("__m").over(first), F.lit(0)))
        parts = groups.withColumn("__part_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1, F.lit(_PART).cast("long")))).repartition("__part_at")
        rows = parts.withColumn("__i", F.explode(F.sequence(F.col("__part_at"), F.least(F.col("__part_at") + _PART, "__m") - 1)))
        rows = rows.withColumn("copies", copies(F.col("__from") + F.col("__i") < F.col("__in")))
        plain = joined.where(~F.coalesce(tied, F.lit(False))).withColumn("copies", copies(more))
        joined = plain.select(*every, "size", "source_size", "target", "copies").unionByName(rows.select(*every, "size", "source_size", "target", "copies"))
    else:
        joined = joined.withColumn("copies", copies(more))
    return joined.select(*every, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken = copies * size."""
    decided = decide(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), **how)
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
