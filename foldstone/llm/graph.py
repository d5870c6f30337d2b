"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import shuffled, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them: larger neighbours (large), or smaller ones and itself."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.join(shuffled(least), F.col("u") == F.col("n"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, root) for every node that has a link to another; root is the component's least node.

    Every round is written to the shared folder, and only three sums go to the driver.  Rounds grow with the
    logarithm of the longest path; beyond ``most_rounds`` an error is raised, never a partial result.
    """
    state = None
    edges = stored(edges.select("u", "v").where(F.col("u") != F.col("v")), "edges")
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        edges = stored(_star(_star(edges, True), False), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
