"""URL block and allow lists by hashed expressions.

Each URL is expanded into the expressions (host suffix, path prefix) that some rule could have, and equi-joined with
the rules on the first 8 hex digits of the expression's SHA-256; a hit counts only if the whole digest agrees.
Suffixes are expanded only to the label counts that occur among the rules, and prefixes only to the lengths that
occur, so a URL of many labels or slashes stays cheap and nothing is lost.  The longest rule wins; of equally long
ones the one with the longer host, then block before allow.

The rules are broadcast if they are at most ``most_broadcast``, else shuffled.  Edge cases: a null URL or one without
``://`` has empty host and path and fits no rule; repeated rows are judged each; an empty table, or no rules, is fine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import small_enough

_SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(rule, action) pairs; a rule is host and path in one string, such as ``example.net/en/``."""
    return spark.createDataFrame([(r, a) for r, a in rules], "rule string, action string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", most_broadcast: int = 200_000) -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict; columns of these names are replaced."""
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col(url_col))
    rules = rules.where(F.col("rule").isNotNull()).withColumn("__rh", F.substring_index("rule", "/", 1)).withColumn("__rp", F.expr("substring(rule, length(__rh) + 1)"))
    shapes = rules.agg(F.array_sort(F.collect_set(F.size(F.split("__rh", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("__rp"))).alias("lengths")).first()
    pages = pages.withColumn("host", host).withColumn("path", path)
    if not shapes["labels"]:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    labels = F.array(*[F.lit(x) for x in shapes["labels"]])
    lengths = F.array(*[F.lit(x) for x in shapes["lengths"]])
    count = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.filter(labels, lambda k: k <= count), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(F.concat(s, p)))))
    keyed = rules.withColumn("__digest", _digest(F.col("rule"))).groupBy("__digest").agg(F.max_by(F.struct("rule", "action"), F.struct(F.col("action"))).alias("__r"), F.max(F.struct(F.length("rule"), F.length("__rh"))).alias("__rank")).select("__digest", "__rank", F.col("__r.rule").alias("__rule"), F.col("__r.action").alias("__action"), F.substring("__digest", 1, _SHORT).alias("__short"))
    # Hits are looked up for each distinct (host, path): repeated URLs, however many, are judged once.
    asked = pages.select("host", "path").distinct().withColumn("__d", F.explode(digests)).withColumn("__s", F.substring("__d", 1, _SHORT))
    side = F.broadcast(keyed) if small_enough(keyed, most_broadcast) else keyed
    hits = asked.join(side, (F.col("__s") == F.col("__short")) & (F.col("__d") == F.col("__digest")))
    best = hits.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max_by(F.struct("__rule", "__action"), F.struct("__rank", "__action")).alias("__best"))
    return pages.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").withColumn("rule", F.col("__best.__rule")).withColumn("verdict", F.coalesce("__best.__action", F.lit(default))).drop("__h", "__p", "__best")
