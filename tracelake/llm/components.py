"""Connected components of a graph given by links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import cut, drop, plain, tidy


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Attach each node's larger (or else its smaller) neighbours to the least one of them and itself."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u"))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label of every node in `links` (a, b): the label is the least node of its component.

    The pairs stay distributed; a round's result goes to the shared folder, and the driver sees one
    row of sums, by which it knows that a round changed nothing.
    """
    pairs = cut(spark, links.where("a <> b").select("a", "b").distinct(), "pairs", narrow=True)

    def mark(df: DataFrame) -> tuple:
        sums = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        with tidy(spark), plain(spark):
            return tuple(sums.first())

    seen = mark(pairs)
    while seen[0]:
        last, pairs = pairs, cut(spark, _star(_star(pairs, True), False), "pairs", narrow=True)
        drop(spark, last)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    named = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = cut(spark, named.union(pairs.select("b", "b")).groupBy("node").agg(F.min("label").alias("label")), "labels", narrow=True)
    drop(spark, pairs)
    return labels
