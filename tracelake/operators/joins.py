"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordering import carried, numbered, quantile_bucket


def micros(time: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})")


def hits_and_misses(events: DataFrame, considered: DataFrame, present: DataFrame, event: str, station: str, by: Column | None = None) -> DataFrame:
    """Per event (and bin), the considered stations that are present and those that aren't.

    Each event gets a row for each bin, not for each station: the bins with their numbers of stations are one row
    that is broadcast (there are as many as distance bins).  Hits are counted by a join, misses follow.
    """
    if by is None:
        by = F.lit(0)
    binned = considered.select(station, by.alias("bin")).distinct()
    totals = binned.groupBy("bin").agg(F.count("*").alias("n"))
    found = present.select(event, station).distinct().join(binned, station).groupBy(event, "bin").agg(F.count("*").alias("hits"))
    bins = totals.agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    every = events.select(event).distinct().crossJoin(F.broadcast(bins)).select(event, F.inline("bins"))
    out = every.join(found, [event, "bin"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(event, "bin", "hits", (F.col("n") - F.col("hits")).alias("misses"))


def with_defaults(facts: DataFrame, dimension: DataFrame, on: list[str], defaults: dict[str, float]) -> DataFrame:
    """Left join; what the dimension lacks gets the default."""
    joined = facts.join(dimension, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, time: str, value: str, segments: int = 64) -> DataFrame:
    """For each left row the value of the right row of its key that is nearest in time; the earlier of
    equals, and of rows at the same time the one with the largest value.

    Both sides are merged, cut into segments of time, and scanned once in either direction within each segment of a
    key; what lies before and after a segment is carried over its borders.  So it costs a sort, not a product, and a
    key with all rows is spread over all segments.
    """
    both = left.withColumn("_v", F.lit(None)).withColumn("_left", F.lit(True))
    other = right.groupBy(key, time).agg(F.max(value).alias("_v")).withColumn("_left", F.lit(False))
    rows = both.unionByName(other, allowMissingColumns=True).withColumn("_at", micros(time))
    rows = rows.withColumn("_segment", F.coalesce(quantile_bucket(rows, "_at", segments), F.lit(0)))
    mark = F.when(~F.col("_left"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    rows = carried(rows, [key], "_segment", "_at", mark, "_earlier", "_later")
    order = Window.partitionBy(key, "_segment").orderBy(F.col("_at"), F.col("_left"))
    before = F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    after = F.coalesce(F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))
    rows = rows.withColumn("_b", before).withColumn("_a", after).where("_left")
    gap_b, gap_a = F.col("_at") - micros("_b.t"), micros("_a.t") - F.col("_at")
    near = F.when(F.col("_a").isNull() | (gap_b <= gap_a), F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("nearest_time", near["t"]).withColumn("nearest_value", near["v"]).drop("_v", "_left", "_a", "_b", "_at", "_segment", "_earlier", "_later")


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node and least number of hops from the start nodes, up to `hops`; edges (src, dst)."""
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = front.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def hop_pairs(edges: DataFrame, hops: int) -> DataFrame:
    """start, node, hops: for every node the nodes within so many hops and their least number, itself included."""
    seen = edges.select(F.col("src").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        front = front.select("start", F.col("node").alias("src")).join(edges, "src").select("start", F.col("dst").alias("node")).distinct()
        front = front.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def round_robin(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Give each left row the next right row in turn.  Both are numbered by buckets of their order, so no task
    holds all rows of either."""
    n = max(1, right.count())
    l = numbered(left, left_order, "_nth").withColumn("_slot", F.col("_nth") % n)  # noqa: E741
    return l.join(numbered(right, right_order, "_slot"), "_slot").drop("_slot", "_nth")


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all common columns."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def hex_edges(stations: DataFrame, id_col: str, q: str, r: str) -> DataFrame:
    """Edges between neighbours of a hexagonal lattice in axial coordinates."""
    turns = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))])
    out = stations.select(F.col(id_col).alias("src"), q, r, F.explode(turns).alias("t"))
    out = out.select("src", (F.col(q) + F.col("t.a")).alias(q), (F.col(r) + F.col("t.b")).alias(r))
    return out.join(stations.select(F.col(id_col).alias("dst"), q, r), [q, r]).select("src", "dst")
