"""Coincidences in time of several stations, by a sweep over instants instead of pairs of triggers.

A station is active from each of its triggers for the width of the window.  Where it becomes active and where it
ceases to be are steps of +1 and -1; their running sum is the number of distinct stations with a trigger in the
window that ends there.  Stations, however busy, and bursts, however dense, cost a sort of their rows: runs of a station
are cut into segments of time with what comes before and after carried over their borders, and the sum runs by buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordering import carried, quantile_bucket, running
from tracelake.sources.sinks import stored

#: The detector's own window in microseconds, and the stations that it asks for.
WIDTH, NEED = 11, 3
SEGMENTS = 256


def steps(triggers: DataFrame, station: str, time: str, width: int, segments: int = SEGMENTS) -> DataFrame:
    """at, delta: by how many stations more are active from that microsecond on.  Both ends of the window belong to it."""
    rows = triggers.where(F.col(station).isNotNull() & F.col(time).isNotNull()).select(F.col(station).alias("station"), F.col(time).cast("long").alias("t")).distinct()
    rows = rows.withColumn("segment", quantile_bucket(rows, "t", segments))
    rows = carried(rows, ["station"], "segment", "t", F.col("t"), "before", "after")
    own = Window.partitionBy("station", "segment").orderBy("t")
    rows = rows.withColumn("before", F.coalesce(F.lag("t").over(own), "before")).withColumn("after", F.coalesce(F.lead("t").over(own), "after"))
    rises = rows.where(F.col("before").isNull() | (F.col("t") - F.col("before") > width)).select(F.col("t").alias("at"), F.lit(1).alias("delta"))
    falls = rows.where(F.col("after").isNull() | (F.col("after") - F.col("t") > width)).select((F.col("t") + width + 1).alias("at"), F.lit(-1).alias("delta"))
    return rises.unionByName(falls).groupBy("at").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def ranges(triggers: DataFrame, station: str, time: str, width: int = WIDTH, need: int = NEED, segments: int = SEGMENTS) -> DataFrame:
    """first, last (microseconds), stations: the longest ranges of instants at which the window of `width` that ends there
    holds triggers of at least `need` distinct stations, and the most that it holds.  Triggers without a station or time
    take no part; a station counts once, however often it triggers."""
    spark = triggers.sparkSession
    found = stored(spark, steps(triggers, station, time, width, segments), "steps")
    found = found.withColumn("bucket", quantile_bucket(found, "at", segments))
    level = running(found, [], "bucket", ["at"], "delta", "below").withColumn("level", F.col("below") + F.col("delta"))
    level = stored(spark, level, "levels")
    begins = F.when((F.col("level") >= need) & (F.col("below") < need), 1).otherwise(0)
    number = running(level, [], "bucket", ["at"], begins, "number").withColumn("number", F.col("number") + begins)
    inside = number.where((F.col("level") >= need) | (F.col("below") >= need))
    return inside.groupBy("number").agg(F.min("at").alias("first"), (F.max("at") - 1).alias("last"), F.max("level").alias("stations")).drop("number")
