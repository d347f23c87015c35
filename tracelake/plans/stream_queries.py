"""Coincidences of several stations, and streams that keep an order or a window over many batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import coincidences, joins, nearest, records
from tracelake.plans.registry import query, table
from tracelake.plans.trace_queries import LEVEL, W
from tracelake.sources import sinks
from tracelake.streaming import triggers as streams

DAY_US = 86_400_000_000
#: The detector asks for 3 stations in 11 microseconds; the events here are minutes apart, so a microsecond is taken for a minute.
WIDTH_US = coincidences.WIDTH * 60_000_000


@query(f"""
WITH e AS (SELECT DISTINCT user_id AS s, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT t AS p, s FROM e UNION ALL SELECT t + {WIDTH_US}, NULL FROM e),
c AS (SELECT p, count(DISTINCT s) OVER w AS closed, count(DISTINCT s) OVER o AS after FROM p
    WINDOW w AS (ORDER BY p RANGE BETWEEN {WIDTH_US} PRECEDING AND CURRENT ROW), o AS (ORDER BY p RANGE BETWEEN {WIDTH_US - 1} PRECEDING AND CURRENT ROW)),
i AS (SELECT p, any_value(closed) AS closed, any_value(after) AS after FROM c GROUP BY 1),
k AS (SELECT *, sum(CASE WHEN before >= {coincidences.NEED} THEN 0 ELSE 1 END) OVER (ORDER BY p) AS k
    FROM (SELECT *, lag(after, 1, 0) OVER (ORDER BY p) AS before FROM i) WHERE closed >= {coincidences.NEED})
SELECT min(p) AS first_us, max(p) AS last_us, max(closed) AS stations FROM k GROUP BY k""")
def array_coincidences(spark, sf_dir):
    """Ranges of time in which three or more stations have triggered within the window."""
    e = table(spark, sf_dir, "events").select("user_id", joins.micros("ts").alias("t"))
    found = coincidences.ranges(e, "user_id", "t", WIDTH_US)
    return found.select(F.col("first").alias("first_us"), F.col("last").alias("last_us"), F.col("stations").cast("long").alias("stations"))


def overlapping(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """All events as a stream of batches that overlap in time by up to a day: each is written after the one before."""
    folder = sinks.scratch(spark, "overlapping")
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL").withColumn("t", joins.micros("ts"))
    low, high = e.agg(F.min("t"), F.max("t")).first()
    late = F.pmod(F.xxhash64("event_id"), F.lit(DAY_US))
    part = F.floor((F.col("t") + late - F.lit(low)) * files / F.lit((high or 0) - (low or 0) + DAY_US + 1))
    e = e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", part.alias("part"))
    for i in range(files):
        e.where(F.col("part") == i).drop("part").write.mode("append").parquet(folder)
    per_batch = max(1, e.rdd.getNumPartitions())
    return streams.staged(spark, folder, "event_id long, user_id long, ts timestamp, value double", per_batch)


_HIGH = "(SELECT max(epoch_us(ts)) FROM events) // 1000 - 7 * 86400000"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
    FROM events WHERE value > 20 AND epoch_us(ts) // 1000 < {_HIGH.replace('events)', 'events WHERE value > 20)')}),
r AS (SELECT user_id, k, "at" AS last, "at" AS hit FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, CASE WHEN e."at" > r.last + 43200 THEN e."at" ELSE r.last END, CASE WHEN e."at" > r.last + 43200 THEN e."at" END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, hit AS "at" FROM r WHERE hit IS NOT NULL""")
def stream_dead_time_batches(spark, sf_dir):
    """Dead time over six batches that overlap in time: hits wait for the watermark, a week behind, and come in order."""
    e = overlapping(spark, sf_dir).where("value > 20").withColumn("at", F.unix_seconds("ts"))
    base = sinks.scratch(spark, "dead_time")
    with streams.state_store(spark):
        streams.drain(streams.in_order(e, "user_id", "ts", "event_id", "at", "7 days", streams.dead_time_rule(43200), "at long"), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, at long").parquet(f"{base}/out")


_STEP = "CASE WHEN {0} <= 60 THEN -10 WHEN {0} <= 68 THEN -1 WHEN {0} <= 72 THEN 0 WHEN {0} <= 80 THEN 1 ELSE 10 END"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE epoch_us(ts) // 1000 < {_HIGH}),
c AS (SELECT user_id, k, value, 100.0::DOUBLE + {_STEP.format('value')} AS unit FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.value, c.unit + {_STEP.format('e.value')} FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, value, unit, value > 68 AND value <= 72 AS converged FROM c""")
def stream_calibration_batches(spark, sf_dir):
    """The calibration controller over six batches that overlap in time, in the order of its rates."""
    e = overlapping(spark, sf_dir)
    base = sinks.scratch(spark, "controller")
    rule = streams.calibration_rule(100.0)
    with streams.state_store(spark):
        streams.drain(streams.in_order(e, "user_id", "ts", "event_id", "value", "7 days", rule, "value double, unit double, converged boolean"), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, value double, unit double, converged boolean").parquet(f"{base}/out")


@query(f"""
WITH b AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
r AS (SELECT vec_id, pos, (count(*) FILTER (WHERE v > {LEVEL}) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)) AS act FROM b)
SELECT vec_id, pos, act FROM r WHERE pos >= {W - 1}""")
def stream_running_counts(spark, sf_dir):
    """Bins above the level in the window that ends at each bin, as a channel's bins arrive in five pieces."""
    folder, base = sinks.scratch(spark, "bins"), sinks.scratch(spark, "counts")
    bins = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
    for i in range(5):
        piece = bins.where(F.col("pos") >= 15 * i)
        (piece.where(F.col("pos") < 15 * (i + 1)) if i < 4 else piece).write.mode("append").parquet(folder)
    stream = streams.staged(spark, folder, "vec_id long, pos long, v double", max(1, bins.rdd.getNumPartitions()))
    streams.drain(streams.running_counts(stream, ["vec_id"], "pos", "v", W, LEVEL), f"{base}/out", f"{base}/state")
    return spark.read.schema("vec_id long, pos long, act long").parquet(f"{base}/out")


@query("""
WITH RECURSIVE e AS (SELECT "at", row_number() OVER (ORDER BY "at") AS k FROM (SELECT DISTINCT epoch_us(ts) // 1000000 AS "at" FROM events WHERE value > 10)),
r AS (SELECT k, "at" AS last, "at" AS hit FROM e WHERE k = 1 UNION ALL
  SELECT e.k, CASE WHEN e."at" > r.last + 1800 THEN e."at" ELSE r.last END, CASE WHEN e."at" > r.last + 1800 THEN e."at" END FROM r JOIN e ON e.k = r.k + 1)
SELECT hit AS "at" FROM r WHERE hit IS NOT NULL""")
def dead_time_record(spark, sf_dir):
    """All events as one record with half an hour of dead time, in segments of six hours."""
    hits = table(spark, sf_dir, "events").where("value > 10").select(F.lit(0).alias("record"), F.floor(joins.micros("ts") / 1_000_000).cast("long").alias("at"))
    return records.dead_time(hits, "record", "at", 1800, 21_600).select("at")


_XY = "({0} * 7919) % 20011 AS x, ({0} * 104729) % 15013 AS y"


@query(f"""
WITH s AS (SELECT s_suppkey AS station, {_XY.format('s_suppkey')} FROM supplier), p AS (SELECT o_orderkey AS shower, {_XY.format('(o_orderkey * 31 + 17)')} FROM orders),
n AS (SELECT shower, station, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 AS square FROM p CROSS JOIN s),
r AS (SELECT *, row_number() OVER (PARTITION BY shower ORDER BY square, station) AS nth FROM n)
SELECT shower, station, nth::INTEGER AS nth, square::BIGINT AS square FROM r WHERE nth <= 3""")
def nearest_stations(spark, sf_dir):
    """The three stations nearest to each shower's core."""
    at = lambda c: [(c * 7919 % 20011).alias("x"), (c * 104729 % 15013).alias("y")]
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), *at(F.col("s_suppkey")))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shower"), *at(F.col("o_orderkey") * 31 + 17))
    out = nearest.nearest(p, s, "shower", "station", 3, 500.0)
    return out.select("shower", "station", "nth", F.col("square").cast("long").alias("square"))
