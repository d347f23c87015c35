"""Queries on joins, lookups, selection, sampling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import joins, sampling, triggers
from tracelake.plans.registry import formula, query, table
from tracelake.sources import extracts, sinks
from tracelake.streaming import triggers as streams


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT s_nationkey AS bin, count(*) AS n FROM supplier GROUP BY 1),
h AS (SELECT l_orderkey, s_nationkey AS bin, count(*) AS hits FROM p JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT o_orderkey AS event, t.bin, coalesce(hits, 0) AS hits, n - coalesce(hits, 0) AS misses FROM orders CROSS JOIN t LEFT JOIN h ON h.l_orderkey = o_orderkey AND h.bin = t.bin""")
def hits_and_misses(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("x"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("station"))
    return joins.hits_and_misses(o, s, p, "event", "station", F.col("x"))


_FIT = "(VALUES (0, 0, 0.9, 30.0, 4.0), (1, 0, 0.8, 25.0, 3.0), (1, 1, 0.95, 20.0, 5.0), (2, 1, 1.0, 28.0, 2.0)) f(e, t, eff, p50, width)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 50000 THEN 2 WHEN l_extendedprice >= 10000 THEN 1 ELSE 0 END AS e,
CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS t, l_quantity AS q FROM lineitem)
SELECT x.e, x.t, count(*) AS n, sum(floor(1000 * greatest(0, least(1, coalesce(eff, 0) * (1 - 1 / (1 + exp(-(q - coalesce(p50, 0)) / coalesce(width, 1)))))) + 0.0000001))::BIGINT AS p FROM x LEFT JOIN {_FIT} ON f.e = x.e AND f.t = x.t GROUP BY 1, 2""")
def fit_parameters(spark, sf_dir):
    fits = spark.sql(f"SELECT e, t, cast(eff as double) eff, cast(p50 as double) p50, cast(width as double) width FROM {_FIT}")
    x = table(spark, sf_dir, "lineitem").select(
        A.digitize(F.col("l_extendedprice"), (10000.0, 50000.0)).alias("e"), A.digitize(F.col("l_discount"), (0.05,)).alias("t"), F.col("l_quantity").alias("q")
    )
    x = joins.with_defaults(x, fits, ["e", "t"], {"eff": 0.0, "p50": 0.0, "width": 1.0})
    p = F.floor(1000 * A.lateral(F.col("q"), F.col("eff"), F.col("p50"), F.col("width")) + 0.0000001)
    return x.groupBy("e", "t").agg(F.count("*").alias("n"), F.sum(p).alias("p"))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
j AS (SELECT l.event_id, l.ts, r.ts AS rt, r.v, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS k FROM l JOIN r USING (user_id))
SELECT l.event_id, epoch_us(j.rt) AS calibrated_us, j.v AS calibration FROM l LEFT JOIN j ON j.event_id = l.event_id AND k = 1""")
def nearest_calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    out = joins.nearest_in_time(left, right, "user_id", "ts", "value")
    return out.select("event_id", joins.micros("nearest_time").alias("calibrated_us"), F.col("nearest_value").alias("calibration"))


@query("""SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def natural_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), "n_name")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), "r_name")
    return joins.natural(joins.natural(c, F.broadcast(n)), F.broadcast(r)).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT unnest(range(0, 60)) AS scale), r AS (SELECT l_quantity::BIGINT AS scale, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS t FROM lineitem GROUP BY 1),
e AS (SELECT ps AS scale, count(*) AS parts FROM (SELECT p_size::BIGINT AS ps FROM part) GROUP BY 1)
SELECT g.scale, coalesce(n, 0) AS n_traces, coalesce(t, 0) AS n_all, parts FROM g LEFT JOIN r USING (scale) JOIN e USING (scale)""")
def backfilled_scan(spark, sf_dir):
    g = spark.range(60).select(F.col("id").alias("scale"))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("scale")).agg(
        F.count("*").alias("n_traces"), F.count_if(F.col("l_returnflag") == "R").alias("n_all"))
    e = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("scale")).agg(F.count("*").alias("parts"))
    return joins.with_defaults(g, r, ["scale"], {"n_traces": 0, "n_all": 0}).join(e, "scale").select("scale", F.col("n_traces").cast("long"), F.col("n_all").cast("long"), "parts")


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, (s_suppkey - 1) // 10 AS q, (s_suppkey - 1) % 10 AS r FROM supplier),
e AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))),
w AS (SELECT min(id) AS node, 0 AS hops FROM s UNION SELECT dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < 4)
SELECT node, min(hops)::INT AS hops FROM w GROUP BY 1""")
def crowns(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("(s_suppkey - 1) div 10").alias("q"), ((F.col("s_suppkey") - 1) % 10).alias("r"))
    return joins.within_hops(joins.hex_edges(s, "id", "q", "r"), s.agg(F.min("id").alias("node")), 4)


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS slot FROM part)
SELECT o.o_orderkey, n.p_partkey FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % (SELECT count(*) FROM n) AS slot FROM orders) o JOIN n USING (slot)""")
def assigned_noise(spark, sf_dir):
    noise = table(spark, sf_dir, "part").select("p_partkey")
    return joins.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), noise, "o_orderkey", "p_partkey")


@query("""WITH x AS (SELECT l_orderkey, l_returnflag <> 'N' AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey AS event, count(*) = 3 AND bool_and(f) AS hit FROM x WHERE k <= 3 GROUP BY 1""")
def three_nearest(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), "l_extendedprice", (F.col("l_returnflag") != "N").alias("f"), F.struct("l_linenumber", "l_partkey").alias("tie"))
    return triggers.coincidence(x, "event", "l_extendedprice", "f", "tie")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
SELECT l_orderkey AS event, arg_max(l_linenumber, (l_quantity, -l_linenumber, -l_partkey)) AS station FROM x GROUP BY 1""")
def loudest_station(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(
        F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("station"))


def _lcg_sql(x, turns=3):
    for _ in range(turns):
        x = f"((({x}) * 1103515245 + 12345) % 2147483648)"
    return f"({x} / 2147483648.0)"


def _lcg(x):
    return A.lcg(x)


@formula(f"""WITH d AS (SELECT i, {_lcg_sql('i * 7 + 1')} AS u, {_lcg_sql('i * 7 + 2')} AS v, {_lcg_sql('i * 7 + 3')} AS z, (i % 7)::INT AS e FROM (SELECT unnest(range(20000)) AS i)),
c AS (SELECT i, e, 0.2 + z AS zen, u * 6.283185307179586 AS azi, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS a, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS b FROM d),
k AS (SELECT *, a + b / 2 AS x, b * sqrt(3.0) / 2 AS y FROM c),
s AS (SELECT k.*, t.id, t.sx - x AS dx, t.sy - y AS dy, sin(zen) * cos(azi) AS ax, sin(zen) * sin(azi) AS ay, cos(zen) AS az FROM k CROSS JOIN (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.5, 0.8660254037844386)) t(id, sx, sy)),
r AS (SELECT i, e, id, sqrt((dx - (dx * ax + dy * ay) * ax) ** 2 + (dy - (dx * ax + dy * ay) * ay) ** 2 + ((dx * ax + dy * ay) * az) ** 2) AS dist FROM s),
p AS (SELECT i, e, {_lcg_sql('i * 7 + 4 + id')} < 1 - 1 / (1 + exp(-(dist - 0.3 - 0.1 * e) / -0.1)) AS f FROM r),
g AS (SELECT i, e, bool_and(f) AS hit FROM p GROUP BY 1, 2)
SELECT e, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM g GROUP BY 1""")
def coincidence_simulation(spark, sf_dir):
    i = F.col("id")
    a, b = sampling.triangle(_lcg(i * 7 + 1), _lcg(i * 7 + 2))
    d = spark.range(20000).select("id", (i % 7).cast("int").alias("e"), (0.2 + _lcg(i * 7 + 3)).alias("zen"), (_lcg(i * 7 + 1) * 6.283185307179586).alias("azi"), a.alias("x"), b.alias("y"))
    fired = F.lit(True)
    for k, (sx, sy) in enumerate(((0.0, 0.0), (1.0, 0.0), (0.5, 0.8660254037844386))):  # three stations: three expressions, no product
        dist = A.plane_distance(F.lit(sx), F.lit(sy), F.col("x"), F.col("y"), F.col("zen"), F.col("azi"))
        fired = fired & (_lcg(i * 7 + 4 + k) < A.lateral(dist, F.lit(1.0), 0.3 + 0.1 * F.col("e"), F.lit(-0.1)))
    return d.withColumn("hit", fired).groupBy("e").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey * 1103515245 + 12345) % 2147483648, c_custkey) AS k, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'validate' END AS part FROM f""")
def train_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return sampling.split(c, "c_custkey", 0.8, F.pmod(F.col("c_custkey") * 1103515245 + 12345, F.lit(2147483648)))


_LAB = "CASE WHEN l_returnflag = 'R' THEN 'SIG' WHEN l_quantity <= 5 THEN 'INT' WHEN l_discount <= 0.01 THEN 'PRT' ELSE 'BKG' END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_LAB} AS label FROM lineitem),
k AS (SELECT *, count(*) FILTER (WHERE label = 'SIG') OVER (PARTITION BY l_orderkey) AS s, count(*) FILTER (WHERE label IN ('INT', 'PRT')) OVER (PARTITION BY l_orderkey) AS c,
row_number() OVER (PARTITION BY l_orderkey, label ORDER BY (l_linenumber * 7919 + l_partkey) % 101, l_linenumber, l_partkey) AS nth FROM x)
SELECT l_orderkey AS batch, label, count(*) AS n FROM k WHERE s > 0 AND (label <> 'BKG' OR nth <= s - c) GROUP BY 1, 2""")
def balanced_batches(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), "l_linenumber", "l_partkey", F.expr(_LAB).alias("label"))
    out = sampling.balanced(x, "batch", 0.5, [(F.col("l_linenumber") * 7919 + F.col("l_partkey")) % 101, "l_linenumber", "l_partkey"])
    return out.groupBy("batch", "label").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT l_orderkey, {_LAB} AS label FROM lineitem), b AS (SELECT l_orderkey, count(*) FILTER (WHERE label = 'SIG') AS s, count(*) FILTER (WHERE label IN ('INT', 'PRT')) AS c FROM x GROUP BY 1)
SELECT floor(s * 0.75 / 0.25)::BIGINT - c AS needed, count(*) AS n FROM b WHERE s > 0 GROUP BY 1""")
def background_needed(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_LAB).alias("label"))
    b = x.groupBy("l_orderkey").agg(F.count_if(F.col("label") == "SIG").alias("s"), F.count_if(F.col("label").isin("INT", "PRT")).alias("c"))
    return b.where("s > 0").groupBy(sampling.background_needed(F.col("s"), F.col("c"), 0.25).alias("needed")).agg(F.count("*").alias("n"))


@query("""SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def json_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k long").alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH x AS (SELECT l_suppkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT l_suppkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'A'),
u AS (SELECT *, 'TP' AS o FROM x UNION ALL SELECT *, 'FN' FROM y), m AS (SELECT CASE WHEN o = 'TP' AND l_quantity < 4 THEN 'FN' ELSE o END AS outcome, l_suppkey FROM u)
SELECT outcome, count(*) AS n, count(DISTINCT l_suppkey) AS stations FROM m GROUP BY 1""")
def combined_outcomes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")  # noqa: E741
    both = l.where("l_returnflag = 'R'").withColumn("o", F.lit("TP")).unionByName(l.where("l_returnflag = 'A'").withColumn("o", F.lit("FN")))
    moved = F.when((F.col("o") == "TP") & (F.col("l_quantity") < 4), "FN").otherwise(F.col("o"))
    return both.groupBy(moved.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("stations"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS kinds, sum(l_quantity)::BIGINT AS q FROM lineitem WHERE l_suppkey < 90000
AND l_extendedprice < CASE floor(log10(l_extendedprice)) WHEN 3 THEN 8000 WHEN 4 THEN 60000 ELSE 1e9 END GROUP BY 1 HAVING count(*) = 3 AND count(DISTINCT l_suppkey) > 1""")
def station_filters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(extracts.in_array(F.col("l_suppkey")))  # noqa: E741
    decade = F.floor(F.log10("l_extendedprice"))
    l = l.where(F.col("l_extendedprice") < F.when(decade == 3, 8000).when(decade == 4, 60000).otherwise(1e9))  # noqa: E741
    g = l.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("kinds"), F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n"))
    return g.where("n = 3 AND kinds > 1").drop("n")


@query("""WITH o AS (SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483648, o_orderkey LIMIT 50)
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY 1""")
def limited_showers(spark, sf_dir):
    key = F.pmod(F.col("o_orderkey") * 1103515245 + 12345, F.lit(2147483648))
    o = table(spark, sf_dir, "orders").select("o_orderkey").orderBy(key, "o_orderkey").limit(50)
    return table(spark, sf_dir, "lineitem").join(F.broadcast(o), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value > 20),
r AS (SELECT user_id, k, "at" AS last, "at" AS hit FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.k, CASE WHEN e."at" > r.last + 43200 THEN e."at" ELSE r.last END, CASE WHEN e."at" > r.last + 43200 THEN e."at" END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, hit AS "at" FROM r WHERE hit IS NOT NULL""")
def stream_dead_time(spark, sf_dir):
    """Dead time over the event stream, drained in one batch: files may overlap in time, and hits are put in order
    within a batch only."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    hits = e.where("value > 20").select("user_id", F.floor(joins.micros("ts") / 1000000).cast("long").alias("at"))
    base = sinks.scratch(spark, "stream")
    streams.drain(streams.dead_time(hits, "user_id", "at", 43200), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, at long").parquet(f"{base}/out")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 60000000 AS m, value FROM events), w AS (SELECT user_id, value, unnest(range(m // 60 - 5, m // 60 + 1)) AS s FROM e)
SELECT user_id, s * 3600 AS start, count(*) FILTER (WHERE value > 10) AS n FROM w GROUP BY 1, 2""")
def sliding_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = e.groupBy("user_id", F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.count_if(F.col("value") > 10).alias("n"))
    return w.select("user_id", F.floor(joins.micros("w.start") / 1000000).cast("long").alias("start"), "n")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON b.t BETWEEN a.t - 60000000 AND a.t + 60000000 AND a.user_id < b.user_id""")
def time_coincidence(spark, sf_dir):
    """Pairs within a minute: each event is put into its minute and both neighbours, so it is an equi-join."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", joins.micros("ts").alias("t"))
    a = e.select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("t").alias("ta"), F.expr("t div 60000000").alias("m"))
    b = e.select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("t").alias("tb"), F.explode(F.expr("sequence(t div 60000000 - 1, t div 60000000 + 1)")).alias("m"))
    return a.join(b, "m").where("abs(ta - tb) <= 60000000 AND ua < ub").select("a", "b")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT a.t AS t1, a.user_id AS s1, b.t AS t2, b.user_id AS s2 FROM e a JOIN e b ON b.t BETWEEN a.t - 60000000 AND a.t + 60000000 AND a.user_id < b.user_id""")
def stream_coincidences(spark, sf_dir):
    """Triggers of different stations within a minute, as a join of two streams."""
    schema = table(spark, sf_dir, "events").schema
    a, b = (spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")) for _ in range(2))
    found = streams.coincidences(a, b, "ts", "user_id", 60, "1 hour")
    base = sinks.scratch(spark, "coincidences")
    streams.drain(found.select(joins.micros("t1").alias("t1"), "s1", joins.micros("t2").alias("t2"), "s2"), f"{base}/out", f"{base}/state")
    return spark.read.schema("t1 long, s1 long, t2 long, s2 long").parquet(f"{base}/out")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), w AS (SELECT user_id, value, unnest(range(t // 3600000000 - 5, t // 3600000000 + 1)) AS s FROM e)
SELECT user_id, s * 3600 AS start, count(*) FILTER (WHERE value > 10) AS n FROM w WHERE (s + 6) * 3600000000 <= (SELECT max(t) FROM e) - 7200000000 GROUP BY 1, 2""")
def stream_sliding_counts(spark, sf_dir):
    """Sliding windows over the stream: those that the watermark, two hours behind, has closed."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("hit", F.col("value") > 10).withColumn("ts", F.col("ts").cast("timestamp"))
    w = streams.sliding_counts(e, "user_id", "ts", "hit", "6 hours", "1 hour", "2 hours")
    base = sinks.scratch(spark, "sliding")
    streams.drain(w.select("user_id", F.floor(joins.micros("start") / 1000000).cast("long").alias("start"), "n"), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, start long, n long").parquet(f"{base}/out")
