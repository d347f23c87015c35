"""Queries on events as a whole: coincidences by cell, crowns, scans by file name, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import joins, metrics, sampling, triggers
from tracelake.plans.rate_queries import _D, _lines
from tracelake.plans.registry import formula, query, table
from tracelake.plans.relation_queries import _LAB, _lcg, _lcg_sql
from tracelake.sources import extracts, traces

_PRICES = (20000.0, 60000.0, 120000.0, 200000.0)


@query(f"""WITH x AS (SELECT l_orderkey, l_returnflag <> 'N' AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS k FROM lineitem),
h AS (SELECT l_orderkey, count(*) = 3 AND bool_and(f) AS hit FROM x WHERE k <= 3 GROUP BY 1)
SELECT ({_D('o_totalprice', _PRICES)})::INT AS e, substr(o_orderpriority, 1, 1)::INT AS t, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 8) AS eff
FROM h JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def cell_coincidences(spark, sf_dir):
    """Coincidences of the three nearest stations by energy and angle."""
    x = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("event"), "l_extendedprice", (F.col("l_returnflag") != "N").alias("f"), F.struct("l_linenumber", "l_partkey").alias("tie"))
    hit = triggers.coincidence(x, "event", "l_extendedprice", "f", "tie")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), A.digitize(F.col("o_totalprice"), _PRICES).alias("e"), F.substring("o_orderpriority", 1, 1).cast("int").alias("t"))
    g = hit.join(o, "event").groupBy("e", "t").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return g.withColumn("eff", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 8))


_DRAWS = 35_000


@formula(f"""WITH d AS (SELECT i, (i % 7)::INT AS e, (i // 7 % 5)::INT AS t, {_lcg_sql('i * 7 + 1')} AS u, {_lcg_sql('i * 7 + 2')} AS v, {_lcg_sql('i * 7 + 3')} AS z FROM (SELECT unnest(range({_DRAWS})) AS i)),
c AS (SELECT i, e, t, 0.2 * t + 0.2 * z AS zen, u * 6.283185307179586 AS azi, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS a, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS b FROM d),
k AS (SELECT *, a + b / 2 AS x, b * sqrt(3.0) / 2 AS y FROM c),
s AS (SELECT k.*, q.id, q.sx - x AS dx, q.sy - y AS dy, sin(zen) * cos(azi) AS ax, sin(zen) * sin(azi) AS ay, cos(zen) AS az FROM k CROSS JOIN (VALUES (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.5, 0.8660254037844386)) q(id, sx, sy)),
r AS (SELECT i, e, t, id, sqrt((dx - (dx * ax + dy * ay) * ax) ** 2 + (dy - (dx * ax + dy * ay) * ay) ** 2 + ((dx * ax + dy * ay) * az) ** 2) AS dist FROM s),
p AS (SELECT i, e, t, {_lcg_sql('i * 7 + 4 + id')} < 1 - 1 / (1 + exp(-(dist - 0.3 - 0.1 * e - 0.05 * t) / -0.1)) AS f FROM r), g AS (SELECT i, e, t, bool_and(f) AS hit FROM p GROUP BY 1, 2, 3)
SELECT e, t, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM g GROUP BY 1, 2""")
def coincidence_map(spark, sf_dir):
    """The simulated coincidences by energy and angle; the number of draws is the simulation's."""
    i = F.col("id")
    a, b = sampling.triangle(_lcg(i * 7 + 1), _lcg(i * 7 + 2))
    e, t = (i % 7).cast("int"), (F.floor(i / 7) % 5).cast("int")
    d = spark.range(_DRAWS).select("id", e.alias("e"), t.alias("t"), (0.2 * t + 0.2 * _lcg(i * 7 + 3)).alias("zen"), (_lcg(i * 7 + 1) * 6.283185307179586).alias("azi"), a.alias("x"), b.alias("y"))
    fired = F.lit(True)
    for k, (sx, sy) in enumerate(((0.0, 0.0), (1.0, 0.0), (0.5, 0.8660254037844386))):
        dist = A.plane_distance(F.lit(sx), F.lit(sy), F.col("x"), F.col("y"), F.col("zen"), F.col("azi"))
        fired = fired & (_lcg(i * 7 + 4 + k) < A.lateral(dist, F.lit(1.0), 0.3 + 0.1 * F.col("e") + 0.05 * F.col("t"), F.lit(-0.1)))
    return d.withColumn("hit", fired).groupBy("e", "t").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("""WITH w AS (SELECT l_linenumber AS model, 100 * 99.0 * (l_extendedprice / 900) ** -3 AS w FROM lineitem WHERE l_returnflag = 'R')
SELECT model, round(sum(1 / w) * 50072 / count(*) ** 2 / 3.329e11 * 1e9, 7) AS accuracy FROM w GROUP BY 1""")
def flux_accuracy(spark, sf_dir):
    """Flux-weighted accuracy relative to that of a perfect trigger."""
    w = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_linenumber").alias("model"), metrics.flux_weight(F.col("l_extendedprice"), 900.0, 99.0).alias("w"))
    return w.groupBy("model").agg(F.round(metrics.flux_accuracy(F.sum(1 / F.col("w")), F.count("*")) * 1e9, 7).alias("accuracy"))


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS id, (s_suppkey - 1) // 10 AS q, (s_suppkey - 1) % 10 AS r FROM supplier),
e AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON (b.q - a.q, b.r - a.r) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))),
w AS (SELECT id AS start, id AS node, 0 AS hops FROM s UNION SELECT start, dst, hops + 1 FROM w JOIN e ON src = node WHERE hops < 4), c AS (SELECT DISTINCT start, node FROM w),
l AS (SELECT l_orderkey AS event, arg_max(l_suppkey, (l_quantity, -l_linenumber, -l_partkey)) AS start FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey AS event, l_suppkey AS node, max(l_quantity) AS q, max(l_tax) AS x, bool_or(l_discount >= 0.05) AS tot FROM lineitem GROUP BY 1, 2)
SELECT l.event, l.start AS station, count(p.node) AS hits, count(*) - count(p.node) AS misses, count(*) FILTER (WHERE p.q > 30) AS th1, count(*) FILTER (WHERE p.q > 40) AS th2, count(*) FILTER (WHERE p.tot) AS tot,
    count(*) FILTER (WHERE p.tot AND p.x > 0.02) AS totd, count(*) FILTER (WHERE p.x > 0.05) AS mops
FROM l JOIN c ON c.start = l.start LEFT JOIN p ON p.event = l.event AND p.node = c.node GROUP BY 1, 2""")
def crown_hits(spark, sf_dir):
    """Hits, misses and flags of the stations within four crowns around each event's loudest station."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("(s_suppkey - 1) div 10").alias("q"), ((F.col("s_suppkey") - 1) % 10).alias("r"))
    crowns = joins.hop_pairs(joins.hex_edges(s, "id", "q", "r"), 4).select(F.col("start").alias("station"), "node")
    sizes = crowns.groupBy("station").agg(F.count("*").alias("considered"))
    l = _lines(spark, sf_dir)  # noqa: E741
    loud = l.groupBy(F.col("l_orderkey").alias("event")).agg(F.max_by("l_suppkey", F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("station"))
    present = l.groupBy(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("node")).agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("x"), F.bool_or(F.col("l_discount") >= 0.05).alias("tot"))
    flags = {"th1": F.col("q") > 30, "th2": F.col("q") > 40, "tot": F.col("tot"), "totd": F.col("tot") & (F.col("x") > 0.02), "mops": F.col("x") > 0.05}
    near = loud.join(present, "event").join(crowns, ["station", "node"])
    found = near.groupBy("event").agg(*metrics.flag_counts(F.lit(True), flags)).drop("misses")
    out = loud.join(sizes, "station").join(found, "event", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("hits", *metrics.FLAGS)}
    return out.select("event", "station", *[v.alias(c) for c, v in n.items()], (F.col("considered") - n["hits"]).alias("misses"))


@query("""WITH f AS (SELECT 'station_m' || (l_quantity::INT) || '_' || l_linenumber || '.csv' AS file, l_suppkey AS n FROM lineitem)
SELECT regexp_extract(file, '_m([0-9]+)_', 1)::INT AS scale, count(DISTINCT file) AS files, sum(n)::BIGINT AS n, round(sqrt(sum(n)) / count(*), 8) AS err FROM f GROUP BY 1""")
def rates_by_file_name(spark, sf_dir):
    """Rates by the scale that is in the file's name; distinct files are counted."""
    f = _lines(spark, sf_dir).select(F.concat(F.lit("station_m"), F.col("l_quantity").cast("int"), F.lit("_"), "l_linenumber", F.lit(".csv")).alias("file"), F.col("l_suppkey").alias("n"))
    g = f.groupBy(F.regexp_extract("file", "_m([0-9]+)_", 1).cast("int").alias("scale"))
    return g.agg(F.count_distinct("file").alias("files"), F.sum("n").alias("n"), F.round(F.sqrt(F.sum("n")) / F.count("*"), 8).alias("err"))


@query("""SELECT l_suppkey AS station, round(avg(l_quantity / (1 + l_linenumber)) - avg(l_discount) - avg(l_tax), 7) AS th2 FROM lineitem GROUP BY 1""")
def monitored_th2(spark, sf_dir):
    """The threshold's rate as what other triggers leave of the mean rate."""
    rest = F.avg(F.col("l_quantity") / (1 + F.col("l_linenumber"))) - F.avg("l_discount") - F.avg("l_tax")
    return _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("station")).agg(F.round(rest, 7).alias("th2"))


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_tax) AS my, stddev_pop(l_tax) AS sy FROM lineitem),
b AS (SELECT floor(((l_quantity - mx) / sx + 4) * 5 + 1e-9)::INT AS i, floor(((l_tax - my) / sy + 4) * 5 + 1e-9)::INT AS j FROM lineitem, m WHERE abs(l_quantity - mx) <= 4 * sx AND abs(l_tax - my) <= 4 * sy) SELECT i, j, count(*) AS n FROM b GROUP BY 1, 2""")
def noise_map(spark, sf_dir):
    """Two-dimensional histogram within four spreads of the means (one broadcast row)."""
    l = _lines(spark, sf_dir).select(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))  # noqa: E741
    m = l.agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    b = l.crossJoin(F.broadcast(m)).where("abs(x - mx) <= 4 * sx AND abs(y - my) <= 4 * sy")
    cell = lambda v: F.floor(((F.col(v) - F.col(f"m{v}")) / F.col(f"s{v}") + 4) * 5 + 1e-9).cast("int")
    return b.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT l_linenumber AS batch, {_LAB} AS label FROM lineitem) SELECT batch, label, count(*) AS n FROM x GROUP BY GROUPING SETS ((batch, label), (label))""")
def label_totals(spark, sf_dir):
    """Labels by batch and in all."""
    x = _lines(spark, sf_dir).select(F.col("l_linenumber").alias("batch"), F.expr(_LAB).alias("label"))
    batch, label = F.col("batch"), F.col("label")
    return x.groupingSets([[batch, label], [label]], batch, label).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem WHERE l_quantity * 40 <= 1500 AND l_discount * 1000 >= 38 - 10 AND l_discount * 1000 < 38 + 10 GROUP BY 1""")
def near_angle(spark, sf_dir):
    """Stations within the array's spacing and showers within a tolerance of an angle."""
    x = _lines(spark, sf_dir).where(metrics.near_angle(F.col("l_quantity") * 40, F.col("l_discount") * 1000, 38.0, 10.0))
    return x.groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))


@query(f"""WITH b AS (SELECT l_orderkey AS batch, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS ok, {_lcg_sql('l_orderkey')} AS u FROM lineitem GROUP BY 1), g AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS slot, count(*) OVER () AS n FROM b WHERE ok)
SELECT batch, batch AS served FROM b WHERE ok UNION ALL SELECT b.batch, g.batch FROM b JOIN g ON g.slot = floor(b.u * g.n) WHERE NOT ok""")
def resampled_batches(spark, sf_dir):
    """Batches without signal are served by others."""
    b = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("batch")).agg((F.count_if(F.col("l_returnflag") == "R") > 0).alias("ok"))
    return sampling.resampled(b, "batch", F.col("ok"), A.lcg(F.col("batch")))


@query("""WITH n AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part), u AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS slot, count(*) OVER () AS m FROM n WHERE k > 1)
SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) o JOIN u ON i % m = slot""")
def noise_cursor(spark, sf_dir):
    """Noise served in turn, each file's first trace left out as the cursor does."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    nth = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    served = p.withColumn("k", nth).where("k > 1").select("p_partkey")
    return joins.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), served, "o_orderkey", "p_partkey")


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS adc FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), v AS (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS vem FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT l_orderkey AS event, l_suppkey AS station, adc, vem FROM a JOIN v USING (l_orderkey, l_suppkey)""")
def matched_rows(spark, sf_dir):
    """Counts and calibrated rows matched on event and station; unmatched ones go."""
    l = _lines(spark, sf_dir).withColumnRenamed("l_orderkey", "event").withColumnRenamed("l_suppkey", "station")  # noqa: E741
    a = l.where("l_returnflag = 'R'").groupBy("event", "station").agg(F.max("l_quantity").alias("adc"))
    v = l.where("l_linestatus = 'F'").groupBy("event", "station").agg(F.max("l_extendedprice").alias("vem"))
    return joins.natural(a, v)


@query("""SELECT DISTINCT c_nationkey::VARCHAR AS stem FROM customer WHERE c_nationkey < 20 UNION SELECT DISTINCT s_nationkey::VARCHAR FROM supplier""")
def file_stems(spark, sf_dir):
    """Distinct stems of two lists put together; a nested choice is flattened."""
    path = lambda t, c: table(spark, sf_dir, t).select(F.concat(F.lit(f"/{t}/"), c, F.lit(".csv")).alias("path"), F.col(c).alias("k"))
    both = path("customer", "c_nationkey").where("k < 20").unionByName(path("supplier", "s_nationkey"))
    folders = traces.resolve({"customer": ["/customer/"], "supplier": ["/supplier/"]}, [["customer"], "supplier"])
    wanted = F.concat(F.lit("/"), F.split("path", "/")[1], F.lit("/")).isin(folders)
    return both.where(wanted).select(extracts.base_name(F.col("path")).alias("stem")).distinct()
