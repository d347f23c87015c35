"""Queries on injected particles, signal regions, likelihoods, networks and shower geometry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A
from tracelake.functions import showers
from tracelake.operators import metrics, particles, scoring, triggers, windows
from tracelake.plans.rate_queries import _poisson_sql
from tracelake.plans.registry import TR, TRI, formula, integer_stations, query, stations, table
from tracelake.plans.relation_queries import _lcg_sql
from tracelake.plans.trace_queries import P, _digest, _digest_sql, _p

_RATE = 2.5


@query(f"""WITH {TRI}, lib AS (SELECT n_nationkey AS i, [n_nationkey + 1, 2 * (n_regionkey + 1), 1]::DOUBLE[] AS s FROM nation),
n AS (SELECT station, ({_poisson_sql(_lcg_sql('station'), _RATE)})::INT AS n FROM ti),
d AS (SELECT station, {_lcg_sql('station * 4096 + 2 * k')} AS u, {_lcg_sql('station * 4096 + 2 * k + 1')} AS v FROM (SELECT station, unnest(range(n)) AS k FROM n)),
a AS (SELECT station, floor(v * 61)::BIGINT + j AS pos, s[j + 1] AS x FROM d JOIN lib ON i = floor(u * 25), (SELECT unnest(range(3)) AS j) t),
t AS (SELECT station, sum(x) AS total, sum(x * (pos + 1)) AS moment FROM a GROUP BY 1)
SELECT ti.station, n.n, {', '.join(f"(list_sum({p}) + coalesce(t.total, 0))::BIGINT AS total_{p}, (list_sum(list_transform({p}, lambda v, i: v * i)) + coalesce(t.moment, 0))::BIGINT AS moment_{p}" for p in P)}
FROM ti JOIN n USING (station) LEFT JOIN t USING (station)""")
def injected_particles(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    samples = F.array((F.col("n_nationkey") + 1).cast("double"), (2.0 * (F.col("n_regionkey") + 1)), F.lit(1.0))
    lib = particles.library(n.select("n_nationkey", samples.alias("samples")), "n_nationkey", "samples")
    s = integer_stations(spark, sf_dir).withColumn("n", A.poisson(A.lcg(F.col("station")), particles.expected(_RATE, 1, 1.0), 30))
    s = particles.inject(s, lib, P, F.col("n"), lambda k: A.lcg(F.col("station") * 4096 + k))
    moment = lambda p: A.total(F.transform(p, lambda v, i: v * (i + 1)))
    out = [c for p in P for c in (A.total(F.col(p)).cast("long").alias(f"total_{p}"), moment(p).cast("long").alias(f"moment_{p}"))]
    return s.select("station", "n", *out)


@query(f"""WITH {TRI}, r AS (SELECT station, p1, p2, p3, floor(0.333 * 64)::INT AS latch, floor(0.333 * 64)::INT + label * 3 + 1 AS stop, greatest(floor(0.333 * 64) - 12 + 1 + floor(9 * {_lcg_sql('station')}), 0) AS i0 FROM ti),
w AS (SELECT *, unnest(range(i0::INT, least(stop, 64 - 12)::INT + 1, 2)) AS s FROM r)
SELECT station, latch AS first, stop AS last, s::INT AS start, (list_sum(p1[s + 1:s + 12]) + list_sum(p2[s + 1:s + 12]) + list_sum(p3[s + 1:s + 12]))::BIGINT AS total FROM w""")
def signal_windows(spark, sf_dir):
    s = integer_stations(spark, sf_dir)
    first, last, n = windows.signal_range(F.size("p1"), F.col("label") * 3 + 1)
    s = s.withColumns({"first": first, "last": last, "n": n, "i0": windows.first_window(F.size("p1"), A.lcg(F.col("station")), 12)})
    s = s.withColumn("start", F.explode(windows.starts(F.col("n"), F.col("i0"), F.col("last"), 12, 2)))
    cut = [F.slice(p, F.col("start") + 1, 12) for p in P]
    return s.select("station", "first", "last", "start", (3 * windows.integral(*cut)).cast("long").alias("total"))


@query(f"""WITH {TRI}, r AS (SELECT station, p1, p2, p3, (floor(0.333 * 64)::INT + label * 3 + 1) // 3 AS stop, greatest(floor(0.333 * 64) - 12 + 1 + floor(9 * {_lcg_sql('station')}), 0)::INT // 3 AS i0 FROM ti),
w AS (SELECT *, unnest(range(i0, least(stop, 21 - 4) + 1)) AS s FROM r)
SELECT station, stop AS last, s::INT AS start, (list_sum(p1[3 * s + 1:3 * s + 12]) + list_sum(p2[3 * s + 1:3 * s + 12]) + list_sum(p3[3 * s + 1:3 * s + 12]))::BIGINT AS total FROM w""")
def decimated_signal_windows(spark, sf_dir):
    """Windows of decimated traces, integrated over the bins of full bandwidth that they stand for."""
    s = integer_stations(spark, sf_dir)
    _, last, n = windows.signal_range(F.size("p1"), F.col("label") * 3 + 1, decimated=True)
    s = s.withColumns({"last": last, "n": n, "i0": windows.first_window(F.size("p1"), A.lcg(F.col("station")), 12, decimated=True)})
    s = s.withColumn("start", F.explode(windows.starts(F.col("n"), F.col("i0"), F.col("last"), 4, 1)))
    return s.select("station", "last", "start", (3 * windows.wide_integral(*_p(), F.col("start"), 4)).cast("long").alias("total"))


@query(f"""WITH {TRI}, b AS (SELECT station, unnest(range(64)) AS pos, unnest(p1) + unnest(p2) + unnest(p3) AS v FROM ti),
w AS (SELECT station, pos, sum(v) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS q FROM b)
SELECT station, pos::INT AS start, q::BIGINT AS total FROM w WHERE pos <= 40""")
def sliding_integrals(spark, sf_dir):
    """Windows at step 1."""
    w = windows.windows(integer_stations(spark, sf_dir), "station", 24, 1)
    return w.select("station", "start", (3 * windows.integral(*_p())).cast("long").alias("total"))


@query(f"""WITH {TRI} SELECT station, (list_max(p1[12:32]))::BIGINT AS peak, list_sum(p1[12:32])::BIGINT AS charge FROM ti""")
def peak_or_charge(spark, sf_dir):
    """The same cut reduced by two functions that are given as arguments."""
    how = {"peak": F.array_max, "charge": A.total}
    at = F.lit(15)
    return integer_stations(spark, sf_dir).select("station", *[windows.reduced(F.col("p1"), at, f, 4, 17).cast("long").alias(n) for n, f in how.items()])


_CENTRES = [-200.0, -100.0, 0.0, 100.0, 200.0, 300.0]
_QUOTIENTS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
_NEAR = "list_position(list_transform(c, lambda y: abs(y - v)), list_min(list_transform(c, lambda y: abs(y - v))))"


@query(f"""WITH {TRI}, b AS (SELECT station, unnest(p1 || p2 || p3) AS v, {_CENTRES}::DOUBLE[] AS c FROM ti), n AS (SELECT station, v, {_NEAR} AS k FROM b)
SELECT station, sum(k - 1)::BIGINT AS cells, sum(k - 3)::BIGINT AS log2_likelihood, sum(v) / 3 > 150 AS bayes, true AS always FROM n GROUP BY 1""")
def likelihood_trigger(spark, sf_dir):
    """Cells of the quotient table and the sum of the quotients' logarithms (here powers of 2), and both constant triggers."""
    s = integer_stations(spark, sf_dir)
    centres = F.array(*[F.lit(c) for c in _CENTRES])
    cells = F.aggregate(F.transform(F.concat(*_p()), lambda v: A.nearest_bin(v, centres)), F.lit(0), lambda a, k: a + k)
    total = triggers.log_likelihood(*_p(), _CENTRES, _QUOTIENTS) / math.log(2)
    return s.select("station", cells.cast("long").alias("cells"), F.round(total).cast("long").alias("log2_likelihood"),
                    triggers.bayes(*_p(), least=150.0).alias("bayes"), triggers.REGISTRY["always"](*_p()).alias("always"))


def _network(seed: int) -> scoring.Network:
    """Small whole weights by a rule."""
    i, j = np.arange(6)[:, None], np.arange(192)[None, :]
    first = ((i * 7 + j * 13 + seed * 5) % 11 - 5).astype(float)
    second = ((np.arange(2)[:, None] * 3 + np.arange(6)[None, :] * 5 + seed) % 7 - 3).astype(float)
    return scoring.Network((first, second), (np.zeros(6), np.array([0.0, 0.5])))


def _network_sql(seed: int) -> str:
    hidden = f"list_transform(range(6), lambda i: greatest(0, list_sum(list_transform(range(192), lambda j: ((i * 7 + j * 13 + {seed * 5}) % 11 - 5) * x[j + 1]))))"
    out = lambda o: f"list_sum(list_transform(range(6), lambda i: (({o * 3} + i * 5 + {seed}) % 7 - 3) * h{seed}[i + 1]))"
    return hidden, f"{out(1)} + 0.5 > {out(0)}"


@query(f"""WITH {TRI}, x AS (SELECT station, p1 || p2 || p3 AS x FROM ti), h AS (SELECT station, {', '.join(f"{_network_sql(s)[0]} AS h{s}" for s in range(3))} FROM x),
o AS (SELECT station, {', '.join(f"{_network_sql(s)[1]} AS d{s}" for s in range(3))} FROM h) SELECT station, d0 AS fired, d0::INT + d1::INT + d2::INT AS votes FROM o""")
def network_decisions(spark, sf_dir):
    """Decisions of one network and of three as an ensemble."""
    members = scoring.decisions([_network(s) for s in range(3)], *_p())
    s = integer_stations(spark, sf_dir).select("station", members.alias("d"))
    return s.select("station", F.col("d")[0].alias("fired"), F.size(F.filter("d", lambda v: v)).alias("votes"))


@query()
def trained_network(spark, sf_dir):
    """Outcomes of a network that is trained on the charge of three windows, on the examples themselves."""
    s = integer_stations(spark, sf_dir)
    q = [A.total(F.slice(p, 1, 24)) / 1000 for p in P]
    x = s.select("station", F.array(*q).alias("x"), (A.total(F.col("p1")) > 0).cast("int").alias("y"))
    done = scoring.predicted(scoring.train(x, "x", "y"), x, "x")
    return done.groupBy("y", "fired").agg(F.count("*").alias("n"))


_DISTANCE = ("SELECT s_suppkey AS station, (s_nationkey * 100)::DOUBLE AS x, (s_acctbal / 10)::DOUBLE AS y, 300.0::DOUBLE AS cx, 200.0::DOUBLE AS cy, (s_suppkey % 9) * 0.1 AS zen, (s_suppkey % 13) * 0.4 AS azi FROM supplier")


@query(f"""WITH d AS ({_DISTANCE}), k AS (SELECT *, sin(zen) * cos(azi) AS ax, sin(zen) * sin(azi) AS ay, cos(zen) AS az FROM d),
l AS (SELECT *, (x - cx) * ax + (y - cy) * ay AS t FROM k), n AS (SELECT *, greatest(0, least(1000, t)) AS u FROM l)
SELECT station, round(sqrt((x - cx - u * ax) ** 2 + (y - cy - u * ay) ** 2 + (u * az) ** 2), 5) AS distance,
round(sqrt((x - cx - t * ax) ** 2 + (y - cy - t * ay) ** 2 + (t * az) ** 2), 5) AS to_line FROM n""")
def segment_distances(spark, sf_dir):
    """Distance to the axis as a segment, and as a line."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station"), (F.col("s_nationkey") * 100.0).alias("x"), (F.col("s_acctbal") / 10).alias("y"),
        ((F.col("s_suppkey") % 9) * 0.1).alias("zen"), ((F.col("s_suppkey") % 13) * 0.4).alias("azi"))
    at = (F.col("x"), F.col("y"), F.lit(300.0), F.lit(200.0), F.col("zen"), F.col("azi"))
    return s.select("station", F.round(showers.segment_distance(*at), 5).alias("distance"), F.round(A.plane_distance(*at), 5).alias("to_line"))


@formula("""WITH r AS (SELECT unnest(range(100, 3000, 100))::DOUBLE AS r), d AS (SELECT r, 10.0 + r / 100 AS s, 0.2 + r / 10000 AS z FROM r),
b AS (SELECT *, log10(s) AS l, (-3.72 + 0.0967 * log10(s)) + (1.74 - 0.242 * log10(s)) / cos(z) + (-0.274 + 0.0349 * log10(s)) / cos(z) ** 2 AS beta FROM d),
g AS (SELECT *, -1.87 - 0.183 * l + (0.490 - 0.0650 * l) / (exp((19.6 - 2.10 * l) * (cos(z) ** 2 - (0.483 + 0.005 * l))) + 1) - 2.272 * cos(z) ** 4.64 / (exp(18.01 * (l + 1.95)) + 1) - beta AS gamma FROM b)
SELECT r::INT AS r, round(beta, 7) AS beta, round(gamma, 7) AS gamma, round(s * (r / 1000) ** beta * ((r + 700) / 1700) ** (beta + gamma), 6) AS density,
round(18 * (1e7 / (1e6 * r)) ** 0.75 * (1 + r / 320) ** -2.5, 9) AS muons, round(0.4 * 1e7 / 1e4 * (100 / r) ** 0.75 * (100 / (100 + r)) ** 3.25 * (1 + r / 1140), 7) AS electrons FROM g""")
def shower_densities(spark, sf_dir):
    d = spark.range(100, 3000, 100).select(F.col("id").cast("double").alias("r"))
    d = d.withColumn("s", 10 + F.col("r") / 100).withColumn("z", 0.2 + F.col("r") / 10000)
    beta, gamma = showers.beta(F.col("s"), F.col("z")), showers.gamma(F.col("s"), F.col("z"))
    d = d.withColumn("beta", beta).withColumn("gamma", gamma)
    density = A.nkg(F.col("r"), F.col("s"), F.col("beta"), F.col("gamma"))
    return d.select(F.col("r").cast("int").alias("r"), F.round("beta", 7).alias("beta"), F.round("gamma", 7).alias("gamma"), F.round(density, 6).alias("density"),
                    F.round(showers.muon_density(F.lit(1e7), F.col("r")), 9).alias("muons"), F.round(showers.electron_density(F.lit(1e7), F.col("r")), 7).alias("electrons"))


@formula("""WITH RECURSIVE c AS (SELECT 0 AS step, e, e AS e0, 1.0::DOUBLE AS h, 0.0::DOUBLE AS el FROM (SELECT unnest([1e11, 1e13, 1e15, 1e17])::DOUBLE AS e)
UNION ALL SELECT step + 1, e / 15, e0, h * 10, el + 2 * h / 3 * floor(e / 30 / 85e6) FROM c WHERE e > 20e9)
SELECT e0 AS energy, round(arg_max(h, step), 3) AS hadrons, round(arg_max(el, step), 3) AS electrons FROM c GROUP BY 1""")
def cascades(spark, sf_dir):
    rows = [(e, *(round(x, 3) for x in showers.cascade(e))) for e in (1e11, 1e13, 1e15, 1e17)]
    return spark.createDataFrame(rows, "energy double, hadrons double, electrons double")


@formula("""SELECT q, r, greatest(abs(q), abs(r), abs(q + r)) AS ring, round(1.5 * (q + r / 2), 6) AS x, round(1.5 * sqrt(3) / 2 * r, 6) AS y FROM (SELECT unnest(range(-4, 5)) AS q), (SELECT unnest(range(-4, 5)) AS r) WHERE abs(q + r) <= 4""")
def lattice_points(spark, sf_dir):
    return showers.lattice(spark, 4, 1.5).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(f"""WITH {TRI}, x AS (SELECT station, list_max(p2) > 250 AS sat, list_transform(range(1, 65), lambda i: CASE WHEN list_max(p2) > 250 THEN 32 * p1[i] ELSE p2[i] END) AS t,
list_transform(range(1, 65), lambda i: p3[i] + floor(1000 * {_lcg_sql('station * 64 + i - 1')})) AS d FROM ti)
SELECT station, sat, {_digest_sql("t", "total")}, {_digest_sql("d", "dithered")} FROM x""")
def saturated_traces(spark, sf_dir):
    """The low gain scaled where the high gain is saturated; and noise with a fraction added to each bin."""
    s = integer_stations(spark, sf_dir).withColumn("sat", F.array_max("p2") > 250)
    total = A.saturated(F.col("p1"), F.col("p2"), F.when(F.col("sat"), F.lit(32.0)))
    u = lambda i: A.lcg(F.col("station") * 64 + i)
    s = s.withColumn("total", total).withColumn("dithered", A.dither(F.col("p3"), F.col("station"), draw=lambda i: F.floor(1000 * u(i))))
    return s.select("station", "sat", *_digest("total"), *_digest("dithered"))


@query(f"""WITH {TRI}, k AS (SELECT station, unnest(range(64)) AS i FROM ti), u AS (SELECT station, i, ({_lcg_sql('station * 128 + 2 * i')} * 2147483648 + 1) / 2147483649 AS u, {_lcg_sql('station * 128 + 2 * i + 1')} AS v FROM k)
SELECT station, round(sum(17 + 2 * sqrt(-2 * ln(u)) * cos(2 * pi() * v)), 5) AS total, round(sum((17 + 2 * sqrt(-2 * ln(u)) * cos(2 * pi() * v)) ** 2), 4) AS squares FROM u GROUP BY 1""")
def gaussian_baselines(spark, sf_dir):
    """Normal noise of mean 17 and spread 2 from numbered draws."""
    draws = lambda k: A.lcg(F.col("station") * 128 + k)
    s = stations(spark, sf_dir).select("station", A.gaussian(F.col("station"), 64, 17.0, 2.0, draw=draws).alias("x"))
    return s.select("station", F.round(A.total(F.col("x")), 5).alias("total"), F.round(A.total(F.transform("x", lambda v: v * v)), 4).alias("squares"))


_BACK = "list_reverse(p1[2:11]) || p1[1:63] || list_reverse(p1[53:62]) || [0.0]"
_TAPS = "[" + ", ".join(f"{t}" for t in C.FIR_TAPS) + "]"


@query(f"""WITH {TRI}, x AS (SELECT station, list_transform(range(1, 63, 3), lambda k: greatest(0, least(200, trunc(list_sum(list_transform(range(1, 22), lambda j: ({_BACK})[k + j] * ({_TAPS})[j])))::BIGINT >> 11))) AS y FROM ti)
SELECT station, {_digest_sql("y", "ph")} FROM x""")
def fir_variant(spark, sf_dir):
    """The filter that clips to [0, 200] and mirrors the end without its last bin, phase 1."""
    s = integer_stations(spark, sf_dir).withColumn("ph", A.downsample(F.col("p1"), 1, 0.0, 200.0, skip_last=True))
    return s.select("station", *_digest("ph"))


@query(f"""WITH {TRI}, f AS (SELECT station, (list_max(p1) >= 1.75 * 70 AND list_max(p2) >= 1.75 * 70 AND list_max(p3) >= 1.75 * 70)::INT AS near,
len(list_filter(range(1, 65), lambda i: least(p1[i], p2[i], p3[i]) >= 35 AND p1[i] >= 50)) > 0 AS a, len(list_filter(range(1, 65), lambda i: least(p1[i], p2[i], p3[i]) >= 35 AND p2[i] >= 50)) > 0 AS b,
len(list_filter(range(1, 65), lambda i: least(p1[i], p2[i], p3[i]) >= 35 AND p3[i] >= 50)) > 0 AS c FROM ti)
SELECT round(count(*) FILTER (WHERE a) / (count(*) * 2048 * 8.33e-9), 3) AS rate_1, round(count(*) FILTER (WHERE b) / (count(*) * 2048 * 8.33e-9), 3) AS rate_2, round(count(*) FILTER (WHERE c) / (count(*) * 2048 * 8.33e-9), 3) AS rate_3 FROM f""")
def calibration_rates(spark, sf_dir):
    """Rate of the calibration trigger of each PMT."""
    s = integer_stations(spark, sf_dir)
    n = [F.count_if(triggers.online_calibration(F.col(p), tuple(_p()), 20.0).isNotNull()) for p in P]
    seconds = metrics.duration(F.count("*"), seconds=8.33e-9)
    return s.agg(*[F.round(c / seconds, 3).alias(f"rate_{i + 1}") for i, c in enumerate(n)])
