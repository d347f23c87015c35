"""Queries on rates, efficiencies, histograms and fits."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.operators import fits, joins, metrics
from tracelake.plans.registry import formula, query, table
from tracelake.plans.relation_queries import _lcg_sql

EDGES = (1000.0, 5000.0, 10000.0, 20000.0, 40000.0, 60000.0, 80000.0)
ZEN = (0.0, 0.02, 0.04, 0.06, 0.08)
_D = lambda x, edges: " + ".join(f"({x} >= {e})::INT" for e in edges)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _grid(spark, sf_dir):
    return _lines(spark, sf_dir).select(
        A.digitize(F.col("l_extendedprice"), EDGES).alias("e"), A.digitize(F.col("l_discount"), ZEN).alias("t"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("spd"), (F.col("l_returnflag") == "R").alias("hit"), "l_quantity", "l_extendedprice", "l_linestatus",
        "l_discount", "l_tax", "l_suppkey",
    )


_GRID = f"""g AS (SELECT ({_D('l_extendedprice', EDGES)})::INT AS e, ({_D('l_discount', ZEN)})::INT AS t, floor(l_quantity / 5)::INT AS spd, l_returnflag = 'R' AS hit, l_quantity, l_extendedprice, l_linestatus FROM lineitem)"""


@query("""SELECT user_id, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS rate, round(sqrt(count(*)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS rate_err
FROM events GROUP BY 1 HAVING max(ts) > min(ts)""")
def station_rates(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), ((F.max(joins.micros("ts")) - F.min(joins.micros("ts"))) / 1e6).alias("d"))
    return g.where("d > 0").select("user_id", "n", *[F.round(c, 9).alias(a) for c, a in zip(metrics.rate(F.col("n"), F.col("d")), ("rate", "rate_err"))])


@query("""SELECT l_quantity::INT AS scale, count(*) AS files, sum(l_linenumber)::BIGINT AS n, sum(l_suppkey)::BIGINT AS t, round(sum(l_linenumber) / sum(l_suppkey), 8) AS rate,
round(stddev_pop(l_linenumber) / sum(l_suppkey), 8) AS spread, round(sqrt(sum(l_linenumber)) / sum(l_suppkey), 8) AS err FROM lineitem GROUP BY 1""")
def component_rates(spark, sf_dir):
    n, t = F.sum("l_linenumber"), F.sum("l_suppkey")
    return _lines(spark, sf_dir).groupBy(F.col("l_quantity").cast("int").alias("scale")).agg(
        F.count("*").alias("files"), n.alias("n"), t.alias("t"), F.round(n / t, 8).alias("rate"),
        F.round(F.stddev_pop("l_linenumber") / t, 8).alias("spread"), F.round(F.sqrt(n) / t, 8).alias("err"))


@query("""WITH f AS (SELECT l_suppkey, l_quantity > 45 AS th, l_discount >= 0.09 AS tot, l_tax >= 0.07 AS totd FROM lineitem)
SELECT l_suppkey AS station, count(*) FILTER (WHERE th) + count(*) FILTER (WHERE tot) + count(*) FILTER (WHERE totd) AS added, count(*) FILTER (WHERE th OR tot OR totd) AS any_flag,
count(*) - count(*) FILTER (WHERE tot) - count(*) FILTER (WHERE totd) AS rest FROM f GROUP BY 1""")
def total_rates(spark, sf_dir):
    f = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("station"), (F.col("l_quantity") > 45).alias("th"), (F.col("l_discount") >= 0.09).alias("tot"), (F.col("l_tax") >= 0.07).alias("totd"))
    th, tot, totd = (F.count_if(c) for c in ("th", "tot", "totd"))
    return f.groupBy("station").agg((th + tot + totd).alias("added"), F.count_if(F.col("th") | F.col("tot") | F.col("totd")).alias("any_flag"), (F.count("*") - tot - totd).alias("rest"))


@query("""SELECT l_linenumber AS sigma, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND NOT p) AS tn, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn,
round(count(*) FILTER (WHERE a = p) / count(*), 8) AS accuracy FROM (SELECT l_linenumber, l_returnflag = 'R' AS a, l_quantity > 30 AS p FROM lineitem) GROUP BY 1""")
def confusion(spark, sf_dir):
    x = _lines(spark, sf_dir).select(F.col("l_linenumber").alias("sigma"), (F.col("l_returnflag") == "R").alias("a"), (F.col("l_quantity") > 30).alias("p"))
    a, p = F.col("a"), F.col("p")
    return x.groupBy("sigma").agg(F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"),
                                  F.round(F.count_if(a == p) / F.count("*"), 8).alias("accuracy"))


@query(f"""WITH {_GRID}, c AS (SELECT e, t, count(*) FILTER (WHERE hit) AS x, count(*) FILTER (WHERE NOT hit) AS o FROM g GROUP BY 1, 2)
SELECT e, t, x, o, round(x / (x + o), 8) AS eff, round(abs(x ** 1.5 - o ** 1.5) / (x + o) ** 2, 8) AS eff_err, round(sqrt(x * o * o + o * x * x + 2.0 * x * o) / (x + o) ** 2, 8) AS older FROM c""")
def efficiency_grid(spark, sf_dir):
    c = _grid(spark, sf_dir).groupBy("e", "t").agg(F.count_if("hit").alias("x"), F.count_if(~F.col("hit")).alias("o"))
    eff, err = metrics.efficiency(F.col("x"), F.col("o"))
    x, o = F.col("x").cast("double"), F.col("o").cast("double")
    return c.select("e", "t", "x", "o", F.round(eff, 8).alias("eff"), F.round(err, 8).alias("eff_err"), F.round(metrics.efficiency_error_older(x, o), 8).alias("older"))


@query(f"""WITH {_GRID}, v AS (SELECT e, list_sort(list(l_quantity)) AS v FROM g GROUP BY 1), i AS (SELECT e, v, len(v) AS n, unnest(range(0, 11)) AS i FROM v WHERE len(v) >= 20),
k AS (SELECT *, n * (i / 10.0) + 0.4 + 0.2 * (i / 10.0) AS a FROM i), h AS (SELECT *, greatest(1, least(floor(a), n - 1)) AS k FROM k)
SELECT e, i::INT AS i, round((1 - greatest(0, least(1, a - k))) * v[k::INT] + greatest(0, least(1, a - k)) * v[least(k + 1, n)::INT], 6) AS edge FROM h""")
def quantile_bins(spark, sf_dir):
    q = metrics.quantiles(_grid(spark, sf_dir), ["e"], "l_quantity", bins=10, least=20)
    return q.select("e", "i", F.round("edge", 6).alias("edge"))


_LOG = tuple(round(10 ** (3 + 2.2 * i / 20), 6) for i in range(21))


@query(f"""WITH {_GRID}, b AS (SELECT CASE WHEN l_extendedprice = {_LOG[-1]} THEN {len(_LOG) - 2} ELSE ({_D('l_extendedprice', _LOG)}) - 1 END AS bin, hit FROM g)
SELECT bin::INT AS bin, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM b WHERE bin >= 0 AND bin < {len(_LOG) - 1} GROUP BY 1""")
def charge_bins(spark, sf_dir):
    b = _grid(spark, sf_dir).select(A.histogram_bin(F.col("l_extendedprice"), _LOG).cast("int").alias("bin"), "hit").where("bin IS NOT NULL")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"""WITH x AS (SELECT ({_D('l_extendedprice', EDGES)})::INT AS e, l_returnflag = 'R' AND {_lcg_sql('l_orderkey * 8 + l_linenumber')} < 1 - l_quantity / 60 AS tp FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.08)
SELECT e, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE NOT tp) AS fn FROM x GROUP BY 1""")
def energy_efficiency(spark, sf_dir):
    x = _lines(spark, sf_dir).where("l_discount >= 0.02 AND l_discount < 0.08")
    u = A.lcg(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    x = x.select(A.digitize(F.col("l_extendedprice"), EDGES).alias("e"), ((F.col("l_returnflag") == "R") & (u < 1 - F.col("l_quantity") / 60)).alias("tp"))
    return x.groupBy("e").agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fn"))


@query("""WITH w AS (SELECT l_linenumber AS model, 100 * 50 * (l_extendedprice / 900) ** -3 AS w FROM lineitem WHERE l_returnflag = 'R')
SELECT model, count(*) AS n, round(log10(sum(1 / w)), 7) AS log_inverse, round(log10(sum(w)), 7) AS log_sum FROM w GROUP BY 1""")
def flux_weights(spark, sf_dir):
    w = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_linenumber").alias("model"), (100 * 50 * F.pow(F.col("l_extendedprice") / 900, -3)).alias("w"))
    return w.groupBy("model").agg(F.count("*").alias("n"), F.round(F.log10(F.sum(1 / F.col("w"))), 7).alias("log_inverse"), F.round(F.log10(F.sum("w")), 7).alias("log_sum"))


#: What stands for the stations' flags, in both dialects.
FLAGS = {"th1": "l_quantity > 15", "th2": "l_quantity > 25", "tot": "l_discount >= 0.05", "totd": "l_tax >= 0.03", "mops": "l_suppkey % 3 = 0"}
_FLAG_SQL = ", ".join(f"count(*) FILTER (WHERE hit AND {c}) AS {f}" for f, c in FLAGS.items())


@query(f"""WITH {_GRID.replace('l_quantity, ', 'l_quantity, l_discount, l_tax, l_suppkey, ')},
c AS (SELECT e, t, spd, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, {_FLAG_SQL} FROM g GROUP BY 1, 2, 3),
s AS (SELECT *, sum(hits) OVER (PARTITION BY e, t) AS h, sum(misses) OVER (PARTITION BY e, t) AS m FROM c)
SELECT e, t, spd, hits, misses, th1, th2, tot, totd, mops FROM s WHERE h > 0 AND m > 0""")
def merged_grid(spark, sf_dir):
    flags = {f: F.expr(c) for f, c in FLAGS.items()}
    c = _grid(spark, sf_dir).groupBy("e", "t", "spd").agg(*metrics.flag_counts(F.col("hit"), flags))
    return metrics.sparse_grid(c, ["e", "t"])


@query(f"""WITH {_GRID}, c AS (SELECT spd, count(*) FILTER (WHERE NOT hit) AS miss, count(*) FILTER (WHERE hit AND l_linestatus = 'O') AS tot, count(*) FILTER (WHERE hit) AS every FROM g GROUP BY 1)
SELECT spd, round(tot / (miss + tot), 8) AS eff_tot, greatest(1e-5, round(sqrt(tot) / (miss + tot), 8)) AS err_tot, every - tot AS th2 FROM c WHERE miss + tot > 0""")
def component_efficiency(spark, sf_dir):
    c = _grid(spark, sf_dir).groupBy("spd").agg(F.count_if(~F.col("hit")).alias("miss"), F.count_if(F.col("hit") & (F.col("l_linestatus") == "O")).alias("tot"), F.count_if("hit").alias("every"))
    n = F.col("miss") + F.col("tot")
    return c.where("miss + tot > 0").select("spd", F.round(F.col("tot") / n, 8).alias("eff_tot"), F.greatest(F.lit(1e-5), F.round(F.sqrt("tot") / n, 8)).alias("err_tot"), (F.col("every") - F.col("tot")).alias("th2"))


@query(f"""WITH {_GRID} SELECT e, t, spd, grouping_id(e, t, spd)::BIGINT AS kind, count(*) AS n, count(*) FILTER (WHERE hit) AS chosen FROM g GROUP BY GROUPING SETS ((e), (t), (spd))""")
def physics_histograms(spark, sf_dir):
    e, t, spd = F.col("e"), F.col("t"), F.col("spd")
    g = _grid(spark, sf_dir).groupingSets([[e], [t], [spd]], e, t, spd)
    return g.agg(F.grouping_id(e, t, spd).alias("kind"), F.count("*").alias("n"), F.count_if("hit").alias("chosen"))


@query("""WITH x AS (SELECT l_orderkey % 50 AS batch, l_returnflag = 'R' AS s FROM lineitem) SELECT batch, count(*) FILTER (WHERE s) AS n_sig, count(*) AS n, round(count(*) FILTER (WHERE s) / count(*), 8) AS prior FROM x GROUP BY 1""")
def batch_priors(spark, sf_dir):
    x = _lines(spark, sf_dir).select((F.col("l_orderkey") % 50).alias("batch"), (F.col("l_returnflag") == "R").alias("s"))
    return x.groupBy("batch").agg(F.count_if("s").alias("n_sig"), F.count("*").alias("n"), F.round(F.count_if("s") / F.count("*"), 8).alias("prior"))


@query("""WITH b AS (SELECT l_linestatus, CASE WHEN l_extendedprice = 100000 THEN 249 ELSE floor((l_extendedprice - 1000) * 250 / 99000) END AS bin FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 100000)
SELECT l_linestatus AS kind, bin::INT AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def peak_histogram(spark, sf_dir):
    b = _lines(spark, sf_dir).select(F.col("l_linestatus").alias("kind"), metrics.uniform_bin(F.col("l_extendedprice"), 1000.0, 100000.0, 250).alias("bin")).where("bin IS NOT NULL")
    return b.groupBy("kind", "bin").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_quantity::INT AS bin, count(*) FILTER (WHERE l_returnflag = 'R') AS s, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1)
SELECT bin, round((s / sum(s) OVER ()) / nullif(b / sum(b) OVER (), 0), 7) AS quotient FROM c""")
def pdf_quotient(spark, sf_dir):
    r = F.col("l_returnflag") == "R"
    c = _lines(spark, sf_dir).groupBy(F.col("l_quantity").cast("int").alias("bin")).agg(F.count_if(r).alias("s"), F.count_if(~r).alias("b"))
    every = Window.partitionBy()
    return c.select("bin", F.round((F.col("s") / F.sum("s").over(every)) / F.nullif(F.col("b") / F.sum("b").over(every), F.lit(0.0)), 7).alias("quotient"))


@query("""SELECT l_linenumber AS k, round(avg(greatest(17, least(33, l_quantity))), 7) AS mean, round(stddev_pop(greatest(17, least(33, l_quantity))), 7) AS spread, round(corr(l_quantity, l_extendedprice), 7) AS corr FROM lineitem GROUP BY 1""")
def noise_statistics(spark, sf_dir):
    clipped = F.greatest(F.lit(17.0), F.least(F.lit(33.0), F.col("l_quantity")))
    return _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg(clipped), 7).alias("mean"), F.round(F.stddev_pop(clipped), 7).alias("spread"), F.round(F.corr("l_quantity", "l_extendedprice"), 7).alias("corr"))


@query("""SELECT (epoch_us(ts) // 86400000000) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1, 2""")
def day_averages(spark, sf_dir):
    day = F.floor(joins.micros("ts") / 86400000000).cast("long")
    return table(spark, sf_dir, "events").groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query(f"""WITH {_GRID}, c AS (SELECT l_linestatus, spd, count(*) FILTER (WHERE hit) AS h, count(*) AS n FROM g GROUP BY 1, 2)
SELECT a.spd, round(a.h / a.n - b.h / b.n, 8) AS diff FROM c a JOIN c b ON a.spd = b.spd AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'""")
def variant_difference(spark, sf_dir):
    c = _grid(spark, sf_dir).groupBy("spd", "l_linestatus").agg((F.count_if("hit") / F.count("*")).alias("r"))
    both = c.groupBy("spd").agg(F.max(F.when(F.col("l_linestatus") == "O", F.col("r"))).alias("a"), F.max(F.when(F.col("l_linestatus") == "F", F.col("r"))).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("spd", F.round(F.col("a") - F.col("b"), 8).alias("diff"))


def _poisson_sql(u, rate, most=30):
    acc, term, parts = 0.0, math.exp(-rate), []
    for k in range(most):
        acc += term
        parts.append(f"({u} >= {acc!r})::INT")
        term *= rate / (k + 1)
    return " + ".join(parts)


@query(f"""WITH x AS (SELECT {_poisson_sql(_lcg_sql('o_orderkey'), 2.5)} AS k FROM orders) SELECT k::INT AS k, count(*) AS n FROM x GROUP BY 1""")
def poisson_multiplicity(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(A.poisson(A.lcg(F.col("o_orderkey")), 2.5, 30).alias("k")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_suppkey AS model, avg(l_discount) AS acc, avg(l_tax) AS rate FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(acc), 7) AS acc, arg_min(model, (round(rate / acc, 9), model)) AS model FROM m""")
def ensemble(spark, sf_dir):
    m = _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("model")).agg(F.avg("l_discount").alias("acc"), F.avg("l_tax").alias("rate"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("acc"), 7).alias("acc"), F.min_by("model", F.struct(F.round(F.col("rate") / F.col("acc"), 9), "model")).alias("model"))


@query("""SELECT l_linenumber AS k, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx FROM lineitem GROUP BY 1""")
def line_fits(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_sxx(y, x), 2).alias("sxx"))


@formula("""WITH d AS (SELECT unnest(range(100, 2000, 100))::DOUBLE AS r) SELECT r::INT AS r, round(20 * (r / 1000) ** -2.1 * ((r + 700) / 1700) ** (-2.1 + 0.2), 6) AS density,
round(sqrt(0.01 * (1 - 1 / (1 + exp(-(r - 800) / -100))) ** 2), 6) AS err, round(800 - ln(1 / (1 - 0.5 / 0.9) - 1) / -0.01, 6) AS radius FROM d""")
def lateral_profiles(spark, sf_dir):
    d = spark.range(100, 2000, 100).select(F.col("id").cast("double").alias("r"))
    err = A.lateral_error(F.col("r"), F.lit(0.9), F.lit(800.0), F.lit(-100.0), [[0.01, 0, 0], [0, 0, 0], [0, 0, 0]])
    return d.select(F.col("r").cast("int").alias("r"), F.round(A.nkg(F.col("r"), F.lit(20.0), F.lit(-2.1), F.lit(0.2)), 6).alias("density"), F.round(err, 6).alias("err"),
                    F.round(A.full_efficiency_radius(F.lit(0.9), F.lit(800.0), F.lit(-0.01), 0.5), 6).alias("radius"))


_HIT = "l_extendedprice > 52000 + 3000 * (l_quantity - 25) AND l_returnflag <> 'R'"
_START = """tops AS (SELECT e, t, least(1.0, max(y)) AS p0, max(y) AS top, (max(x) - min(x)) / 8.0 AS p2 FROM pts GROUP BY e, t),
start AS (SELECT e, t, p0, arg_min(x, (abs(y - top / 2), x)) AS p1, p2 FROM pts JOIN tops USING (e, t) GROUP BY e, t, p0, p2)"""
_LATERAL_OUT = "SELECT e, t, round(p0, 4) AS efficiency, round(p1, {0}) AS p50, round(p2, {0}) AS width FROM fit"


def _lateral_out(f, digits):
    return f.select("e", "t", F.round("efficiency", 4).alias("efficiency"), F.round("p50", digits).alias("p50"), F.round("width", digits).alias("width"))


@query(f"""WITH RECURSIVE pts AS (SELECT l_linenumber AS e, l_linestatus AS t, l_quantity AS x, count(*) FILTER (WHERE {_HIT}) / count(*) AS y, 1.0::DOUBLE AS w FROM lineitem GROUP BY 1, 2, 3),
{_START}, {fits.least_squares_sql(fits.FALLING, "pts", "start", ["e", "t"])} {_LATERAL_OUT.format(3)}""")
def lateral_fits(spark, sf_dir):
    """The lateral function fitted to the efficiency of each cell by distance."""
    c = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("e"), F.col("l_linestatus").alias("t"), F.col("l_quantity").alias("x")).agg((F.count_if(F.expr(_HIT)) / F.count("*")).alias("y"))
    return _lateral_out(fits.fit_lateral(c, ["e", "t"]), 3)


@query(f"""WITH RECURSIVE cells AS (SELECT l_linenumber AS e, l_linestatus AS t, 100 * ceil(l_quantity / 2) AS spd, count(*) FILTER (WHERE {_HIT}) AS h, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
pts AS (SELECT e, t, spd - 50 AS x, h / n AS y, n::DOUBLE AS w FROM (SELECT *, max(spd) OVER (PARTITION BY e, t) AS far FROM cells) WHERE spd <= far - 500),
{_START}, {fits.least_squares_sql(fits.FALLING, "pts", "start", ["e", "t"])} {_LATERAL_OUT.format(1)}""")
def binned_lateral_fits(spark, sf_dir):
    """The same to bins of 100 m, weighted by their samples, without each cell's last five."""
    spd = (100 * F.ceil(F.col("l_quantity") / 2)).cast("double")
    c = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("e"), F.col("l_linestatus").alias("t"), spd.alias("spd")).agg(F.count_if(F.expr(_HIT)).alias("hits"), F.count("*").alias("n"))
    b = fits.binned(c.withColumn("misses", F.col("n") - F.col("hits")), ["e", "t"], "spd", "hits", "misses")
    return _lateral_out(fits.fit_lateral(b, ["e", "t"], weight="w"), 1)


@query(f"""WITH RECURSIVE pts AS (SELECT event_type AS kind, 10.0::DOUBLE * floor(value / 10) AS x, count(*)::DOUBLE AS y, 1.0::DOUBLE AS w FROM events GROUP BY 1, 2),
start AS (SELECT kind, exp(regr_intercept(ln(y), x)) AS p0, -regr_slope(ln(y), x) AS p1 FROM pts GROUP BY 1),
{fits.least_squares_sql(fits.EXPONENTIAL, "pts", "start", ["kind"])} SELECT kind, round(p0, 2) AS a, round(p1, 6) AS b, round(ln(5.0 / p0) / p1, 3) AS surplus FROM fit""")
def rate_fits(spark, sf_dir):
    """Rates above a threshold that fall exponentially, and where they reach 5."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), (10.0 * F.floor(F.col("value") / 10)).alias("x")).agg(F.count("*").cast("double").alias("y"))
    f = fits.fit_exponential(c, ["kind"])
    return f.select("kind", F.round("a", 2).alias("a"), F.round("b", 6).alias("b"), F.round(fits.surplus(F.lit(5.0), F.col("a"), F.col("b")), 3).alias("surplus"))


@query(f"""WITH RECURSIVE h AS (SELECT event_type AS kind, floor(20 * log10(1 + value))::INT AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1, 2),
line AS (SELECT kind, regr_slope(ln(n), bin) AS s, regr_intercept(ln(n), bin) AS i FROM h WHERE bin < 12 OR bin >= 48 AND bin < 60 GROUP BY 1),
pts AS (SELECT kind, bin::DOUBLE AS x, n - coalesce(exp(i + s * bin), 0) AS y, 1.0::DOUBLE AS w FROM h LEFT JOIN line USING (kind) WHERE bin >= 20 AND bin < 46),
start AS (SELECT kind, greatest(max(y), 1) AS p0, arg_min(x, (-y, x)) AS p1, greatest((max(x) - min(x)) / 6, 1) AS p2 FROM pts GROUP BY 1),
{fits.least_squares_sql(fits.GAUSS, "pts", "start", ["kind"])} SELECT kind, round(p1, 4) AS mean, round(p2, 4) AS sigma FROM fit""")
def peak_fits(spark, sf_dir):
    """The peak of a charge histogram, on a logarithmic scale, over the background of its side bands."""
    e = table(spark, sf_dir, "events").where("value >= 0")
    h = e.groupBy(F.col("event_type").alias("kind"), F.floor(20 * F.log10(1 + F.col("value"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return fits.fit_peak(h, ["kind"], ((0, 12), (48, 60)), (20, 46)).select("kind", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))
