"""Queries on traces: array functions, windows and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A
from tracelake.operators import baseline, metrics, triggers, windows
from tracelake.plans import lifecycles
from tracelake.plans.registry import TR, TRI, integer_stations, query, stations

P = ("p1", "p2", "p3")
W, LEVEL, LEAST = 24, 0.05, 8


def _p():
    return [F.col(p) for p in P]


def _digest(name):
    """count and position-weighted sum of an integer array."""
    x = F.col(name)
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return [F.size(x).cast("long").alias(f"{name}_n"), weighted.cast("long").alias(f"{name}_sum")]


def _digest_sql(expr, name):
    return f"len({expr})::BIGINT AS {name}_n, coalesce(list_sum(list_transform({expr}, lambda v, i: v * i)), 0)::BIGINT AS {name}_sum"


@query(f"""
WITH b AS (SELECT vec_id // 3 AS station, vec_id % 3 AS pmt, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
r AS (SELECT *, sum(CASE WHEN v > {LEVEL} THEN 1 ELSE 0 END) OVER (PARTITION BY station, pmt ORDER BY pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS act FROM b),
m AS (SELECT station, pos, count(*) FILTER (WHERE act >= {LEAST}) AS pmts FROM r WHERE pos >= {W - 1} GROUP BY 1, 2)
SELECT station, count(*) AS n_windows, count(*) FILTER (WHERE pmts >= 2) AS n_fired, coalesce(bool_or(pmts >= 2), false) AS fired FROM m GROUP BY 1""")
def tot_summary(spark, sf_dir):
    s = stations(spark, sf_dir, whole=False)
    bins = triggers.long_form(s.withColumns({p: F.coalesce(p, F.array().cast("array<double>")) for p in P}))
    m = triggers.over_threshold_long(bins, "station", W, LEVEL, LEAST)
    return m.groupBy("station").agg(F.count("*").alias("n_windows"), F.count_if("fired").alias("n_fired"), F.bool_or("fired").alias("fired"))


@query(f"""WITH {TR}, z AS (SELECT station, unnest(p1) AS a, unnest(p2) AS b, unnest(p3) AS c FROM tr)
SELECT station, bool_or(least(a, b, c) > 0.1) AS th, bool_or(least(a, b, c) >= 0.125) AS th_loose, bool_or(greatest(a, b, c) >= 0.3) AS pooled
FROM z GROUP BY 1""")
def threshold_trigger(spark, sf_dir):
    return stations(spark, sf_dir).select(
        "station", triggers.threshold(*_p(), level=0.1).alias("th"), triggers.threshold(*_p(), level=0.125, strict=False).alias("th_loose"),
        triggers.pooled_threshold(*_p(), level=0.3).alias("pooled"),
    )


@query(f"""WITH {TR}, d AS (SELECT station, {", ".join(f"list_filter(list_transform(range(2, len({p}) + 1), lambda i: {p}[i] - {p}[i - 1] * exp(-25.0 / 67)), lambda v: v > 0.05 * (1 - exp(-25.0 / 67))) AS {p}" for p in P)} FROM tr)
SELECT station, len(p1)::BIGINT AS n1, len(p2)::BIGINT AS n2, len(p3)::BIGINT AS n3,
(len(p1) >= 23)::INT + (len(p2) >= 23)::INT + (len(p3) >= 23)::INT >= 2 AS fired FROM d""")
def totd_trigger(spark, sf_dir):
    s = stations(spark, sf_dir)
    n = [F.size(F.filter(A.deconvolve(F.col(p)), lambda v: v > 0.05)).cast("long").alias(f"n{i + 1}") for i, p in enumerate(P)]
    return s.select("station", *n, triggers.over_threshold_deconvolved(*_p(), level=0.05, bins=23).alias("fired"))


@query(f"""WITH {TR}, z AS (SELECT station, unnest(p1) AS a, unnest(p2) AS b, unnest(p3) AS c FROM tr),
k AS (SELECT station, bool_or(least(a, b, c) > 0.15) AS th, count(*) FILTER (WHERE a > 0.1) AS n1, count(*) FILTER (WHERE b > 0.1) AS n2, count(*) FILTER (WHERE c > 0.1) AS n3 FROM z GROUP BY 1)
SELECT station, th OR (n1 >= 14)::INT + (n2 >= 14)::INT + (n3 >= 14)::INT >= 2 AS fired FROM k""")
def composite_trigger(spark, sf_dir):
    own = {"th2": lambda *p: triggers.threshold(*p, level=0.15), "tot": lambda *p: triggers.over_threshold(*p, level=0.1, bins=14)}
    return stations(spark, sf_dir).select("station", triggers.any_of(["tot", "th2"], *_p(), **own).alias("fired"))


_TAPS = "[" + ", ".join(f"{t}" for t in C.FIR_TAPS) + "]"


def _fir_sql(p, phase):
    """The filter's definition, over the padded array."""
    pad = f"list_reverse({p}[2:11]) || {p}[1:63] || list_reverse({p}[54:63]) || [0.0]"
    return f"list_transform(range({phase}, 63, 3), lambda k: trunc(list_sum(list_transform(range(1, 22), lambda j: ({pad})[k + j] * ({_TAPS})[j])))::BIGINT >> 11)"


@query(f"WITH {TRI} SELECT station, {', '.join(_digest_sql(_fir_sql(p, k), f'{p}_ph{k}') for p in P for k in range(3))} FROM ti")
def fir_downsample(spark, sf_dir):
    s = integer_stations(spark, sf_dir).withColumns({f"{p}_ph{k}": A.downsample(F.col(p), k) for p in P for k in range(3)})
    return s.select("station", *[c for p in P for k in range(3) for c in _digest(f"{p}_ph{k}")])


@query(f"""WITH {TRI}, f AS (SELECT station, {', '.join(f"{_fir_sql(p, k)} AS {p}_{k}" for p in P for k in range(3))} FROM ti)
SELECT station, {' OR '.join(f"len(list_filter(range(1, 22), lambda i: least(p1_{k}[i], p2_{k}[i], p3_{k}[i]) > 40)) > 0" for k in range(3))} AS fired FROM f""")
def any_phase_trigger(spark, sf_dir):
    return lifecycles.any_phase(integer_stations(spark, sf_dir), "station", lambda *p: triggers.threshold(*p, level=40.0))


def _digits_sql(p):
    adc = f"list_transform({p}, lambda v: greatest(-100, least(120, floor(1000 * v))))"
    dec = f"list_filter(list_transform({p}, lambda v: floor(1000 * v)), lambda v, i: (i - 1) % 3 = 1)"
    return f"{_digest_sql(adc, f'{p}_adc')}, {_digest_sql(dec, f'{p}_dec')}"


@query(f"""WITH {TR} SELECT station, {', '.join(_digits_sql(p) for p in P)} FROM tr""")
def digitised_trace(spark, sf_dir):
    s = stations(spark, sf_dir)
    for p in P:
        x = A.scale(F.col(p), 1000.0)
        s = s.withColumn(f"{p}_adc", A.digitise(x, 1.0, -100.0, 120.0)).withColumn(f"{p}_dec", A.decimate(A.digitise(x, 1.0, -1e9, 1e9), 1))
    return s.select("station", *[c for p in P for kind in ("adc", "dec") for c in _digest(f"{p}_{kind}")])


@query(f"""WITH {TRI} SELECT station, {', '.join(f"list_sum({p})::BIGINT AS sum_{p}" for p in P)},
round((list_sum(p1) + list_sum(p2) + list_sum(p3)) / 3 / 1593.51, 6) AS charge FROM ti""")
def deposited_charge(spark, sf_dir):
    s = integer_stations(spark, sf_dir)
    q = [A.total(A.charge(F.col(p), 1.0)) for p in P]
    return s.select("station", *[A.total(F.col(p)).cast("long").alias(f"sum_{p}") for p in P], F.round((q[0] + q[1] + q[2]) / 3 / C.Q_CHARGE, 6).alias("charge"))


_NEXT = {"p1": "p2", "p2": "p3", "p3": "p1"}


@query(f"""WITH {TRI}, x AS (SELECT station, {', '.join(f"list_transform(range(1, 65), lambda i: {p}[i] * 2 + CASE WHEN i > 21 AND i <= 37 THEN {q}[i - 21] ELSE 0 END) AS t{p}" for p, q in _NEXT.items())} FROM ti)
SELECT station, {', '.join(_digest_sql(f"t{p}", f"total_{p}") for p in P)} FROM x""")
def total_trace(spark, sf_dir):
    """Scaled baselines with a signal of 16 bins (from the next PMT) at the latch bin, and nothing injected."""
    s = integer_stations(spark, sf_dir)
    for p, q in _NEXT.items():
        placed = A.place(F.slice(q, 1, 16), 64, A.latch_bin(64))
        s = s.withColumn(f"total_{p}", A.add(A.scale(F.col(p), 2.0), placed, F.lit(None).cast("array<double>")))
    return s.select("station", *[c for p in P for c in _digest(f"total_{p}")])


@query(f"""WITH {TRI}, x AS (SELECT station, list_transform(range(1, 65), lambda i: greatest(p1[i], p2[i], p3[i])) AS top,
list_transform(range(1, 65), lambda i: floor((p1[i] + p2[i] + p3[i]) / 3)) AS mid, list_transform(range(1, 65), lambda i: p3[i] - p1[i]) AS swap FROM ti)
SELECT station, {_digest_sql("top", "top")}, {_digest_sql("mid", "mid")}, {_digest_sql("swap", "swap")} FROM x""")
def pooled_traces(spark, sf_dir):
    s = integer_stations(spark, sf_dir).withColumn("turned", A.permute(F.array(*_p()), (2, 0, 1)))
    s = s.withColumn("top", A.pool_max(*_p())).withColumn("mid", F.transform(A.pool_mean(*_p()), lambda v: F.floor(v)).cast("array<double>"))
    s = s.withColumn("swap", F.zip_with(F.col("turned")[0], F.col("turned")[1], lambda a, b: a - b))
    return s.select("station", *_digest("top"), *_digest("mid"), *_digest("swap"))


@query(f"""WITH {TRI}, w AS (SELECT station, label, unnest(range(0, 64 - {W} + 1, 5)) AS s, * EXCLUDE (station, label) FROM ti)
SELECT station, s::INT AS start, (list_sum(p1[s + 1:s + {W}]) + list_sum(p2[s + 1:s + {W}]) + list_sum(p3[s + 1:s + {W}]))::BIGINT AS total FROM w""")
def window_integrals(spark, sf_dir):
    w = windows.windows(integer_stations(spark, sf_dir), "station", W, 5)
    return w.select("station", "start", (3 * windows.integral(*_p())).cast("long").alias("total"))


_LABELLED = f"""{TRI}, w AS (SELECT station, label, unnest(range(0, 64 - {W} + 1, 5)) AS s, p1, p2, p3 FROM ti),
i AS (SELECT station, s, label, list_sum(p1[s + 1:s + {W}]) + list_sum(p2[s + 1:s + {W}]) + list_sum(p3[s + 1:s + {W}]) AS q,
  (len(list_filter(p1[s + 1:s + {W}], lambda v: v > 50)) >= 8)::INT + (len(list_filter(p2[s + 1:s + {W}], lambda v: v > 50)) >= 8)::INT
  + (len(list_filter(p3[s + 1:s + {W}], lambda v: v > 50)) >= 8)::INT >= 2 AS fired FROM w),
l AS (SELECT *, CASE WHEN label % 4 = 0 THEN 'BKG' WHEN label <= 2 THEN 'PRT' WHEN q <= 0 THEN 'INT' ELSE 'SIG' END AS lab FROM i)"""


def _labelled(spark, sf_dir):
    w = windows.windows(integer_stations(spark, sf_dir).drop("label"), "station", W, 5)
    w = w.join(stations(spark, sf_dir).select("station", "label"), "station")
    q = 3 * windows.integral(*_p())
    lab = windows.label(F.col("label") % 4 != 0, F.col("label"), q, 2, 0)
    return w.select("station", "start", lab.alias("label"), triggers.over_threshold(*_p(), level=50.0, bins=8).alias("fired"), q.alias("integral"))


@query(f"WITH {_LABELLED} SELECT lab AS label, fired, count(*) AS n, sum(q)::BIGINT AS total FROM l GROUP BY 1, 2")
def window_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label", "fired").agg(F.count("*").alias("n"), F.sum("integral").cast("long").alias("total"))


@query(f"""WITH {_LABELLED}, t AS (SELECT station, min(s) FILTER (WHERE lab = 'SIG' AND fired) AS tp, max(q) FILTER (WHERE NOT fired) AS top FROM l GROUP BY 1)
SELECT l.station, l.s::INT AS start, 'FP' AS outcome, NULL::BIGINT AS integral FROM l JOIN t USING (station) WHERE lab <> 'SIG' AND fired AND (tp IS NULL OR s < tp)
UNION ALL SELECT station, tp::INT, 'TP', NULL FROM t WHERE tp IS NOT NULL UNION ALL SELECT station, NULL, 'FN', top::BIGINT FROM t WHERE tp IS NULL""")
def first_match_outcomes(spark, sf_dir):
    out = windows.first_match(_labelled(spark, sf_dir), "station")
    return out.select("station", "start", "outcome", F.round("integral").cast("long").alias("integral"))


@query(f"""WITH {TRI}, w AS (SELECT station, unnest(range(0, 64 - {W} + 1, 3)) AS s, p1, p2, p3 FROM ti),
f AS (SELECT station, s, len(list_filter(range(s + 1, s + {W} + 1), lambda i: least(p1[i], p2[i], p3[i]) > 60)) > 0 AS th,
  (len(list_filter(p1[s + 1:s + {W}], lambda v: v > 100)) >= 6)::INT + (len(list_filter(p2[s + 1:s + {W}], lambda v: v > 100)) >= 6)::INT + (len(list_filter(p3[s + 1:s + {W}], lambda v: v > 100)) >= 6)::INT >= 2 AS tot FROM w),
t AS (SELECT station, bool_or(th) AS th, bool_or(tot) AS tot FROM f GROUP BY 1)
SELECT count(*) AS n_traces, count(*) FILTER (WHERE th) AS n_th, count(*) FILTER (WHERE tot) AS n_tot, count(*) FILTER (WHERE th OR tot) AS n_all,
round(count(*) FILTER (WHERE th OR tot) / (count(*) * 2048 * 8.3e-9), 3) AS rate FROM t""")
def production_rate(spark, sf_dir):
    w = windows.windows(integer_stations(spark, sf_dir), "station", W, 3)
    w = w.select("station", triggers.threshold(*_p(), level=60.0).alias("th"), triggers.over_threshold(*_p(), level=100.0, bins=6).alias("tot"))
    t = w.groupBy("station").agg(F.bool_or("th").alias("th"), F.bool_or("tot").alias("tot"))
    n = t.agg(F.count("*").alias("n_traces"), F.count_if("th").alias("n_th"), F.count_if("tot").alias("n_tot"), F.count_if(F.col("th") | F.col("tot")).alias("n_all"))
    return n.withColumn("rate", F.round(F.col("n_all") / metrics.duration(F.col("n_traces")), 3))


_LONG = "x AS (SELECT station, unnest([1, 2, 3]) AS pmt, unnest([p1, p2, p3]) AS x FROM ti)"


def _long(spark, sf_dir):
    s = integer_stations(spark, sf_dir).select("station", F.posexplode(F.array(*_p())).alias("pmt", "x"))
    return s.withColumn("pmt", F.col("pmt") + 1)


@query(f"""WITH RECURSIVE {TRI}, {_LONG}, h AS (SELECT station, pmt, list_sort(list_filter(range(0, 64), lambda i: x[i + 1] > 60)) AS h, x FROM x),
r AS (SELECT station, pmt, h, 0 AS k, NULL::BIGINT AS last, NULL::BIGINT AS hit FROM h
  UNION ALL SELECT station, pmt, h, k + 1, CASE WHEN last IS NULL OR h[k + 1] > last + 9 THEN h[k + 1] ELSE last END, CASE WHEN last IS NULL OR h[k + 1] > last + 9 THEN h[k + 1] END
  FROM r WHERE k < len(h))
SELECT r.station, r.pmt, hit AS at, list_max(x[greatest(hit - 4, 0) + 1:least(hit + 9, 64)])::BIGINT AS peak, list_sum(x[greatest(hit - 4, 0) + 1:least(hit + 9, 64)])::BIGINT AS charge
FROM r JOIN h ON h.station = r.station AND h.pmt = r.pmt WHERE hit IS NOT NULL""")
def dead_time_cuts(spark, sf_dir):
    hits = F.filter(F.transform("x", lambda v, i: F.when(v > 60, i.cast("long"))), lambda x: x.isNotNull())
    s = _long(spark, sf_dir).select("station", "pmt", "x", F.explode(windows.dead_time(hits, 9)).alias("at"))
    s = s.withColumn("cut", windows.cut_around(F.col("x"), F.col("at"), 4, 9))
    return s.select("station", "pmt", "at", F.array_max("cut").cast("long").alias("peak"), A.total(F.col("cut")).cast("long").alias("charge"))


@query(f"""WITH {TRI}, {_LONG}, b AS (SELECT station, pmt, unnest(x) AS v, unnest(range(64)) AS pos FROM x),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY station, pmt ORDER BY pos) AS step FROM b),
u AS (SELECT *, pos - row_number() OVER (PARTITION BY station, pmt ORDER BY pos) AS g FROM d WHERE step > 0)
SELECT station, pmt, min(pos)::INT AS first, max(pos)::INT AS last, sum(step)::BIGINT AS rise FROM u GROUP BY station, pmt, g HAVING count(*) >= 2""")
def rising_runs(spark, sf_dir):
    bins = _long(spark, sf_dir).select("station", "pmt", F.posexplode("x").alias("pos", "v"))
    f = triggers.flanks(bins, ["station", "pmt"])
    return f.select("station", "pmt", "first", "last", F.col("rise").cast("long").alias("rise"))


@query(f"""WITH {TRI}, x AS (SELECT station, list_filter(range(0, 64), lambda i: least(p1[i + 1], p2[i + 1], p3[i + 1]) >= 35 AND p1[i + 1] >= 50) AS h,
  len(list_filter(range(1, 65), lambda i: (p1[i] > 100)::INT + (p2[i] > 100)::INT + (p3[i] > 100)::INT >= 1)) AS muon FROM ti)
SELECT station, list_min(h)::BIGINT AS first_bin, muon::BIGINT AS muon_bins FROM x""")
def calibration_triggers(spark, sf_dir):
    muon = F.size(F.filter(A.pool_max(*_p()), lambda v: v > 100)).cast("long")
    return integer_stations(spark, sf_dir).select("station", triggers.online_calibration(F.col("p1"), tuple(_p()), 20.0).alias("first_bin"), muon.alias("muon_bins"))


@query(f"""WITH {TRI} SELECT station, list_max(p1) <= 350 AND list_max(p2) <= 350 AND list_max(p3) <= 350 AS quiet,
list_max(p1) > 200 AND list_max(p2) > 200 AND list_max(p3) > 200 AS coincident,
list_sum(list_transform(range(1, 65), lambda i: floor(1000 * greatest(-10, least(10, p1[i] / nullif(p2[i], 0))))))::BIGINT AS ratio_sum FROM ti""")
def trace_filters(spark, sf_dir):
    top = [F.array_max(p) for p in P]
    r = F.filter(F.transform(A.ratio(F.col("p1"), F.col("p2")), lambda v: F.floor(1000 * v)), lambda v: v.isNotNull())
    return integer_stations(spark, sf_dir).select(
        "station", ((top[0] <= 350) & (top[1] <= 350) & (top[2] <= 350)).alias("quiet"),
        ((top[0] > 200) & (top[1] > 200) & (top[2] > 200)).alias("coincident"),
        F.aggregate(r, F.lit(0).cast("long"), lambda a, v: a + v).alias("ratio_sum"),
    )


_MOPS = f"""{TRI}, b AS (SELECT station, pmt, unnest(x) AS v, unnest(range(len(x))) AS pos, x FROM (SELECT station, unnest([1, 2, 3]) AS pmt, unnest([p1, p2, p3]) AS x FROM ti)),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY station, pmt ORDER BY pos) AS step FROM b),
u AS (SELECT *, pos - row_number() OVER (PARTITION BY station, pmt ORDER BY pos) AS g FROM d WHERE step > 0),
f AS (SELECT station, pmt, min(pos) - 1 AS lo, max(pos) AS hi, any_value(x) AS x FROM u GROUP BY station, pmt, g HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY station, pmt ORDER BY lo) AS k FROM f),
r AS (SELECT station, pmt, 0::BIGINT AS k, 0::BIGINT AS until, 0::BIGINT AS n FROM (SELECT DISTINCT station, pmt FROM k)
  UNION ALL SELECT r.station, r.pmt, k.k, CASE WHEN hi - greatest(lo, until) >= 1 THEN hi + greatest(floor(log2(x[hi + 1] - x[greatest(lo, until) + 1]) - 2 + 1e-9), 0)::BIGINT ELSE until END,
    n + CASE WHEN hi - greatest(lo, until) >= 1 AND x[hi + 1] - x[greatest(lo, until) + 1] > 3 AND x[hi + 1] - x[greatest(lo, until) + 1] < 150 THEN 1 ELSE 0 END
  FROM r JOIN k ON k.station = r.station AND k.pmt = r.pmt AND k.k = r.k + 1),
c AS (SELECT station, pmt, max(n) AS n FROM r GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_MOPS} SELECT t.station, coalesce(max(n) FILTER (WHERE pmt = 1), 0)::INT AS n1, coalesce(max(n) FILTER (WHERE pmt = 2), 0)::INT AS n2, coalesce(max(n) FILTER (WHERE pmt = 3), 0)::INT AS n3,
count(*) FILTER (WHERE n > 4 AND list_sum(CASE pmt WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) > 36) >= 2 AS fired FROM ti t LEFT JOIN c ON c.station = t.station GROUP BY 1""")
def mops_trigger(spark, sf_dir):
    n = [triggers.flank_count(F.col(p), 3.0, 150.0).alias(f"n{i + 1}") for i, p in enumerate(P)]
    s = integer_stations(spark, sf_dir).select("station", *P, *n)
    hits = [F.when((A.total(F.col(p)) > 36) & (F.col(f"n{i + 1}") > 4), 1).otherwise(0) for i, p in enumerate(P)]
    return s.select("station", "n1", "n2", "n3", (hits[0] + hits[1] + hits[2] >= 2).alias("fired"))


def _estimates(source: str) -> str:
    """The baseline estimator over rows (station, part, x) as a recursion: each turn drops what is far from the mode."""
    mode = "CASE WHEN list_max(x) > list_min(x) THEN list_min(x) + list_position(cnt, list_max(cnt)) - 1 ELSE x[1] END"
    return f"""z AS (SELECT station, part, x, 0 AS turn FROM ({source}) UNION ALL SELECT station, part, kept, turn + 1 FROM (
  SELECT station, part, x, turn, list_filter(x, lambda v: abs(v - m) <= 2 * sd) AS kept FROM (SELECT *, {mode} AS m, list_stddev_pop(x) AS sd FROM (
    SELECT *, list_transform(range(list_min(x)::BIGINT, list_max(x)::BIGINT), lambda c: len(list_filter(x, lambda v: v = c))) AS cnt FROM z))) WHERE len(kept) < len(x) AND len(kept) > 0),
est AS (SELECT station, part, arg_max(list_avg(x), turn) AS mean, arg_max(list_stddev_pop(x), turn) AS spread FROM z GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {TRI}, {_estimates("SELECT station, unnest([1, 2, 3]) AS part, unnest([p1, p2, p3]) AS x FROM ti")}
SELECT station, part::INT AS pmt, round(mean, 6) AS mean, round(spread, 6) AS spread FROM est""")
def baseline_estimates(spark, sf_dir):
    s = integer_stations(spark, sf_dir).select("station", F.posexplode(F.array(*_p())).alias("pmt", "x"))
    e = baseline.estimates(s.withColumn("pmt", F.col("pmt") + 1), ["station", "pmt"], "x")
    return e.select("station", "pmt", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(f"""WITH RECURSIVE {TRI}, {_estimates("SELECT station, unnest([1, 2, 3]) AS part, unnest([p1[1:16], p1[49:64], p1]) AS x FROM ti")},
j AS (SELECT t.station, p1, a.mean AS b0, b.mean AS b1, w.mean AS bw, b.mean - a.mean AS d, sqrt(a.spread ** 2 + b.spread ** 2) AS s, list_position(p1, list_max(p1)) AS top FROM ti t JOIN est a ON a.station = t.station AND a.part = 1
  JOIN est b ON b.station = t.station AND b.part = 2 JOIN est w ON w.station = t.station AND w.part = 3),
k AS (SELECT *, CASE WHEN d >= 5 * s THEN 'rejected' WHEN d >= 0 THEN 'constant' WHEN d >= -s OR list_max(p1) - b0 < 50 THEN 'step' ELSE 'undershoot' END AS status FROM j)
SELECT station, status, round(CASE status WHEN 'constant' THEN list_sum(p1) - 64 * bw WHEN 'step' THEN list_sum(p1) - (top - 1) * b0 - (65 - top) * b1 ELSE list_sum(p1) END, 5) AS total FROM k""")
def corrected_baselines(spark, sf_dir):
    s = baseline.correct(integer_stations(spark, sf_dir).select("station", "p1"), "p1", edge=16)
    return s.select("station", "status", F.round(A.total(F.col("p1")), 5).alias("total"))


@query(f"""WITH {TRI}, x AS (SELECT station, label, list_transform(range(1, 65), lambda i: p1[i] + p2[i] + p3[i]) AS x FROM ti),
f AS (SELECT station, label, f, list_sum(list_transform(range(64), lambda i: x[i + 1] * cos(2 * pi() * f * i / 64))) AS re, list_sum(list_transform(range(64), lambda i: x[i + 1] * sin(2 * pi() * f * i / 64))) AS im
  FROM (SELECT *, unnest(range(64)) AS f FROM x)),
s AS (SELECT label, f, avg(re * re + im * im) AS m FROM f GROUP BY 1, 2) SELECT f::INT AS freq, round(avg(m), 3) AS power FROM s GROUP BY 1""")
def power_spectra(spark, sf_dir):
    s = integer_stations(spark, sf_dir).select("label", A.add(*_p()).alias("x"))
    return baseline.spectra(s, ["label"], "x").select("freq", F.round("power", 3).alias("power"))


_LIFE = f"""{TRI}, w AS (SELECT station, label, unnest(range(0, 64 - {W} + 1, 5)) AS s, p1, p2, p3 FROM ti),
i AS (SELECT station, s, label, (list_sum(p1[s + 1:s + {W}]) + list_sum(p2[s + 1:s + {W}]) + list_sum(p3[s + 1:s + {W}])) / 3 / {C.Q_CHARGE} AS q,
  (len(list_filter(p1[s + 1:s + {W}], lambda v: greatest({C.CLIP_LOW}, v) / 100 > 0.5)) >= 8)::INT + (len(list_filter(p2[s + 1:s + {W}], lambda v: greatest({C.CLIP_LOW}, v) / 100 > 0.5)) >= 8)::INT
  + (len(list_filter(p3[s + 1:s + {W}], lambda v: greatest({C.CLIP_LOW}, v) / 100 > 0.5)) >= 8)::INT >= 2 AS fired FROM w)"""


@query(f"""WITH {_LIFE}, t AS (SELECT station, bool_or(fired) AS hit FROM i GROUP BY 1), n AS (SELECT count(*) AS n_traces, count(*) FILTER (WHERE hit) AS n FROM t)
SELECT n_traces, n, round(n_traces * (2048 * 8.3e-9), 9) AS duration, round(n / (n_traces * (2048 * 8.3e-9)), 3) AS rate, round(sqrt(n) / (n_traces * (2048 * 8.3e-9)), 3) AS rate_err FROM n""")
def noise_lifecycle(spark, sf_dir):
    s = integer_stations(spark, sf_dir).select("station", *P)
    options = C.TraceOptions(window=W, step=5, q_peak=100.0)
    out = lifecycles.noise_rate(s, "station", options, lambda *p: triggers.over_threshold(*p, level=0.5, bins=8))
    return out.select("n_traces", "n", F.round("duration", 9).alias("duration"), F.round("rate", 3).alias("rate"), F.round("rate_err", 3).alias("rate_err"))


@query(f"""WITH {_LIFE}, l AS (SELECT *, CASE WHEN label % 4 = 0 THEN 'BKG' WHEN label <= 2 THEN 'PRT' WHEN q <= 0 THEN 'INT' ELSE 'SIG' END AS lab FROM i),
t AS (SELECT station, min(s) FILTER (WHERE lab = 'SIG' AND fired) AS tp, max(q) FILTER (WHERE NOT fired) AS top FROM l GROUP BY 1)
SELECT l.station, l.s::INT AS start, 'FP' AS outcome, NULL::DOUBLE AS integral FROM l JOIN t USING (station) WHERE lab <> 'SIG' AND fired AND (tp IS NULL OR s < tp)
UNION ALL SELECT station, tp::INT, 'TP', NULL FROM t WHERE tp IS NOT NULL UNION ALL SELECT station, NULL, 'FN', round(top, 6) FROM t WHERE tp IS NULL""")
def prediction_lifecycle(spark, sf_dir):
    s = integer_stations(spark, sf_dir)
    options = C.TraceOptions(window=W, step=5, q_peak=100.0, ignore_particles=2)
    out = lifecycles.predictions(s, "station", options, F.col("label") % 4 != 0, F.col("label"), lambda *p: triggers.over_threshold(*p, level=0.5, bins=8))
    return out.withColumn("integral", F.round("integral", 6))
