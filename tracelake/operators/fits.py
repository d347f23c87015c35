"""Fits per group by sums of products: every round joins the curves' parameters to the points and adds up, so a group
of any size is spread over all tasks, and what is shuffled is a row of sums for each group and task."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.sinks import stored

FAR = 1e300


@dataclass(frozen=True)
class Model:
    """A curve in x and p0, p1, ..., its slopes by them, and bounds of them; expressions that any SQL engine takes."""

    value: str
    slopes: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]


_E = "exp(least(60.0, greatest(-60.0, (x - p1) / p2)))"
_D = "exp(least(60.0, greatest(-60.0, -p1 * x)))"
_G = "exp(greatest(-600.0, -0.5 * (x - p1) * (x - p1) / (p2 * p2)))"
_LATERAL = (f"p0 / (1 + {_E})", (f"1 / (1 + {_E})", f"p0 * {_E} / ((1 + {_E}) * (1 + {_E}) * p2)", f"p0 * {_E} * (x - p1) / ((1 + {_E}) * (1 + {_E}) * p2 * p2)"))
#: The lateral function that falls with the distance, and the one that rises with it.
FALLING = Model(*_LATERAL, (0.0, -1e5, 1e-3), (1.0, 1e5, 1e5))
RISING = Model(*_LATERAL, (0.0, -1e5, -1e5), (1.0, 1e5, -1e-3))
EXPONENTIAL = Model(f"p0 * {_D}", (_D, f"-p0 * x * {_D}"), (-FAR, -FAR), (FAR, FAR))
GAUSS = Model(f"p0 * {_G}", (_G, f"p0 * {_G} * (x - p1) / (p2 * p2)", f"p0 * {_G} * (x - p1) * (x - p1) / (p2 * p2 * p2)"), (-FAR, -FAR, 1e-6), (FAR, FAR, FAR))


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _moves(k: int) -> list[str]:
    """The solution of the damped normal equations, for two or three parameters, by cofactors.  A parameter whose f is 0 is
    held at its bound: the others move as if it weren't there."""
    m = lambda i, j: f"(n{i}{i} * (1 + damp))" if i == j else f"(n{min(i, j)}{max(i, j)} * f{i} * f{j})"
    if k == 2:
        cof = [[m(1, 1), f"-{m(0, 1)}"], [f"-{m(0, 1)}", m(0, 0)]]
    else:
        cof = [[f"({m((i + 1) % 3, (j + 1) % 3)} * {m((i + 2) % 3, (j + 2) % 3)} - {m((i + 1) % 3, (j + 2) % 3)} * {m((i + 2) % 3, (j + 1) % 3)})" for j in range(3)] for i in range(3)]
    det = " + ".join(f"{m(0, j)} * {cof[0][j]}" for j in range(k))
    return ["(" + " + ".join(f"{cof[j][i]} * g{j}" for j in range(k)) + f") / nullif({det}, 0.0)" for i in range(k)]


def _free(model: Model, name: str) -> list[str]:
    """0 for parameters at a bound that the cost pulls beyond it, else 1."""
    return [f"CASE WHEN {name}{i} >= {hi!r} AND g{i} > 0 OR {name}{i} <= {lo!r} AND g{i} < 0 THEN 0.0 ELSE 1.0 END" for i, (lo, hi) in enumerate(zip(model.low, model.high))]


def least_squares(points: DataFrame, keys: list[str], model: Model, start: DataFrame, x: str = "x", y: str = "y", weight: str | None = None, rounds: int = 60) -> DataFrame:
    """keys and p0, p1, ... of each group, by damped Gauss-Newton inside the model's bounds from those in `start`.

    `points` are read once a round and should be a stored table.  A round is an aggregation over all points; groups
    are done when a step changes the cost by less than 1e-11 of it, nothing is left of it, or no step is found.  Points need finite x, y and weight.
    Null keys are a group.  Parameters are broadcast only if Spark finds their table small."""
    spark, k = points.sparkSession, len(model.slopes)
    params = [f"p{i}" for i in range(k)]
    sums = [f"n{i}{j}" for i, j in _pairs(k)] + [f"g{i}" for i in range(k)]
    rows = points.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                         (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    state = start.select(*keys, *[F.col(p).cast("double").alias(f"best{i}") for i, p in enumerate(params)], *[F.col(p).cast("double").alias(p) for p in params],
                         *[F.lit(0.0).alias(c) for c in sums], F.lit(FAR).alias("cost"), F.lit(1e-3).alias("damp"), F.lit(False).alias("done"))
    state = stored(spark, state, "fit")
    off = F.expr(f"y - {model.value}")
    slopes = [F.expr(s) for s in model.slopes]
    same = lambda: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], F.lit(True))
    for _ in range(rounds):
        at = rows.join(state.where(~F.col("done")).select(*keys, *params), same()).withColumn("r", off).withColumns({f"s{i}": s for i, s in enumerate(slopes)})
        found = at.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(
            F.sum(F.expr("w * r * r")).alias("now"), F.sum(F.expr("w * y * y")).alias("size"), *[F.sum(F.expr(f"w * s{i} * s{j}")).alias(f"new_n{i}{j}") for i, j in _pairs(k)],
            *[F.sum(F.expr(f"w * s{i} * r")).alias(f"new_g{i}") for i in range(k)])
        both = state.join(found, same(), "left")
        better = F.coalesce(F.col("now") < F.col("cost"), F.lit(False))
        done = F.col("done") | F.col("now").isNull() | F.expr("abs(now - cost) <= 1e-11 * cost OR now <= 1e-20 * size OR damp > 1e12")
        both = both.select(*keys, *[F.when(better, F.col(p)).otherwise(F.col(f"best{i}")).alias(f"best{i}") for i, p in enumerate(params)],
                           *[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in sums], F.when(better, F.col("now")).otherwise(F.col("cost")).alias("cost"),
                           F.when(better, F.col("damp") / 3).otherwise(F.col("damp") * 4).alias("damp"), done.alias("done"))
        moved = [F.coalesce(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(f"best{i}") + F.expr(m))), F.col(f"best{i}")).alias(f"p{i}") for i, (m, lo, hi) in enumerate(zip(_moves(k), model.low, model.high))]
        both = both.withColumns({f"f{i}": F.expr(f).cast("double") for i, f in enumerate(_free(model, "best"))})
        state = stored(spark, both.select("*", *moved).select(state.columns), "fit")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(*keys, *[F.col(f"best{i}").alias(p) for i, p in enumerate(params)])


def least_squares_sql(model: Model, points: str, start: str, keys: list[str], rounds: int = 60) -> str:
    """Recursive common table expression `fit` (keys, p0, p1, ...) that does the same over lists: `points` names a table of keys, x, y, w,
    `start` one of keys, p0, p1, ..."""
    k = len(model.slopes)
    tried = lambda e: re.sub(r"\bx\b", "xs[i]", re.sub(r"\bp(\d)\b", r"t\1", e))
    over = lambda e: f"list_sum(list_transform(range(1, len(xs) + 1), lambda i: {e}))"
    key, off, slopes = ", ".join(keys), f"(ys[i] - {tried(model.value)})", [f"({tried(s)})" for s in model.slopes]
    names = [f"n{i}{j}" for i, j in _pairs(k)] + [f"g{i}" for i in range(k)]
    new = [over(f"ws[i] * {slopes[i_]} * {slopes[j_]}") for i_, j_ in _pairs(k)] + [over(f"ws[i] * {s} * {off}") for s in slopes]
    ps = [f"p{i}" for i in range(k)]
    moved = ", ".join(f"coalesce(greatest({lo!r}::DOUBLE, least({hi!r}::DOUBLE, p{i} + {m})), p{i}) AS t{i}" for i, (m, lo, hi) in enumerate(zip(_moves(k), model.low, model.high)))
    return f"""lists AS (SELECT {key}, list(x) AS xs, list(y) AS ys, list(w) AS ws FROM {points} GROUP BY {key}),
rounds AS (SELECT {key}, xs, ys, ws, 0 AS turn, {', '.join(ps)}, {', '.join(f'{p}::DOUBLE AS t{i}' for i, p in enumerate(ps))}, {', '.join(f'0.0::DOUBLE AS {n}' for n in names)}, {FAR}::DOUBLE AS cost, 1e-3::DOUBLE AS damp
  FROM lists JOIN (SELECT {key}, {', '.join(f'{p}::DOUBLE AS {p}' for p in ps)} FROM {start}) USING ({key})
UNION ALL SELECT {key}, xs, ys, ws, turn, {', '.join(ps)}, {moved}, {', '.join(names)}, cost, damp FROM (SELECT *, {', '.join(f"{f} AS f{i}" for i, f in enumerate(_free(model, "p")))} FROM (
  SELECT {key}, xs, ys, ws, turn + 1 AS turn, {', '.join(f'CASE WHEN now < cost THEN t{i} ELSE p{i} END AS p{i}' for i in range(k))},
    {', '.join(f'CASE WHEN now < cost THEN new_{n} ELSE {n} END AS {n}' for n in names)}, least(cost, now) AS cost, CASE WHEN now < cost THEN damp / 3 ELSE damp * 4 END AS damp
  FROM (SELECT *, {over(f'ws[i] * {off} * {off}')} AS now, {', '.join(f'{e} AS new_{n}' for e, n in zip(new, names))} FROM rounds WHERE turn < {rounds} AND damp < 1e12)))),
fit AS (SELECT {key}, {', '.join(f'arg_max({p}, turn) AS {p}' for p in ps)} FROM rounds GROUP BY {key})"""


def _finite(name: str) -> Column:
    return F.coalesce(F.abs(F.col(name).cast("double")) < float("inf"), F.lit(False))  # NaN is above all


def fit_lateral(bins: DataFrame, keys: list[str], x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """efficiency, p50 and width per group of keys; the curve falls (width above 0) or rises with x as x and y are correlated.
    Points that aren't finite take no part; groups of under three usable points give the defaults 0, 0, 1."""
    spark, names = bins.sparkSession, [*keys, x, y, *([weight] if weight else [])]
    usable = stored(spark, bins.where(reduce(lambda a, b: a & b, [_finite(c) for c in names[len(keys):]])).select(*names), "points")
    tops = usable.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(y).alias("_top"), ((F.max(x) - F.min(x)) / 8.0).alias("_span"), F.covar_samp(x, y).alias("_slope"))
    tops = stored(spark, tops, "tops")
    tied = reduce(lambda a, b: a & b, [F.col(f"u.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys], F.lit(True))
    half = usable.alias("u").join(tops.alias("t"), tied).groupBy(*[F.col(f"t.{c}").alias(c) for c in keys], "_n", "_top", "_span", "_slope")
    half = half.agg(F.min_by(F.col(f"u.{x}"), F.struct(F.abs(F.col(f"u.{y}") - F.col("_top") / 2), F.col(f"u.{x}"))).cast("double").alias("p1"))
    start = stored(spark, half.select(*keys, "_n", "_slope", F.least(F.lit(1.0), F.col("_top")).alias("p0"), "p1", F.greatest(F.lit(1e-3), F.col("_span")).alias("p2")), "start")
    enough, down = F.col("_n") >= 3, F.coalesce(F.col("_slope") <= 0, F.lit(True))
    out = start.where(~enough).select(*keys, F.lit(0.0).alias("p0"), F.lit(0.0).alias("p1"), F.lit(1.0).alias("p2"))
    for model, sign, which in ((FALLING, 1.0, enough & down), (RISING, -1.0, enough & ~down)):
        own = start.where(which).withColumn("p2", sign * F.col("p2"))
        if not own.isEmpty():
            out = out.unionByName(least_squares(usable, keys, model, own, x, y, weight))
    return out.select(*keys, F.col("p0").alias("efficiency"), F.col("p1").alias("p50"), F.col("p2").alias("width"))


def fit_exponential(rates: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """a and b of a exp(-b x) per group, from the line through the logarithms of what is above 0; a group of one point is flat."""
    usable = stored(rates.sparkSession, rates.where(_finite(x) & _finite(y)).select(*keys, x, y), "points")
    log = F.when(F.col(y) > 0, F.log(F.when(F.col(y) > 0, F.col(y))))
    start = usable.groupBy(*keys).agg(F.regr_slope(log, F.col(x)).alias("_s"), F.regr_intercept(log, F.col(x)).alias("_i"), F.avg(y).alias("_m"))
    start = start.select(*keys, F.coalesce(F.exp("_i"), F.col("_m")).alias("p0"), F.coalesce(-F.col("_s"), F.lit(0.0)).alias("p1"))
    return least_squares(usable, keys, EXPONENTIAL, start, x, y).select(*keys, F.col("p0").alias("a"), F.col("p1").alias("b"))


def surplus(rate: Column, a: Column, b: Column) -> Column:
    """Scale at which the fitted rate a exp(-b x) has the given value, downwards from 0."""
    return F.log(rate / a) / b


def binned(cells: DataFrame, keys: list[str], distance: str, hit: str, miss: str, last: int = 5) -> DataFrame:
    """keys, x, y, w for weighted fits: efficiency at the middle of 100 m bins, by the number of samples; each
    group's last bins are left out."""
    far = F.max(distance).over(Window.partitionBy(*keys))
    n = F.col(hit) + F.col(miss)
    rows = cells.withColumn("_far", far).where((F.col(distance) <= F.col("_far") - 100 * last) & (n > 0))
    return rows.select(*keys, (F.col(distance) - 50.0).alias("x"), (F.col(hit) / n).alias("y"), n.cast("double").alias("w"))


def line(y: str, x: str) -> list[Column]:
    """Slope and intercept of a straight line, and their variances and covariance from the residuals."""
    n, sxx, mean = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_avgx(y, x)
    s2 = (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / (n - 2)
    parts = [F.regr_slope(y, x), F.regr_intercept(y, x), s2 / sxx, s2 * (1 / n + mean * mean / sxx), -s2 * mean / sxx]
    return [c.alias(a) for c, a in zip(parts, ("slope", "intercept", "var_slope", "var_intercept", "cov"))]


def fit_peak(histogram: DataFrame, keys: list[str], side_bands: tuple[tuple[int, int], ...], peak: tuple[int, int]) -> DataFrame:
    """Gaussian on the bins of `peak` over a log-linear background fitted on the side bands; columns bin and n.  Without two bins
    of a side band above 0 there is no background; groups of under three bins in the peak give null."""
    spark, inside = histogram.sparkSession, (F.col("bin") >= peak[0]) & (F.col("bin") < peak[1])
    side = reduce(lambda a, b: a | b, [(F.col("bin") >= lo) & (F.col("bin") < hi) for lo, hi in side_bands])
    log = F.when(side & (F.col("n") > 0), F.log(F.when(F.col("n") > 0, F.col("n"))))
    kept = stored(spark, histogram.where(_finite("bin") & _finite("n")).select(*keys, "bin", "n"), "histogram")
    lines = kept.groupBy(*keys).agg(F.regr_slope(log, F.col("bin")).alias("_s"), F.regr_intercept(log, F.col("bin")).alias("_i"))
    tied = reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"l.{c}")) for c in keys], F.lit(True))
    rest = F.col("n") - F.coalesce(F.exp(F.col("_i") + F.col("_s") * F.col("bin")), F.lit(0.0))
    points = kept.alias("h").join(lines.alias("l"), tied).select(*[F.col(f"h.{c}").alias(c) for c in keys], F.col("bin").cast("double").alias("x"), F.when(inside, rest).alias("y"))
    points = stored(spark, points, "points")
    start = points.groupBy(*keys).agg(F.count("y").alias("_n"), F.greatest(F.max("y"), F.lit(1.0)).alias("p0"), F.min_by("x", F.when(F.col("y").isNotNull(), F.struct(-F.col("y"), "x"))).alias("p1"),
                                      ((F.max(F.when(F.col("y").isNotNull(), F.col("x"))) - F.min(F.when(F.col("y").isNotNull(), F.col("x")))) / 6).alias("p2"))
    start = stored(spark, start.withColumn("p2", F.greatest(F.lit(1.0), "p2")), "start")
    fitted = least_squares(points.where("y IS NOT NULL"), keys, GAUSS, start.where("_n >= 3"))
    few = start.where("_n < 3").select(*keys, *[F.lit(None).cast("double").alias(c) for c in ("p0", "p1", "p2")])
    return fitted.unionByName(few).select(*keys, F.col("p1").alias("mean"), F.col("p2").alias("sigma"))


def next_unit(rate_hz: float, unit: float) -> tuple[float, bool]:
    """One step of the calibration controller: the new unit, and whether it has converged."""
    for bound, change in ((60, -10.0), (68, -1.0), (72, 0.0), (80, 1.0)):
        if rate_hz <= bound:
            return unit + change, change == 0
    return unit + 10.0, False
