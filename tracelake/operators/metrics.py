"""Rates, efficiencies and other aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.operators.ordering import quantile_bucket, running


def rate(n: Column, duration: Column) -> list[Column]:
    """Rate and its counting error."""
    d = F.nullif(duration, F.lit(0.0))
    return [(n / d).alias("rate"), (F.sqrt(n) / d).alias("rate_err")]


def duration(n_traces: Column, bins: int = C.TRACE_BINS, seconds: float = C.BIN_SECONDS) -> Column:
    return n_traces * (bins * seconds)


def efficiency(hit: Column, miss: Column) -> list[Column]:
    """x / (x + o) and |x^1.5 - o^1.5| / n^2."""
    n = F.nullif((hit + miss).cast("double"), F.lit(0.0))
    return [(hit / n).alias("eff"), (F.abs(F.pow(hit, 1.5) - F.pow(miss, 1.5)) / (n * n)).alias("eff_err")]


def efficiency_error_older(hit: Column, miss: Column) -> Column:
    n = F.nullif((hit + miss).cast("double"), F.lit(0.0))
    return F.sqrt(hit * miss * miss + miss * hit * hit + 2 * hit * miss) / (n * n)


#: The flags of a histogram of stations, in the order of its columns.
FLAGS = ("th1", "th2", "tot", "totd", "mops")


def flag_counts(hit: Column, flags: dict[str, Column]) -> list[Column]:
    """Hits, misses, and for each of :data:`FLAGS` the hits that have it."""
    if missing := [f for f in FLAGS if f not in flags]:
        raise KeyError(f"no flags {missing}")
    return [F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), *[F.count_if(hit & flags[f]).alias(f) for f in FLAGS]]


def sparse_grid(grid: DataFrame, cell: list[str], hit: str = "hits", miss: str = "misses") -> DataFrame:
    """Rows of cells that have both hits and misses somewhere."""
    by = Window.partitionBy(*cell)
    return grid.withColumn("_h", F.sum(hit).over(by)).withColumn("_m", F.sum(miss).over(by)).where("_h > 0 AND _m > 0").drop("_h", "_m")


def bins_for(count: Column, first: Column) -> Column:
    """How many edges so many values are cut by: values per bin start at `first` and go down by 10 until there are
    more than 7 bins, or the next step would come to 50 or fewer."""
    size = lambda k: F.greatest(first - 10 * k, F.lit(1))
    enough = lambda k: (F.floor(count / size(k)) - 1 > 7) | (size(k + 1) <= 50)
    k = F.element_at(F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(first / 10).cast("int"), F.lit(0))), enough), 1)
    return F.floor(count / size(k)).cast("int")


def quantiles(values: DataFrame, keys: list[str], value: str, edges: Column | None = None, bins: int | None = None, least: int = 1) -> DataFrame:
    """keys, i, edge: equal-count edges of the values of each key, with plotting positions of 0.4.

    There are bins + 1 edges, or as many as `edges` says (a column on `n`, the key's values).  Values are
    counted first; the places of the wanted ones in the order follow from running sums by buckets, so neither a key
    nor its values is held by a task.  The wanted places (some per key) are broadcast, so they are to be few: keys
    are cells of a grid."""
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    groups = counted.groupBy(*keys).agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    groups = groups.withColumn("m", F.lit(bins + 1) if edges is None else edges).where("m > 1")
    p = F.col("i") / (F.col("m") - 1)
    want = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1))).withColumn("a", F.col("n") * p + 0.4 + p * 0.2)
    want = want.withColumn("k", F.greatest(F.lit(1.0), F.least(F.floor("a").cast("double"), F.col("n") - 1)))
    want = want.withColumn("g", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") - F.col("k"))))
    sides = F.array(F.struct(F.col("k").alias("at"), (1 - F.col("g")).alias("w")), F.struct(F.least(F.col("k") + 1, F.col("n")).alias("at"), F.col("g").alias("w")))
    want = want.select(*keys, F.inline(F.transform(sides, lambda s: F.struct(F.col("i").alias("i"), s["at"].alias("at"), s["w"].alias("w")))))
    wanted = want.groupBy(*keys).agg(F.collect_list(F.struct("i", "at", "w")).alias("want"))
    placed = running(counted.withColumn("_bucket", quantile_bucket(counted, value)), keys, "_bucket", [value], "c", "_before")
    met = placed.join(F.broadcast(wanted), keys)
    met = met.select(*keys, value, F.inline(F.filter("want", lambda x: (x["at"] > F.col("_before")) & (x["at"] <= F.col("_before") + F.col("c")))))
    return met.groupBy(*keys, "i").agg(F.sum(F.col(value) * F.col("w")).alias("edge"))


def uniform_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin from 0; the last is closed on its right; null outside."""
    b = F.floor((x - low) * bins / (high - low)).cast("int")
    return F.when(x == high, bins - 1).when((x >= low) & (x < high), b)


#: Showers in the flux histogram, and the inverse weights of a perfect trigger.
SHOWERS, PERFECT = 50072, 3.329e11


def flux_weight(energy: Column, least: float, most: float) -> Column:
    """Weight of a true positive by the flux, which falls with the third power of the energy."""
    return 100 * F.lit(most) * F.pow(energy / least, F.lit(-3.0))


def flux_accuracy(inverse: Column, n: Column) -> Column:
    """Sum of the inverse weights of n positives relative to a perfect trigger's."""
    return inverse * SHOWERS / (n * n) / PERFECT


def near_angle(spd: Column, angle: Column, centre: float, tolerance: float, spacing: float = 1500.0) -> Column:
    """Within the array's spacing, and from a tolerance below the angle up to one above it."""
    return (spd <= spacing) & (angle >= centre - tolerance) & (angle < centre + tolerance)


def best(df: DataFrame, model: str, score: Column) -> DataFrame:
    """The model with the least score, the smaller name of equals."""
    return df.agg(F.min_by(model, F.struct(score, F.col(model))).alias(model))
