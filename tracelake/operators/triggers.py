"""Triggers: from a window of three PMTs to a decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A

PMTS = ("p1", "p2", "p3")


def threshold(p1: Column, p2: Column, p3: Column, level: float = C.TH2, strict: bool = True) -> Column:
    """Some bin with all PMTs above the level.  No PMT's maximum may be below it, which is tested first."""
    above = (lambda v: v > level) if strict else (lambda v: v >= level)
    peaks = above(F.array_max(p1)) & above(F.array_max(p2)) & above(F.array_max(p3))
    return F.coalesce(peaks & F.exists(A.pool_min(p1, p2, p3), above), F.lit(False))


def pooled_threshold(p1: Column, p2: Column, p3: Column, level: float) -> Column:
    """The older form on the maximum over PMTs."""
    return F.exists(A.pool_max(p1, p2, p3), lambda v: v >= level)


def over_threshold(p1: Column, p2: Column, p3: Column, level: float = C.TOT_LEVEL, bins: int = C.TOT_BINS, pmts: int = C.TOT_PMTS) -> Column:
    """Enough bins above the level in enough PMTs of the window given."""
    hits = [F.when(F.size(F.filter(p, lambda v: v > level)) >= bins, 1).otherwise(0) for p in (p1, p2, p3)]
    return hits[0] + hits[1] + hits[2] >= pmts


def over_threshold_deconvolved(p1: Column, p2: Column, p3: Column, **options) -> Column:
    return over_threshold(*[A.deconvolve(p) for p in (p1, p2, p3)], **options)


def online_calibration(p: Column, others: tuple[Column, Column, Column], unit: float) -> Column:
    """First bin where all PMTs reach 1.75 units and this one 2.5, from 0; null if none."""
    both = F.zip_with(A.pool_min(*others), p, lambda m, v: (m >= 1.75 * unit) & (v >= 2.5 * unit))
    at = F.array_position(both, F.lit(True))
    return F.when(at > 0, at - 1)


def bayes(p1: Column, p2: Column, p3: Column, least: float = 1.5875) -> Column:
    """Window integral, the mean over PMTs, above a constant."""
    return (A.total(p1) + A.total(p2) + A.total(p3)) / 3 > least


def long_form(traces: DataFrame, key: str = "station") -> DataFrame:
    """station, pmt, pos, v from a row per station with p1 to p3."""
    pmts = F.array(*[F.col(p) for p in PMTS])
    one = traces.select(key, F.posexplode(pmts).alias("pmt", "bins"))
    return one.select(key, "pmt", F.posexplode("bins").alias("pos", "v"))


def over_threshold_long(bins: DataFrame, key: str, width: int, level: float, least: int, pmts: int = 2) -> DataFrame:
    """Per key and window end: PMTs with enough bins above the level, and whether the trigger fires.

    The count in the window is the difference of two running counts, so it costs the same for any
    width, and one sort by (key, pmt) serves both.
    """
    by = Window.partitionBy(key, "pmt").orderBy("pos")
    run = F.sum(F.when(F.col("v") > level, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    counted = bins.withColumn("run", run)
    counted = counted.withColumn("act", F.col("run") - F.coalesce(F.lag("run", width).over(by), F.lit(0)))
    full = counted.where(F.col("pos") >= width - 1)
    return full.groupBy(key, "pos").agg(F.count_if(F.col("act") >= least).alias("pmts")).withColumn("fired", F.col("pmts") >= pmts)


def flanks(bins: DataFrame, key: list[str]) -> DataFrame:
    """Rising runs of at least two steps: key, first and last position, rise."""
    by = Window.partitionBy(*key).orderBy("pos")
    steps = bins.withColumn("step", F.col("v") - F.lag("v").over(by)).where("step > 0")
    steps = steps.withColumn("island", F.col("pos") - F.row_number().over(by))
    runs = steps.groupBy(*key, "island").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("step").alias("rise"), F.count("*").alias("n")
    )
    return runs.where("n >= 2").drop("island", "n")


def flank_count(x: Column, low: float = 3.0, high: float = 31.0) -> Column:
    """Rises between the bounds of an array's flanks (runs of at least two rising steps).

    A rise of y casts a shadow of max(0, int(log2 y - 2)) bins from its top on.  A later flank that lies in
    the shadow is left out; one that reaches out of it begins where the shadow ends.  Flanks that are left out cast
    no shadow.  One pass over the bins: what was counted, where the shadow ends, and the run that is going on.
    """
    state = lambda n, until, first: F.struct(n.cast("int").alias("n"), until.cast("int").alias("until"), first.cast("int").alias("first"))

    def closed(a: Column, last: Column) -> Column:
        start = F.greatest(a["first"], a["until"])
        rise = F.element_at(x, last + 1) - F.element_at(x, start + 1)
        shadow = F.greatest(F.floor(F.log2(rise) - 2 + 1e-9), F.lit(0))
        counted = state(a["n"] + F.when((rise > low) & (rise < high), 1).otherwise(0), last + shadow, F.lit(-1))
        whole = (a["first"] >= 0) & (last - a["first"] >= 2) & (last - start >= 1)
        return F.when(whole, counted).otherwise(state(a["n"], a["until"], F.lit(-1)))

    def step(a: Column, i: Column) -> Column:
        rising = F.element_at(x, i + 1) > F.element_at(x, i)
        return F.when(rising, state(a["n"], a["until"], F.when(a["first"] < 0, i - 1).otherwise(a["first"]))).otherwise(closed(a, i - 1))

    start = state(F.lit(0), F.lit(0), F.lit(-1))
    folded = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), start, step, lambda a: closed(a, F.size(x) - 1)["n"])
    return F.when(F.size(x) > 1, folded).otherwise(F.lit(0))


def multiple_flanks(
    p1: Column, p2: Column, p3: Column, q_peak: float = C.Q_PEAK, least_sum: float = 36.0, more_than: int = 4, pmts: int = 2
) -> Column:
    """Whether enough PMTs of the window have enough charge and more than four counted flanks."""
    hits = [F.when((A.total(x) > least_sum) & (flank_count(x) > more_than), 1).otherwise(0) for x in (A.scale(p, q_peak) for p in (p1, p2, p3))]
    return hits[0] + hits[1] + hits[2] >= pmts


def log_likelihood(p1: Column, p2: Column, p3: Column, centres: list[float], quotients: list[float]) -> Column:
    """Sum over all bins of the logarithm of the signal to background quotient in the nearest cell of the table."""
    c, q = F.array(*[F.lit(float(x)) for x in centres]), F.array(*[F.log(F.lit(float(x))) for x in quotients])
    return A.total(F.transform(F.concat(p1, p2, p3), lambda v: F.element_at(q, A.nearest_bin(v, c) + 1)))


def coincidence(stations: DataFrame, event: str, distance: str, flag: str, tie: str, need: int = 3) -> DataFrame:
    """Per event, whether its `need` nearest stations all fired; fewer stations are a miss."""
    by = Window.partitionBy(event).orderBy(distance, tie)
    near = stations.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= need)
    out = near.groupBy(event).agg(F.count("*").alias("n"), F.bool_and(flag).alias("all"))
    return out.select(event, ((F.col("n") == need) & F.col("all")).alias("hit"))


#: Triggers by name; an unknown name raises.
REGISTRY: dict[str, Callable[..., Column]] = {
    "th1": lambda *p: threshold(*p, level=C.TH1),
    "th2": lambda *p: threshold(*p, level=C.TH2),
    "tot": over_threshold,
    "totd": over_threshold_deconvolved,
    "mops": multiple_flanks,
    "bayes": bayes,
    "always": lambda *p: F.lit(True),
}


def any_of(names: list[str], p1: Column, p2: Column, p3: Column, **overrides: Callable[..., Column]) -> Column:
    """Whether one of the named triggers fires; thresholds come first, as they are cheapest."""
    known = REGISTRY | overrides
    if missing := [n for n in names if n not in known]:
        raise KeyError(f"unknown triggers: {missing}")
    out = F.lit(False)
    for n in sorted(names, key=lambda n: not n.startswith("th")):
        out = out | known[n](p1, p2, p3)
    return out
