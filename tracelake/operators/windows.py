"""Sliding windows over bins and sequential rules on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A


def starts(n: Column, first: Column | int = 0, stop: Column | None = None, width: int = C.WINDOW, step: int = C.STEP) -> Column:
    """Window starts: up to the signal's end, if one is given, and no window past the trace."""
    first = F.lit(first) if isinstance(first, int) else first
    last = n - width if stop is None else F.least(stop, n - width)
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(traces: DataFrame, key: str, width: int = C.WINDOW, step: int = C.STEP, first: Column | int = 0) -> DataFrame:
    """key, start, and p1 to p3 of each window; nothing but the arrays is carried along."""
    at = F.explode(starts(F.size("p1"), first, None, width, step)).alias("start")
    cut = traces.select(key, at, "p1", "p2", "p3")
    return cut.select(key, "start", *[F.slice(p, F.col("start") + 1, width).alias(p) for p in ("p1", "p2", "p3")])


def signal_range(bins: Column, signal: Column, decimated: bool = False) -> tuple[Column, Column, Column]:
    """First and last bin of a signal that is placed at the latch bin, and the trace's length; after decimation
    all are a third, cut to whole bins."""
    start = F.floor(C.LATCH_SHARE * bins).cast("int")
    third = 3 if decimated else 1
    return tuple(F.floor(x / third).cast("int") for x in (start, start + signal, bins))


def first_window(bins: Column, u: Column, width: int = C.WINDOW, decimated: bool = False) -> Column:
    """Start of the first window of a trace with a signal: 1 to 9 bins (by u in [0, 1)) after the last one that
    ends at the latch bin."""
    at = F.greatest(F.floor(C.LATCH_SHARE * bins) - width + 1 + F.floor(9 * u), F.lit(0))
    return F.floor(at / (3 if decimated else 1)).cast("int")


def wide_integral(q1: Column, q2: Column, q3: Column, start: Column, width: int) -> Column:
    """Integral of a window of a decimated trace, from the charge at full bandwidth."""
    return integral(*[F.slice(q, 3 * start + 1, 3 * width) for q in (q1, q2, q3)])


def reduced(trace: Column, at: Column, how: Callable[[Column], Column], before: int = C.CUT_BEFORE, after: int = C.DEAD_BINS) -> Column:
    """What `how` (the largest bin, their sum) makes of the cut around a hit."""
    return how(cut_around(trace, at, before, after))


def integral(p1: Column, p2: Column, p3: Column) -> Column:
    """Mean over PMTs of the charge in the window."""
    return (A.total(p1) + A.total(p2) + A.total(p3)) / 3


def first_match(labelled: DataFrame, key: str) -> DataFrame:
    """Outcomes per trace from rows (key, start, label, fired, integral): the first fired signal window
    is a TP and ends the trace; fired windows of other labels before it are FP; a trace without a TP
    adds an FN with its largest integral of windows that didn't fire."""
    tp = F.min(F.when((F.col("label") == "SIG") & F.col("fired"), F.col("start")))
    per = labelled.groupBy(key).agg(
        tp.alias("tp"), F.max(F.when(~F.col("fired"), F.col("integral"))).alias("integral"),
        F.sort_array(F.collect_list(F.when((F.col("label") != "SIG") & F.col("fired"), F.col("start")))).alias("fp"),
    )
    false = per.select(key, F.explode(F.expr("filter(fp, x -> tp IS NULL OR x < tp)")).alias("start"), F.lit("FP").alias("outcome"), F.lit(None).cast("double").alias("integral"))
    true = per.where("tp IS NOT NULL").select(key, F.col("tp").alias("start"), F.lit("TP").alias("outcome"), F.lit(None).cast("double").alias("integral"))
    missed = per.where("tp IS NULL").select(key, F.lit(None).cast(labelled.schema["start"].dataType).alias("start"), F.lit("FN").alias("outcome"), "integral")
    return false.unionByName(true).unionByName(missed)


def label(has_signal: Column, particles: Column, integral_: Column, ignore_particles: float, ignore_charge: float) -> Column:
    """BKG without signal; PRT with too few particles (tested first); INT with too little charge; else SIG.  A NaN
    integral raises."""
    return (
        F.when(F.isnan(integral_.cast("double")), F.raise_error(F.lit("an integral isn't a number")).cast("string"))
        .when(~has_signal, "BKG")
        .when(particles <= ignore_particles, "PRT")
        .when(integral_ <= ignore_charge, "INT")
        .otherwise("SIG")
    )


def dead_time(hits: Column, dead: int = C.DEAD_BINS) -> Column:
    """Of ascending hit positions those that are accepted: after one, `dead` positions are skipped."""
    t = "bigint"
    start = F.struct(F.lit(None).cast(t).alias("last"), F.array().cast(f"array<{t}>").alias("out"))
    return F.aggregate(
        F.transform(hits, lambda x: x.cast(t)),
        start,
        lambda a, x: F.when(
            a["last"].isNull() | (x > a["last"] + dead),
            F.struct(x.alias("last"), F.concat(a["out"], F.array(x)).alias("out")),
        ).otherwise(a),
        lambda a: a["out"],
    )


def cut_around(trace: Column, at: Column, before: int = C.CUT_BEFORE, after: int = C.DEAD_BINS) -> Column:
    """Bins from at - before up to at + after, inside the trace."""
    lo = F.greatest(at - before, F.lit(0))
    return F.slice(trace, (lo + 1).cast("int"), (F.least(at + after, F.size(trace)) - lo).cast("int"))
