"""Whole analyses put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A
from tracelake.operators import metrics, triggers, windows


def calibrated(traces: DataFrame, options: C.TraceOptions) -> DataFrame:
    """p1 to p3 in units of the peak; q1 to q3 in whole counts (before any filtering), so that their sums are exact."""
    peaks = {}
    for i in (1, 2, 3):
        p = F.col(f"p{i}")
        filtered = A.downsample(p, options.phase) if options.downsample else p
        q = C.Q_PEAK_COMPATIBILITY if options.downsample else options.q_peak
        peaks[f"p{i}"] = A.digitise(filtered, q, options.clip_low, options.clip_high)
    charges = {f"q{i}": A.charge(F.col(f"p{i}"), 1.0) for i in (1, 2, 3)}
    return traces.withColumns(charges).withColumns(peaks)


def noise_rate(noise: DataFrame, key: str, options: C.TraceOptions, fired: Column) -> DataFrame:
    """Trigger rate of noise traces: at most one count per trace; no shuffle but the last sum."""
    cal = calibrated(noise, options)
    cut = F.transform(
        windows.starts(F.size("p1"), 0, None, options.window, options.step),
        lambda s: F.struct(*[F.slice(F.col(p), s + 1, options.window).alias(p) for p in ("p1", "p2", "p3")]),
    )
    hit = cal.select(F.exists(cut, lambda w: _on(fired, w)).alias("hit"))
    out = hit.agg(F.count("*").alias("n_traces"), F.count_if("hit").alias("n"))
    seconds = metrics.duration(F.col("n_traces"))
    return out.select("n_traces", "n", seconds.alias("duration"), *metrics.rate(F.col("n"), seconds))


def _on(fired, w: Column) -> Column:
    return fired(w["p1"], w["p2"], w["p3"])


def predictions(traces: DataFrame, key: str, options: C.TraceOptions, has_signal: Column, particles: Column, fired) -> DataFrame:
    """TP, FP and FN rows of labelled traces."""
    cal = calibrated(traces, options).select(key, "p1", "p2", "p3", "q1", "q2", "q3", has_signal.alias("sig"), particles.alias("np"))
    at = F.explode(windows.starts(F.size("p1"), 0, None, options.window, options.step)).alias("start")
    w = cal.select(key, "sig", "np", at, "p1", "p2", "p3", "q1", "q2", "q3")
    for c in ("p1", "p2", "p3", "q1", "q2", "q3"):
        w = w.withColumn(c, F.slice(c, F.col("start") + 1, options.window))
    w = w.withColumn("integral", windows.integral(F.col("q1"), F.col("q2"), F.col("q3")) / options.q_charge)
    lab = windows.label(F.col("sig"), F.col("np"), F.col("integral"), options.ignore_particles, options.ignore_low_charge)
    flagged = w.select(key, "start", lab.alias("label"), fired(F.col("p1"), F.col("p2"), F.col("p3")).alias("fired"), "integral")
    return windows.first_match(flagged, key)


def any_phase(traces: DataFrame, key: str, fired) -> DataFrame:
    """Whether a trigger fires in any of the three decimation phases."""
    phases = [fired(*[A.downsample(F.col(p), k) for p in triggers.PMTS]) for k in range(3)]
    return traces.select(key, (phases[0] | phases[1] | phases[2]).alias("fired"))
