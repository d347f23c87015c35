"""Rules against plain versions on small traces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import arrays as A
from tracelake.functions import showers
from tracelake.operators import baseline, fits, metrics, ordering, particles, triggers, windows
from tracelake.sources import extracts, sinks


def plain_estimate(x):
    x = list(x)
    while x:
        lo, hi = int(min(x)), int(max(x))
        mode = max(range(lo, hi), key=lambda v: (x.count(v), -v)) if hi > lo else x[0]
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        kept = [v for v in x if abs(v - mode) <= 2 * spread]
        if len(kept) == len(x) or not kept:
            return mean, spread
        x = kept


def test_baseline_estimate():
    r = random.Random(2)
    for _ in range(60):
        x = [float(round(r.gauss(20, 3))) for _ in range(r.randint(1, 200))] + [float(r.randint(0, 900)) for _ in range(r.randint(0, 9))]
        assert np.allclose(baseline.estimate(np.array(x)), plain_estimate(x))
    assert np.allclose(baseline.estimate(np.array([1.5, 2.0, 2.0, 3.25, 9.75])), plain_estimate([1.5, 2.0, 2.0, 3.25, 9.75]))


def test_baseline_statuses():
    r = np.random.default_rng(4)
    noise = lambda b0, b1: np.append(np.round(r.normal(b0, 2, 1000)), np.round(r.normal(b1, 2, 1000)))
    assert baseline.corrected(noise(20, 60))[0] == "rejected"
    status, x = baseline.corrected(noise(20, 21))
    assert status == "constant" and abs(x.mean()) < 1
    fall = noise(20, 10)
    assert baseline.corrected(fall)[0] == "step" and abs(baseline.corrected(fall)[1][-300:].mean()) < 1
    fall[900:920] += 800
    status, x = baseline.corrected(fall)
    assert status == "undershoot" and (x == fall).all()
    status, x = baseline.corrected(fall, mend=True)
    assert status == "mended" and abs(x[:300].mean()) < 1 and abs(x[-300:].mean()) < 2


def test_undershoot_equals_a_plain_loop():
    r = np.random.default_rng(5)
    x = np.round(r.normal(20, 2, 400))
    x[100:110] += 500
    x[110:] -= 6
    b0, b1, edge, tau = 20.0, 14.0, 40, 300.0
    base = [b0 + (b1 - b0) * i / 320 for i in range(320)] + [b1] * 40
    for _ in range(3):
        q, held = sum(x[:edge] - b0), []
        for v, b in zip(x[edge:], base):
            q = q * math.exp(-1 / tau) + (v - b)
            held.append(q)
        base = [b0 + (b1 - b0) * h / held[-20] for h in held]
    assert np.allclose(baseline.undershoot(x, b0, b1, edge, tau=tau), np.append(x[:edge] - b0, x[edge:] - base))


def plain_flanks(x, low=3, high=31):
    runs, i = [], 1
    while i < len(x):
        j = i
        while j < len(x) and x[j] > x[j - 1]:
            j += 1
        if j - i >= 2:
            runs.append((i - 1, j - 1))
        i = max(j, i + 1)
    until = n = 0
    for a, b in runs:
        a = max(a, until)
        if b - a >= 1:
            rise = x[b] - x[a]
            n += low < rise < high
            until = b + max(0, int(math.log2(rise) - 2 + 1e-9) if rise > 4 else 0)
    return n


def test_flank_count(spark):
    r = random.Random(6)
    rows = [([float(r.randint(0, 40) + (r.randint(0, 60) if r.random() < 0.2 else 0)) for _ in range(n)],) for n in [0, 1, 2, 3] + [120] * 60]
    rows += [([float(v) for v in range(0, 120, 7)],), ([0.0, 20.0, 40.0, 39.0, 41.0, 45.0, 60.0, 2.0, 3.0, 9.0],)]
    df = spark.createDataFrame([(i, x) for i, (x,) in enumerate(rows)], "i int, x array<double>")
    got = {a.i: a.n for a in df.select("i", triggers.flank_count(F.col("x")).alias("n")).collect()}
    assert got == {i: plain_flanks(x) for i, (x,) in enumerate(rows)}


def test_mops_by_name(spark):
    x = [0.0] + [float(v) for _ in range(6) for v in (5, 10, 15, 0, 0, 0, 0)]
    df = spark.createDataFrame([(x, x, [0.0] * len(x)), (x, [0.0] * len(x), [0.0] * len(x))], "p1 array<double>, p2 array<double>, p3 array<double>")
    p = [F.col(c) for c in triggers.PMTS]
    own = {"mops": lambda *p: triggers.multiple_flanks(*p, q_peak=1.0)}
    assert [r.f for r in df.select(triggers.any_of(["mops"], *p, **own).alias("f")).collect()] == [True, False]


def test_nan_integral_raises(spark):
    df = spark.range(1).select(windows.label(F.lit(True), F.lit(3), F.lit(math.nan), 0, 0))
    with pytest.raises(Exception, match="integral"):
        df.collect()


def test_large_particle_library_is_refused(spark, monkeypatch):
    lib = spark.createDataFrame([(0, [1.0, 2.0])], "i int, s array<double>")
    assert particles.library(lib, "i", "s").first().lib == [[1.0, 2.0]]
    monkeypatch.setattr(particles, "MOST_SAMPLES", 1)
    with pytest.raises(ValueError):
        particles.library(lib, "i", "s")


def test_numbered_equals_a_sort(spark):
    r = random.Random(7)
    rows = [(r.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(5)
    got = {a.i: a.n for a in ordering.numbered(df, "v", "n", buckets=7, tie="i").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows))}
    assert ordering.numbered(df.where("v < 0"), "v", "n").count() == 0


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(1, 5.0)] * 9 + [(2, 1.0)], "e int, v double")
    got = sorted(map(tuple, metrics.quantiles(df, ["e"], "v", bins=2).collect()))
    assert got == [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_surplus_inverts_the_rate():
    assert abs(500 * math.exp(-0.1 * math.log(23 / 500) / -0.1) - 23) < 1e-9
    assert fits.MODELS["exponential"](np.array([2.0]), np.array([3.0, 0.5]))[0] == 3 * math.exp(-1)


def test_cascade_keeps_its_multiplicity():
    assert showers.cascade(1e11) == (10.0, 2 / 3 * (1e11 / 15 / 2 // 85e6)) and showers.cascade(1e9) == (1.0, 0.0)


def test_reader_modes_and_order():
    assert extracts.mode(1) == "hits_and_misses" and extracts.name_order(["b2", "a2"]) == ["a2", "b2"]
    with pytest.raises(ValueError):
        extracts.mode(4)


def test_base_names(spark):
    df = spark.createDataFrame([("/a/b.csv",), ("c.d.txt",), ("/x/plain",), ("file:/q/a_1.csv",)], "path string")
    assert [r[0] for r in df.select(extracts.base_name(F.col("path"))).collect()] == ["b", "c.d", "plain", "a_1"]
    some = spark.range(400).withColumn("name", F.concat(F.lit("f"), "id"))
    assert 10 < extracts.tenth(some, "name").count() < 90


def test_monitoring_columns(spark):
    path = sinks.scratch(spark, "monitoring")
    spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "station int, peak array<double>").write.parquet(path)
    assert extracts.monitoring(spark, path).first().peak_2 == 2.0


def test_hashed_draws_dont_depend_on_partitions(spark):
    df = spark.range(200).select("id", A.hashed_uniform("id", seed=3).alias("u"), A.geometric(A.hashed_uniform("id", seed=4), 0.3).alias("g"))
    again = spark.range(200).repartition(7).select("id", A.hashed_uniform("id", seed=3).alias("u"), A.geometric(A.hashed_uniform("id", seed=4), 0.3).alias("g"))
    assert sorted(df.collect()) == sorted(again.collect()) and all(0 <= r.u < 1 for r in df.collect())
