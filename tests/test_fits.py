"""Fits by sums of products against a plain Gauss-Newton with numerical slopes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import fits


def lateral(x, p):
    return p[0] * (1 - 1 / (1 + np.exp(np.clip(-(x - p[1]) / p[2], -60, 60))))


def exponential(x, p):
    return p[0] * np.exp(-p[1] * x)


def gauss(x, p):
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)


def plain(model, x, y, p, w):
    """Damped Gauss-Newton, by numpy and differences."""
    p, damp, cost = np.array(p, float), 1e-3, np.inf
    for _ in range(300):
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(model(x, p + d) - model(x, p - d)) / (2 * s) for s, d in zip(step, np.diag(step))], 1)
        off = y - model(x, p)
        cost = (w * off**2).sum()
        normal, pull = jac.T @ (w[:, None] * jac), jac.T @ (w * off)
        new = p + np.linalg.solve(normal + damp * np.diag(np.diag(normal)), pull)
        if (w * (y - model(x, new)) ** 2).sum() < cost:
            p, damp = new, damp / 3
        else:
            damp *= 4
    return p


def noisy(model, p, x, seed, spread):
    r = np.random.default_rng(seed)
    return model(x, p) + r.normal(0, spread, len(x)), r.uniform(0.5, 2.0, len(x))


@pytest.mark.parametrize("width", [8.0, -8.0])
def test_lateral_equals_a_plain_fit(spark, width):
    x = np.arange(0, 100, 4.0)
    rows, want = [], {}
    for key, (top, p50) in {1: (0.8, 40.0), 2: (0.5, 55.0), None: (0.9, 30.0)}.items():
        y, w = noisy(lateral, (top, p50, width), x, int(p50), 0.02)
        rows += [(key, float(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
        want[key] = plain(lateral, x, y, (top, p50, width), w)
    rows += [(7, 1.0, 0.5, 1.0), (7, 2.0, 0.4, 1.0), (1, math.inf, 0.5, 1.0), (1, 3.0, math.nan, 1.0), (2, 3.0, 0.1, None)]
    got = {r.k: (r.efficiency, r.p50, r.width) for r in fits.fit_lateral(spark.createDataFrame(rows, "k int, x double, y double, w double"), ["k"], weight="w").collect()}
    assert got.pop(7) == (0.0, 0.0, 1.0) and set(got) == set(want)
    for key in want:
        assert np.allclose(got[key], want[key], rtol=1e-4)


def test_bounds_hold(spark):
    """A curve above 1 is fitted at the bound."""
    x = np.arange(0, 100, 4.0)
    rows = [(float(a), float(1.2 * lateral(a, (1.0, 50.0, 9.0)))) for a in x]
    row = fits.fit_lateral(spark.createDataFrame(rows, "x double, y double").withColumn("k", F.lit(1)), ["k"]).first()
    assert row.efficiency == 1.0 and row.width > 0


def test_exponential_equals_a_plain_fit(spark):
    x = np.arange(0, 60, 3.0)
    y, _ = noisy(exponential, (500.0, 0.07), x, 3, 4.0)
    rows = [("a", "b", float(u), float(v)) for u, v in zip(x, y)] + [("a", None, 5.0, 3.0), ("a", "z", 1.0, None)]
    got = {r.j: r for r in fits.fit_exponential(spark.createDataFrame(rows, "i string, j string, x double, y double"), ["i", "j"]).collect()}
    assert set(got) == {"b", None} and (got[None].a, got[None].b) == (3.0, 0.0)
    assert np.allclose((got["b"].a, got["b"].b), plain(exponential, x, y, (500.0, 0.07), np.ones(len(x))), rtol=1e-5)


def test_peak_equals_a_plain_fit(spark):
    x = np.arange(0, 120)
    n = np.round(800 * np.exp(-0.5 * ((x - 50) / 9.0) ** 2) + 100 * np.exp(-0.02 * x))
    rows = [(1, int(b), int(c)) for b, c in zip(x, n)] + [(2, 30, 5), (2, 31, 6)]
    got = {r.k: r for r in fits.fit_peak(spark.createDataFrame(rows, "k int, bin int, n long"), ["k"], ((0, 10), (100, 120)), (25, 80)).collect()}
    side = (x < 10) | (x >= 100)
    line, inside = np.polyfit(x[side], np.log(n[side]), 1), (x >= 25) & (x < 80)
    want = plain(gauss, x[inside].astype(float), (n - np.exp(np.polyval(line, x)))[inside], (800.0, 50.0, 9.0), np.ones(inside.sum()))
    assert np.allclose((got[1].mean, got[1].sigma), want[1:], rtol=1e-5) and (got[2].mean, got[2].sigma) == (None, None)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k int, x double, y double")
    assert fits.fit_lateral(empty, ["k"]).count() == 0 == fits.fit_exponential(empty, ["k"]).count()


def test_one_group_with_nearly_all_points(spark):
    t = spark.range(0, 40_000, numPartitions=16).select(F.when(F.col("id") % 1000 == 0, 2).otherwise(1).alias("k"), (F.col("id") % 97).cast("double").alias("x"))
    t = t.withColumn("y", 30 * F.exp(-0.05 * F.col("x")) + F.pmod(F.col("x") * 7, F.lit(3)))
    got = {r.k: r for r in fits.fit_exponential(t, ["k"]).collect()}
    x = np.arange(97.0)
    want = plain(exponential, x, 30 * np.exp(-0.05 * x) + x * 7 % 3, (30.0, 0.05), np.ones(97))
    assert np.allclose((got[1].a, got[1].b), want, rtol=1e-2) and got[2].a > 0
