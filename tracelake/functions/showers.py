"""Geometry and densities of air showers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def segment_distance(x: Column, y: Column, core_x: Column, core_y: Column, zenith: Column, azimuth: Column, length: float = 1000.0) -> Column:
    """Distance of a ground point from the axis taken as a segment from the core to a point `length` above it in
    the axis' own scale: beyond an end the distance to that end counts.  Angles in radians."""
    sx, sy, sz = F.sin(zenith) * F.cos(azimuth), F.sin(zenith) * F.sin(azimuth), F.cos(zenith)
    dx, dy = x - core_x, y - core_y
    along = dx * sx + dy * sy
    beyond = F.greatest(-along, along - length, F.lit(0.0))
    cx, cy, cz = dy * sz, -dx * sz, dx * sy - dy * sx
    return F.sqrt(beyond * beyond + cx * cx + cy * cy + cz * cz)


# Coefficients of the lateral density's slopes.
BETA = (-3.72, 0.0967, 1.74, -0.242, -0.274, 0.0349)
GAMMA = (-1.87, -0.183, 0.490, -0.0650, -2.272, 4.64, 18.01, -1.95)
GAMMA_BEND = (19.6, -2.10, 0.483, 0.005)


def beta(size: Column, zenith: Column) -> Column:
    """Slope of :func:`tracelake.functions.arrays.nkg` for a signal and a zenith angle."""
    s, sec = F.log10(size), 1 / F.cos(zenith)
    return (BETA[0] + BETA[1] * s) + (BETA[2] + BETA[3] * s) * sec + (BETA[4] + BETA[5] * s) * sec * sec


def gamma(size: Column, zenith: Column) -> Column:
    """Second slope of the same."""
    s, cos = F.log10(size), F.cos(zenith)
    bend = F.exp((GAMMA_BEND[0] + GAMMA_BEND[1] * s) * (cos * cos - (GAMMA_BEND[2] + GAMMA_BEND[3] * s)))
    steep = F.exp(GAMMA[6] * (s - GAMMA[7])) + 1
    return GAMMA[0] + GAMMA[1] * s + (GAMMA[2] + GAMMA[3] * s) / (bend + 1) + GAMMA[4] * F.pow(cos, F.lit(GAMMA[5])) / steep - beta(size, zenith)


def muon_density(n: Column, r: Column) -> Column:
    """Muons at a distance from the axis, for n in all."""
    return 18 * F.pow(n / (1e6 * r), F.lit(0.75)) * F.pow(1 + r / 320, F.lit(-2.5))


def electron_density(n: Column, r: Column, unit: float = 100.0) -> Column:
    """Electrons and photons at a distance from the axis."""
    near, far = F.pow(unit / r, F.lit(0.75)), F.pow(unit / (unit + r), F.lit(3.25))
    return 0.4 * n / unit**2 * near * far * (1 + r / (11.4 * unit))


def cascade(energy: float, pions: int = 15, least: float = 20e9, electron: float = 85e6) -> tuple[float, float]:
    """Hadrons and electrons of a shower whose energy is shared by `pions` in each step until it falls to `least`."""
    hadrons, electrons = 1.0, 0.0
    while energy > least:
        energy /= pions
        electrons += 2 * hadrons / 3 * (energy / 2 // electron)
        hadrons *= 2 / 3 * pions
    return hadrons, electrons


def lattice(spark: SparkSession, rings: int, spacing: float = 1.0) -> DataFrame:
    """q, r, ring, x, y of the hexagonal lattice's points up to a ring."""
    side = spark.range(-rings, rings + 1).select(F.col("id").alias("q")).withColumn("r", F.explode(F.sequence(F.lit(-rings), F.lit(rings)).cast("array<bigint>")))
    ring = F.greatest(F.abs("q"), F.abs("r"), F.abs(F.col("q") + F.col("r")))
    points = side.withColumn("ring", ring).where(F.col("ring") <= rings)
    return points.withColumn("x", spacing * (F.col("q") + F.col("r") / 2)).withColumn("y", spacing * (3**0.5 / 2) * F.col("r"))
