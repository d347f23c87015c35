"""Column expressions on traces: arrays of doubles, one per PMT.  All stay on the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import config as C



def total(x: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def scale(x: Column, factor: float | Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def add(*arrays: Column) -> Column:
    """Element-wise sum; a null array counts as zeros, and the result has the longest length."""
    out = F.coalesce(arrays[0], F.array().cast("array<double>"))
    for a in arrays[1:]:
        other = F.coalesce(a, F.array().cast("array<double>"))
        out = F.zip_with(out, other, lambda u, v: F.coalesce(u, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)))
    return out


def place(signal: Column, n: int | Column, at: int | Column) -> Column:
    """The signal from bin `at` on in a trace of n bins that are zero else."""
    n, at = (F.lit(x) if isinstance(x, int) else x for x in (n, at))
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), at), signal, F.array_repeat(F.lit(0.0), F.greatest(n - at - F.size(signal), F.lit(0)))), 1, n)


def latch_bin(n: int) -> int:
    return int(C.LATCH_SHARE * n)


def digitise(x: Column, q_peak: float = C.Q_PEAK, low: float = C.CLIP_LOW, high: float = C.CLIP_HIGH, floor: bool = True) -> Column:
    """Floor, clip, and divide by the calibration; a NaN stays one."""

    def one(v: Column) -> Column:
        f = F.floor(v).cast("double") if floor else v
        return F.when(F.isnan(v), v).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), f))) / q_peak

    return F.transform(x, one)


def charge(x: Column, q_charge: float = C.Q_CHARGE) -> Column:
    return F.transform(x, lambda v: F.floor(v) / F.lit(q_charge))


def downsample(x: Column, phase: int = 0, low: float | None = None, high: float | None = None, skip_last: bool = False) -> Column:
    """FIR filter and decimation by 3.  The array is cut to a multiple of 3 and padded with bins of its
    own mirrored ends (the front without its first bin; the back without its last one if `skip_last`); the
    filtered value is truncated, then shifted arithmetically."""
    taps = F.array(*[F.lit(float(t)) for t in C.FIR_TAPS])
    half = len(C.FIR_TAPS) // 2

    def filtered(t: Column) -> Column:
        n = F.size(t)
        padded = F.concat(
            F.reverse(F.slice(t, 2, half)), t, F.reverse(F.slice(t, n - half + (0 if skip_last else 1), half)), F.array(F.lit(0.0))
        )

        def at(k: Column) -> Column:
            dot = total(F.zip_with(F.slice(padded, k + 1, len(C.FIR_TAPS)), taps, lambda u, v: u * v))
            y = F.shiftright(dot.cast("bigint"), C.FIR_SHIFT).cast("double")
            y = F.greatest(F.lit(low), y) if low is not None else y
            return F.least(F.lit(high), y) if high is not None else y

        return F.when(n > half, F.transform(F.sequence(F.lit(phase), n - 1, F.lit(3)), at)).otherwise(F.array().cast("array<double>"))

    cut = F.slice(x, 1, F.size(x) - F.size(x) % 3)
    return F.element_at(F.transform(F.array(cut), filtered), 1)


def decimate(x: Column, phase: int = 0) -> Column:
    """Every third bin from `phase` on."""
    return F.filter(x, lambda v, i: (i % 3) == phase)


def deconvolve(x: Column, tau: float = C.DECAY_TAU_BINS) -> Column:
    """Exponential tails taken out: one value fewer than the input."""
    r = math.exp(-1.0 / tau)
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: (a - b * r) / (1 - r))


def pool_max(p1: Column, p2: Column, p3: Column) -> Column:
    return F.zip_with(F.zip_with(p1, p2, lambda a, b: F.greatest(a, b)), p3, lambda a, b: F.greatest(a, b))


def pool_min(p1: Column, p2: Column, p3: Column) -> Column:
    return F.zip_with(F.zip_with(p1, p2, lambda a, b: F.least(a, b)), p3, lambda a, b: F.least(a, b))


def pool_mean(p1: Column, p2: Column, p3: Column) -> Column:
    return F.zip_with(F.zip_with(p1, p2, lambda a, b: a + b), p3, lambda a, b: (a + b) / 3)


def permute(pmts: Column, order: tuple[int, int, int]) -> Column:
    """An array of PMTs in another order (counted from 0)."""
    return F.array(*[F.element_at(pmts, i + 1) for i in order])


def digitize(x: Column, edges: tuple[float, ...]) -> Column:
    """Number of edges that are at most x; a NaN is above all."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return out


def digitize_array(x: Column, edges: Column) -> Column:
    """The same with the edges in an array column."""
    return F.size(F.filter(edges, lambda e: x >= e))


def histogram_bin(x: Column, edges: tuple[float, ...]) -> Column:
    """Bin from 0 on, the last closed on its right; null outside."""
    d = digitize(x, edges) - 1
    return F.when(x == edges[-1], len(edges) - 2).when((d >= 0) & (d < len(edges) - 1), d)


def nearest_bin(x: Column, centres: Column) -> Column:
    """Index of the nearest centre, from 0, the first of equals."""
    d = F.transform(centres, lambda c: F.abs(c - x))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def ratio(a: Column, b: Column, bound: float = 10.0) -> Column:
    """Element-wise ratio clipped to ±bound; null where b is 0."""
    return F.zip_with(a, b, lambda u, v: F.greatest(F.lit(-bound), F.least(F.lit(bound), u / F.nullif(v, F.lit(0.0)))))


def saturated(low_gain: Column, high_gain: Column, factor: Column) -> Column:
    """Low gain times the ratio where one is known, else the high gain."""
    return F.when(F.coalesce(factor, F.lit(0.0)) != 0, scale(low_gain, factor)).otherwise(high_gain)


def lcg(x: Column, turns: int = 3) -> Column:
    """Uniform in [0, 1) from an integer: integer arithmetic that any engine repeats."""
    v = x.cast("bigint")
    for _ in range(turns):
        v = F.pmod(v * 1103515245 + 12345, F.lit(2147483648))
    return v / F.lit(2147483648.0)


def hashed_uniform(*cols: Column | str, seed: int = 0) -> Column:
    """Uniform in [0, 1) by hash, the same whatever the partitioning."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def dither(x: Column, key: Column, seed: int = 0, draw: Callable[[Column], Column] | None = None) -> Column:
    """A uniform fraction added to each integer bin; `draw` gives it for a bin's number, else a hash does."""
    draw = draw or (lambda i: hashed_uniform(key, i, seed=seed))
    return F.transform(x, lambda v, i: v + draw(i))


def gaussian(key: Column, n: int, mean: float, std: float, seed: int = 0, draw: Callable[[Column], Column] | None = None) -> Column:
    """n normal values by the polar angle transform of draws 2i and 2i + 1, uniform in [0, 1) (hashed unless given)."""
    draw = draw or (lambda k: hashed_uniform(key, k, seed=seed))

    def one(i: Column) -> Column:
        u = (draw(2 * i) * 2147483648 + 1) / 2147483649  # not 0
        return mean + std * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * draw(2 * i + 1))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def poisson(u: Column, rate: float, most: int = 64) -> Column:
    """Inverse of the Poisson distribution at u, up to `most`."""
    cdf, term, acc = [], math.exp(-rate), 0.0
    for k in range(most):
        acc += term
        cdf.append(acc)
        term *= rate / (k + 1)
    return digitize(u, tuple(cdf))


def geometric(u: Column, p: float) -> Column:
    """Failures before a success at u."""
    return F.floor(F.log(1 - u) / math.log(1 - p)).cast("int")


def lateral(x: Column, efficiency: Column, p50: Column, width: Column) -> Column:
    """Trigger probability at a distance, in [0, 1]; NaN stays NaN."""
    y = efficiency * (1 - 1 / (1 + F.exp(-(x - p50) / width)))
    return F.when(F.isnan(y), y).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def lateral_error(x: Column, efficiency: Column, p50: Column, width: Column, cov: list[list[float]]) -> Column:
    """Error of :func:`lateral` from the covariance of its three parameters."""
    z = F.exp(-(x - p50) / width)
    s = 1 - 1 / (1 + z)
    slope = efficiency * z / ((1 + z) * (1 + z))
    gradient = [s, slope / width, slope * (x - p50) / (width * width)]
    out = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            out = out + gradient[i] * gradient[j] * cov[i][j]
    return F.sqrt(out)


def full_efficiency_radius(efficiency: Column, p50: Column, inverse_width: Column, level: Column | float) -> Column:
    """Distance at which :func:`lateral` falls to `level`."""
    return p50 - F.log(1 / (1 - level / efficiency) - 1) / inverse_width


def plane_distance(x: Column, y: Column, core_x: Column, core_y: Column, zenith: Column, azimuth: Column) -> Column:
    """Distance of a ground point from the shower axis; angles in radians."""
    ax, ay, az = F.sin(zenith) * F.cos(azimuth), F.sin(zenith) * F.sin(azimuth), F.cos(zenith)
    dx, dy = x - core_x, y - core_y
    along = dx * ax + dy * ay
    return F.sqrt((dx - along * ax) ** 2 + (dy - along * ay) ** 2 + (along * az) ** 2)


def nkg(r: Column, size: Column, beta: Column, gamma: Column, r0: float = 1000.0, r1: float = 700.0) -> Column:
    """Modified lateral density at r for the signal `size` at r0."""
    return size * F.pow(r / r0, beta) * F.pow((r + r1) / (r0 + r1), beta + gamma)
