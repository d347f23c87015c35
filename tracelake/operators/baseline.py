"""Baselines and spectra: loops that depend on the data, in Arrow batches of whole traces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAU_BINS = 41e-6 / 8.33e-9


def spread(x: np.ndarray) -> float:
    """Standard deviation by a running mean, sample by sample, as SQL engines add it up: where a sample lies two spreads
    from the mode, to the last bit, that decides whether it stays."""
    mean = squares = 0.0
    for n, v in enumerate(x.tolist(), 1):
        change = v - mean
        mean += change / n
        squares += (v - mean) * change
    return math.sqrt(squares / len(x))


def estimate(x: np.ndarray) -> tuple[float, float]:
    """Mean and spread after dropping, until nothing is dropped, what is beyond two spreads of the most
    frequent integer (the smallest of equals; the largest integer isn't a candidate)."""
    x = np.asarray(x, float)
    while len(x):
        low, high = int(x.min()), int(x.max())
        whole = x[x == np.floor(x)].astype(int) - low
        counts = np.bincount(whole[(whole >= 0) & (whole < high - low)], minlength=high - low)
        mode = low + int(counts.argmax()) if high > low else x[0]
        off, most = np.abs(x - mode), 2 * x.std()
        if np.abs(off - most).min() <= 1e-9 * (abs(low) + abs(high) + 1):
            most = 2 * spread(x)
        kept = x[off <= most]
        if len(kept) == len(x) or not len(kept):
            break
        x = kept
    return (float(x.mean()), spread(x)) if len(x) else (float("nan"), float("nan"))


def corrected(x: np.ndarray, edge: int = 300, mend: bool = False) -> tuple[str, np.ndarray]:
    """Status and samples after the baseline is taken out.  With the change between both ends and its spread s (of both
    ends): from 5 s on the trace is rejected; a smaller rise counts as constant; a fall of up to s, or any if no
    sample is 50 above the first baseline, as a step at the largest sample; a larger one is an undershoot,
    which is rejected too unless it is to be mended."""
    (b0, s0), (b1, s1) = estimate(x[:edge]), estimate(x[-edge:])
    change, s = b1 - b0, math.sqrt(s0 * s0 + s1 * s1)
    if change >= 5 * s:
        return "rejected", x
    if change >= 0:
        return "constant", x - estimate(x)[0]
    if change >= -s or x.max() - b0 < 50:
        return "step", x - np.where(np.arange(len(x)) < int(x.argmax()), b0, b1)
    if not mend:
        return "undershoot", x
    done = undershoot(x, b0, b1, edge)
    return ("undershoot", x) if done is None else ("mended", done)


def undershoot(x: np.ndarray, b0: float, b1: float, edge: int = 300, rounds: int = 3, tau: float = TAU_BINS) -> np.ndarray | None:
    """A baseline that falls as charge is collected and recovers as it decays: at first a straight line between both
    ends, then in each round the held charge above the last one, scaled to its value in the middle of the last
    end.  None if that is negative."""
    n = len(x)
    base = np.append(np.linspace(b0, b1, n - 2 * edge, endpoint=False), np.full(edge, b1))
    decay = np.exp(-np.arange(1, n - edge + 1) / tau)
    front = (x[:edge] - b0).sum()
    for _ in range(rounds):
        held = (front + np.cumsum((x[edge:] - base) / decay)) * decay
        if held[-(edge // 2)] < 0:
            return None
        base = b0 + (b1 - b0) * held / held[-(edge // 2)]
    return x - np.append(np.full(edge, b0), base)


def estimates(traces: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """keys, mean and spread of each trace's baseline."""
    schema = traces.select(*keys).schema.add("mean", "double").add("spread", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [estimate(np.asarray(v, float)) if v is not None else (None, None) for v in df[samples]]
            yield df[keys].assign(mean=[m for m, _ in found], spread=[s for _, s in found])

    return traces.select(*keys, samples).mapInPandas(run, schema)


def correct(traces: DataFrame, samples: str, edge: int = 300, mend: bool = False) -> DataFrame:
    """All rows with status and corrected samples; rejected traces keep theirs and can be put elsewhere."""
    names = [f.name for f in traces.schema]
    schema = traces.select(*[F.col(c) for c in names]).schema.add("status", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            done = [corrected(np.asarray(v, float), edge, mend) if v is not None and len(v) else ("empty", v) for v in df[samples]]
            df[samples] = [list(v) if v is not None else None for _, v in done]
            df["status"] = [s for s, _ in done]
            yield df

    return traces.mapInPandas(run, schema)


def spectra(traces: DataFrame, keys: list[str], samples: str) -> DataFrame:
    """freq, power: the mean over showers (the first key) of the mean power spectrum of their traces.  Each batch
    adds up its spectra by shower, so the shuffle carries sums only."""
    key = keys[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for k, rows in df.groupby(key):
                power = [np.abs(np.fft.fft(np.asarray(v, float))) ** 2 for v in rows[samples]]
                n = max(map(len, power))
                total, count = np.zeros(n), np.zeros(n, int)
                for p in power:
                    total[: len(p)] += p
                    count[: len(p)] += 1
                yield pd.DataFrame({key: k, "freq": np.arange(n), "s": total, "c": count})

    kind = traces.schema[key].dataType.simpleString()
    sums = traces.select(key, samples).mapInPandas(run, f"{key} {kind}, freq int, s double, c long")
    return sums.groupBy(key, "freq").agg((F.sum("s") / F.sum("c")).alias("m")).groupBy("freq").agg(F.avg("m").alias("power"))
