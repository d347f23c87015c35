"""Background particles injected into traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import arrays as A

#: A library beyond so many samples in all isn't broadcast but refused.
MOST_SAMPLES = 4_000_000


def library(particles: DataFrame, order: str, samples: str) -> DataFrame:
    """The particles' samples as one row, `lib`, in order.  It is broadcast, so its size is checked first."""
    held = particles.agg(F.sum(F.size(samples))).first()[0] or 0
    if held > MOST_SAMPLES:
        raise ValueError(f"a particle library of {held} samples is too large to be sent to every task")
    every = F.transform(F.array_sort(F.collect_list(F.struct(order, samples))), lambda s: s[samples])
    return particles.agg(every.alias("lib"))


def expected(rate_hz: float, bins: int, seconds: float) -> float:
    """Mean number of particles in a trace."""
    return rate_hz * bins * seconds


def inject(traces: DataFrame, lib: DataFrame, pmts: tuple[str, ...], count: Column, uniform: Callable[[Column], Column]) -> DataFrame:
    """Each trace with `count` particles added, the same ones in all PMTs; draw number 2k of `uniform` chooses the
    k-th particle and draw 2k + 1 the bin that it starts at, so that it ends within the trace.

    No row leaves its partition: the library comes as a broadcast row."""
    rows = traces.crossJoin(F.broadcast(lib)).withColumn("_count", count)
    n = F.size(pmts[0])

    def one(held: Column, k: Column) -> Column:
        particle = F.element_at("lib", (1 + F.floor(uniform(2 * k) * F.size("lib"))).cast("int"))
        at = F.floor(uniform(2 * k + 1) * F.greatest(n - F.size(particle), F.lit(1))).cast("int")
        return A.add(held, A.place(particle, n, at))

    zeros = F.array_repeat(F.lit(0.0), n)
    drawn = F.when(F.col("_count") > 0, F.aggregate(F.sequence(F.lit(0), F.col("_count") - 1), zeros, one)).otherwise(zeros)
    rows = rows.withColumn("_injected", drawn)
    return rows.withColumns({p: A.add(F.col(p), F.col("_injected")) for p in pmts}).drop("lib", "_count", "_injected")
