"""Extractions: what is kept of a reconstructed event, and in which layout."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import arrays as A

#: Stations from this id on aren't part of the array.
LEAST_TEST_STATION = 90_000


def reconstructed(events: DataFrame, ok: Column) -> DataFrame:
    """Events whose reconstruction didn't fail."""
    return events.where(F.coalesce(ok, F.lit(False)))


def central_trigger(stations: DataFrame, station: str, dense: Column, window_us: int = 1000) -> DataFrame:
    """All stations that aren't dense, with no offset and one window."""
    return stations.where(~F.coalesce(dense, F.lit(False))).select(station, F.lit(0).alias("offset_us"), F.lit(window_us).alias("window_us"))


def in_array(station: Column) -> Column:
    return station < LEAST_TEST_STATION


def extracted(vem: Column, adc: Column, start: Column, end: Column, counts: bool) -> Column:
    """Bins from start to end: of the calibrated trace with the last one, of the counts without it."""
    if counts:
        return F.slice(adc, start + 1, F.greatest(end - start, F.lit(0)))
    return F.slice(vem, start + 1, F.greatest(end - start + 1, F.lit(0)))


def side_by_side(traces: DataFrame, keys: list[str], adc: str, unit: float) -> DataFrame:
    """Counts and calibrated trace of one scan."""
    return traces.select(*keys, F.col(adc).alias("adc"), A.scale(F.col(adc), 1 / unit).alias("vem"))


def flags_as_counts(traces: DataFrame, keys: list[str], flags: tuple[Column, Column, Column], samples: list[str]) -> DataFrame:
    """A station table whose three particle counts hold trigger flags."""
    names = ("n_mu", "n_e", "n_gamma")
    return traces.select(*keys, *[f.cast("int").alias(n) for f, n in zip(flags, names)], *samples)


def columns_of(long: DataFrame, keys: list[str], pos: str, column: str, names: list, value: str) -> DataFrame:
    """The wide layout: a row per bin and a column per trace (the names are given, so nothing is scanned for them)."""
    return long.groupBy(*keys, pos).pivot(column, names).agg(F.first(value))


def rows_of(wide: DataFrame, keys: list[str], pos: str, names: list, unit: float | None = None) -> DataFrame:
    """The columns of :func:`columns_of` as rows again, with their samples in order, in whole units if one is given."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("trace"), F.col(f"`{n}`").cast("double").alias("v")) for n in names])).alias("e")
    rows = wide.select(*keys, pos, parts).where("e.v IS NOT NULL")
    samples = F.transform(F.array_sort(F.collect_list(F.struct(pos, "e.v"))), lambda s: s["v"])
    if unit is not None:
        samples = F.transform(samples, lambda v: F.floor(v) / unit)
    return rows.groupBy(*keys, F.col("e.trace").alias("trace")).agg(samples.alias("samples"))


def base_name(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def aligned(*tables: DataFrame, path: str = "path") -> DataFrame:
    """Tables of files joined on the files' base names; the paths are numbered."""
    out = None
    for i, t in enumerate(tables):
        t = t.select(base_name(F.col(path)).alias("name"), *[F.col(c).alias(f"{c}_{i}") for c in t.columns])
        out = t if out is None else out.join(t, "name")
    return out


def sane(files: DataFrame, path: Column, size: Column) -> DataFrame:
    """Files that aren't empty and whose name has an underscore, as all complete ones have; nothing is deleted."""
    return files.where((size > 0) & base_name(path).contains("_"))


def checksum(path: Column) -> Column:
    """A file's place in an order by the digits in its name."""
    return F.crc32(F.regexp_replace(path, "[^0-9]", ""))


def tenth(files: DataFrame, name: str, parts: int = 10) -> DataFrame:
    """One part in ten of the files, by a hash of their names."""
    return files.where(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(parts)) == 0)


MODES = ("component_traces", "hits_and_misses", "side_by_side", "near_stations")


def mode(number: int) -> str:
    """Name of the reader's mode of that number; another one raises."""
    if not 0 <= number < len(MODES):
        raise ValueError(f"no mode {number}: they are 0 to {len(MODES) - 1}")
    return MODES[number]


def monitoring(spark: SparkSession, path: str) -> DataFrame:
    """Monitoring rows staged as Parquet, with peak and variance of three PMTs as columns and arrays."""
    m = spark.read.parquet(path)
    return m.withColumns({f"peak_{i + 1}": F.col("peak")[i] for i in range(3)})


def name_order(files: list[str]) -> list[str]:
    """The order of :func:`checksum` for a list on the driver."""
    return sorted(files, key=lambda f: (zlib.crc32("".join(c for c in f if c.isdigit()).encode()), f))
