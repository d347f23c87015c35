"""Trace text files, noise files, lookup tables; and the sinks for decisions and rates."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake import config as C

METADATA = ("station_id int", "spd int", "energy double", "zenith double", "n_mu int", "n_e int", "n_gamma int")


def resolve(libraries: dict[str, list[str]], choice: str | list | None) -> list[str]:
    """Files of a choice: a library's name, a slice "a:b" of the libraries in order (b excluded; without b
    the last library is left out), "all", a directory pattern, or a list of any of these, flattened."""
    names = list(libraries)
    if isinstance(choice, list):
        out = [f for c in choice for f in resolve(libraries, c)]
    elif choice == "all":
        out = [f for n in names for f in libraries[n]]
    elif choice in libraries:
        out = list(libraries[choice])
    elif choice and ":" in choice and "/" not in choice:
        a, _, b = choice.partition(":")
        out = [f for n in names[names.index(a) if a else 0 : names.index(b) if b else -1] for f in libraries[n]]
    else:
        out = [choice] if choice else []
    return [f for f in out if f.endswith((".csv", "/", "*")) or "." not in f.rsplit("/", 1)[-1]]


def shuffled(files: list[str], seed: int = 0) -> list[str]:
    """An order by hash, the same on every machine."""
    return sorted(files, key=lambda f: (zlib.crc32(f"{seed}:{f}".encode()), f))


def train_validate(files: list[str], share: float = C.TRAIN_SHARE) -> tuple[list[str], list[str]]:
    k = int(share * len(files))
    return files[:k], files[k:]


def _numbered(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines with file and line number.  A large file is read by many tasks: lines are counted within each of its splits,
    and those of the splits before are added.  Splits depend on files and settings only, so the counts fit the lines."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("event_file"), F.col("_metadata.file_block_start").alias("split"),
        "value", F.monotonically_increasing_id().alias("row"),
    )
    splits = lines.groupBy("event_file", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("event_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("event_file", "split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    lines = lines.join(splits, ["event_file", "split"]).select("event_file", (F.col("row") + F.col("shift")).alias("line"), F.col("value").alias("text"))
    return lines.where(F.trim("text") != "")


def station_traces(spark: SparkSession, paths: list[str] | str, legacy: bool = False) -> DataFrame:
    """A row per station from files with three lines per station: metadata, then samples.  Blocks whose
    lines disagree on station or distance are dropped; lines may differ in length between stations."""
    metadata = METADATA[:4] if legacy else METADATA
    cells = F.split(F.trim("text"), r"\s+")
    rows = _numbered(spark, paths).select("event_file", "line", cells.alias("c"))
    n = len(metadata)
    parsed = [F.expr(f"try_cast(c[{i}] as double)").cast(m.split()[1]).alias(m.split()[0]) for i, m in enumerate(metadata)]
    rows = rows.select("event_file", (F.col("line") % 3).alias("pmt"), F.expr("line div 3").alias("block"), *parsed,
                       F.expr(f"slice(c, {n + 1}, greatest(size(c) - {n}, 0))").cast("array<double>").alias("samples"))
    names = [m.split()[0] for m in metadata]
    first = [F.first(c).alias(c) for c in names]
    pmts = F.transform(F.sort_array(F.collect_list(F.struct("pmt", "samples"))), lambda s: s["samples"]).alias("pmt")
    grouped = rows.groupBy("event_file", "block").agg(*first, pmts, F.count("*").alias("n"), F.count_distinct("station_id", "spd").alias("kinds"))
    return grouped.where("n = 3 AND kinds = 1").select("event_file", *names, "pmt")


def noise_traces(spark: SparkSession, paths: list[str] | str, with_baseline: bool = False) -> DataFrame:
    """A row per three lines of integers; if asked, the first value is the station's own baseline."""
    samples = F.split(F.trim("text"), r"\s+").cast("array<double>")
    rows = _numbered(spark, paths).select("event_file", (F.col("line") % 3).alias("pmt"), F.expr("line div 3").alias("block"), samples.alias("s"))
    parts = F.sort_array(F.collect_list(F.struct("pmt", "s")))
    out = rows.groupBy("event_file", "block").agg(parts.alias("x"), F.count("*").alias("n")).where("n = 3")
    if not with_baseline:
        return out.select("event_file", "block", F.expr("transform(x, e -> e.s)").alias("pmt"))
    return out.select("event_file", "block", F.expr("transform(x, e -> e.s[0])").alias("baseline"),
                      F.expr("transform(x, e -> slice(e.s, 2, size(e.s) - 1))").alias("pmt"))


def lookup(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A numeric table separated by blanks; only the columns used are kept by the planner."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").where(~F.col("value").startswith("#"))
    return rows.select(*[cells[i].cast("double").alias(n) for i, n in enumerate(columns)])


def json_events(spark: SparkSession, path: str, parts: list[str], whole: bool = True) -> dict[str, DataFrame]:
    """One table for each array of records of JSON files: each file one document, or else each line, which is how large
    records are to be kept, as lines are dealt out to tasks."""
    doc = spark.read.json(path, multiLine=whole)
    return {p: doc.select(F.inline(p)) for p in parts}


def component_sum(long: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Element-wise sum of component traces: keys and the summed array, without holding single components."""
    by_pos = long.groupBy(*keys, pos).agg(F.sum(value).alias("v"))
    return by_pos.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, "v"))).alias("x")).select(*keys, F.expr("transform(x, e -> e.v)").alias("trace"))


def far_enough(energy: Column, spd: Column) -> Column:
    """Keeps stations below the distance that goes with the decade of energy."""
    decade = F.floor(F.log10(energy))
    cut = F.lit(None)
    for d, most in C.DISTANCE_CUT.items():
        cut = F.when(decade == d, most).otherwise(cut)
    return spd < F.coalesce(cut, F.lit(max(C.DISTANCE_CUT.values())))


def write_outcomes(df: DataFrame, path: str) -> None:
    """One table of decisions, partitioned by outcome."""
    df.write.mode("overwrite").partitionBy("outcome").parquet(path)


def append_rates(df: DataFrame, path: str, job: str) -> None:
    """Add a job's rate rows to a table.  They are a partition of their own, so a job that is run again, whole or
    after a failure, replaces its rows and no others."""
    rows = df.withColumn("job", F.lit(job))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)


def write_by_status(df: DataFrame, path: str) -> None:
    """Rejected traces go to partitions of their own."""
    df.write.mode("overwrite").partitionBy("status").parquet(path)


def pack(df: DataFrame, path: str, fragments: int = 100) -> None:
    """Many small inputs as a fixed number of files."""
    df.repartition(fragments).write.mode("overwrite").parquet(path)


def quarantined(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str) -> DataFrame:
    """What `work` makes of the rows, and a row with the key and the error's class for each that it raises on.

    `work` gets tables of rows and gives columns of `schema`.  Where it raises, the rows are given to it one by one,
    so that one of them ends neither the task nor the work on its neighbours.  The result has the schema's columns and,
    for rows that failed, `failed_key` (as text) and `error` beside nulls."""
    fields = [f.name for f in T.StructType.fromDDL(schema)]

    def attempt(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple]]:
        try:
            return work(rows), []
        except Exception as e:
            if len(rows) > 1:
                parts = [attempt(rows.iloc[i : i + 1]) for i in range(len(rows))]
                good = [p for p, _ in parts if len(p)]
                return pd.concat(good) if good else pd.DataFrame(columns=fields), [f for _, bad in parts for f in bad]
            return pd.DataFrame(columns=fields), [(str(rows[key].iloc[0]), type(e).__name__)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            good, bad = attempt(rows)
            if len(good):
                yield good.assign(failed_key=None, error=None)
            if bad:
                yield pd.DataFrame(bad, columns=["failed_key", "error"]).reindex(columns=[*fields, "failed_key", "error"])

    return df.mapInPandas(run, f"{schema}, failed_key string, error string")
