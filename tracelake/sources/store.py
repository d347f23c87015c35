"""A store of traces in partitions by energy and buckets by event: queries open only the energies that they ask for, and
tables of one event number join bucket by bucket, without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.arrays import digitize


def write(df: DataFrame, path: str, event: str, energy: Column, edges: tuple[float, ...], buckets: int = 16) -> str:
    """Write the rows below `path` and return the table's name, which no other call gives.

    `energy_range` is the number of edges that the energy reaches.  Rows are dealt by event before they are written, so each
    bucket of a range is a file or two, and not one for every task."""
    name = f"traces_{uuid.uuid4().hex}"
    rows = df.withColumn("energy_range", digitize(energy, edges)).repartition(buckets, event)
    rows.write.mode("overwrite").partitionBy("energy_range").bucketBy(buckets, event).sortBy(event).option("path", path).saveAsTable(name)
    return name


def opened(spark: SparkSession, name: str, first: int | None = None, stop: int | None = None) -> DataFrame:
    """A table's rows of the energy ranges from `first` up to, but without, `stop`."""
    rows = spark.table(name)
    if first is not None:
        rows = rows.where(F.col("energy_range") >= first)
    return rows if stop is None else rows.where(F.col("energy_range") < stop)


def together(left: DataFrame, right: DataFrame, event: str) -> DataFrame:
    """Rows of two tables of the store with one event.  The energy is the event's, so both have it in one range, and the
    bucket alone decides where they meet: a join on the range too would be dealt out anew."""
    return left.join(right.drop("energy_range"), event)
