"""Deterministic sampling and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.ordering import numbered, quantile_bucket, running


#: Rows that a task sorts, about, where whole batches go to one.
ROWS = 1 << 18


def split(files: DataFrame, name: str, share: float, order: Column) -> DataFrame:
    """part: the first int(share * n) files by `order` (a number) and name train, the others validate."""
    n = files.count()
    nth = numbered(files.withColumn("_order", order.cast("double")), "_order", "_nth", tie=name)
    return nth.withColumn("part", F.when(F.col("_nth") < int(share * n), "train").otherwise("validate")).drop("_order", "_nth")


def background_needed(n_sig: Column, n_other: Column, prior: float) -> Column:
    """Background rows to add (or, negative, to take out) for the prior."""
    return (F.floor(n_sig * (1 - prior) / prior) - n_other).cast("bigint")


def balanced(rows: DataFrame, batch: str, prior: float, order: list[Column | str]) -> DataFrame:
    """Batches without too much background: signal rows, and the first BKG rows in `order` that the
    prior leaves room for; batches without signal go.

    Batches are dealt out to so many tasks that each sorts about ROWS rows, however many there are in all."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(least, -(-rows.count() // ROWS)), batch)
    by = Window.partitionBy(batch)
    n_sig = F.count_if(F.col("label") == "SIG").over(by)
    n_cut = F.count_if(F.col("label").isin("INT", "PRT")).over(by)
    nth = F.row_number().over(Window.partitionBy(batch, "label").orderBy(*order))
    room = F.floor(n_sig * (1 - prior) / prior) - n_cut
    kept = rows.withColumn("_sig", n_sig).withColumn("_room", room).withColumn("_nth", nth)
    return kept.where("_sig > 0 AND (label <> 'BKG' OR _nth <= _room)").drop("_sig", "_room", "_nth")


def triangle(u: Column, v: Column) -> tuple[Column, Column]:
    """Uniform points of the unit triangle: what lies beyond the diagonal is reflected."""
    over = u + v > 1
    a, b = F.when(over, 1 - u).otherwise(u), F.when(over, 1 - v).otherwise(v)
    return a + b / 2, b * (3**0.5 / 2)


def with_background(batches: DataFrame, batch: str, needed: str, windows: DataFrame, order: str) -> DataFrame:
    """For each batch as many background windows as it needs: batches in order take consecutive windows, and after
    the last one the first comes again.  Windows are numbered by `order`, and dealt out by an equi-join."""
    n = windows.count()
    asked = batches.where(F.col(needed) > 0).withColumn("_bucket", quantile_bucket(batches, batch))
    asked = running(asked, [], "_bucket", [batch], needed, "_before")
    slots = asked.select(batch, F.explode(F.expr(f"sequence(_before, _before + {needed} - 1)")).alias("_slot"))
    slots = slots.withColumn("_slot", F.col("_slot") % F.lit(max(1, n)))
    return slots.join(numbered(windows, order, "_slot"), "_slot").drop("_slot")


def legacy_background(n: Column, prior: float) -> Column:
    """The older count: all rows that the prior asks for, less the signal."""
    return (F.floor(n / prior) - n).cast("bigint")


def interleaved(signal: DataFrame, order: str, u: Column, prior: float) -> DataFrame:
    """Signal rows with `skipped`, the background rows before each (geometric, by u), and `place`, where it then comes."""
    rows = signal.withColumn("skipped", F.floor(F.log(1 - u) / F.log(F.lit(1 - prior))).cast("bigint")).withColumn("_bucket", quantile_bucket(signal, order))
    rows = running(rows, [], "_bucket", [order], F.col("skipped") + 1, "_before")
    return rows.withColumn("place", F.col("_before") + F.col("skipped")).drop("_before", "_bucket")


def resampled(batches: DataFrame, batch: str, usable: Column, u: Column) -> DataFrame:
    """Each batch with the batch that it is served by: itself where it is usable, else one drawn from those by u."""
    marked = batches.withColumn("_usable", usable).withColumn("_u", u)
    good = numbered(marked.where("_usable").select(batch), batch, "_slot").withColumnRenamed(batch, "served")
    n = good.count()
    drawn = marked.where("NOT _usable").withColumn("_slot", F.floor(F.col("_u") * n).cast("long")).join(good, "_slot")
    return marked.where("_usable").select(batch, F.col(batch).alias("served")).unionByName(drawn.select(batch, "served"))
