"""Nearest stations of points in the plane, by hexagonal cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.sinks import stored

RING = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon of circumradius `size` in which a point lies."""
    q, r = (x * (3**0.5 / 3) - y / 3) / size, y * (2 / 3) / size
    a, b, c = F.rint(q), F.rint(r), F.rint(-q - r)
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c + q + r)
    q = F.when((da > db) & (da > dc), -b - c).otherwise(a)
    r = F.when((da > db) & (da > dc), b).when(db > dc, -a - c).otherwise(b)
    return q.cast("long"), r.cast("long")


#: Stations in the first cell of a typical station, about, and how many meet a point in one row.
CROWD, ROW = 6, 512


def crowds(sites: DataFrame, size: float, span: float, halvings: int = 16) -> tuple[float, dict[float, int]]:
    """The largest of size, size / 2, size / 4, ... at which a station's own cell holds about CROWD stations on average, or
    half as many again as at the finest, if they lie too close for that; and the most stations in a cell by its size."""
    finer, sizes = [size / 2**i for i in range(halvings + 1)], [size]
    while sizes[-1] <= span:
        sizes.append(2 * sizes[-1])
    q, r = hex_cell(F.col("sx"), F.col("sy"), F.col("size"))
    every = F.explode(F.array(*[F.lit(s) for s in finer + sizes[1:]])).alias("size")
    cells = sites.select("sx", "sy", every).groupBy("size", q.alias("q"), r.alias("r")).agg(F.count("*").alias("n"))
    mean = (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("mean")
    found = {x["size"]: x for x in cells.groupBy("size").agg(mean, F.max("n").alias("most")).collect()}
    enough = max(CROWD, 1.5 * found[finer[-1]]["mean"])
    return next(s for s in finer if found[s]["mean"] <= enough or s == finer[-1]), {s: x["most"] for s, x in found.items()}


def nearest(points: DataFrame, stations: DataFrame, point: str, station: str, k: int = 3, size: float = 1.0) -> DataFrame:
    """point, station, nth, square: each point's k nearest stations (all, if there are fewer) with the squares of their
    distances, the smaller station of equals.  Both tables have columns x and y; rows with nulls take no part.

    A point meets the stations of its cell and the six around it in an equi-join.  Whatever isn't in those is further away
    than the cell's circumradius, so a point is done when its k-th station is nearer; those that aren't go on with cells
    of twice the size.  `size` is that of the first cells, or the largest one: where stations are dense it starts with finer ones.

    Stations are laid out by the cells that they are met from, some to a row, and a point keeps the k best of a row as it
    meets it.  So no pairs are shuffled or sorted, but for cells of more stations than a row holds the k best of each row."""
    spark = points.sparkSession
    full = lambda df, name: df.where(F.col(name).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    given, sites = full(points, point).select(point, "x", "y"), full(stations, station).select(station, F.col("x").alias("sx"), F.col("y").alias("sy"))
    extent = sites.agg(F.count("*").alias("n"), F.min("sx").alias("a"), F.max("sx").alias("b"), F.min("sy").alias("c"), F.max("sy").alias("d")).first()
    around = given.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    out = None
    if not extent.n or around.a is None:
        return points.limit(0).select(point).crossJoin(stations.limit(0).select(station)).withColumns({"nth": F.lit(0), "square": F.lit(0.0)})
    span = float(max(extent.b, around.b) - min(extent.a, around.a)) + float(max(extent.d, around.d) - min(extent.c, around.c))
    k = min(k, extent.n)
    open_ = given.distinct()
    size, most = crowds(sites, size, span)
    while True:
        last = size > span  # one cell and its ring hold all stations
        q, r = hex_cell(F.col("sx"), F.col("sy"), size)
        ring = F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in RING])
        rows = -(-7 * most[size] // ROW)
        met = sites.select(station, "sx", "sy", F.inline(ring)).groupBy("q", "r", F.pmod(F.xxhash64(station), F.lit(rows)).alias("row"))
        met = stored(spark, met.agg(F.collect_list(F.struct(station, "sx", "sy")).alias("sites")).drop("row"), "cells")
        q, r = hex_cell(F.col("x"), F.col("y"), size)
        square = lambda s: (F.col("x") - s["sx"]) * (F.col("x") - s["sx"]) + (F.col("y") - s["sy"]) * (F.col("y") - s["sy"])
        best = lambda pairs: F.slice(F.sort_array(pairs), 1, k)
        pairs = F.transform("sites", lambda s: F.struct(square(s).alias("square"), s[station].alias(station)))
        near = open_.withColumn("q", q).withColumn("r", r).join(met, ["q", "r"], "left").select(point, "x", "y", best(pairs).alias("best"))
        if rows > 1:
            near = near.groupBy(point, "x", "y").agg(best(F.flatten(F.collect_list("best"))).alias("best"))
        near = near.withColumn("done", F.lit(True) if last else F.coalesce((F.size("best") == k) & (F.col("best")[k - 1]["square"] < size * size), F.lit(False)))
        near = stored(spark, near.withColumn("best", F.when(F.col("done"), F.col("best"))), "nearest")
        done = near.where("done").select(point, F.posexplode("best").alias("nth", "b")).select(point, F.col(f"b.{station}").alias(station), (F.col("nth") + 1).alias("nth"), "b.square")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        open_ = near.where("NOT done").select(point, "x", "y")
        if not open_.take(1):
            return out
        size *= 2
