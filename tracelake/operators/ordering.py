"""Running sums and numbers in an order, without a window over all rows.

The rows of a key are cut into buckets that ascend with the order.  Sums per bucket are added up over the
(few) buckets, and within a bucket a window adds up its own rows; so a task holds one bucket, however
many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a bucket, about.
BUCKET = 4096


def hashed(seed: int, *cols: str | Column) -> Column:
    """A number in [0, 2^53) by hash: an order that reruns repeat."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53))


def bucket_of(order: str | Column, rows: str | Column) -> Column:
    """The bucket of a value of :func:`hashed`, for a key with about so many rows."""
    order, rows = (F.col(x) if isinstance(x, str) else x for x in (order, rows))
    return F.floor(order / float(1 << 53) * F.ceil((rows + 1) / BUCKET)).cast("long")


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str | Column, name: str) -> DataFrame:
    """The rows with the sum of `value` over all rows of their key that come before them in the order."""
    value = F.col(value) if isinstance(value, str) else value
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_run_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_run_sum").over(before), F.lit(0)).alias("_run_before"))
    own = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, [*by, bucket]).withColumn(name, F.col("_run_before") + F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.drop("_run_before")


def quantile_bucket(df: DataFrame, column: str, buckets: int = 256) -> Column:
    """Bucket of a numeric column's values by its approximate quantiles, which decide on balance only."""
    cuts = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)]).alias("x")).first().x or []
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return F.size(F.filter(edges, lambda e: F.col(column) >= e))


def numbered(df: DataFrame, column: str, name: str, buckets: int = 256, tie: str | None = None) -> DataFrame:
    """The rows with their number, from 0, in the order of a numeric column, and of `tie` where it has equals."""
    marked = df.withColumn("_part", quantile_bucket(df, column, buckets))
    order = [column] if tie is None else [column, tie]
    return running(marked, [], "_part", order, F.lit(1), name).drop("_part")


def carried(df: DataFrame, by: list[str], segment: str, order: str | Column, value: Column, before: str, after: str) -> DataFrame:
    """The rows with the last value that isn't null of their key's earlier segments, and the first one of its later segments.

    Segments ascend with the order.  What is carried over their borders comes from a row for each key and segment, so
    a key with all rows is worked on by as many tasks as it has segments."""
    order = F.when(value.isNotNull(), F.col(order) if isinstance(order, str) else order)
    ends = df.groupBy(*by, segment).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    along = Window.partitionBy(*by).orderBy(segment)
    last = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    return df.join(ends.select(*by, segment, last.alias(before), first.alias(after)), [*by, segment], "left")
