"""Trigger rates by day and station, kept up to date as files of station events arrive.

    python -m jobs.trigger_rates --source 's3a://array/events/*' --output s3a://array/monitor

The source is followed by a file stream with a checkpoint, so a run takes only files that no run has taken.  A batch
goes to `decisions`, one partition for its number in each day, and the days that it touched are worked out again in
`rates`.  Both are dynamic partition overwrites of what the batch alone decides: a batch that is run again, after a
failure, replaces what it had written.  Days that a batch doesn't touch are neither read nor written.

Events without an id, a time, a station or a finite signal go to the partition `rejected` of the decisions.  An event that
is delivered again, in the same file or a later one, counts once: its first delivery, and of one batch its largest signal.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from tracelake.operators import metrics

LOG = logging.getLogger(__name__)
DAY_SECONDS = 86_400.0


def decided(events: DataFrame, config: dict) -> DataFrame:
    """status, day, and the event with a flag for each level."""
    names = {"event": "event_id", "station": "station", "time": "at", "signal": "signal"}
    rows = events.select(*[F.col(config[k]).alias(v) for k, v in names.items()])
    signal = F.col("signal").cast("double")
    sane = F.col("event_id").isNotNull() & F.col("station").isNotNull() & F.col("at").isNotNull() & signal.isNotNull()
    sane = sane & ~F.isnan(signal) & (F.abs(signal) < float("inf"))
    flags = [(signal > level).alias(name) for name, level in config["levels"].items()]
    return rows.select(
        F.when(sane, "accepted").otherwise("rejected").alias("status"),
        F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("none")).alias("day"),
        F.col("event_id").cast("long"), F.col("station").cast("long"), signal.alias("signal"), *flags,
    )


def decision_schema(config: dict) -> str:
    flags = "".join(f"{name} boolean, " for name in config["levels"])
    return f"event_id long, station long, signal double, {flags}status string, day string, batch long"


def rate_schema(config: dict) -> str:
    counts = "".join(f"n_{name} long, rate_{name} double, rate_{name}_err double, " for name in config["levels"])
    return f"station long, n_all long, {counts}day string"


def rates(decisions: DataFrame, levels: list[str]) -> DataFrame:
    """day, station, events, and for each level its count and its rate with the counting error."""
    first = F.struct("batch", -F.col("signal"))
    once = decisions.groupBy("day", "event_id").agg(F.min_by(F.struct("station", *levels), first).alias("x")).select("day", "x.*")
    counted = once.groupBy("day", "station").agg(F.count("*").alias("n_all"), *[F.count_if(n).alias(f"n_{n}") for n in levels])
    parts = []
    for n in levels:
        rate, error = metrics.rate(F.col(f"n_{n}"), F.lit(DAY_SECONDS))
        parts += [f"n_{n}", rate.alias(f"rate_{n}"), error.alias(f"rate_{n}_err")]
    return counted.select("day", "station", "n_all", *parts)


def run(spark: SparkSession, source: str, output: str, config: dict) -> None:
    """Take the files of `source` that are new, and bring the rates of their days up to date below `output`."""
    output, levels = output.rstrip("/"), list(config["levels"])
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = decided(batch, config).withColumn("batch", F.lit(number))
        overwrite = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
        overwrite(rows, "status", "day", "batch").parquet(f"{output}/decisions")
        kept = session.read.schema(decision_schema(config)).parquet(f"{output}/decisions")
        counts = kept.where(F.col("batch") == number).groupBy("status", "day").agg(F.count("*").alias("n")).collect()
        days = sorted(r.day for r in counts if r.status == "accepted")  # as many as the calendar has
        LOG.info("batch %d: read %d events, %d of them rejected, of %d days", number, sum(r.n for r in counts), sum(r.n for r in counts if r.status == "rejected"), len(days))
        if days:
            touched = kept.where((F.col("status") == "accepted") & F.col("day").isin(days))
            overwrite(rates(touched, levels).repartition("day"), "day").parquet(f"{output}/rates")
            LOG.info("batch %d: wrote the rates of %s to %s", number, days[0] if len(days) == 1 else f"{days[0]} to {days[-1]}", f"{output}/rates")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def result(spark: SparkSession, output: str, config: dict) -> DataFrame:
    """The rates as they stand."""
    return spark.read.schema(rate_schema(config)).parquet(f"{output.rstrip('/')}/rates")


if __name__ == "__main__":
    main("trigger_rates", run, {"source": "path or pattern of Parquet files", "output": "folder of decisions, rates and checkpoint"})
