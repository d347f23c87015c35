"""Sinks of fits, models and ensembles, and the shared folder that steps write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share.  A cluster has to name one; in local mode a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_fits(fits: DataFrame, path: str) -> None:
    """One table of fit parameters, a folder per energy bin, so that a bin is read alone."""
    fits.write.mode("overwrite").partitionBy("e").parquet(path)


def write_model_lists(files: DataFrame, path: str) -> None:
    """Training and validation files of a model (column `part`)."""
    files.write.mode("overwrite").partitionBy("part").parquet(path)


def write_ensemble(members: DataFrame, path: str) -> None:
    """A row per member: accuracy and its error, rate and its error, true accuracy."""
    members.select("model", "acc", "acc_err", "rate", "rate_err", "true_acc").write.mode("append").parquet(path)


def write_scan(scan: DataFrame, path: str) -> None:
    """A row per scale of the classical triggers: scale, then efficiency and rate in all and by trigger.  Files, by
    their names, and the rows in each ascend with the scale."""
    scan.repartitionByRange("scale").sortWithinPartitions("scale").write.mode("overwrite").parquet(path)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The table, worked out once and kept in the shared folder, for plans that read it several times."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
