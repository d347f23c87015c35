"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Formulas over generated rows, with the SQL that they equal: under test, but no queries, as they read no table.
FORMULAS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FORMULA_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it equals."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def formula(sql: str):
    """Keep a formula over generated rows, with the SQL that it equals."""

    def add(f):
        FORMULAS[f.__name__], FORMULA_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Traces from the embeddings: three rows in a row are the PMTs p1 to p3 of a station."""
    e = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 3").alias("station"), (F.col("vec_id") % 3).alias("pmt"), F.col("embedding").cast("array<double>").alias("e"), "label"
    )
    out = e.groupBy("station").agg(*[F.first(F.when(F.col("pmt") == i, F.col("e")), ignorenulls=True).alias(f"p{i + 1}") for i in range(3)],
                                   F.min("label").alias("label"), F.count("*").alias("n"))
    return (out.where("n = 3") if whole else out).drop("n")


#: The same in SQL, as a common table expression.
TR = """tr AS (SELECT vec_id // 3 AS station, any_value(e) FILTER (WHERE vec_id % 3 = 0) AS p1,
    any_value(e) FILTER (WHERE vec_id % 3 = 1) AS p2, any_value(e) FILTER (WHERE vec_id % 3 = 2) AS p3, min(label) AS label
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) GROUP BY 1 HAVING count(*) = 3)"""
#: Integer bins of a trace: floor(1000 v).
TRI = TR + """, ti AS (SELECT station, label, list_transform(p1, lambda v: floor(1000 * v)) AS p1,
    list_transform(p2, lambda v: floor(1000 * v)) AS p2, list_transform(p3, lambda v: floor(1000 * v)) AS p3 FROM tr)"""


def integer_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stations(spark, sf_dir)
    return s.withColumns({p: F.transform(p, lambda v: F.floor(1000 * v).cast("double")) for p in ("p1", "p2", "p3")})
