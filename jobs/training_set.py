"""A training set with a given share of signal, from labelled texts.

    python -m jobs.training_set --documents s3a://corpus/documents --labels s3a://corpus/labels --output s3a://corpus/training

Texts are to classifiers of passages what traces are to those of triggers, and the set is built by the same rules: a
positive text is signal (SIG), unless it has too few words (PRT) or characters (INT); a text that isn't is background
(BKG).  Each source is a batch: it keeps its signal, what was ignored, and as much background as leaves the share
of signal at the prior; sources without signal go.  Which background stays, and whether a row is for training or
validation, is decided by hashes of ids, so reruns agree, and a row keeps its part as the tables grow.

Rows are numbered by buckets of those hashes, so a source with a third of all rows isn't sorted by one task.  The
set is written by part and label, with the number of sliding windows that each text gives; beside it goes a summary
by source as JSON, the ids that were left out for having no text, and the sizes and labels of all labelled texts,
from which the rest is made: texts are read once.  All four are replaced by a rerun.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from tracelake.operators import ordering, sampling, windows

LOG = logging.getLogger(__name__)
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, source string, lang string, n_chars long, n_words long, n_windows long, part string, label string"


def draw(salt: str) -> Column:
    """A whole number below 2^52 that a row's id decides."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long")


def described(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """The labelled texts with their sizes, windows, label and draws; an id with several labels is positive if one is."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("positive"))
    rows = documents.where("doc_id IS NOT NULL").join(marks, "doc_id")
    text, chars = F.coalesce("text", F.lit("")), F.col("n_chars")
    rows = rows.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "positive",
        F.length(text).cast("long").alias("n_chars"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    label = windows.label(F.col("positive"), F.col("n_words"), chars, config["ignore_words"], config["ignore_chars"])
    n_windows = F.when(chars >= config["window"], F.floor((chars - config["window"]) / config["step"]) + 1).otherwise(0).cast("long")
    part = F.when(draw("part") < F.lit(int(config["train_share"] * 2**52)), "train").otherwise("validate")
    return rows.select("doc_id", "source", "lang", "n_chars", "n_words", n_windows.alias("n_windows"), part.alias("part"), label.alias("label"), draw("order").alias("order"))


def balanced(rows: DataFrame, prior: float) -> DataFrame:
    """The rows without the background that is too much for its source."""
    count = lambda *names: F.count_if(F.col("label").isin(*names)).alias(f"n_{names[0].lower()}")
    sources = rows.groupBy("source").agg(count("SIG"), count("INT", "PRT"), count("BKG")).where("n_sig > 0")
    needed = sampling.background_needed(F.col("n_sig"), F.col("n_int"), prior)
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")  # a source's rows meet its counts in 16 places
    wanted = sources.select("source", "n_bkg", needed.alias("needed"), salts)
    joined = rows.withColumn("salt", (F.col("order") % 16).cast("int")).join(wanted, ["source", "salt"]).drop("salt")
    background = joined.where("label = 'BKG'").withColumn("bucket", ordering.bucket_of(2 * F.col("order"), "n_bkg"))
    background = ordering.running(background, ["source"], "bucket", ["order", "doc_id"], F.lit(1), "before").where("before < needed")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return joined.where("label <> 'BKG'").select(names).unionByName(background.select(names))


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict) -> None:
    """Build the set below `output`, replacing what is there."""
    output = output.rstrip("/")
    texts = spark.read.parquet(documents).select("doc_id", "text", "source", "lang")
    rows = described(texts, spark.read.parquet(labels).select("doc_id", "toxic"), config)
    rows.write.mode("overwrite").parquet(f"{output}/described")  # so that texts are read and cut into words once
    rows = spark.read.schema(rows.schema).parquet(f"{output}/described")
    rows.where("n_words = 0").select("doc_id", "source").write.mode("overwrite").parquet(f"{output}/left_out")
    chosen = balanced(rows.where("n_words > 0"), config["prior"])
    chosen.repartition("part", "label", F.pmod("doc_id", F.lit(8))).write.mode("overwrite").partitionBy("part", "label").parquet(f"{output}/set")
    written = result(spark, output)
    summary = written.groupBy("source", "part", "label").agg(F.count("*").alias("n"), F.sum("n_windows").alias("n_windows"))
    summary.repartition(1).write.mode("overwrite").json(f"{output}/summary")  # a row per source, part and label
    for r in written.groupBy("part", "label").agg(F.count("*").alias("n"), F.sum("n_windows").alias("w")).orderBy("part", "label").collect():
        LOG.info("wrote %d texts with %d windows to part=%s, label=%s of %s/set", r.n, r.w, r.part, r.label, output)
    LOG.info("read %s and %s; %d labelled texts had no words", documents, labels, spark.read.schema("doc_id long, source string").parquet(f"{output}/left_out").count())


def result(spark: SparkSession, output: str) -> DataFrame:
    """The set as it stands."""
    return spark.read.schema(SCHEMA).parquet(f"{output.rstrip('/')}/set")


if __name__ == "__main__":
    main("training_set", run, {"documents": "Parquet of texts", "labels": "Parquet of labels", "output": "folder of the set"})
