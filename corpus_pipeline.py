"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets; run() writes each stage's rows
to the shared folder and reads them again.  All but the last return the columns of `documents`.

Cases: a document with a null or empty text is like no other and holds no passage, so it passes the first three
stages, and is never drawn by the mixture; null and repeated doc_ids stand for as many documents as they have rows;
rows that are equal in doc_id and text are copies of each other; further columns are carried along, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, jaccard, mixing, suffixes, toxicity
from tracelake.llm.common import drop, fresh, spread, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id.  Documents that are like
    no other stay, whatever ids they share."""
    return jaccard.survivors(spark, docs, k=5, per_cent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; documents of which nothing is left go too.  Where a cut falls
    inside a character, its remaining bytes go as well."""
    gone = fresh("gone", docs)
    kept = suffixes.cleaned(spark, docs, length=100, gone=gone)
    kept = kept.where(f"{gone} IS NULL OR {gone} = 0 OR text <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return kept.drop(gone)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    return mixing.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", passages),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Trained trees, suffix repeats in bytes and merges aren't expressible; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(spark, stage(spark, docs, sf_dir), name)
        if n:
            drop(spark, before)
    return docs
