"""The jobs as queries over whole tables: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import training_set, trigger_rates
from jobs.common import settings
from tracelake.sources.sinks import scratch


def job1_trigger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, output = settings("trigger_rates"), scratch(spark, "job1")
    for _ in range(2):
        trigger_rates.run(spark, f"{sf_dir}/events.parquet*", output, config)
    return trigger_rates.result(spark, output, config)


def job2_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch(spark, "job2")
    for _ in range(2):
        training_set.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output, settings("training_set"))
    return training_set.result(spark, output)


QUERIES = {f.__name__: f for f in (job1_trigger_rates, job2_training_set)}

_RATES, _SET = settings("trigger_rates"), settings("training_set")
_LEVELS = ", ".join(
    f"count(*) FILTER (WHERE value > {v}) AS n_{n}, count(*) FILTER (WHERE value > {v}) / 86400.0::DOUBLE AS rate_{n}, "
    f"sqrt(count(*) FILTER (WHERE value > {v})) / 86400.0::DOUBLE AS rate_{n}_err"
    for n, v in _RATES["levels"].items()
)
_DRAW = "('0x' || substr(md5('{}' || doc_id::VARCHAR), 1, 13))::BIGINT"

ORACLE_SQL = {
    "job1_trigger_rates": f"""
        SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS station, count(*) AS n_all, {_LEVELS} FROM events
        WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND isfinite(value) GROUP BY 1, 2""",
    "job2_training_set": f"""
        WITH m AS (SELECT doc_id, max(toxic) > 0 AS positive FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
        d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, positive, length(coalesce(text, '')) AS n_chars,
            len(regexp_extract_all(coalesce(text, ''), '{training_set.WORD}')) AS n_words FROM documents JOIN m USING (doc_id)),
        r AS (SELECT doc_id, source, lang, n_chars, n_words,
            CASE WHEN n_chars >= {_SET['window']} THEN (n_chars - {_SET['window']}) // {_SET['step']} + 1 ELSE 0 END AS n_windows,
            CASE WHEN {_DRAW.format('part')} < {int(_SET['train_share'] * 2**52)} THEN 'train' ELSE 'validate' END AS part,
            CASE WHEN NOT positive THEN 'BKG' WHEN n_words <= {_SET['ignore_words']} THEN 'PRT' WHEN n_chars <= {_SET['ignore_chars']} THEN 'INT' ELSE 'SIG' END AS label,
            {_DRAW.format('order')} AS o FROM d WHERE n_words > 0),
        c AS (SELECT *, count(*) FILTER (WHERE label = 'SIG') OVER (PARTITION BY source) AS s, count(*) FILTER (WHERE label IN ('INT', 'PRT')) OVER (PARTITION BY source) AS k,
            row_number() OVER (PARTITION BY source, label ORDER BY o, doc_id) AS nth FROM r)
        SELECT doc_id, source, lang, n_chars, n_words::BIGINT AS n_words, n_windows::BIGINT AS n_windows, part, label FROM c
        WHERE s > 0 AND (label <> 'BKG' OR nth <= floor(s * (1 - {_SET['prior']}) / {_SET['prior']}) - k)""",
}
