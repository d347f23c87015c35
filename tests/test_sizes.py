"""What shows on larger tables only, on small ones that are made for it."""

import datetime
import importlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from jobs import training_set
from jobs.common import settings
from tracelake.operators import nearest, sampling
from tracelake.streaming import triggers as streams

entry = importlib.import_module("__spark_entry__")


def against_sql(spark, folder, name, **tables):
    """Rows of a query over the given tables, which must be those of its SQL."""
    con = duckdb.connect()
    for k, t in tables.items():
        pq.write_table(t, f"{folder}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM read_parquet('{folder}/{k}.parquet')")
    got = sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()), key=str)
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)
    return got


def embeddings(bins, label=3):
    """A table of embeddings whose bins, times 1000 and cut, are the given ones."""
    rows = [np.float32((np.array(b) + 0.5) / 1000) for b in bins]
    return pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([label] * len(rows), pa.int32())})


def test_baselines_two_spreads_from_the_mode(spark, tmp_path):
    """whether -4 lies within two spreads of -6 is up to the last bit of the spread."""
    level = [-4, -4, -6, -6] * 16
    got = against_sql(spark, tmp_path, "baseline_estimates", embeddings=embeddings([level, [1, -8, -8, -6, -6] * 12 + [-8, -6, -8, -6], [0] * 64]))
    assert len(got) == 3


def test_corrected_baselines_at_the_limit(spark, tmp_path):
    """the same at a trace's ends decides its status."""
    first, last = [-2, 1, -2, -3, -3, 0, 2, 1, 2, -2, 3, 3, -3, 3, 1, 0], [3, -3, -2, 2, 1, 2, 1, -3, -3, 1, -3, 3, -2, 1, -1, 0]
    assert against_sql(spark, tmp_path, "corrected_baselines", embeddings=embeddings([first + [0] * 32 + last, [0] * 64, [0] * 64]))[0][1] == "rejected"


def test_windows_without_charge(spark, tmp_path):
    """counts that add up to nothing are no charge, whatever their quotients add up to."""
    bins = [
        [91, 85, 62, 89, 85, 86, 78, 94, 74, -1, 1, -22, -100, -19, -73, -2, 9, -49, 14, -9, -61, 5, -54, -88],
        [71, 61, 78, 73, 68, 63, 74, 63, 95, -17, -5, -65, -25, 4, -83, -67, -38, -33, -53, -53, -85, -27, 11, -77],
        [35, -39, -55, 29, -39, 30, -21, 8, 52, 50, -3, -36, -30, 42, 10, -40, 46, 55, 56, 14, 57, 12, 0, -561],
    ]
    bins = [b + [0] * 40 for b in bins]
    got = against_sql(spark, tmp_path, "prediction_lifecycle", embeddings=embeddings(bins))
    assert (0, 0, "FP", None) in got


def test_dense_stations_begin_with_fine_cells(spark):
    """cells far too large for the stations are halved first, so points don't meet them all; some lie in one place."""
    r = np.random.default_rng(5)
    xy = np.concatenate([r.integers(0, 4000, (1500, 2)), np.full((700, 2), 77), [[90_000, 90_000]]])
    sites = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(xy)], "s long, sx long, sy long")
    size, most = nearest.crowds(sites.where("s < 1500"), 50_000.0, 8000.0)
    assert 20 < size < 200 and most[size] < 60 and most[50_000.0] == 1500
    at = np.concatenate([r.integers(-500, 4500, (120, 2)), [[77, 77], [85_000, 90_000]]])
    points = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(at)] * 2, "p long, x long, y long")
    got = nearest.nearest(points, sites.toDF("s", "x", "y"), "p", "s", 3, 50_000.0)
    want = []
    for p, (x, y) in enumerate(at):
        d = ((xy - [x, y]) ** 2).sum(1)
        want += [(p, int(s), n + 1, int(d[s])) for n, s in enumerate(np.lexsort([np.arange(len(d)), d])[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_training_set_reads_texts_once(spark, tmp_path, monkeypatch):
    """all that the job writes comes from one pass over the texts."""
    seen, described = spark.sparkContext.accumulator(0), training_set.described

    def counted(doc_id: int) -> int:
        seen.add(1)
        return doc_id

    once = F.udf(counted, "long").asNondeterministic()
    monkeypatch.setattr(training_set, "described", lambda d, *rest: described(d.withColumn("doc_id", once("doc_id")), *rest))
    docs = spark.createDataFrame([(i, "a few words that are long enough to be a signal " + str(i), "web", "en") for i in range(20)], "doc_id long, text string, source string, lang string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels")
    training_set.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out", settings("training_set"))
    assert training_set.result(spark, f"{tmp_path}/out").count() == 20 and seen.value == 20


def test_batches_are_dealt_out_by_their_rows(spark, monkeypatch):
    """more rows are more tasks, not larger ones."""
    monkeypatch.setattr(sampling, "ROWS", 50, raising=False)
    rows = spark.range(2000).selectExpr("id div 4 AS batch", "CASE id % 4 WHEN 0 THEN 'SIG' WHEN 1 THEN 'INT' ELSE 'BKG' END AS label", "id")
    out = sampling.balanced(rows, "batch", 0.25, ["id"])
    assert out.rdd.getNumPartitions() >= 40 and out.count() == 2000
    assert sampling.balanced(rows, "batch", 0.5, ["id"]).count() == 1000


def test_coincidences_hold_few_rows_of_a_trigger(spark):
    """a trigger is kept in the cells that its window touches, mostly one, not in three."""
    times = spark.range(400).selectExpr("timestamp_seconds(id * 7) AS ts")
    n = times.select(F.sum(F.size(streams.touched("ts", 60)))).first()[0]
    assert 400 <= n <= 1.6 * 400


def test_running_counts_of_many_channels(spark, tmp_path):
    """F8: channels share states and calls by bucket; their windows go on over batches all the same."""
    for i in range(3):
        bins = spark.range(3000).selectExpr("id AS k", f"explode(sequence({3 * i}L, {3 * i + 2}L)) AS pos").selectExpr("*", "pmod(xxhash64(k, pos), 2) + 0.0D AS v")
        bins.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "k long, pos long, v double"
    streams.drain(streams.running_counts(streams.staged(spark, f"{tmp_path}/in", schema, 1), ["k"], "pos", "v", 5, 0.5), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema("k long, pos long, act long").parquet(f"{tmp_path}/out")
    want = spark.read.parquet(f"{tmp_path}/in").selectExpr("k", "pos", "count_if(v > 0.5) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS act").where("pos >= 4")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() < 1500


@pytest.mark.parametrize("width", [1, 4])
def test_running_counts_keep_keys_apart(spark, tmp_path, width):
    """F8: channels of a bucket don't touch each other: nulls, long keys, channels that rest for a batch, bins without a position."""
    big, day = 2**60, datetime.date(2020, 1, 1)
    keys = [(a, b, day if n % 2 else None) for n in range(30) for a, b in ((f"s{n}", big + n), (f"s{n}", None), (None, big + n))] + [(None, None, None)]
    for batch in range(4):
        rows = [(*k, big + 2 * batch + j, float((i + batch * j) % 3)) for i, k in enumerate(keys) for j in range(2) if batch == 0 or i % 3 != batch % 3]
        rows += [(*keys[0], None, 2.0), (*keys[1], None, None)] if batch == 3 else []
        spark.createDataFrame(rows, "a string, b long, c date, pos long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.staged(spark, f"{tmp_path}/in", "a string, b long, c date, pos long, v double", 1)
    streams.drain(streams.running_counts(stream, ["a", "b", "c"], "pos", "v", width, 0.5), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema("a string, b long, c date, pos long, act long").parquet(f"{tmp_path}/out")
    over = f"OVER (PARTITION BY a, b, c ORDER BY pos NULLS LAST ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    want = spark.read.parquet(f"{tmp_path}/in").selectExpr("a", "b", "c", "pos", f"count_if(v > 0.5) {over} AS act", f"count(1) {over} AS n").where(f"n = {width}").drop("n")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_counts_of_odd_vectors(spark, tmp_path):
    """F8: NaN is above the level and null is not, as in SQL; vectors may be of any length or null."""
    r = np.random.default_rng(5)
    odd = [float("nan"), float("inf"), None, -0.5, 0.5]
    rows = [[odd[i] for i in r.integers(0, 5, n)] for n in (64, 64, 100, 24, 23, 0, 31)] + [None]
    t = pa.table({"vec_id": pa.array([0, 1, 2**60 + 1, 3, 4, 5, None, 7], pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([3] * 8, pa.int32())})
    assert len(against_sql(spark, tmp_path, "stream_running_counts", embeddings=t)) == 41 + 41 + 77 + 1 + 8


def test_coincidences_keep_a_value_for_each_stretch(spark, tmp_path):
    """the state has a value for a stretch of time, not two for each trigger; pairs meet over batches that overlap in time."""
    rows = spark.range(2000).selectExpr("timestamp_seconds(id * 17 + pmod(xxhash64(id), 900) + 0.000001D) AS ts", "pmod(xxhash64(id, 3), 5) AS s", "id div 500 AS part")
    for i in range(4):
        rows.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    a, b = (streams.staged(spark, f"{tmp_path}/in", "ts timestamp, s long", 1) for _ in range(2))
    streams.drain(streams.coincidences(a, b, "ts", "s", 60, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.schema("t1 timestamp, s1 long, t2 timestamp, s2 long").parquet(f"{tmp_path}/out")
    e = spark.read.parquet(f"{tmp_path}/in")
    near = "y.ts BETWEEN x.ts - interval 60 seconds AND x.ts + interval 60 seconds AND x.s < y.s"
    want = e.alias("x").join(e.alias("y"), F.expr(near)).selectExpr("x.ts", "x.s", "y.ts", "y.s")
    assert got.count() > 2000 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() <= 3
