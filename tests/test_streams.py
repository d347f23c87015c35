"""Coincidences, joins in time without a task per key, and streams over many batches, against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import coincidences, fits, joins, nearest, records
from tracelake.sources import store, traces
from tracelake.streaming import triggers as streams

START = datetime(2024, 1, 1)


def plain_ranges(rows, width, need):
    level = {}
    top = max(t for _, t in rows) + width + 2
    times = {}
    for s, t in rows:
        times.setdefault(s, set()).add(t)
    for s, ts in times.items():
        for x in set().union(*(range(t, t + width + 1) for t in ts)):
            level[x] = level.get(x, 0) + 1
    out, first = [], None
    for x in range(top + 1):
        if level.get(x, 0) >= need and first is None:
            first = x
        if level.get(x, 0) < need and first is not None:
            out.append((first, x - 1, max(level[y] for y in range(first, x))))
            first = None
    return sorted(out)


@pytest.mark.parametrize("segments, width, need", [(1, 11, 3), (16, 11, 3), (5, 3, 2), (256, 0, 2)])
def test_coincidences_equal_plain(spark, segments, width, need):
    r = random.Random(segments)
    rows = [(r.randrange(6), r.randrange(3000)) for _ in range(500)] + [(9, t) for t in range(1000, 1300, 2)]  # one station never rests
    rows += [(s, t) for s in (1, 2) for t in (2000, 2000 + width, 2001 + width)]
    df = spark.createDataFrame([*rows, *rows[:50], (None, 5), (3, None)], "station int, t long").repartition(4)
    got = coincidences.ranges(df, "station", "t", width, need, segments).collect()
    assert sorted((x["first"], x["last"], x.stations) for x in got) == plain_ranges(rows, width, need)
    assert coincidences.ranges(df.limit(0), "station", "t").count() == 0


@pytest.mark.parametrize("segments", [1, 7, 64])
def test_nearest_in_time_of_one_key(spark, segments):
    r = random.Random(segments)
    at = lambda s: START + timedelta(seconds=s)
    left = [(i, r.choice([1, 1, 1, 2, None]), r.randrange(5000)) for i in range(300)]
    right = [(1, r.choice([r.randrange(2000), 4000 + r.randrange(500)]), float(i)) for i in range(60)] + [(2, 10, 5.0), (1, 77, 1.0), (1, 77, 2.0)]
    l = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id int, k int, ts timestamp")  # noqa: E741
    rt = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k int, ts timestamp, v double")
    got = {x.id: x for x in joins.nearest_in_time(l, rt, "k", "ts", "v", segments).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        near = min(((abs(t - u), u, -v) for q, u, v in right if q == k), default=None)
        assert (got[i].nearest_time, got[i].nearest_value) == ((at(near[1]), -near[2]) if near else (None, None))


def test_one_key_is_spread(spark):
    n = 4000
    l = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), "id")  # noqa: E741
    r = spark.range(50).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 800).alias("ts"), F.col("id").cast("double").alias("v"))
    out = joins.nearest_in_time(l, r, "k", "ts", "v")
    sizes = [x.c for x in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum(sizes) == n and "SinglePartition" not in plan
    segments = out.sparkSession.createDataFrame([(1,)], "x int")  # the window's partitions are segments, not keys
    assert segments.count() == 1 and "_segment" in plan


def micro(t):
    return START + timedelta(microseconds=t)


def stream_of(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.staged(spark, folder, schema, 1)


@pytest.mark.parametrize("late", [400, 5000])
def test_dead_time_over_overlapping_batches(spark, tmp_path, late):
    """Files overlap by less than the lateness; the rows that the watermark has passed are those of the plain recursion."""
    r = random.Random(late)
    rows = [(r.randrange(4), r.randrange(10_000) * 1000 + r.randrange(1000), i) for i in range(600)]
    order = sorted(rows, key=lambda x: x[1] + r.randrange(300_000))
    batches = [[(k, micro(t), i, t // 1000) for k, t, i in order[j : j + 100]] for j in range(0, 600, 100)]
    stream = stream_of(spark, f"{tmp_path}/in", batches, "k int, ts timestamp, id long, at long")
    out = streams.in_order(stream, "k", "ts", "id", "at", f"{late} milliseconds", streams.dead_time_rule(49), "at long")
    with streams.state_store(spark):
        streams.drain(out, f"{tmp_path}/out", f"{tmp_path}/state")
    progress = spark.read.text(f"{tmp_path}/state/commits")
    assert progress.select(F.input_file_name()).distinct().count() >= 6
    end = max(t for _, t, _ in rows) // 1000 - late
    want = []
    for k in range(4):
        last = None
        for t in sorted(t for q, t, _ in rows if q == k and t // 1000 < end):
            if last is None or t // 1000 > last + 49:
                last = t // 1000
                want.append((k, last))
    assert sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(want)


def test_running_counts_go_on_over_batches(spark, tmp_path):
    r = np.random.default_rng(3)
    v = {k: r.random(200) for k in range(3)}
    cuts = [0, 1, 7, 60, 61, 130, 200]
    batches = [[(k, p, float(v[k][p])) for k in v for p in r.permutation(np.arange(a, b)).tolist()] for a, b in zip(cuts, cuts[1:])]
    stream = stream_of(spark, f"{tmp_path}/in", batches, "k int, pos long, v double")
    streams.drain(streams.running_counts(stream, ["k"], "pos", "v", 12, 0.4), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select("k", "pos", "act").collect())
    assert got == [(k, p, int((v[k][p - 11 : p + 1] > 0.4).sum())) for k in v for p in range(11, 200)]


def test_infinite_points_take_no_part_in_a_fit(spark):
    x = np.arange(1.0, 20.0)
    y = 0.9 * (1 - 1 / (1 + np.exp((x - 10.0) / 2.0)))
    rows = [(1, float(a), float(b), 1.0) for a, b in zip(x, y)]
    bad = [(1, float("inf"), 0.5, 1.0), (1, 5.0, float("-inf"), 1.0), (1, 5.0, float("nan"), 1.0), (1, 5.0, 0.0, float("inf")), (1, None, 0.1, 1.0), (1, 3.0, 0.1, None)]
    clean, dirty = (fits.fit_lateral(spark.createDataFrame(d, "k int, x double, y double, w double"), ["k"], weight="w").first() for d in (rows, rows + bad))
    assert abs(clean.p50 - 10) < 1e-3 and tuple(clean) == tuple(dirty)


@pytest.mark.parametrize("dead, segment", [(49, 100), (49, 7), (0, 30), (500, 64), (3, 10_000)])
def test_dead_time_of_segments_equals_the_recursion(spark, dead, segment):
    r = random.Random(dead + segment)
    hits = {k: sorted(r.sample(range(-500, 3000), n)) for k, n in ((1, 700), (2, 40), (3, 1))}
    rows = [(k, h) for k, hs in hits.items() for h in hs] + [(1, hits[1][0]), (None, 4), (2, None)]
    df = spark.createDataFrame(rows, "k int, at long").repartition(5)
    want = []
    for k, hs in hits.items():
        last = None
        for h in hs:
            if last is None or h > last + dead:
                want.append((k, h))
                last = h
    assert sorted(tuple(x) for x in records.dead_time(df, "k", "at", dead, segment).collect()) == sorted(want)


@pytest.mark.parametrize("size, n_stations", [(4.0, 60), (5000.0, 60), (60.0, 2), (3.0, 0)])
def test_nearest_equals_brute_force(spark, size, n_stations):
    r = random.Random(n_stations)
    stations = [(i, r.randrange(30), r.randrange(30)) for i in range(n_stations - n_stations // 6)] + [(100 + i, 300 + i, -90) for i in range(n_stations // 6)]
    points = [(i, r.randrange(-10, 40), r.randrange(-10, 40)) for i in range(150)] + [(500, 290, -80), (501, 900, 0), (501, 900, 0)]
    p = spark.createDataFrame([*points, (None, 1, 1), (7, None, 1)], "p int, x int, y int").withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))
    s = spark.createDataFrame([*stations, (None, 1, 1), (1000, None, 1)], "s int, x int, y int").withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))
    got = sorted((x.p, x.nth, x.s, int(x.square)) for x in nearest.nearest(p, s, "p", "s", 3, size).collect())
    want = []
    for i, x, y in set(points):
        order = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in stations)[:3]
        want += [(i, n + 1, j, d) for n, (d, j) in enumerate(order)]
    assert got == sorted(want)


def test_text_files_are_split(spark, tmp_path):
    """Blocks of three lines that splits cut through, over several files and tasks, with blank lines at the end."""
    r = random.Random(2)
    want = set()
    for f in range(2):
        lines = []
        for b in range(400):
            bins = [[r.randrange(99) for _ in range(1 + b % 9)] for _ in range(3)]
            lines += [" ".join(map(str, x)) for x in bins]
            want.add((f"f{f}.csv", b, tuple(tuple(map(float, x)) for x in bins)))
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = traces.noise_traces(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want) and {(x.event_file.rsplit("/", 1)[1], x.block, tuple(map(tuple, x.pmt))) for x in got} == want


def test_a_job_that_runs_again_replaces_its_rates(spark, tmp_path):
    path = f"file://{tmp_path}/rates"
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 4)], "scale int, file string, n long")
    traces.append_rates(rows, path, "p0")
    traces.append_rates(rows.where("scale = 1"), path, "p1")
    traces.append_rates(rows, path, "p0")
    assert sorted((x.job, x.scale, x.n) for x in spark.read.parquet(path).collect()) == [("p0", 1, 3), ("p0", 2, 4), ("p1", 1, 3)]


def test_rows_that_raise_are_put_aside(spark):
    def work(rows):
        if (rows["x"] % 5 == 0).any():
            raise KeyError("five")
        if (rows["x"] % 7 == 0).any():
            raise ValueError("seven")
        return rows.assign(y=rows["x"] * 2.0)[["id", "y"]]

    df = spark.range(0, 100, 1, 3).select("id", (F.col("id") + 1).alias("x"))
    got = {(x.id, x.y, x.failed_key, x.error) for x in traces.quarantined(df, work, "id long, y double", "id").collect()}
    assert got == {(i, 2.0 * (i + 1), None, None) if (i + 1) % 5 and (i + 1) % 7 else (None, None, str(i), "ValueError" if (i + 1) % 5 else "KeyError") for i in range(100)}
    assert traces.quarantined(df.limit(0), work, "id long, y double", "id").count() == 0


def test_store_opens_what_is_asked_for_and_joins_without_a_shuffle(spark, tmp_path):
    events = spark.range(400).select(F.col("id").alias("event"), (F.col("id") * 10.0).alias("energy"))
    stations = events.select("event", "energy", F.explode(F.array(*map(F.lit, range(3)))).alias("station"))
    edges = (1000.0, 2000.0, 3000.0)
    a, b = (store.write(df, f"file://{tmp_path}/{n}", "event", F.col("energy"), edges, 4) for n, df in (("a", events), ("b", stations)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = store.together(store.opened(spark, a, 1, 3), store.opened(spark, b, 1, 3).select("event", "energy_range", "station"), "event")
        out = both.groupBy("event").agg(F.count("*").alias("n")).collect()
        plan = both.groupBy("event").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.event, r.n) for r in out) == [(i, 3) for i in range(100, 300)]
    assert "Exchange" not in plan and plan.count("PartitionFilters: [isnotnull(energy_range") == 2
