import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A
from tracelake.operators import fits, metrics, sampling, triggers, windows
from tracelake.queries import QUERIES
from tracelake.sources import traces as sources

SCHEMA = "station int, p1 array<double>, p2 array<double>, p3 array<double>"


def bins(value, at, n=120):
    x = [0.0] * n
    for i in at:
        x[i] = value
    return x


def one(spark, row, *cols):
    return spark.createDataFrame([(1, *row)], SCHEMA).select(*cols).first()


def test_over_threshold_fixture(spark):
    p = [F.col(c) for c in triggers.PMTS]
    run = range(20, 33)
    fires = triggers.over_threshold(*p).alias("tot"), triggers.threshold(*p).alias("th")
    assert tuple(one(spark, (bins(0.3, run), bins(0.21, run), bins(0.1, run)), *fires)) == (True, False)
    assert not one(spark, (bins(0.3, run[1:]), bins(0.21, run[1:]), bins(0.1, run)), *fires).tot
    assert tuple(one(spark, [bins(4.0, [40])] * 3, *fires)) == (False, True)
    edge = triggers.threshold(*p).alias("a"), triggers.threshold(*p, strict=False).alias("b")
    assert tuple(one(spark, [bins(3.2, [40])] * 3, *edge)) == (False, True)


def test_unknown_trigger_raises():
    with pytest.raises(KeyError):
        triggers.any_of(["th"], None, None, None)


def test_digitize(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 33.56, 50.0, 65.37, 70.0, math.nan)], "x double")
    assert [r[0] for r in df.select(A.digitize(F.col("x"), C.ZENITH_EDGES)).collect()] == [0, 1, 2, 3, 6, 6, 6]


def test_dead_time(spark):
    df = spark.createDataFrame([([0, 30, 60, 90, 200],), ([],)], "h array<long>")
    assert [r[0] for r in df.select(windows.dead_time(F.col("h"), 49)).collect()] == [[0, 60, 200], []]


def test_downsample_equals_definition(spark):
    x = np.random.default_rng(3).integers(-50, 900, 200).astype(float)
    t = x[: len(x) // 3 * 3]
    padded = np.concatenate([t[10:0:-1], t, t[-1:-11:-1], [0]])
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    for phase in range(3):
        want = [int(sum(padded[k + j] * C.FIR_TAPS[j] for j in range(21))) >> 11 for k in range(phase, len(t), 3)]
        assert df.select(A.downsample(F.col("x"), phase)).first()[0] == want


def test_efficiency_error(spark):
    row = spark.range(1).select(*metrics.efficiency(F.lit(3), F.lit(1))).first()
    assert row.eff == 0.75 and abs(row.eff_err - (3**1.5 - 1) / 16) < 1e-12


def test_coincidence(spark):
    rows = [(e, d, f, i) for e, flags in ((1, "ttft"), (2, "tttf"), (3, "tt")) for i, (d, f) in enumerate(zip((10, 20, 30, 40), [c == "t" for c in flags]))]
    df = spark.createDataFrame(rows, "event int, d int, f boolean, s int")
    assert dict(map(tuple, triggers.coincidence(df, "event", "d", "f", "s").collect())) == {1: False, 2: True, 3: False}


def test_lateral_keeps_nan(spark):
    row = spark.range(1).select(A.lateral(F.lit(math.nan), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("y")).first()
    assert math.isnan(row.y)


def test_lateral_fit(spark):
    x = np.arange(0, 100, 5.0)
    rows = [(1, float(a), float(0.9 * (1 - 1 / (1 + np.exp((a - 40) / 8))))) for a in x]
    got = fits.fit_lateral(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).first()
    assert abs(got.efficiency - 0.9) < 1e-3 and abs(got.p50 - 40) < 1e-2 and abs(got.width + 8) < 1e-2


def test_hits_and_misses_over_all_orders(spark, small):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]
    bins, hits = dict(read("supplier", "s_suppkey", "s_nationkey")), collections.Counter()
    for order, supplier in set(read("lineitem", "l_orderkey", "l_suppkey")):
        hits[order, bins.get(supplier)] += 1
    n = collections.Counter(bins.values())
    want = sorted((o, b, hits[o, b], n[b] - hits[o, b]) for (o,) in read("orders", "o_orderkey") for b in n)
    assert sorted(map(tuple, QUERIES["hits_and_misses"](spark, small).collect())) == want


def test_stream_dead_time_over_many_files(spark, tmp_path):
    """Files that overlap in time, more than 50 of them."""
    rows = [(i, i % 3, i * 7919 % 900 * 1000, 30.0) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double")
    df.selectExpr("event_id", "user_id", "timestamp_seconds(s) ts", "value").repartition(70).write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for user in range(3):
        last = None
        for at in sorted(s for _, u, s, _ in rows if u == user):
            if last is None or at > last + 43200:
                want.append((user, at))
                last = at
    assert sorted(map(tuple, QUERIES["stream_dead_time"](spark, str(tmp_path)).collect())) == want


def test_station_files(spark, tmp_path):
    good = "\n".join("7 500 1e18 33.5 1 2 3 " + " ".join(str(p * 10 + i) for i in range(n)) for p, n in ((1, 4), (2, 4), (3, 4)))
    bad = "8 600 1e18 33.5 1 2 3 1\n9 600 1e18 33.5 1 2 3 1\n8 600 1e18 33.5 1 2 3 1"
    (tmp_path / "a.csv").write_text(good + "\n" + bad + "\n")
    rows = sources.station_traces(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.station_id, r.spd, r.pmt[2]) for r in rows] == [(7, 500, [30.0, 31.0, 32.0, 33.0])]


def test_file_choices():
    libs = {"a": ["a1.csv", "a.txt"], "b": ["b1.csv"], "c": ["c1.csv"]}
    assert sources.resolve(libs, "all") == ["a1.csv", "b1.csv", "c1.csv"]
    assert sources.resolve(libs, "a:c") == ["a1.csv", "b1.csv"] == sources.resolve(libs, "a:")
    assert sources.resolve(libs, [["a", "b"], "c"]) == ["a1.csv", "b1.csv", "c1.csv"]


def test_controller():
    assert [fits.next_unit(r, 100.0) for r in (50, 65, 70, 75, 90)] == [(90.0, False), (99.0, False), (100.0, True), (101.0, False), (110.0, False)]


def test_triangle_is_inside(spark):
    a, b = sampling.triangle(A.lcg(F.col("id")), A.lcg(F.col("id") + 5))
    row = spark.range(500).select(a.alias("a"), b.alias("b")).agg(F.min("b"), F.max(F.col("b") + 3**0.5 * F.col("a"))).first()
    assert row[0] >= 0 and row[1] <= 3**0.5 + 1e-9
