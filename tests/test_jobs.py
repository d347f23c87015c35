"""The jobs over growing input, failed runs and reruns."""

import collections
import json
import math
import sys
from datetime import datetime, timedelta

import pytest

from jobs import common, training_set, trigger_rates
from tracelake.operators import ordering

CONFIG = {"station": "user_id", "event": "event_id", "time": "ts", "signal": "value", "levels": {"th1": 5.0, "th2": 20.0}, "files_per_batch": 2}
EVENTS = "event_id long, ts timestamp, user_id long, value double, extra string"
START = datetime(2024, 3, 1)


def event(i, day, station, value):
    return (i, START + timedelta(days=day, seconds=i), station, value, "x")


def plain_rates(rows):
    once = {}
    for r in rows:
        if None not in r[:4] and math.isfinite(r[3]):
            once.setdefault((r[1].strftime("%Y-%m-%d"), r[0]), r)
    out = collections.defaultdict(lambda: [0, 0, 0])
    for (day, _), r in once.items():
        out[day, r[2]] = [a + b for a, b in zip(out[day, r[2]], (1, r[3] > 5, r[3] > 20))]
    return {k: tuple(v) for k, v in out.items()}


def found_rates(spark, output):
    rows = trigger_rates.result(spark, output, CONFIG).collect()
    assert len(rows) == len({(r.day, r.station) for r in rows})
    assert all(r.rate_th2 == r.n_th2 / 86400 and r.rate_th2_err == math.sqrt(r.n_th2) / 86400 for r in rows)
    return {(r.day, r.station): (r.n_all, r.n_th1, r.n_th2) for r in rows}


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_rates_over_growing_input(spark, tmp_path):
    source, output = f"file://{tmp_path}/in", f"file://{tmp_path}/out/"
    first = [event(i, i % 3, i % 5, float(i % 40)) for i in range(200)]
    bad = [(None, START, 1, 9.0, "x"), (900, None, 1, 9.0, "x"), (901, START, None, 9.0, "x"), (902, START, 1, None, "x"), (903, START, 1, math.nan, "x"), (904, START, 1, math.inf, "x")]
    for part in (first[:50], first[50:120], first[120:] + bad):
        deliver(spark, source, part)
    trigger_rates.run(spark, source, output, CONFIG)
    assert found_rates(spark, output) == plain_rates(first)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/rates").rglob("*.parquet")}
    decisions = spark.read.parquet(f"{output}decisions")
    assert decisions.where("status = 'rejected'").count() == len(bad)

    trigger_rates.run(spark, source, output, CONFIG)  # nothing new
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out/rates").rglob("*.parquet")} == before

    more = [event(i, 2 + i % 2, i % 7, float(i % 40)) for i in range(300, 360)]
    again = [(i, t, s, 99.0, x) for i, t, s, _, x in first[2::3][:10]]  # delivered before: counts no more
    deliver(spark, source, more + again + more[:5])
    trigger_rates.run(spark, source, output, CONFIG)
    assert found_rates(spark, output) == plain_rates(first + more + again)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/rates").rglob("*.parquet")}
    untouched = [p for p in before if "day=2024-03-01" in str(p) or "day=2024-03-02" in str(p)]
    assert untouched and all(after.get(p) == before[p] for p in untouched)
    whole = f"file://{tmp_path}/whole"
    trigger_rates.run(spark, source, whole, CONFIG | {"files_per_batch": 100})
    assert {k: v[0] for k, v in found_rates(spark, whole).items()} == {k: v[0] for k, v in found_rates(spark, output).items()}


def test_a_failed_batch_is_taken_again(spark, tmp_path, monkeypatch):
    source, output = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = [event(i, i % 2, i % 3, float(i)) for i in range(40)]
    deliver(spark, source, rows)
    work = trigger_rates.rates

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(trigger_rates, "rates", broken)
    with pytest.raises(Exception, match="lost"):
        trigger_rates.run(spark, source, output, CONFIG)
    monkeypatch.setattr(trigger_rates, "rates", work)
    trigger_rates.run(spark, source, output, CONFIG)
    assert found_rates(spark, output) == plain_rates(rows)
    assert spark.read.parquet(f"{output}/decisions").count() == len(rows)


SET = {"prior": 0.25, "train_share": 0.7, "window": 20, "step": 5, "ignore_words": 2, "ignore_chars": 12}


def texts(n=300):
    rows = [(i, " ".join(["wort"] * (i % 11)) if i % 13 else None, ["hot", "hot", "a", None][i % 4], "en" if i % 3 else None) for i in range(n)]
    return rows + [(n + i, "mehrere worte in einem text", "quiet", "de") for i in range(9)] + [(None, "ohne nummer", "a", "de")]


def write_texts(spark, tmp_path, rows):
    marks = [(d, int(d % 10 == 0 and d < 300)) for d, *_ in rows if d is not None and d % 7] + [(10, 0), (11, None), (None, 1), (99_999, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/docs")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels")
    return marks


@pytest.mark.parametrize("bucket", [4096, 5])
def test_training_set(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(ordering, "BUCKET", bucket)
    rows = texts()
    marks = write_texts(spark, tmp_path, rows)
    out = f"file://{tmp_path}/out"
    paths = [f"file://{tmp_path}/docs", f"file://{tmp_path}/labels", out]
    training_set.run(spark, *paths, SET)
    got = sorted(tuple(r) for r in training_set.result(spark, out).collect())
    training_set.run(spark, *paths, SET)
    assert sorted(tuple(r) for r in training_set.result(spark, out).collect()) == got

    positive = collections.defaultdict(bool)
    for d, y in marks:
        if d is not None and y is not None:
            positive[d] |= y > 0
    by_source = collections.defaultdict(collections.Counter)
    assert len({r[0] for r in got}) == len(got)
    for d, text, source, _ in rows:
        if d in positive and text:
            n = len(text.split())
            by_source[source or ""]["BKG" if not positive[d] else "PRT" if n <= 2 else "INT" if len(text) <= 12 else "SIG"] += 1
    for source, want in by_source.items():
        kept = collections.Counter(r[7] for r in got if r[1] == source)
        room = want["SIG"] * 3 - want["PRT"] - want["INT"]
        assert kept == +collections.Counter({**want, "BKG": max(0, min(want["BKG"], room))} if want["SIG"] else {})
    whole = {d: t for d, t, *_ in rows}
    for d, _, _, chars, words, windows, _, _ in got:
        assert (chars, words, windows) == (len(whole[d]), len(whole[d].split()), max(0, (len(whole[d]) - 20) // 5 + 1))
    assert {r[6] for r in got} == {"train", "validate"} and (tmp_path / "out/set/part=train/label=SIG").is_dir()
    left = {r.doc_id for r in spark.read.parquet(f"{out}/left_out").collect()}
    assert left == {d for d, t, *_ in rows if d in positive and not t}
    summary = spark.read.json(f"{out}/summary").collect()
    assert sum(r.n for r in summary) == len(got)

    parts = {r[0]: r[6] for r in got}
    write_texts(spark, tmp_path, rows + [(1000 + i, "neue worte im text hier", "hot", "de") for i in range(50)])
    training_set.run(spark, *paths, SET)  # a row keeps its part as the tables grow
    now = {r.doc_id: r.part for r in training_set.result(spark, out).collect()}
    assert all(parts[d] == p for d, p in now.items() if d in parts)


def test_command_line(spark, tmp_path, monkeypatch):
    """The command line makes a session and stops it; here both are stand-ins for the tests' session."""
    stopped = []

    class Session:
        class builder:
            @staticmethod
            def appName(name):
                return Session.builder

            @staticmethod
            def getOrCreate():
                return Session()

        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            stopped.append(True)

    monkeypatch.setattr(common, "SparkSession", Session)
    deliver(spark, f"{tmp_path}/in", [event(i, 0, 1, 30.0) for i in range(3)])
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    monkeypatch.setattr(sys, "argv", ["x", "--source", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/config.json"])
    common.main("trigger_rates", trigger_rates.run, {"source": "", "output": ""})
    assert stopped and found_rates(spark, f"{tmp_path}/out") == {("2024-03-01", 1): (3, 3, 3)}
