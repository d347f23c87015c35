"""Queries on files, extractions, sinks, sampling, joins of files and fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake import config as C
from tracelake.functions import arrays as A
from tracelake.operators import fits, joins, metrics, sampling, triggers
from tracelake.plans.rate_queries import _GRID, EDGES, _grid, _lines
from tracelake.plans.registry import TR, TRI, formula, integer_stations, query, stations, table
from tracelake.plans.relation_queries import _LAB, _lcg_sql
from tracelake.plans.trace_queries import P, _digest, _digest_sql, _p
from tracelake.sources import extracts, sinks, store, traces
from tracelake.streaming import triggers as streams


def _text_lines(s, head):
    """Three lines per station: metadata, then samples."""
    line = lambda p: F.concat_ws(" ", head, F.transform(p, lambda v: v.cast("long").cast("string")))
    return s.select(F.concat_ws("\n", *[line(F.col(p)) for p in P]).alias("value"))


@query(f"""WITH {TRI} SELECT station::INT AS station_id, (label * 100)::INT AS spd, label::INT AS n_mu, 3 AS n_pmt, (list_sum(p1) + 2 * list_sum(p2) + 3 * list_sum(p3))::BIGINT AS total, len(p1)::INT AS bins FROM ti""")
def station_files(spark, sf_dir):
    """Stations written as text and read again."""
    path = sinks.scratch(spark, "station_files")
    s = integer_stations(spark, sf_dir)
    head = F.concat_ws(" ", F.col("station"), F.col("label") * 100, F.lit("1e18"), F.lit("33.5"), F.col("label"), F.lit("0"), F.lit("0"))
    _text_lines(s, head).write.text(path)
    t = traces.station_traces(spark, path)
    total = F.expr("aggregate(transform(pmt, (x, i) -> (i + 1) * aggregate(x, 0D, (a, v) -> a + v)), 0D, (a, v) -> a + v)")
    return t.select("station_id", F.col("spd").cast("int").alias("spd"), "n_mu", F.size("pmt").alias("n_pmt"), total.cast("long").alias("total"), F.size(F.col("pmt")[0]).alias("bins"))


@query(f"""WITH {TRI} SELECT p1[1] AS first_1, p2[1] AS first_2, p3[1] AS first_3, (list_sum(p1) - p1[1])::BIGINT AS total, (len(p1) - 1)::INT AS bins FROM ti""")
def noise_files(spark, sf_dir):
    """Noise traces whose first value is the station's own baseline."""
    path = sinks.scratch(spark, "noise_files")
    _text_lines(integer_stations(spark, sf_dir), F.lit(None).cast("string")).write.text(path)
    t = traces.noise_traces(spark, path, with_baseline=True)
    return t.select(*[F.col("baseline")[i].alias(f"first_{i + 1}") for i in range(3)], A.total(F.col("pmt")[0]).cast("long").alias("total"), F.size(F.col("pmt")[0]).alias("bins"))


@query("""SELECT s_suppkey::DOUBLE AS a, s_nationkey::DOUBLE AS c FROM supplier""")
def lookup_table(spark, sf_dir):
    """Two columns of a numeric table."""
    path = sinks.scratch(spark, "lookup")
    s = table(spark, sf_dir, "supplier")
    s.select(F.concat_ws(" ", "s_suppkey", F.lit("0.5"), "s_nationkey").alias("value")).unionByName(spark.sql("SELECT '# a b c' AS value")).write.text(path)
    return traces.lookup(spark, path, ["a", "b", "c"]).select("a", "c")


@query("""SELECT l_linenumber::BIGINT AS line, count(*) AS n, sum(l_suppkey)::BIGINT AS keys FROM lineitem GROUP BY 1""")
def json_event_tables(spark, sf_dir):
    """Event records with arrays of station records, a document to a line, written and read as tables."""
    path = sinks.scratch(spark, "json")
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    l.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linenumber")).alias("stations")).write.json(path)
    found = traces.json_events(spark, path, ["stations"], whole=False)["stations"]
    return found.groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("keys"))


@query(f"""WITH {TRI}, b AS (SELECT label, pos, sum(v) AS v FROM (SELECT label, unnest(range(64)) AS pos, unnest(p1) AS v FROM ti) GROUP BY 1, 2)
SELECT label, sum(v * (pos + 1))::BIGINT AS moment, count(*)::INT AS bins FROM b GROUP BY 1""")
def component_traces(spark, sf_dir):
    """Traces of a group summed bin by bin."""
    long = integer_stations(spark, sf_dir).select("label", F.posexplode("p1").alias("pos", "v"))
    t = traces.component_sum(long, ["label"], "pos", "v")
    moment = A.total(F.transform("trace", lambda v, i: v * (i + 1))).cast("long")
    return t.select("label", moment.alias("moment"), F.size("trace").alias("bins"))


@query("""SELECT l_orderkey AS event, count(*) AS stations, sum(l_suppkey)::BIGINT AS keys FROM lineitem
WHERE l_quantity * 40 < CASE floor(log10(l_extendedprice * 1e13)) WHEN 16 THEN 500 WHEN 17 THEN 800 WHEN 18 THEN 1100 ELSE 1700 END GROUP BY 1""")
def near_stations(spark, sf_dir):
    l = _lines(spark, sf_dir).where(traces.far_enough(F.col("l_extendedprice") * 1e13, F.col("l_quantity") * 40))  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("event")).agg(F.count("*").alias("stations"), F.sum("l_suppkey").alias("keys"))


@query(f"""WITH {TRI}, r AS (SELECT station, p1, label % 10 AS a, label % 10 + 20 AS b FROM ti) SELECT station, len(p1[a + 1:b])::INT AS n_adc, list_sum(p1[a + 1:b])::BIGINT AS adc, len(p1[a + 1:b + 1])::INT AS n_vem, round(list_sum(p1[a + 1:b + 1]) / 61.75, 6) AS vem FROM r""")
def bandwidth_extraction(spark, sf_dir):
    """Counts without their last bin, calibrated traces with it, side by side."""
    s = integer_stations(spark, sf_dir).withColumn("a", F.col("label") % 10).withColumn("b", F.col("label") % 10 + 20)
    both = extracts.side_by_side(s, ["station", "a", "b"], "p1", 61.75)
    cut = [extracts.extracted(F.col("vem"), F.col("adc"), F.col("a"), F.col("b"), counts) for counts in (True, False)]
    return both.select("station", F.size(cut[0]).alias("n_adc"), A.total(cut[0]).cast("long").alias("adc"), F.size(cut[1]).alias("n_vem"), F.round(A.total(cut[1]), 6).alias("vem"))


@query(f"""WITH {TRI}, p AS (SELECT station, unnest(['p1', 'p2', 'p3']) AS trace, unnest([p1, p2, p3]) AS x FROM ti) SELECT station, trace, round(list_sum(list_transform(x, lambda v, i: floor(v) / 61.75 * i)), 5) AS moment FROM p""")
def transposed_traces(spark, sf_dir):
    """A column per PMT and a row per bin, and back to a row per trace in whole units."""
    long = integer_stations(spark, sf_dir).select("station", F.explode(F.array(*[F.struct(F.lit(p).alias("trace"), F.col(p).alias("x")) for p in P])).alias("e"))
    long = long.select("station", "e.trace", F.posexplode("e.x").alias("pos", "v"))
    wide = extracts.columns_of(long, ["station"], "pos", "trace", list(P), "v")
    rows = extracts.rows_of(wide, ["station"], "pos", list(P), 61.75)
    return rows.select("station", "trace", F.round(A.total(F.transform("samples", lambda v, i: v * (i + 1))), 5).alias("moment"))


@query(f"""WITH {TRI}, z AS (SELECT station, unnest(p1) AS a, unnest(p2) AS b, unnest(p3) AS c FROM ti),
k AS (SELECT station, bool_or(least(a, b, c) > 60) AS th, count(*) FILTER (WHERE a > 100) AS n1, count(*) FILTER (WHERE b > 100) AS n2, count(*) FILTER (WHERE c > 100) AS n3 FROM z GROUP BY 1)
SELECT station, th::INT AS n_mu, ((n1 >= 14)::INT + (n2 >= 14)::INT + (n3 >= 14)::INT >= 2)::INT AS n_e, 0 AS n_gamma FROM k""")
def flags_in_counts(spark, sf_dir):
    flags = (triggers.threshold(*_p(), level=60.0), triggers.over_threshold(*_p(), level=100.0, bins=14), F.lit(False))
    return extracts.flags_as_counts(integer_stations(spark, sf_dir), ["station"], flags, [])


@query("""SELECT s_suppkey AS station, 0 AS offset_us, 1000 AS window_us FROM supplier WHERE s_acctbal >= 5000""")
def central_trigger(spark, sf_dir):
    return extracts.central_trigger(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "station"), "station", F.col("s_acctbal") < 5000)


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS showers FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def reconstructed_events(spark, sf_dir):
    o = extracts.reconstructed(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 1000)
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("showers"))


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'TP' WHEN l_returnflag = 'A' THEN 'FN' ELSE 'FP' END AS outcome, count(*) AS n, sum(l_suppkey)::BIGINT AS keys FROM lineitem GROUP BY 1""")
def outcome_files(spark, sf_dir):
    """Decisions written by outcome and read again."""
    path = sinks.scratch(spark, "outcomes")
    x = _lines(spark, sf_dir).select("l_suppkey", F.expr("CASE WHEN l_returnflag = 'R' THEN 'TP' WHEN l_returnflag = 'A' THEN 'FN' ELSE 'FP' END").alias("outcome"))
    traces.write_outcomes(x, path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("keys"))


@query("""SELECT l_linenumber::INT AS scale, l_linestatus AS job, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def appended_rates(spark, sf_dir):
    """Rate rows added to one table by two jobs, one of which is run twice."""
    path = sinks.scratch(spark, "rates")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("scale"), "l_linestatus").agg(F.count("*").alias("n"))
    for job in ("O", "F", "O"):
        traces.append_rates(rows.where(F.col("l_linestatus") == job).select("scale", "n"), path, job)
    return spark.read.schema("scale int, n long, job string").parquet(path)


@query("""WITH e AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: floor(1000 * x::DOUBLE)))::BIGINT AS total, floor(1000 * embedding[1]::DOUBLE) AS first FROM embeddings)
SELECT CASE WHEN first >= 0 THEN vec_id END AS vec_id, CASE WHEN first >= 0 THEN total END AS total, CASE WHEN first < 0 THEN vec_id::VARCHAR END AS failed_key, CASE WHEN first < 0 THEN 'ValueError' END AS error FROM e""")
def quarantined_traces(spark, sf_dir):
    """Charges of traces; those that begin below zero raise, and are put aside with their error."""

    def charge(rows):
        bins = [np.floor(1000 * np.asarray(e, float)) for e in rows["embedding"]]
        if any(b[0] < 0 for b in bins):
            raise ValueError("a trace begins below zero")
        return pd.DataFrame({"vec_id": rows["vec_id"], "total": [int(b.sum()) for b in bins]})

    return traces.quarantined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), charge, "vec_id long, total long", "vec_id")


@query("""SELECT l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1""")
def traces_by_status(spark, sf_dir):
    """Rows put by status, then packed into a fixed number of files."""
    path, packed = sinks.scratch(spark, "status"), sinks.scratch(spark, "packed")
    traces.write_by_status(_lines(spark, sf_dir).select(F.col("l_linestatus").alias("status"), "l_orderkey"), path)
    traces.pack(spark.read.parquet(path), packed, 16)
    return spark.read.parquet(packed).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_GRID} SELECT e::INT AS e, t, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 8) AS p FROM g GROUP BY 1, 2""")
def fit_files(spark, sf_dir):
    """Parameters per cell, written by energy and read again."""
    path = sinks.scratch(spark, "fits")
    sinks.write_fits(_grid(spark, sf_dir).groupBy("e", "t").agg(F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 8).alias("p")), path)
    return spark.read.parquet(path).select("e", "t", "hits", "p")


@query("""WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey * 1103515245 + 12345) % 2147483648, c_custkey) AS k, count(*) OVER () AS n FROM customer)
SELECT CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'validate' END AS part, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM f GROUP BY 1""")
def model_lists(spark, sf_dir):
    """Training and validation lists, written and read again."""
    path = sinks.scratch(spark, "lists")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    sinks.write_model_lists(sampling.split(c, "c_custkey", 0.8, F.pmod(F.col("c_custkey") * 1103515245 + 12345, F.lit(2147483648))), path)
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("""WITH m AS (SELECT l_suppkey AS model, avg(l_discount) AS acc, count(*) AS rate, avg(l_tax) AS true_acc FROM lineitem GROUP BY 1)
SELECT model, round(acc, 7) AS acc, round(sqrt(acc * (1 - acc) / rate), 7) AS acc_err, rate::DOUBLE AS rate, round(sqrt(rate), 7) AS rate_err, round(true_acc, 7) AS true_acc FROM m""")
def ensemble_matrix(spark, sf_dir):
    path = sinks.scratch(spark, "ensemble")
    m = _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("model")).agg(F.avg("l_discount").alias("acc"), F.count("*").cast("double").alias("rate"), F.avg("l_tax").alias("true_acc"))
    m = m.withColumn("acc_err", F.round(F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("rate")), 7)).withColumn("rate_err", F.round(F.sqrt("rate"), 7))
    sinks.write_ensemble(m.withColumn("acc", F.round("acc", 7)).withColumn("true_acc", F.round("true_acc", 7)), path)
    return spark.read.parquet(path)


@query("""SELECT l_quantity::INT AS scale, count(*) AS n, row_number() OVER (ORDER BY l_quantity::INT)::BIGINT - 1 AS place FROM lineitem GROUP BY 1""")
def sorted_scan(spark, sf_dir):
    """A scan written in the order of its scale: the place of a row is that in its file, after all files before it."""
    path = sinks.scratch(spark, "scan")
    sinks.write_scan(_lines(spark, sf_dir).groupBy(F.col("l_quantity").cast("int").alias("scale")).agg(F.count("*").alias("n")), path)
    rows = spark.read.schema("scale int, n long").parquet(path).select("scale", "n", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = rows.groupBy("file").agg(F.count("*").alias("rows")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(files, "file").select("scale", "n", (F.col("before") + F.col("row")).alias("place"))


_STORE_EDGES = (50_000.0, 100_000.0, 150_000.0, 200_000.0, 250_000.0)


@query(f"""
WITH o AS (SELECT o_orderkey, ({" + ".join(f"(o_totalprice >= {e})::INT" for e in _STORE_EDGES)}) AS r, o_custkey FROM orders)
SELECT r AS energy_range, count(DISTINCT o_orderkey) AS events, count(*) AS stations, sum(l_suppkey * (o_custkey % 7))::BIGINT AS keys
FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE r >= 2 AND r < 5 GROUP BY 1""")
def pruned_store(spark, sf_dir):
    """Events and their stations written to a store by energy, and joined for some energies only."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), "o_totalprice", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), "l_suppkey").join(o.select("event", "o_totalprice"), "event")  # noqa: E741
    names = [store.write(df, sinks.scratch(spark, "store"), "event", F.col("o_totalprice"), _STORE_EDGES) for df in (o, l)]
    events, stations_ = (store.opened(spark, n, 2, 5) for n in names)
    both = store.together(events.select("event", "energy_range", "o_custkey"), stations_.select("event", "energy_range", "l_suppkey"), "event")
    per_event = both.groupBy("event", "energy_range").agg(F.count("*").alias("n"), F.sum(F.col("l_suppkey") * (F.col("o_custkey") % 7)).alias("keys"))
    return per_event.groupBy("energy_range").agg(F.count("*").alias("events"), F.sum("n").alias("stations"), F.sum("keys").alias("keys"))


@query("""SELECT c_custkey::VARCHAR AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def aligned_files(spark, sf_dir):
    """Files of two folders matched by base name."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("/a/"), "c_custkey", F.lit(".csv")).alias("path"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("/b/deep/"), "o_custkey", F.lit(".txt")).alias("path"), "o_orderkey")
    return extracts.aligned(c, o).groupBy("name").agg(F.count("*").alias("n"), F.sum("o_orderkey_1").alias("keys"))


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '/x/a_' ELSE '/x/a' END || c_custkey || '.csv' AS path, c_acctbal FROM customer)
SELECT path, (row_number() OVER (ORDER BY c_custkey))::BIGINT AS place FROM f WHERE c_acctbal > 0 AND path LIKE '/x/a\\_%' ESCAPE '\\'""")
def sane_files(spark, sf_dir):
    """Files that have content and a complete name."""
    c = table(spark, sf_dir, "customer").withColumn("path", F.concat(F.when(F.col("c_nationkey") % 2 == 0, "/x/a_").otherwise("/x/a"), F.col("c_custkey"), F.lit(".csv")))
    kept = extracts.sane(c, F.col("path"), F.col("c_acctbal")).select("path", "c_custkey")
    return joins.numbered(kept, "c_custkey", "n").select("path", (F.col("n") + 1).alias("place"))


@query(f"""WITH {_GRID}, c AS (SELECT e * 6 + t AS cell, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM g GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS cell, s_nationkey AS v FROM supplier)
SELECT cell::BIGINT AS cell, hits, n, v FROM c JOIN l USING (cell)""")
def cells_by_ordinal(spark, sf_dir):
    """Own efficiencies beside a table whose rows are in the order of the cells."""
    c = _grid(spark, sf_dir).groupBy((F.col("e") * 6 + F.col("t")).cast("long").alias("cell")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    s = joins.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("v")), "s_suppkey", "cell").drop("s_suppkey")
    return c.join(s, "cell").select("cell", "hits", "n", "v")


@query("""WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, avg(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT user_id, avg(v) AS daily FROM d GROUP BY 1),
r AS (SELECT user_id, count(*) AS n FROM events WHERE value > 20 GROUP BY 1) SELECT user_id, n, round(daily, 7) AS daily, round(n / daily, 7) AS quotient FROM a JOIN r USING (user_id)""")
def monitored_rates(spark, sf_dir):
    """Day averages of each station beside its computed rate."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy("user_id", F.floor(joins.micros("ts") / 86400000000).alias("day")).agg(F.avg("value").alias("v"))
    daily = days.groupBy("user_id").agg(F.avg("v").alias("daily"))
    n = e.where("value > 20").groupBy("user_id").agg(F.count("*").alias("n"))
    return daily.join(n, "user_id").select("user_id", "n", F.round("daily", 7).alias("daily"), F.round(F.col("n") / F.col("daily"), 7).alias("quotient"))


@query("""WITH b AS (SELECT l_linenumber AS energy, CASE WHEN l_quantity = 50 THEN 499 ELSE floor((l_quantity + 0.1) * 500 / 50.1) END AS bin, l_returnflag = 'R' AS s FROM lineitem WHERE l_quantity BETWEEN -0.1 AND 50)
SELECT energy, bin::INT AS bin, count(*) FILTER (WHERE s) AS n_sig, count(*) FILTER (WHERE NOT s) AS n_bkg, round(count(*) FILTER (WHERE s) / count(*), 8) AS purity FROM b GROUP BY 1, 2""")
def signal_purity(spark, sf_dir):
    b = _lines(spark, sf_dir).select(F.col("l_linenumber").alias("energy"), metrics.uniform_bin(F.col("l_quantity"), -0.1, 50.0, 500).alias("bin"), (F.col("l_returnflag") == "R").alias("s"))
    n = [F.count_if("s"), F.count_if(~F.col("s"))]
    return b.where("bin IS NOT NULL").groupBy("energy", "bin").agg(n[0].alias("n_sig"), n[1].alias("n_bkg"), F.round(n[0] / (n[0] + n[1]), 8).alias("purity"))


@query("""WITH f AS (SELECT l_orderkey AS file, l_returnflag = 'R' AS label, l_quantity > 40 AS t1, l_quantity > 45 AS t2, l_discount >= 0.09 AS tot FROM lineitem)
SELECT file, count(*) FILTER (WHERE t1) AS t1, count(*) FILTER (WHERE t2) AS t2, count(*) FILTER (WHERE tot) AS tot, count(*) FILTER (WHERE (t1 OR t2 OR tot) AND NOT label) AS fp, count(*) FILTER (WHERE NOT (t1 OR t2 OR tot) AND label) AS fn FROM f GROUP BY 1""")
def counts_per_file(spark, sf_dir):
    f = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("file"), (F.col("l_returnflag") == "R").alias("label"), (F.col("l_quantity") > 40).alias("t1"), (F.col("l_quantity") > 45).alias("t2"), (F.col("l_discount") >= 0.09).alias("tot"))
    fired = F.col("t1") | F.col("t2") | F.col("tot")
    return f.groupBy("file").agg(*[F.count_if(c).alias(c) for c in ("t1", "t2", "tot")], F.count_if(fired & ~F.col("label")).alias("fp"), F.count_if(~fired & F.col("label")).alias("fn"))


_CUT = "CASE WHEN n // (f - 10 * k) - 1 > 7 OR f - 10 * (k + 1) <= 50 THEN k END"


@query(f"""WITH {_GRID}, v AS (SELECT e, list_sort(list(l_quantity)) AS v, count(*) AS n, floor(60 * sqrt(e + 1))::BIGINT AS f FROM g GROUP BY 1),
b AS (SELECT e, v, n, f, min({_CUT}) AS k FROM (SELECT *, unnest(range(0, 30)) AS k FROM v) WHERE f - 10 * k > 0 GROUP BY ALL), m AS (SELECT e, v, n, n // (f - 10 * k) AS m FROM b),
i AS (SELECT *, unnest(range(0, m)) AS i FROM m WHERE m > 1), a AS (SELECT *, n * (i / (m - 1)) + 0.4 + 0.2 * (i / (m - 1)) AS a FROM i), h AS (SELECT *, greatest(1, least(floor(a), n - 1)) AS q FROM a)
SELECT e, i::INT AS i, round((1 - greatest(0, least(1, a - q))) * v[q::BIGINT] + greatest(0, least(1, a - q)) * v[least(q + 1, n)::BIGINT], 6) AS edge FROM h""")
def reduced_bins(spark, sf_dir):
    """Equal-count edges with the number of bins chosen by the size of each group."""
    m = metrics.bins_for(F.col("n"), F.floor(60 * F.sqrt(F.col("e") + 1)))
    q = metrics.quantiles(_grid(spark, sf_dir), ["e"], "l_quantity", edges=m)
    return q.select("e", "i", F.round("edge", 6).alias("edge"))


@query(f"""WITH {_GRID}, c AS (SELECT spd, count(*) FILTER (WHERE hit) AS x, count(*) AS n FROM g GROUP BY 1) SELECT spd, round(x / n * greatest(0, least(1, 0.9 * (1 - 1 / (1 + exp(-(spd * 5 + 2.5 - 30) / -4))))), 8) AS folded FROM c""")
def folded_efficiency(spark, sf_dir):
    """Efficiency times the lateral probability at the middle of the bin."""
    c = _grid(spark, sf_dir).groupBy("spd").agg((F.count_if("hit") / F.count("*")).alias("eff"))
    return c.select("spd", F.round(F.col("eff") * A.lateral(F.col("spd") * 5 + 2.5, F.lit(0.9), F.lit(30.0), F.lit(-4.0)), 8).alias("folded"))


@query(f"""SELECT l_orderkey AS k, l_linenumber AS i, (l_quantity >= 10)::INT + (l_quantity >= 25)::INT AS cell, (l_quantity >= 10)::INT + (l_quantity >= 25)::INT - 1 AS histogram FROM lineitem""")
def edge_cells(spark, sf_dir):
    """Cell numbers from an array of edges; a histogram's cells are one less."""
    edges = F.array(F.lit(10.0), F.lit(25.0))
    cell = A.digitize_array(F.col("l_quantity"), edges)
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), cell.alias("cell"), (cell - 1).alias("histogram"))


@query(f"""WITH x AS (SELECT l_orderkey, {_LAB} AS label FROM lineitem), b AS (SELECT l_orderkey, greatest(0, floor(count(*) FILTER (WHERE label = 'SIG') * 0.75 / 0.25)::BIGINT - count(*) FILTER (WHERE label IN ('INT', 'PRT'))) AS k FROM x GROUP BY 1),
s AS (SELECT l_orderkey, unnest(range(coalesce(o, 0), coalesce(o, 0) + k)) AS slot FROM (SELECT *, sum(k) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS o FROM b WHERE k > 0)),
w AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS slot, count(*) OVER () AS n FROM part)
SELECT l_orderkey AS batch, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM s JOIN w ON s.slot % w.n = w.slot GROUP BY 1""")
def appended_background(spark, sf_dir):
    """Batches with too little background get windows in turn."""
    x = _lines(spark, sf_dir).select("l_orderkey", F.expr(_LAB).alias("label"))
    b = x.groupBy("l_orderkey").agg(F.count_if(F.col("label") == "SIG").alias("s"), F.count_if(F.col("label").isin("INT", "PRT")).alias("c"))
    b = b.select("l_orderkey", sampling.background_needed(F.col("s"), F.col("c"), 0.25).alias("needed"))
    out = sampling.with_background(b, "l_orderkey", "needed", table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return out.groupBy(F.col("l_orderkey").alias("batch")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query(f"""WITH g AS (SELECT o_orderkey, floor(ln(1 - {_lcg_sql('o_orderkey')}) / ln(0.7))::BIGINT AS skipped FROM orders) SELECT o_orderkey AS signal, skipped, (sum(skipped + 1) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place FROM g""")
def interleaved_background(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal"))
    return sampling.interleaved(o, "signal", A.lcg(F.col("signal")), 0.3)


@query("""SELECT o_orderpriority AS kind, floor(count(*) / 0.25)::BIGINT - count(*) AS needed FROM orders GROUP BY 1""")
def legacy_background(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(sampling.legacy_background(F.count("*"), 0.25).alias("needed"))


@query("""SELECT DISTINCT o_orderkey AS trace FROM orders WHERE o_orderkey = (SELECT min(l_orderkey) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 1 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0))""")
def first_single_muon(spark, sf_dir):
    """The first event with one particle of one kind and none of another."""
    g = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_mu"), F.count_if(F.col("l_returnflag") == "A").alias("n_e"))
    return g.where("n_mu = 1 AND n_e = 0").agg(F.min("l_orderkey").alias("trace")).where("trace IS NOT NULL")


@query("""WITH m AS (SELECT l_suppkey AS model, avg(l_discount) AS acc, count(*) AS rate FROM lineitem GROUP BY 1) SELECT arg_min(model, (round(log10(rate) / acc, 9), model)) AS model FROM m""")
def best_by_logarithm(spark, sf_dir):
    """The second criterion for the best model."""
    m = _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("model")).agg(F.avg("l_discount").alias("acc"), F.count("*").alias("rate"))
    return metrics.best(m, "model", F.round(F.log10("rate") / F.col("acc"), 9))


@query("""WITH c AS (SELECT 'lib' || (c_nationkey % 3) || '/' || c_custkey || '.csv' AS path, c_nationkey % 3 AS lib FROM customer) SELECT lib, count(*) AS n FROM c WHERE lib < 2 GROUP BY 1""")
def file_choice(spark, sf_dir):
    """Files of a slice of the libraries: its high end is left out."""
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("lib"), "c_custkey")
    names = traces.resolve({str(i): [f"lib{i}/"] for i in range(3)}, "0:2")
    chosen = c.withColumn("folder", F.concat(F.lit("lib"), "lib", F.lit("/"))).where(F.col("folder").isin(names))
    return chosen.groupBy("lib").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_linenumber AS k, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_avgx(l_extendedprice, l_quantity) AS mx, count(*) AS n,
(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) AS s2 FROM lineitem GROUP BY 1)
SELECT k, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(s2 / sxx, 4) AS var_slope, round(s2 * (1 / n + mx * mx / sxx), 3) AS var_intercept, round(-s2 * mx / sxx, 3) AS cov FROM m""")
def line_covariances(spark, sf_dir):
    g = _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("k")).agg(*fits.line("l_extendedprice", "l_quantity"))
    return g.select("k", *[F.round(c, d).alias(c) for c, d in (("slope", 4), ("intercept", 4), ("var_slope", 4), ("var_intercept", 3), ("cov", 3))])


@formula("""SELECT n_nationkey AS e, n_regionkey AS t, round((0.5 + 0.02 * n_nationkey)::DOUBLE, 3) AS efficiency, (700 + 10 * n_nationkey)::DOUBLE AS p50, (-60 - 5 * n_regionkey)::DOUBLE AS width FROM nation""")
def recovered_lateral(spark, sf_dir):
    """Weighted fits of hits and misses that follow known curves give the curves back."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("e"), F.col("n_regionkey").alias("t"))
    c = n.withColumn("spd", F.explode(F.sequence(F.lit(100), F.lit(2500), F.lit(100))))
    p = A.lateral(F.col("spd") - 50.0, 0.5 + 0.02 * F.col("e"), 700 + 10.0 * F.col("e"), -(60.0 + 5 * F.col("t")))
    c = c.withColumn("hits", 1e6 * p).withColumn("misses", 1e6 * (1 - p))
    f = fits.fit_lateral(fits.binned(c, ["e", "t"], "spd", "hits", "misses"), ["e", "t"], weight="w")
    return f.select("e", "t", F.round("efficiency", 3).alias("efficiency"), F.round("p50", 1).alias("p50"), F.round("width", 1).alias("width"))


@formula("""SELECT n_nationkey AS kind, (500 + 20 * n_nationkey)::DOUBLE AS a, round((0.05 + 0.002 * n_nationkey)::DOUBLE, 5) AS b, round(ln(23 / (500 + 20.0 * n_nationkey)::DOUBLE) / (0.05 + 0.002 * n_nationkey)::DOUBLE, 2) AS surplus FROM nation""")
def recovered_rates(spark, sf_dir):
    """Exponential fits of known curves, and the scale at which the rate is 23 Hz."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(5)).cast("array<double>")).alias("x"))
    n = n.withColumn("y", (500 + 20.0 * F.col("kind")) * F.exp(-(0.05 + 0.002 * F.col("kind")) * F.col("x")))
    f = fits.fit_exponential(n, ["kind"])
    return f.select("kind", F.round("a", 2).alias("a"), F.round("b", 5).alias("b"), F.round(fits.surplus(F.lit(23.0), F.col("a"), F.col("b")), 2).alias("surplus"))


@formula("""SELECT n_nationkey AS kind, round(50.0 + n_nationkey / 2, 1) AS mean, (8 + n_regionkey)::DOUBLE AS sigma FROM nation""")
def recovered_peaks(spark, sf_dir):
    """Gaussian peaks over a falling background."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("bin"))
    z = (F.col("bin") - (50.0 + F.col("n_nationkey") / 2)) / (8.0 + F.col("n_regionkey"))
    n = n.withColumn("n", 1000 * F.exp(-0.5 * z * z) + 200 * F.exp(-0.03 * F.col("bin")))
    f = fits.fit_peak(n.select(F.col("n_nationkey").alias("kind"), "bin", "n"), ["kind"], ((0, 4), (140, 200)), (20, 100))
    return f.select("kind", F.round("mean", 1).alias("mean"), F.round("sigma", 1).alias("sigma"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT user_id, k, value, 100.0::DOUBLE AS before, CASE WHEN value <= 60 THEN 90 WHEN value <= 68 THEN 99 WHEN value <= 72 THEN 100 WHEN value <= 80 THEN 101 ELSE 110 END::DOUBLE AS unit FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.value, c.unit, c.unit + CASE WHEN e.value <= 60 THEN -10 WHEN e.value <= 68 THEN -1 WHEN e.value <= 72 THEN 0 WHEN e.value <= 80 THEN 1 ELSE 10 END FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, value, unit, unit = before AS converged FROM c""")
def stream_calibration(spark, sf_dir):
    """The calibration controller over a stream; rates come in the order of their time."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    base = sinks.scratch(spark, "calibration")
    streams.drain(streams.calibration(e, "user_id", "value", 100.0, order=["ts", "event_id"]), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, value double, unit double, converged boolean").parquet(f"{base}/out")


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def staged_files(spark, sf_dir):
    """A folder's files fed in batches of one."""
    folder, base = sinks.scratch(spark, "stage"), sinks.scratch(spark, "staged")
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    e.repartition(6).write.parquet(folder)
    streams.drain(streams.staged(spark, folder, "user_id long, event_type string", 1), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
