"""Source divergence and URL rules against plain versions, and their cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_stages import CLASH
from tracelake.llm import divergence, urls


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_audit(rows, least, most):
    """(lang, source, text) rows -> set of (lang, source, part, item, value, rank)."""
    count, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))
        sources[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(count[lang, s][t] for t in kept) for s in names}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in names}
        every = {t: sum(count[lang, s][t] for s in names) for t in kept}
        q = {t: 1 + 10**9 * (n + 5) // (sum(every.values()) + 5 * len(kept)) for t, n in every.items()}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in names - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def audit_rows(seed, n=400, n_sources=9):
    r = random.Random(seed)
    vocabulary = ["Ab", "É", "é", "x-y", "straße", "日本語", "a1b", "𝒳y"] + ["".join(r.choice("abcdeßé") for _ in range(3)) for _ in range(60)]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", "", None, "xx"]), r.choice([None, "", *[f"s{i}" for i in range(n_sources)], "hot", "hot", "hot", "hot"])
        own = vocabulary[: 8 + (hash(source or "") + 7 * len(source or "")) % 3 * 20] if lang != "xx" else ["zz" + str(r.random())]
        rows.append((lang, source, None if r.random() < 0.05 else " ".join(r.choice(own) for _ in range(r.randint(0, 40)))))
    return rows + [("de", "long", "lang " * 40_000), ("none", "a", None), ("none", "b", ""), ("solo", "x", "wort " * 9)] + [("en", "copy", "ab cd")] * 40


def audit(spark, rows, least=30, most=50):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    out = divergence.audited(spark, df, least, most).collect()
    assert len(out) == len({tuple(r) for r in out})
    return {tuple(r) for r in out}


@pytest.mark.parametrize("terms, sources, heavy", [(1024, 256, 4), (7, 3, 4), (5, 2, 1), (9, 4, 1000)])
def test_divergence_equals_plain(spark, monkeypatch, terms, sources, heavy):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "HEAVY", heavy)
    rows = audit_rows(terms)
    assert audit(spark, rows) == plain_audit(rows, 30, 50)
    assert audit(spark, rows, 2, 3) == plain_audit(rows, 2, 3)


def test_divergence_cases(spark):
    assert audit(spark, [], 1, 5) == set()
    assert audit(spark, [("en", "a", None), ("en", None, "x"), (None, None, None)]) == plain_audit([("en", "a", None), ("en", None, "x"), (None, None, None)], 30, 50)
    tied = [("en", s, "b a c é") for s in "xyz"] * 2
    assert audit(spark, tied, 1, 2) == plain_audit(tied, 1, 2)
    df = spark.createDataFrame(tied, "lang string, source string, text string")
    for spec in (CLASH + ", term string, df long, sources long, heavy boolean, other int, tile int, own int").split(", "):
        df = df.withColumn(spec.split()[0], F.lit(None).cast(spec.split()[1]))
    df = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert {tuple(r) for r in divergence.audited(spark, df, 1, 2).collect()} == plain_audit(tied, 1, 2)


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 9_000_000_000_000_000, 9_000_000_000_000_007, 3
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path, host = re.match("[^?#]*", rest[len(host) :])[0], lower(host)
    fits = []
    for h, p, v in rules:
        if h is None or p is None or v not in ("allow", "block") or re.search("[?#]", p):
            continue
        if (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p):
            fits.append((len(h) + len(p), len(p), v == "block", lower(h) + p, v))
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def url_rules(seed, n):
    r = random.Random(seed)
    part = lambda: r.choice("abc")
    host = lambda k: ".".join(part() for _ in range(k))
    rules = [(host(r.randint(1, 3)), r.choice(["", "/", "/" + part(), f"/{part()}/", f"/{part()}/{part()}"]), r.choice(["allow", "block"])) for _ in range(n)]
    rules += [("B.a", "/", "block"), ("b.a", "/", "allow"), ("", "/z", "block"), (None, "/", "block"), ("a", None, "block"), ("a", "/", None), ("a", "/", "drop"), ("a", "b", "block"), ("c", "/x?y", "block")]
    rules += [(".".join("abc" * 7), "/", "block"), (".".join("bbc" * 7), "/a", "block"), ("a", "/" + "l" * 300, "block"), ("a", "/" + "l" * 299 + "m", "allow"), ("é", "/ü/", "block")]
    links = [None, "", "a.b/c", "http://", "http:///a/", "x://a", "x://A?b://c/", "x://a#/", "x://a/?q", "x://.a/", "x://a./", "x://a.b.a/" + "l" * 4000, "x://y." + ".".join("abc" * 7) + "/", "x://" + ".".join("bbc" * 9) + "/a", "x://bbc.b/a", "x://ü.é/ü/x"]
    links += [f"http://{host(r.randint(1, 4))}{r.choice(['', '/', '?a', '#b', ''.join('/' + part() for _ in range(r.randint(1, 3))), '/z'])}{r.choice(['', '/', '?x=/a', '#/b'])}" for _ in range(300)]
    return rules, links + ["x://a.b.a/a/" * 2000] + ["http://a.b/a/"] * 100


@pytest.mark.parametrize("small, hot", [(200_000, 4096), (0, 4096), (0, 4), (0, 1)])
def test_url_rules_equal_plain(spark, monkeypatch, small, hot):
    monkeypatch.setattr(urls, "SMALL", small)
    monkeypatch.setattr(urls, "HOT", hot)
    rules, links = url_rules(hot, 25)
    pages = spark.createDataFrame([(i // 2, u, i) for i, u in enumerate(links)], "page_id long, url string, i int").repartition(5)
    out = urls.judged(pages, urls.rule_table(spark, rules)).collect()
    want = [plain_verdict(u, rules) for u in links]
    assert len(out) == len(links)
    for r in out:
        assert (r.page_id, r.url) == (r.i // 2, links[r.i])
        assert (r.host, r.path, r.rule, r.verdict) == want[r.i]
    assert {r.verdict for r in out} == {"allow", "block"} and sum(r.rule is not None for r in out) > 100


def test_url_cases(spark):
    rules = urls.rule_table(spark, [("net", "/", "block"), ("a.net", "/x/", "allow")])
    pages = spark.createDataFrame([(None, "http://q.net/", "h", "p"), (1, None, None, None), (1, "http://A.NET/x/", None, "v"), (1, "http://A.NET/x/", None, "v")], "page_id long, url string, host string, verdict string")
    pages = pages.withColumn("row", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("code", F.lit("c")).withColumn("nth", F.lit(0)).withColumn("a.b", F.lit(2)).withColumn("page", F.lit("p"))
    out = urls.judged(pages, rules)
    assert out.columns == [*pages.columns, "host_", "path", "rule", "verdict_"]
    assert sorted(((r.page_id, r.host_, r.path, r.rule, r.verdict_, r["a.b"], r.m) for r in out.collect()), key=str) == sorted(
        [(None, "q.net", "/", "net/", "block", 2, {"a": 1}), (1, "", "", None, "allow", 2, {"a": 1}), *[(1, "a.net", "/x/", "a.net/x/", "allow", 2, {"a": 1})] * 2], key=str
    )
    assert urls.judged(pages, rules.limit(0), default="block").where("verdict_ = 'block' AND rule IS NULL").count() == 4
    assert urls.judged(pages.limit(0), rules).count() == 0
    kept = urls.allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == 3


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 7)
    text = "Straße x1y  ÉÉÉÉÉÉÉÉÉÉÉÉ AbC " * 5
    parts = list(divergence._parts(text.encode().translate(divergence.FOLD)))
    assert len(parts) > 5
    want = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
    assert [t.decode() for p in parts for t in p.split()] == want
