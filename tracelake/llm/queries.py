"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, divergence, jaccard, language, mixing, quality, suffixes, topk, toxicity, urls, warc, wavelet
from tracelake.llm.common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=False)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, documents(spark, sf_dir), k=3, per_cent=90)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(spark, spread(table(spark, sf_dir, "pages")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(spark, documents(spark, sf_dir), length=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(spark, documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return wavelet.read(spark, wavelet.write(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("clean_text", "kept_chars")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(spark, documents(spark, sf_dir), least=30, most=50)


#: Fixed values of the query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.rule_table(spark, URL_RULES)).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_ngram_jaccard, op3_warc, op4_suffix_dedup, op5_mixing, op6_toxicity, op7_language, op8_wavelet,
        op9_quality, op10_topk, op11_divergence, op12_urls,
    )
}

_W = r"[^\x20\x09-\x0D]+"
_BOILER = "|".join(quality.BOILERPLATE)
_NAV = quality.NAVIGATION
_END = quality.SENTENCE_END.replace("'", "''")

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g)
                  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * k >= 90 * (x.n + y.n - k)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON c.node = d.doc_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, t, strlen(t) AS n, sha1(t) AS x FROM p),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM h),
        b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS v FROM l)
        SELECT page_id, n::BIGINT AS payload_bytes,
            array_to_string(flatten(list_transform(v, lambda y: list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> k) & 31)::INT + 1, 1)))), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM b""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
        g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
        c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
        k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM c),
        m AS (SELECT d.doc_id, any_value(x) AS x, any_value(n) AS n, count(a) AS spans, coalesce(sum(b - a), 0) AS removed, coalesce(max(b), 0) AS stop,
            coalesce(string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a), '') AS head FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY 1)
        SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(head || substr(x, 2 * stop + 1))) AS kept_sha256 FROM m""",
    "op9_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT *, regexp_extract_all(t, '{_W}') AS w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
        b AS (SELECT *, len(w) AS n, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) AS tri FROM a),
        p AS (SELECT doc_id, unnest(tri) AS x, unnest(range(1, len(tri) + 1)) AS i FROM b),
        q AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM p) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat FROM q GROUP BY 1),
        m AS (SELECT b.*, coalesce(n_repeat, 0) AS n_rep,
            length(array_to_string(w, '')) AS chars,
            coalesce(list_sum(list_transform(list_filter(ls, lambda x: NOT (
                (regexp_matches(lower(x), '{_BOILER}') AND len(regexp_extract_all(x, '{_W}')) < {quality.PHRASE_LINE}) OR
                (NOT regexp_matches(x, '{_END}')
                    AND (regexp_matches(x, '{_NAV}') OR len(regexp_extract_all(x, '{_W}')) < {quality.SHORT_LINE})))),
                lambda x: length(array_to_string(regexp_extract_all(x, '{_W}'), '')))), 0) AS stay
            FROM b LEFT JOIN r USING (doc_id))
        SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
            (n < 50 OR 100 * n_rep > 50 * n) AS base_failed,
            NOT (n < 50 OR 100 * n_rep > 50 * n) AND 100 * stay >= {quality.LEAST_KEPT} * chars AS kept
        FROM m""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score FROM e a JOIN e b USING (i)
              WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{divergence.TERM}')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE kept.term IS NOT NULL), 0) AS total FROM g
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN kept ON kept.lang = c.lang AND kept.term = c.term GROUP BY ALL),
        p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.total + 5 * v.v)::HUGEINT AS q
            FROM t JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        WHERE part = 'pair' OR rank <= 50""",
    "op12_urls": """
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        b AS (SELECT *, '.' || host AS x FROM h)
        SELECT page_id, host, path,
            CASE WHEN x LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN x LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN x LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN x LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
            CASE WHEN x LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'allow'
                WHEN x LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'block'
                WHEN x LIKE '%.net' AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
        FROM b""",
}
