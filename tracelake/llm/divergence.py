"""Source divergence: how far the sources of a language differ in their use of its words.

Terms are counted by (lang, source) where the texts lie; a language keeps the terms of at least `least` of its
documents.  The distance of two sources is a sum over all kept terms of |p - q|, in two parts:

* Heavy terms, those in more than a share of a language's sources, are tiles of numpy: a row for each source, a column
  for each term.
* Light terms are postings.  With d = |p0 - q0| for what two sources give a term that they lack, the sum over light
  terms is d for each, corrected by each posting alone (a sum of |p - q0| over one's postings, from sorted values
  and their running sums, for any number of other sources) and by the pairs of postings of one term.

Both parts are integers, each relative to d, and are added up over tiles.  A task holds a cell: `TERMS` terms by two
blocks of about `SOURCES` sources, so neither a language with many terms, nor one with many sources, nor a term in all
of them comes into one task whole.  Counts and terms are partial sums before they are shuffled.

Cases: null text, lang and source are ''; a row is a document, whatever its doc_id, also if it repeats; a group whose
texts have no kept term is in all pairs; a language without kept terms has distances of 0 and no term rows; values tie
by the item's UTF-8 bytes; very long texts are taken whole, cut between terms; columns beside text, lang and
source aren't read; an empty table gives an empty result.  Values are integers: quotients are worked out as 38-digit
decimals, sums as 64-bit integers (a sum over terms of values below 10^9 + 2, whose p add up to about 10^9).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import batch, cut, slices, texts_of

#: What the SQL calls a term; here texts are folded by bytes: what is no part of a term becomes a blank.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms that a task holds, about, and bytes of a text that it cuts at a time.
ENTRIES, PART = 400_000, 1 << 20
#: A cell's terms and a block's sources, about.
TERMS, SOURCES = 1024, 256
#: A term is heavy in more than one in so many of its language's sources.
HEAVY = 4
#: Values are shares of this; each count is raised by `ADD`.
SCALE, ADD = 1_000_000_000, 5

SCHEMA = "lang string, source string, item string, value long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents with the term).

    A task adds up what it reads until it holds `ENTRIES` terms, then hands the sums on.  Bytes of a term are letters or
    belong to characters beyond ASCII, so a text in UTF-8 is folded and cut by its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for rows in batches:
            for piece in slices(rows):
                for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts_of(piece.column("text"))):
                    n, df = held.setdefault((lang, source), (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for part in _parts(text.translate(FOLD)):
                        terms = part.split()
                        n.update(terms)
                        seen.update(terms)
                    df.update(seen)
                if sum(len(n) for n, _ in held.values()) > ENTRIES:
                    yield from _sums(held)
                    held.clear()
        yield from _sums(held)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*named).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _parts(data: bytes) -> Iterator[bytes]:
    """A folded text in parts of about `PART` bytes, cut between terms."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _sums(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, df) in held.items():
        if n:
            term = pa.array(n.keys(), pa.binary()).cast(pa.string())
            yield batch(_COUNTS, [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), term, n.values(), map(df.__getitem__, n)])


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (n + ADD) / (total + ADD terms))."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    wide = lambda c: c.cast("decimal(27,0)")
    scaled, whole = F.lit(SCALE).cast("decimal(10,0)") * wide(n + ADD), wide(total + ADD * terms)
    return F.when(whole > 0, F.call_function("div", scaled, whole) + 1)


class Audit:
    """Counts and shares of a corpus: `groups` (lang, source, total, terms, base: the share of a term that the group
    lacks), `kept` (lang, term, n, sources) and `postings` (lang, source, term, n, p, q, heavy)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, least: int = 30):
        found = cut(spark, counts(docs), "term_counts")
        kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.count("*").alias("sources"))
        kept = cut(spark, kept.where(F.col("df") >= least).drop("df"), "kept_terms")
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        every = docs.select(*named).distinct()
        rows = found.drop("df").join(kept.select("lang", "term", F.col("n").alias("lang_n"), "sources"), ["lang", "term"])
        rows = cut(spark, rows, "postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
        sizes = every.groupBy("lang").agg(F.count("*").alias("n_sources"))
        totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left")
        groups = groups.fillna(0, ["total", "terms", "lang_total"]).withColumn("base", F.coalesce(share(F.lit(0), "total", "terms"), F.lit(0)))
        self.groups = cut(spark, groups, "groups")
        self.kept = kept
        p, q = share("n", "total", "terms"), share("lang_n", "lang_total", "terms")
        joined = rows.join(self.groups, ["lang", "source"])
        self.postings = joined.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), (HEAVY * F.col("sources") > F.col("n_sources")).alias("heavy"), "terms", "n_sources")


def block(source: str, n_sources: str) -> tuple[Column, Column]:
    """A source's block, and the number of blocks of its language."""
    blocks = F.ceil(F.col(n_sources) / SOURCES).cast("int")
    return F.pmod(F.xxhash64(source), blocks).cast("int"), blocks


def _cells(rows: DataFrame, tiles: Column) -> DataFrame:
    """Rows once for each cell that they belong to: (lang, tile, lo, hi), where lo <= hi are blocks."""
    own, blocks = block("source", "n_sources")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("tile", tiles)
    return rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def distances(audit: Audit) -> DataFrame:
    """lang, source, item (another source of the lang), value: in both directions."""
    n_tiles = F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int")
    cols = ["lang", "tile", "lo", "hi", "own", "source", "term", "p", "heavy", "terms"]
    groups = audit.groups.select("lang", "source", "terms", "n_sources", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.lit(False).alias("heavy"))
    groups = _cells(groups, F.explode(F.sequence(F.lit(0), n_tiles - 1))).select(cols)
    postings = _cells(audit.postings, F.pmod(F.xxhash64("term"), n_tiles).cast("int")).select(cols)
    sums = groups.unionByName(postings).groupBy("lang", "tile", "lo", "hi").applyInArrow(cell_sums, SCHEMA)
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def cell_sums(rows: pa.Table) -> pa.Table:
    """A cell's part of the distance of each source of its one block to each of the other."""
    lang, tile, lo, hi = (rows.column(c)[0].as_py() for c in ("lang", "tile", "lo", "hi"))
    is_group = rows.column("term").is_null().to_numpy()
    sources = rows.column("source").combine_chunks().dictionary_encode()
    code, name = sources.indices.to_numpy(), sources.dictionary.to_pylist()
    own, p = rows.column("own").to_numpy(), rows.column("p").to_numpy()
    # sources by number: those of block lo first; a posting's source is one of the cell's groups
    at = np.flatnonzero(is_group)
    at = at[np.lexsort((code[at], own[at]))]
    place = np.empty(len(name), np.int64)
    place[code[at]] = np.arange(len(at))
    base, names = p[at], np.array([name[c] for c in code[at]], object)
    first = int((own[at] == lo).sum())
    a, b = (np.arange(first), np.arange(first, len(at))) if lo < hi else (np.arange(len(at)),) * 2
    if not len(a) or not len(b):
        return _SCHEMA.empty_table()
    d = np.abs(base[a][:, None] - base[b][None, :])
    out = d * rows.column("terms")[0].as_py() if tile == 0 else np.zeros_like(d)

    post = np.flatnonzero(~is_group)
    if len(post):
        heavy = rows.column("heavy").to_numpy()[post]
        term = rows.column("term").combine_chunks().take(pa.array(post)).dictionary_encode().indices.to_numpy()
        src, p = place[code[post]], p[post]
        _dense(out, d, base, a, b, src[heavy], term[heavy], p[heavy])
        _sparse(out, d, base, a, b, src[~heavy], term[~heavy], p[~heavy])
    i, j = np.nonzero(np.ones_like(d, bool) if lo < hi else ~np.eye(len(a), dtype=bool))
    left, right, value = names[a[i]], names[b[j]], out[i, j]
    if lo < hi:
        left, right, value = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([value, value])
    return pa.table([pa.array([lang] * len(value), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(value)], schema=_SCHEMA)


def _dense(out, d, base, a, b, src, term, p) -> None:
    """Add sums of |p - q| - d over the heavy terms of the cell: a tile with a row for each source."""
    if not len(src):
        return
    seen, col = np.unique(term, return_inverse=True)
    tile = np.repeat(base[:, None], len(seen), 1)
    tile[src, col] = p
    right = tile[b]
    for k, g in enumerate(a):
        out[k] += np.abs(right - tile[g]).sum(1) - len(seen) * d[k]


def _sparse(out, d, base, a, b, src, term, p) -> None:
    """Add the corrections of d by the light terms' postings."""
    if not len(src):
        return
    order = np.lexsort((p, src))
    starts = np.searchsorted(src[order], np.arange(len(base) + 1))

    def alone(g: int, others: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Sum over g's postings of |p - other's base| - d."""
        v = p[order[starts[g] : starts[g + 1]]]
        run = np.concatenate([[0], np.cumsum(v)])
        k = np.searchsorted(v, base[others])
        return base[others] * k - run[k] + (run[-1] - run[k]) - base[others] * (len(v) - k) - len(v) * apart

    for k, g in enumerate(a):
        out[k] += alone(g, b, d[k])
    for k, h in enumerate(b):
        out[:, k] += alone(h, a, d[:, k])
    in_a, in_b = np.full(len(base), -1), np.full(len(base), -1)
    in_a[a], in_b[b] = np.arange(len(a)), np.arange(len(b))
    order = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[order])) + 1
    for one in np.split(order, cuts):
        s, v = src[one], p[one]
        x, y = in_a[s] >= 0, in_b[s] >= 0
        if not x.any() or not y.any():
            continue
        i, j = in_a[s[x]], in_b[s[y]]
        u, w = v[x][:, None], v[y][None, :]
        fix = np.abs(u - w) - np.abs(u - base[s[y]][None, :]) - np.abs(w - base[s[x]][:, None]) + d[np.ix_(i, j)]
        out[np.ix_(i, j)] += fix


def audited(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distances to the others of its lang (`pair`), and the
    terms that it uses most above its lang (`term`, ranks to `most`)."""
    audit = Audit(spark, docs, least)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    pairs = distances(audit).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = audit.postings.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.select("*", rank).where(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
