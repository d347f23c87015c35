"""URL filters: rules on a host with its subdomains and a path's beginning.

Each URL is expanded into expressions, a suffix of its host at a dot with a beginning of its path, of just the
shapes (labels of the host, length of the path) that the rules have.  Expressions meet rules in an equi-join on the
first 32 bits of their SHA-256; the whole digest is compared after it, and the longest rule that fits decides.

No key of the join grows with the pages of a popular host: rules of a checked number are broadcast; of more, those
whose prefix many expressions have are (at most ``HOT`` prefixes, whatever the tables), and the others are joined by
a shuffle.  A row's expressions come from one pass over it and are brought together by a number of that row, which
no two rows share.

Cases: a null URL, or one without ``://``, has an empty host and path; a path that is empty begins with no rule's
path but an empty one; rows that are equal are judged one by one; very long URLs are expanded no further than the
longest rule (and 16 labels and 256 characters: longer rules meet at those and are then compared whole).  A rule with a
null, with another verdict than `allow` or `block`, with a host that holds ``/``, ``?`` or ``#``, or with a path
that neither is empty nor begins with ``/`` fits nothing.  Of rules with equal host and path that differ in verdict
`block` counts; of different rules of equal length that with the longer path.  Without rules every URL has the default verdict.
Columns of the pages keep their names; the new ones get a `_` where a name is taken.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import cut, fresh

#: The longest host and path that an expression has; longer rules are compared whole after they met.
LABELS, PATH = 16, 256
#: Rules that are broadcast at most: under 200 bytes each.
SMALL = 200_000
#: Prefixes of which rules are broadcast at most, when there are more rules.
HOT = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or # in lower case (A to Z only); else empty."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _prefix(digest: Column) -> Column:
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")


def _digested(host: Column, path: Column) -> Column:
    """No host holds a slash and a path that isn't empty begins with one, so no two expressions are the same text."""
    return F.sha2(F.concat(host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """prefix, digest, labels, chars, code, and host and path of rules that are longer than an expression.

    The code orders rules: their length, then their path's, then `block` over `allow`."""
    rules = rules.select(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict"))
    rules = rules.where("verdict IN ('allow', 'block') AND NOT host RLIKE '[/?#]' AND (path = '' OR path LIKE '/%') AND NOT path RLIKE '[?#]'")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels, chars = F.least(_labels(F.col("host")), F.lit(LABELS)), F.least(F.length("path"), F.lit(PATH))
    code = F.shiftleft((F.length("host") + F.length("path")).cast("long"), 32) + 2 * F.length("path").cast("long") + F.when(F.col("verdict") == "block", 1).otherwise(0)
    rules = rules.select("host", "path", labels.alias("labels"), chars.alias("chars"), code.alias("code"))
    digest = _digested(F.substring_index(F.col("host"), ".", -LABELS), F.left("path", F.lit(PATH)))
    long = (_labels(F.col("host")) > LABELS) | (F.length("path") > PATH)
    rules = rules.select(digest.alias("digest"), "labels", "chars", "code", *[F.when(long, F.col(c)).alias(f"long_{c}") for c in ("host", "path")])
    return rules.select(_prefix(F.col("digest")).alias("prefix"), *rules.columns)


def expressions(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """Digests of the expressions of a URL in these shapes: number of labels -> lengths of paths."""
    parts = []
    for labels, lengths in sorted(shapes.items()):
        fit = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(path))
        suffix = F.substring_index(host, ".", -labels)
        digests = F.transform(fit, lambda n: _digested(suffix, F.left(path, n)))  # noqa: B023
        parts.append(F.when(_labels(host) >= labels, digests).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def shapes_of(rules: DataFrame) -> dict[int, list[int]]:
    """The shapes of prepared rules: no more than (PATH + 1) x LABELS, whatever their number."""
    out: dict[int, list[int]] = {}
    for r in rules.select("labels", "chars").distinct().collect():
        out.setdefault(r.labels, []).append(r.chars)
    return out


def _met(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """parts (row, host, path, digest, prefix, and the row's values) with the code of each rule that fits."""
    spark = parts.sparkSession
    fits = lambda r: (
        (F.col("digest") == r["digest"])
        & (r["long_host"].isNull() | (F.col("host") == r["long_host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["long_host"])))
        & (r["long_path"].isNull() | F.startswith(F.col("path"), r["long_path"]))
    )
    side = lambda df, name: df.select(F.col("prefix").alias(f"{name}_prefix"), F.struct(*[c for c in df.columns if c != "prefix"]).alias(name))
    if rules.count() <= SMALL:
        few = side(rules, "few")
        met = parts.join(F.broadcast(few), parts["prefix"] == few["few_prefix"], "left")
        return met.withColumn("code", F.when(fits(F.col("few")), F.col("few.code")))
    seen = parts.groupBy("prefix").agg(F.count("*").alias("n"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = cut(spark, seen.where(F.col("n") > total / HOT).join(rules, "prefix").select(rules.columns), "hot_rules")
    few, many = side(hot, "few"), side(rules.join(hot.select("prefix").distinct(), "prefix", "left_anti"), "many")
    met = parts.join(F.broadcast(few), parts["prefix"] == few["few_prefix"], "left")
    # what met a hot prefix goes by its row's number, so that it is spread and meets nothing in the second join
    met = met.withColumn("prefix", F.when(F.col("few_prefix").isNotNull() | F.col("prefix").isNull(), -1 - F.col("row")).otherwise(F.col("prefix")))
    met = met.join(many, met["prefix"] == many["many_prefix"], "left")
    return met.withColumn("code", F.greatest(F.when(fits(F.col("few")), F.col("few.code")), F.when(fits(F.col("many")), F.col("many.code"))))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule (host and path of the rule that decides, else null) and verdict.

    A row's columns travel once, with its first expression; leave those out that aren't needed."""
    spark = pages.sparkSession
    known = cut(spark, prepared(rules), "url_rules")
    names = [fresh(n, pages) for n in ("host", "path", "rule", "verdict")]
    link = F.col(url).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), host_of(link).alias("host"), path_of(link).alias("path"), F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    rows = rows.select("*", F.posexplode_outer(expressions(F.col("host"), F.col("path"), shapes_of(known))).alias("nth", "digest"))
    first = F.coalesce(F.col("nth"), F.lit(0)) == 0
    parts = rows.select("row", "host", "path", F.when(first, F.col("page")).alias("page"), "digest", _prefix(F.col("digest")).alias("prefix"))
    best = _met(parts, known).groupBy("row").agg(
        F.first("page", ignorenulls=True).alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("code").alias("code")
    )
    chars, tail = F.shiftright("code", 32).cast("int"), F.floor(F.col("code") % (1 << 32) / 2).cast("int")
    rule = F.concat(F.right(F.col("host"), chars - tail), F.left(F.col("path"), tail))
    verdict = F.when(F.col("code").isNull(), default).when(F.col("code") % 2 == 1, "block").otherwise("allow")
    return best.select(*[F.col("page").getField(c).alias(c) for c in pages.columns], *[c.alias(n) for c, n in zip((F.col("host"), F.col("path"), rule, verdict), names)])


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages that aren't blocked, with their own columns."""
    out = judged(pages, rules, url, default)
    return out.where(F.col(out.columns[-1]) == "allow").select(*[F.col(f"`{c}`") for c in pages.columns])
