"""Mixing sources to target weights; DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all
documents; a target stops at `most` times its source's size and what is over goes to the others by
weight.  With L(s) the level that is left if all sources with a lower cap-to-weight ratio are at their
cap, the level at which the targets add up is the largest L(s), so no iteration is needed.

Draws: the documents of a source are dealt by hash into blocks of about BLOCK_WORDS words.  A source is
passed over as often as its target holds its size, and a last pass takes blocks in hashed order, one of
them in part: within it, documents in hashed order, one of them in part.  So the words taken are the
target, rounded.

Shards: there are 2^depth output shards, so many that one has about SHARD_WORDS words.  Each source's
number of drawn blocks is its quota.  A binary tree over the shards splits the quotas at each node between
its halves by a multivariate hypergeometric draw (source after source, by inversion of the cumulative
weights with a hashed uniform), which keeps all quotas exact.  A leaf's quota of a source takes the next
of the source's draws, permuted by hash, so shards get disjoint draws; and what a document gives to
the mixture is what its block's shards have drawn.  A shard's documents are shuffled locally by hash.

Everything depends on hashes of rows (doc_id, source, text) and the seed, so reruns agree.  Orders over all
blocks or shards of a source go by buckets (:mod:`tracelake.operators.ordering`), so no task holds a source.

Cases: a null or wordless text has size 0 and is never drawn; a null source is a source; null and
repeated doc_ids are drawn row by row, told apart by their texts; rows that are equal in doc_id, source and
text are drawn alike (where the last one is drawn in part, :func:`mixed` takes all or none of them); sources of
size 0 get a target of 0; an empty table gives an empty result; other columns are kept by :func:`mixed` and not
looked at, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, cut, drop, fresh
from tracelake.operators.ordering import bucket_of, hashed, running

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARD_WORDS = 1 << 14, 1 << 20
#: A shard is shuffled in so many parts.
PARTS = 8
#: Levels of the tree before its nodes are dealt out again.
LEVELS = 6


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("row"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, rank, source_size, target; a row per source."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    lower = Window.orderBy(F.col("ratio"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by))
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"1 + (rank - 1) % {len(weights)}").cast("int")))
    t = t.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(lower), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.max("level").over(every))
    return t.select("source", "rank", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL of the number of good ones among `drawn` of `total`, at the quantile u; weights are kept as logarithms.
    Only counts within nine standard deviations are gone through: all others weigh less than u can tell."""
    t, g, d = (f"cast({x} as double)" for x in (total, good, drawn))
    mean, spread = f"{d} * {g} / {t}", f"sqrt({d} * ({g} / {t}) * (1 - {g} / {t}) * ({t} - {d}) / greatest(1D, {t} - 1))"
    lo = f"greatest(0L, {drawn} + {good} - {total}, cast(floor({mean} - 9 * {spread} - 9) as bigint))"
    hi = f"least({drawn}, {good}, cast(ceil({mean} + 9 * {spread} + 9) as bigint))"
    step = "if(k = r.lo, 0D, a.l + ln((({g} - k + 1D) * ({d} - k + 1D)) / (k * ({t} - {g} - {d} + k + 0D))))".format(g=good, d=drawn, t=total)
    logs = (
        f"aggregate(sequence(r.lo, r.hi), named_struct('l', 0D, 'm', 0D, 's', 0D), (a, k) -> transform(array({step}), "
        "l -> named_struct('l', l, 'm', greatest(a.m, l), 's', a.s * exp(a.m - greatest(a.m, l)) + exp(l - greatest(a.m, l))))[0])"
    )
    find = (
        f"aggregate(sequence(r.lo, r.hi), named_struct('l', 0D, 'c', 0D, 'x', -1L), (a, k) -> transform(array({step}), "
        f"l -> named_struct('l', l, 'c', a.c + exp(l - z.m) / z.s, "
        f"'x', if(a.x < 0 and a.c + exp(l - z.m) / z.s >= {u}, k, a.x)))[0], a -> if(a.x < 0, r.hi, a.x))"
    )
    return f"transform(array(named_struct('lo', {lo}, 'hi', {hi})), r -> transform(array({logs}), z -> {find})[0])[0]"


def quotas(spark: SparkSession, blocks: DataFrame, depth: int, seed: int) -> DataFrame:
    """rank (of the source), shard, quota: the tree's leaves.  `blocks`: rank and n, its drawn blocks.

    A node is a row with the counts of the sources that it still has draws of; a node without draws goes.
    """
    count = F.struct(F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n"))
    nodes = blocks.groupBy().agg(F.sort_array(F.collect_list(count)).alias("x")).select(F.lit(0).cast("long").alias("node"), "x")
    held = None
    for level in range(depth):
        u = f"(pmod(xxhash64(node, e.rank, {level}L, {seed}L), 9007199254740992L) / 9007199254740992D)"
        draw = _hypergeometric("b.total", "e.n", "b.drawn", u)
        split = (
            "aggregate(x, named_struct('total', total, 'drawn', total div 2, 'out', cast(array() as array<bigint>)), (b, e) -> "
            f"transform(array({draw}), y -> named_struct('total', b.total - e.n, 'drawn', b.drawn - y, 'out', concat(b.out, array(y))))[0], b -> b.out)"
        )
        nodes = nodes.where("size(x) > 0").withColumn("total", F.expr("aggregate(x, 0L, (a, e) -> a + e.n)"))
        nodes = nodes.withColumn("left", F.expr(split))
        half = "filter(zip_with(x, left, (e, y) -> named_struct('rank', e.rank, 'n', {n})), e -> e.n > 0)"
        sides = [
            F.struct((2 * F.col("node")).alias("node"), F.expr(half.format(n="y")).alias("x")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.expr(half.format(n="e.n - y")).alias("x")),
        ]
        nodes = nodes.select(F.explode(F.array(*sides)).alias("h")).select("h.node", "h.x")
        if level % LEVELS == LEVELS - 1:
            last, held = held, cut(spark, nodes.repartition("node"), "nodes")
            nodes = held
            if last is not None:
                drop(spark, last)
    leaves = nodes.select(F.col("node").alias("shard"), F.explode("x").alias("e"))
    return leaves.select("shard", F.col("e.rank").cast("int").alias("rank"), F.col("e.n").alias("quota"))


def plan(spark: SparkSession, sized: DataFrame, depth: int | None = None, seed: int = 20, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the sources (source, rank, source_size, target and more); the rows of `sized` that have words, with
    these and their block; and the draws: rank, block, copy, shard, and `part`, the words that are taken of a block
    drawn in part (else null)."""
    t = targets(sized, **options)
    t = t.withColumn("quota", F.round("target").cast("long"))
    t = t.withColumn("n_blocks", F.expr(f"greatest(1L, cast(ceil(source_size / {BLOCK_WORDS}) as bigint))"))
    t = cut(spark, t.withColumn("full", F.coalesce(F.expr("quota div nullif(source_size, 0)"), F.lit(0)).cast("long")), "sources")
    if depth is None:
        words = t.agg(F.sum("quota")).first()[0] or 0
        depth = max(0, ceil(log2(max(1, words) / SHARD_WORDS)))
    placed = sized.where("size > 0").withColumnRenamed("source", "s").join(t, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.col("n_blocks")))
    firsts = [F.first(c).alias(c) for c in ("quota", "full", "source_size", "n_blocks")]
    blocks = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), *firsts)
    blocks = blocks.withColumn("place", hashed(seed + 1, "block")).withColumn("bucket", bucket_of("place", "n_blocks"))
    blocks = running(blocks, ["rank"], "bucket", ["place", "block"], "words", "before")
    blocks = blocks.withColumn("rest", F.expr("quota - full * source_size - before"))
    last = F.when(F.col("rest") > 0, F.struct(F.col("full").alias("copy"), F.when(F.col("rest") < F.col("words"), F.col("rest")).alias("part")))
    every = F.expr("transform(if(full > 0, sequence(0L, full - 1), array()), c -> named_struct('copy', c, 'part', cast(null as bigint)))")
    draws = blocks.select("rank", "block", F.expr("n_blocks * (full + 1)").alias("about"), F.explode(F.array_compact(F.concat(every, F.array(last)))).alias("d"))
    draws = cut(spark, draws.select("rank", "block", "about", "d.copy", "d.part"), "draws")
    shares = cut(spark, quotas(spark, draws.groupBy("rank").agg(F.count("*").alias("n")), depth, seed), "quotas")
    shares = running(shares.withColumn("bucket", F.expr("shard div 4096")), ["rank"], "bucket", ["shard"], "quota", "above")
    slots = shares.select("rank", "shard", F.explode(F.expr("sequence(above, above + quota - 1)")).alias("nth"))
    permuted = draws.withColumn("place", hashed(seed + 2, "block", "copy")).withColumn("bucket", bucket_of("place", "about"))
    permuted = running(permuted, ["rank"], "bucket", ["place", "block", "copy"], F.lit(1), "nth")
    dealt = cut(spark, permuted.join(slots, ["rank", "nth"]).select("rank", "block", "copy", "shard", "part"), "dealt")
    drop(spark, draws)
    return t, placed, dealt


def _drawn(placed: DataFrame, dealt: DataFrame, seed: int) -> DataFrame:
    """The placed rows with the shards that draw them whole (an array), the shard that draws their block in part, and
    `extra`, how many words of the row that takes."""
    whole = F.sort_array(F.collect_list(F.when(F.col("part").isNull(), F.struct("copy", "shard"))))
    part = F.col("part").isNotNull()
    of = dealt.groupBy("rank", "block").agg(
        whole.alias("whole"), F.max("part").alias("part"), F.max(F.when(part, F.struct("copy", "shard"))).alias("last")
    )
    rows = placed.join(of, ["rank", "block"], "left")
    order = Window.partitionBy("rank", "block").orderBy(hashed(seed + 3, "row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    extra = F.when(F.col("part").isNotNull(), F.greatest(F.lit(0).cast("long"), F.least("size", F.col("part") - before))).otherwise(0)
    none = F.array().cast(of.schema["whole"].dataType)
    return rows.withColumn("extra", extra).withColumn("whole", F.coalesce("whole", none))


def taken(spark: SparkSession, docs: DataFrame, depth: int | None = None, seed: int = 20, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and shards (those that draw from the row, one
    for each draw) of every row."""
    sized = cut(spark, sizes(docs), "sizes")
    t, placed, dealt = plan(spark, sized, depth, seed, **options)
    rows = _drawn(placed, dealt, seed)
    last = F.when(F.col("extra") > 0, F.array("last.shard")).otherwise(F.array().cast("array<bigint>"))
    shards = F.array_sort(F.concat(F.col("whole.shard"), last))
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("whole") + F.col("extra")).alias("taken"), shards.alias("shards"))
    wordless = sized.where("size = 0").withColumnRenamed("source", "s").join(t, F.col("s").eqNullSafe(F.col("source")))
    none = [F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("shards")]
    return rows.unionByName(wordless.select("doc_id", "size", "source_size", "target", *none))


def mixed(spark: SparkSession, docs: DataFrame, depth: int | None = None, seed: int = 20, **options) -> DataFrame:
    """The mixture: each row as often as it is drawn (a part of one counts from one half on), shard after shard; a
    shard's rows are shuffled by hash, in parts, and no task holds more than some parts."""
    sized = cut(spark, sizes(docs), "sizes")
    t, placed, dealt = plan(spark, sized, depth, seed, **options)
    rows = _drawn(placed, dealt, seed)
    last = F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), F.array("last"))
    every = F.concat("whole", F.coalesce(last, F.array().cast(rows.schema["whole"].dataType)))
    chosen = rows.select("row", F.explode(every).alias("d")).select("row", "d.copy", "d.shard").distinct()
    chosen = cut(spark, chosen, "chosen")
    drop(spark, sized, t, dealt)
    row, mine, copy, shard = (fresh(n, docs) for n in ("row", "drawn_row", "copy", "shard"))
    wordy = docs.where(F.col("text").rlike(WORD)).withColumn(row, F.xxhash64("doc_id", "source", "text"))
    out = wordy.join(chosen.select(F.col("row").alias(mine), F.col("copy").alias(copy), F.col("shard").alias(shard)), F.col(row) == F.col(mine))
    part = F.pmod(F.xxhash64(row, copy, F.lit(seed + 5)), F.lit(PARTS))
    out = out.repartition(F.col(shard), part).sortWithinPartitions(shard, part, hashed(seed + 4, row, copy))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


