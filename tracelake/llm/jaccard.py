"""Jaccard join on word shingles with a token-group matrix.

Sets of equal shingles form a class, and one row of each class goes on.  The rest is in three steps.

Groups.  Similar classes are gathered under pivots: classes that share a min-hash form a bucket, a few
random members of it are its pivots, and the others are compared with these only.  Classes that found a
pivot leave; a further min-hash gathers what is left, pivots included.  What proves to be linked when
its texts are compared is a tight group: a connected one, so nothing within it has to be compared again.
This is linear in the number of near copies, however large their cluster is.  Other classes are groups of their own.
Those that have tokens in wide rows of the matrix also form loose groups, by the min-hash that they share with most
others: for these rows only, which as pairs of single classes would cost the square of their width.

Matrix.  Tokens are ordered from rare to common (by a counting sketch of fixed size over all documents).
Two sets that link share one of the first tokens of either: of n - ceil(2 t n / (1 + t)) + 1 for the
smaller and n - ceil(t n) + 1 for the larger one.  A row is wide if a sample of the classes has the token often; that
decides on the cost only, as each row is whole, by single classes or by loose groups.  The matrix has a row for each of
these tokens and group, with the range of sizes and of what follows the token; two groups (or members of a loose one) that meet in a
row and could still reach the threshold from there are a candidate pair.  Each group's token union is stored as
bitmaps, one for each block of members.  The smaller group's members are the queries: the bitmap
of a query and of the union bound the overlap from above, and only blocks that it may reach are opened.

Opening.  The members' own bitmaps rule most pairs out; for the others texts are fetched and compared.
Groups and queries come in blocks of bounded size, so no task holds a whole group.

Links are enough to connect all that is linked, not all links of a group's members with each other.
Shingles are compared by 64-bit hashes, classes by 128-bit ones, groups are named by 64 bits.

Cases: a null text, or one without words, has an empty set that links with nothing; a text with fewer
words than a shingle takes is one shingle; a null doc_id counts as larger than all and never names a
component unless it is alone; rows that repeat a doc_id are linked by their texts like any others; an
empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, batch, cut, drop, fresh, give_back, row_key, runs, slices, texts_of, tidy
from tracelake.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)
SKETCH_BITS, SKETCH_BLOCK = 22, 1 << 18
ROUNDS, PIVOTS = 3, 4
PICKS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: A bucket's members are looked up in so many parts.
SALTS = 16
#: Classes in a wide row of the matrix, about; one in so many is looked at.
WIDE, LOOKED_AT = 512, 16
#: In which rows a class stands under a label: a class of a loose group is by itself in narrow ones.
ALL_ROWS, NARROW_ROWS, WIDE_ROWS = 0, 1, 2


class WordHashes(dict):
    """Word -> 64-bit hash; it keeps so many words at most."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


_WORDS = WordHashes()


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z are lower-cased."""
    words = list(map(_WORDS.__getitem__, data.lower().split()))
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(words, np.uint64)
    k = min(k, len(h))
    out = h[: len(h) - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = ((out ^ out >> np.uint64(31)) * MIX) + h[i : len(h) - k + 1 + i]
    out = (out ^ out >> np.uint64(29)) * TURN
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Level of commonness of each of 2^22 cells of shingles: each task counts its own, and blocks of cells
    are then added by at most 64 at a time, so no task holds more than a few MB however many there are."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int32)
        for rows in batches:
            for piece in slices(rows):
                found = [shingles(data, k) for data in texts_of(piece.column("text"))]
                at = (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                cells += np.bincount(at, minlength=len(cells)).astype(np.int32)
                np.minimum(cells, 0xFF, out=cells)
        parts = cells.astype(np.uint8).reshape(-1, SKETCH_BLOCK)
        task = TaskContext.get().partitionId()
        yield batch(schema, [range(len(parts)), [task] * len(parts), [p.tobytes() for p in parts]])

    def added(last: bool):
        """Sum of some tasks' blocks; the last one gives levels.  (In a step of its own, that would be a second
        Python worker beside the first in each task, and workers stay.)"""

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            total = np.zeros(SKETCH_BLOCK, np.int64)
            for data in rows.column("counts"):
                kind = np.uint8 if len(data.as_buffer()) == SKETCH_BLOCK else "<u4"
                total += np.frombuffer(data.as_buffer(), kind)
            total = np.minimum(total, 0xFFFFFFFF)
            out = np.log2(np.maximum(total, 1)).astype(np.uint8) if last else total.astype("<u4")
            return pa.Table.from_batches([batch(schema, [[key[0].as_py()], [key[1].as_py()], [out.tobytes()]])])

        return add

    text = "block int, part long, counts binary"
    sums = docs.select("text").mapInArrow(count, text)
    tasks = docs.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // 64)
        sums = sums.withColumn("part", F.expr("part div 64")).groupBy("block", "part").applyInArrow(added(tasks <= 1), text)
        if tasks <= 1:
            break
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    with tidy(docs.sparkSession):
        found = sums.collect()  # as many cells as the sketch has, whatever the input
    for row in found:
        out[row.block * SKETCH_BLOCK : (row.block + 1) * SKETCH_BLOCK] = np.frombuffer(row.counts, np.uint8)
    return out


def need(n: np.ndarray | int, per_cent: int) -> np.ndarray | int:
    """The least overlap of a set of n with any set that it links to."""
    return (per_cent * n + 99) // 100


def bitmap(s: np.ndarray) -> bytes:
    """The cells that a set's elements fall into; there are two to four times as many cells as elements."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    cells = np.zeros(bits, bool)
    cells[(s >> np.uint64(7)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(cells).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each, of 64-bit words) with so many words only."""
    if maps.shape[1] == words:
        return maps
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def union(maps: list[bytes]) -> bytes:
    """The bitmap of the union, as wide as the widest member's."""
    rows = [np.frombuffer(m, np.uint64) for m in maps]
    width = max(map(len, rows))
    out = np.zeros(width, np.uint64)
    for r in rows:
        out |= np.tile(r, width // len(r))  # a narrow one stands for all cells that fold onto it
    return out.tobytes()


def overlap_bound(size: int, own: np.ndarray, other: np.ndarray) -> int:
    """At most so many of a set's elements are in the set (or union) of the other bitmap: each cell that only
    its own has holds one at least that isn't."""
    width = min(len(own), len(other))
    own, other = folded(own[None], width)[0], folded(other[None], width)[0]
    return size - int(np.bitwise_count(own & ~other).sum())


def likely(sizes: np.ndarray, maps: list[np.ndarray], outs: np.ndarray, ins: np.ndarray, per_cent: int) -> np.ndarray:
    """Which pairs of an out and an in the bitmaps don't rule out as linked, as a matrix."""
    near = np.zeros((len(outs), len(ins)), bool)
    widths = np.array([len(m) for m in maps])
    for a in np.unique(widths[outs]):
        rows = np.flatnonzero(widths[outs] == a)
        own = np.array([maps[outs[i]] for i in rows])
        for b in np.unique(widths[ins]):
            cols = np.flatnonzero(widths[ins] == b)
            x, y = folded(own, min(a, b)), folded(np.array([maps[ins[j]] for j in cols]), min(a, b))
            m = sizes[ins[cols]]
            for i, row in zip(rows, x):
                n = sizes[outs[i]]
                most = np.minimum(n - np.bitwise_count(row & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~row).sum(1, dtype=np.int64))
                near[i, cols] = 100 * most >= per_cent * (n + m - most)
    return near


def profiles(docs: DataFrame, k: int, per_cent: int, commonness: np.ndarray) -> DataFrame:
    """doc_id, row key, n_shingles, class fingerprint, min-hashes, first tokens and bitmap of every row."""
    names = [f"h{r}" for r in range(ROUNDS)]
    schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary())]
        + [(h, pa.int64()) for h in names]
        + [("tokens", pa.list_(pa.int64())), ("bits", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for piece in slices(rows):
                sizes, fps, firsts, maps = [], [], [], []
                picks: list[list] = [[] for _ in names]
                for data in texts_of(piece.column("text")):
                    s = shingles(data, k)
                    n = len(s)
                    sizes.append(n)
                    fps.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    for found, turn in zip(picks, PICKS):
                        x = (s ^ turn) * MIX
                        found.append(int((x ^ x >> np.uint64(32)).min().view(np.int64)) if n else None)
                    level = commonness[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.argsort(level, kind="stable")[: n - need(n, per_cent) + 1]
                    firsts.append(s[first].view(np.int64) if n else None)
                    maps.append(bitmap(s) if n else None)
                yield batch(schema, [piece.column("doc_id"), piece.column("key"), sizes, fps, *picks, firsts, maps])

    ddl = "doc_id long, key long, n_shingles long, fp binary, " + ", ".join(f"{h} long" for h in names) + ", tokens array<long>, bits binary"
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text").mapInArrow(run, ddl)


def n_blocks(count: str | Column, weight: str | Column) -> Column:
    """Blocks for so many sets with so many shingles in all."""
    return F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK), F.ceil(F.col(weight) / BLOCK_SHINGLES)).cast("int")


def block_of(key: str, blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.col(blocks)).cast("int")


def survey(rows: DataFrame, per_cent: int, pivots: bool) -> DataFrame:
    """Of the outs and ins (g, i, j, key, inside, n_shingles, bits) of each g, i, j those with a likely partner
    on the other side.  With `pivots` the ins are outs as well, and then turn to ins of a smaller key only."""
    schema = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.int64()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in runs(batches, ["g", "i", "j"]):
            key, inside = t.column("key").to_numpy(), t.column("inside").to_numpy()
            sizes = t.column("n_shingles").to_numpy()
            maps = [np.frombuffer(m.as_buffer(), np.uint64) for m in t.column("bits")]
            outs, ins = np.flatnonzero(~inside), np.flatnonzero(inside)
            near = likely(sizes, maps, outs, ins, per_cent)
            near &= key[outs][:, None] != key[ins][None, :]
            if pivots:
                near &= ~np.isin(key[outs], key[ins])[:, None] | (key[ins][None, :] < key[outs][:, None])
            keep = np.zeros(len(key), bool)
            keep[outs], keep[ins] = near.any(1), near.any(0)
            if keep.any():
                held.append(t.select(schema.names).filter(pa.array(keep)))
            if len(held) > 500:
                yield pa.concat_tables(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.concat_tables(held).combine_chunks().to_batches()[0]

    rows = rows.select(*schema.names, "n_shingles", "bits").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return rows.mapInArrow(run, "g long, i int, j int, key long, inside boolean")


def linked(fps: list[bytes], sets: list[np.ndarray], outs: list[int], ins: list[int], per_cent: int) -> list[tuple[bytes, bytes]]:
    """Links between outs and ins, those that connect what isn't yet connected by earlier ones."""
    if not outs or not ins:
        return []
    sizes = np.array([len(sets[j]) for j in ins])
    tokens = np.concatenate([sets[j] for j in ins])
    owner = np.repeat(np.arange(len(ins)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root, ins_at = np.arange(len(sets)), np.array(ins)
    links = []
    for i in outs:
        lo, hi = np.searchsorted(tokens, sets[i]), np.searchsorted(tokens, sets[i], "right")
        found = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(found)[:-1]), found) + np.arange(found.sum())
        both = np.bincount(owner[at], minlength=len(ins))
        near = ins_at[np.flatnonzero(100 * both >= per_cent * (len(sets[i]) + sizes - both))]
        for r in np.unique(root[near]):
            if r != root[i]:
                links.append((fps[i], fps[near[root[near] == r][0]]))
                root[root == r] = root[i]
    return links


def compared(docs: DataFrame, rows: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links (a, b: class fingerprints) between the outs and ins (g, i, j, key, inside) of each g, i, j, by their texts."""
    want = rows.select("g", "i", "j", F.col("key").alias("want"), "inside")
    texts = docs.select(row_key().alias("key"), "text").join(want, F.col("key") == F.col("want"))
    texts = texts.select("g", "i", "j", "key", "inside", "text").dropDuplicates(["g", "i", "j", "key", "inside"])
    pair = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[bytes, bytes]] = []
        for t in runs(batches, ["g", "i", "j"]):
            number: dict[bytes, int] = {}
            sets, sides = [], ([], [])
            for inside, data in zip(t.column("inside").to_pylist(), texts_of(t.column("text"))):
                s = shingles(data, k)
                fp = xxhash.xxh3_128_digest(s.tobytes())
                if fp not in number:
                    number[fp] = len(sets)
                    sets.append(s)
                sides[inside].append(number[fp])
            links += linked(list(number), sets, list(dict.fromkeys(sides[0])), list(dict.fromkeys(sides[1])), per_cent)
            if t.nbytes > 1 << 21:
                give_back()
            if len(links) > 10_000:
                yield batch(pair, list(zip(*links)))
                links = []
        if links:
            yield batch(pair, list(zip(*links)))

    # texts travel, not sets: they take less than half the room
    return texts.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a binary, b binary")


def gathered(spark: SparkSession, docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links of classes with pivots of the buckets that they share a min-hash with."""
    active, made, marks = classes, [], rows.select("key", "n_shingles", "bits")
    for r in range(ROUNDS):
        random = [F.min_by("key", F.xxhash64("key", F.lit(100 * r + p))).alias(f"p{p}") for p in range(PIVOTS)]
        buckets = active.groupBy(F.col(f"h{r}").alias("g")).agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"), *random)
        buckets = buckets.where("c > 1").select("g", n_blocks("c", "w").alias("blocks"), F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)])).alias("pivots"))
        salt = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(SALTS)).cast("int").alias("salt")
        salted = buckets.select("g", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        outs = active.select(F.col(f"h{r}").alias("g"), salt, "key").join(salted, ["g", "salt"])
        outs = outs.select("g", block_of("key", "blocks", r).alias("i"), "key", F.lit(False).alias("inside"))
        ins = buckets.select("g", "blocks", F.explode("pivots").alias("key"))
        ins = ins.select("g", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), "key", F.lit(True).alias("inside"))
        both = outs.unionByName(ins).withColumn("j", F.lit(r)).join(marks, "key")
        made.append(cut(spark, survey(both, per_cent, True), "pivots", narrow=True))
        if r + 1 < ROUNDS:
            found = made[-1].where("NOT inside").select("key").distinct()
            before, active = active, cut(spark, active.join(found, "key", "left_anti"), "active", narrow=True)
            if r:
                drop(spark, before)
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    links = cut(spark, compared(docs, every, k, per_cent), "links")
    drop(spark, *made, active)
    return links


def wide_tokens(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """token: those of the matrix's wide rows, as a sample of the classes shows them."""
    some = classes.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(LOOKED_AT)) == 0).select("key")
    tokens = rows.select("key", "tokens").join(some, "key").select(F.explode("tokens").alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("c")).where(f"c >= {WIDE // LOOKED_AT}").select("token")


def matrix_pairs(rows: DataFrame, named: DataFrame, wide: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a <= b) of groups that meet in a row of the matrix and may reach the threshold from there; a loose group
    also meets itself."""
    tokens = rows.select("key", "tokens").join(named.select("key", "label", "place", F.col("n_shingles").alias("n")), "key")
    tokens = tokens.select("label", "n", "place", F.posexplode("tokens").alias("pos", "token"))
    tokens = tokens.join(wide.withColumn("wide", F.lit(WIDE_ROWS)), "token", "left").where(f"place in ({ALL_ROWS}, coalesce(wide, {NARROW_ROWS}))")
    tokens = tokens.select("token", "label", F.expr("shiftleft(n, 32) + pos").alias("at")).repartition("token")
    cells = tokens.select("token", "label", F.expr("shiftright(at, 32)").alias("n"), F.expr("at & 4294967295L").alias("pos"))
    early = F.expr(f"pos <= n - ({2 * per_cent} * n + {99 + per_cent}) div {100 + per_cent}")
    rest = F.col("n") - F.col("pos")
    cells = cells.groupBy("token", "label").agg(
        F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(rest).alias("rest"),
        F.min(F.when(early, F.col("n"))).alias("i_least"), F.max(F.when(early, F.col("n"))).alias("i_most"), F.max(F.when(early, rest)).alias("i_rest"),
    )
    small = cells.where("i_least IS NOT NULL").select("token", F.col("label").alias("a"), "i_least", "i_most", "i_rest")
    met = small.join(cells.select("token", F.col("label").alias("b"), "least", "most", "rest", "c"), "token")
    met = met.where("(a <> b OR c > 1 AND a & 1 = 1) AND most >= i_least").where(f"100 * i_most >= {per_cent} * least")
    met = met.where(f"{100 + per_cent} * least(i_rest, rest) >= {per_cent} * (i_least + least)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unions(members: DataFrame) -> DataFrame:
    """g, i, union: the token union of each block of a group, as a bitmap."""
    schema = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("union", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["g", "i"]):
            out = union(t.column("bits").to_pylist())
            yield batch(schema, [[t.column("g")[0].as_py()], [t.column("i")[0].as_py()], [out]])

    many = members.where("members > 1").select("g", "i", "bits").repartition("g", "i").sortWithinPartitions("g", "i")
    return members.where("members = 1").select("g", "i", F.col("bits").alias("union")).unionByName(
        many.mapInArrow(run, "g long, i int, union binary")
    )


def reaching(queries: DataFrame, per_cent: int) -> DataFrame:
    """Queries (with g, i, union) whose overlap with the union may reach their need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column("n_shingles").to_numpy()
            own, others = rows.column("bits"), rows.column("union")
            keep = np.zeros(rows.num_rows, bool)
            for i, n in enumerate(sizes.tolist()):
                a, b = np.frombuffer(own[i].as_buffer(), np.uint64), np.frombuffer(others[i].as_buffer(), np.uint64)
                keep[i] = overlap_bound(n, a, b) >= need(n, per_cent)
            yield rows.filter(pa.array(keep)).drop_columns(["union"])

    return queries.select("g", "i", "key", "n_shingles", "bits", "union").mapInArrow(run, "g long, i int, key long, n_shingles long, bits binary")


def matched(spark: SparkSession, docs: DataFrame, rows: DataFrame, named: DataFrame, wide: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links between groups and within loose ones.  `named`: key, n_shingles, label (odd: of a loose group), place, members
    and weight (of the group) of every class; twice, if it is in a loose group."""
    pairs = cut(spark, matrix_pairs(rows, named, wide, per_cent), "pairs")
    large = named.where("members > 1").groupBy("label").agg(F.first("members").alias("members"))
    sized = pairs
    for side in ("a", "b"):
        size = large.select(F.col("label").alias(side), F.col("members").alias(f"n_{side}"))
        sized = sized.join(size, side, "left").withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(1)))
    first = "(n_a < n_b OR n_a = n_b AND a < b)"  # the group with fewer members asks
    sized = sized.select(F.expr(f"if({first}, a, b)").alias("q"), F.expr(f"if({first}, b, a)").alias("g"))
    marks = rows.select("key", "bits")
    members = named.join(sized.select(F.col("g").alias("label")).distinct(), "label")
    members = members.select(F.col("label").alias("g"), "key", "n_shingles", "members", n_blocks("members", "weight").alias("blocks"))
    members = members.withColumn("i", block_of("key", "blocks", 7)).join(marks, "key")
    members = cut(spark, members.select("g", "i", "key", "n_shingles", "members", "blocks", "bits"), "members", narrow=True)
    asking = sized.join(named.select(F.col("label").alias("q"), "key", "n_shingles"), "q").join(marks, "key")
    queries = reaching(asking.join(unions(members), "g"), per_cent)
    opened = cut(spark, queries, "opened", narrow=True)
    parts = opened.groupBy("g", "i").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w")).select("g", "i", n_blocks("c", "w").alias("parts"))
    outs = opened.join(parts, ["g", "i"]).withColumn("j", block_of("key", "parts", 8))
    ins = members.join(parts, ["g", "i"]).withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    columns = ["g", "i", "j", "key", "n_shingles", "bits"]
    both = outs.select(*columns, F.lit(False).alias("inside")).unionByName(ins.select(*columns, F.lit(True).alias("inside")))
    chosen = cut(spark, survey(both, per_cent, False), "chosen", narrow=True)
    links = cut(spark, compared(docs, chosen, k, per_cent), "links")
    drop(spark, pairs, members, opened, chosen)
    return links


def with_groups(rows: DataFrame, classes: DataFrame, labels: DataFrame, wide: DataFrame) -> DataFrame:
    """key, n_shingles, label, place, members and weight of every class: those of a tight group share an even label, others
    have one of their own.  Those with tokens in wide rows may be in a loose group too, with a row of an odd label."""
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    salt = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    tokens = rows.select("key", F.explode("tokens").alias("token"))
    often = tokens.join(wide, "token", "left_semi").select("key").distinct()
    picks = named.where("label IS NULL").join(often, "key", "left_semi").select("key", F.posexplode(F.array(*[f"h{r}" for r in range(ROUNDS)])).alias("r", "h"))
    shared = picks.groupBy("r", "h").agg(F.count("*").alias("c")).where("c > 1").withColumn("salt", salts)
    loose = picks.withColumn("salt", salt).join(shared, ["r", "h", "salt"]).groupBy("key").agg(F.max(F.struct("c", "r", "h")).alias("x"))
    loose = loose.select("key", F.expr("xxhash64(x.r, x.h) | 1L").alias("loose"))
    own = F.struct(F.expr("xxhash64(coalesce(label, fp)) & ~1L").alias("label"), F.expr(f"if(loose IS NULL, {ALL_ROWS}, {NARROW_ROWS})").alias("place"))
    both = F.array_compact(F.array(own, F.when(F.col("loose").isNotNull(), F.struct(F.col("loose").alias("label"), F.lit(WIDE_ROWS).alias("place")))))
    many = F.col("label").isNotNull() | F.col("loose").isNotNull()
    named = named.join(loose, "key", "left").select("key", "n_shingles", many.alias("many"), F.inline(both))
    sums = named.where("many").groupBy("label").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
    named = named.withColumn("salt", salt).join(sums.withColumn("salt", salts), ["label", "salt"], "left")
    return named.select("key", "n_shingles", "label", "place", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("weight", "n_shingles").alias("weight"))


def grouped(spark: SparkSession, docs: DataFrame, k: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, n_shingles, fp of every row; and fp, doc_id (the least), label of every class: classes of one component
    have one label, whatever ids their rows have."""
    profiled = cut(spark, profiles(docs, k, per_cent, sketch(docs, k)), "profiles")
    rows = cut(spark, profiled.select("doc_id", "key", "n_shingles", "fp"), "rows", narrow=True)
    full = profiled.where("fp IS NOT NULL")
    hashes = [F.max(f"h{r}").alias(f"h{r}") for r in range(ROUNDS)]
    classes = full.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"), *hashes)
    classes = cut(spark, classes, "classes", narrow=True)
    links = gathered(spark, docs, full, classes, k, per_cent)
    labels = components(spark, links)
    wide = cut(spark, wide_tokens(full, classes), "wide", narrow=True)
    named = cut(spark, with_groups(full, classes, labels, wide), "named", narrow=True)
    more = matched(spark, docs, full, named, wide, k, per_cent)
    if more.take(1):
        drop(spark, labels)
        labels = components(spark, links.unionByName(more))
    of = classes.select("fp", "doc_id").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    of = cut(spark, of.select("fp", "doc_id", F.coalesce("label", "fp").alias("label")), "labels", narrow=True)
    drop(spark, profiled, classes, links, wide, named, more, labels)
    return rows, of


def join(spark: SparkSession, docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when 100 |A and B| >= per_cent |A or B|."""
    rows, of = grouped(spark, docs, k, per_cent)
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    names = of.select("fp", "label").join(least, "label").select("fp", "component_id")
    return rows.join(names, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def survivors(spark: SparkSession, docs: DataFrame, k: int = 5, per_cent: int = 80) -> DataFrame:
    """One row of each component: that of the least doc_id (null is the largest), then of the least fingerprint and
    row key, then the least as JSON.  Rows without words link with nothing and all stay."""
    rows, of = grouped(spark, docs, k, per_cent)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    stay = of.groupBy("label").agg(F.min_by(F.struct("doc_id", "fp"), first).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.fp").alias("f"))
    found = rows.join(stay, (F.col("fp") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("id")))
    found = found.groupBy("fp", "key").agg(F.count("*").alias("c")).groupBy("fp").agg(F.min(F.struct("key", "c")).alias("x")).select("x.*")
    found = cut(spark, found, "survivors", narrow=True)
    key, want = fresh("key", docs), fresh("want", docs)
    marked = docs.withColumn(key, row_key())
    once = found.where("c = 1").select(F.col("key").alias(want))
    kept = marked.join(once, F.col(key) == F.col(want), "left_semi").drop(key)
    again = found.where("c > 1").select(F.col("key").alias(want))
    if again.take(1):  # rows equal in doc_id and text
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # told apart as JSON: maps have no order of their own
        equal = marked.join(again, F.col(key) == F.col(want), "left_semi")
        equal = equal.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(want))
        kept = kept.unionByName(equal.select(f"{want}.*"))
    drop(spark, rows, of)
    return kept.unionByName(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))
