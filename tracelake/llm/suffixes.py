"""Removal of repeated passages by suffix sorting.

A repeat is a string of `length` bytes that also starts earlier: in a smaller doc_id, or earlier in
the same document.  Not every suffix has to be sorted to find them all.  In each window of `length`
bytes, the seed of GRAM bytes with the least hash (leftmost, if several) marks one position, its
anchor; equal windows have their anchors at the same place.  So suffixes start at anchors, one in
about thirty positions.

Classes.  An anchor's surroundings are the bytes that its windows cover.  Anchors of equal seed and
surroundings are a class, and all but the earliest of a class are repeats as a whole.  Each task first
settles this within a slice of texts, so a seed that is everywhere reaches the shuffle as one row for
each slice and class.  A class whose seed has no other class is done with.

Suffixes.  Of the other classes the earliest member goes on, with its surroundings: the suffix from the
anchor on, and the bytes to the left after it.  Splitters, seeds of a sample in order, cut the suffixes
into ranges of leading bytes; a bucket is sorted by multikey quicksort.  What neighbours in the order
share tells how far to the right a suffix agrees with any other, which leaves few windows that can
repeat; these are compared by 64-bit hashes.  Splitters are whole seeds, and strings that match share
their seed, so a match never lies across the boundary of two buckets.  A seed with more classes than
a bucket should hold isn't sorted: its windows are dealt out by their hashes and compared by aggregation.

Texts are read twice and shuffled once for the suffixes, and once more for the cuts.

Cases: a null or empty text has no bytes; a text shorter than `length` keeps all of them; a null
doc_id counts as smaller than all; rows that repeat a doc_id are ordered by a 64-bit hash of their
texts, and rows that are equal in both count as one document (they get equal results); an empty table
gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelake.llm.common import batch, cut, drop, fan_out, fresh, row_key, runs, slices, texts_of

GRAM = 32
CHUNK = 1 << 18
POSITION = np.uint64((1 << 23) - 1)
ODD = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SYMBOL = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Suffixes in a bucket, about; classes of one seed that are sorted together; documents sampled for splitters.
BUCKET, MOST_CLASSES, SAMPLED = 20_000, 1 << 14, 4096
NONE = -(2**63)


def _powers(base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, for all places of a chunk."""
    out = np.ones(CHUNK + 256, np.uint64)
    size, step = 1, base % 2**64
    while size < len(out):  # out[size + i] = out[i] * base^size
        part = out[size : 2 * size]
        part[:] = out[: len(part)] * np.uint64(step)
        size, step = 2 * size, step * step % 2**64
    return out


BASE = 0x2545F4914F6CDD1D
POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 2**64))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as an integer (the last seven positions are left out)."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for o in range(8):
        if n > o:
            count = (n - o + 7) // 8
            out[o::8] = np.frombuffer(data, "<u8", count, o)
    return out


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * ODD[31]
    return h ^ h >> np.uint64(29)


def sums_of(part: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' symbols times powers of the base, from which any range's hash follows."""
    out = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(SYMBOL[part] * POWERS[: len(part)], out=out[1:])
    return out


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie within one document of the concatenated texts.

    Returns for each its position, its seed's hash, the hash of its surroundings, and the first and last
    start of its windows.
    """
    buf = np.frombuffer(data, np.uint8)
    grams = length - GRAM + 1
    found = []
    for at in range(0, max(0, len(buf) - length + 1), CHUNK):
        part = buf[at : at + CHUNK + length - 1]
        w = words_at(part)
        n = len(part) - GRAM + 1
        h = np.zeros(n, np.uint64)
        for j in range(GRAM // 8):
            h += w[8 * j : 8 * j + n] * ODD[j]
        h = scramble(h)
        key = h & ~POSITION | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= grams:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if grams > span:
            key = np.minimum(key[: len(key) - (grams - span)], key[grams - span :])
        place = (key & POSITION).astype(np.int64)  # by window start
        p = np.arange(len(place))
        ok = p + at + length <= ends[np.searchsorted(ends, p + at, "right")]
        p, place = p[ok], place[ok]
        if len(p):
            doc = np.searchsorted(ends, p + at, "right")
            cut_at = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1
            first, last = p[np.append(0, cut_at)], p[np.append(cut_at, len(p)) - 1]
            place = place[np.append(0, cut_at)]
            sums = sums_of(part)
            around = (sums[last + length] - sums[first]) * INVERSES[first]
            shape = ((place - first) << 8 | (place - last)).astype(np.uint64)
            found.append((place + at, h[place], scramble(around + shape * ODD[9]), first + at, last + at))
    if not found:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def pack(offset: np.ndarray, back: np.ndarray, fore: np.ndarray) -> np.ndarray:
    """Offset in the text, and how far before the anchor its windows start, least and most."""
    return offset << 14 | back << 7 | fore


def _joined(piece: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    texts = list(texts_of(piece.column("text")))
    return b"".join(texts), np.cumsum([len(t) for t in texts])


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document that touch as one."""
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    far = np.maximum.accumulate(hi + doc * (1 << 40))  # ranges of a later document lie further
    start = np.flatnonzero(np.append(True, (lo + doc * (1 << 40))[1:] > far[:-1] + 1) | np.append(True, doc[1:] != doc[:-1]))
    stop = np.append(start[1:], len(doc)) - 1
    return doc[start], lo[start], (far - doc * (1 << 40))[stop]


def seeds(docs: DataFrame, length: int) -> DataFrame:
    """h, c, doc_id, key, a, b: anchors (seed's hash, class, packed place), of each slice's classes the earliest;
    and ranges of window starts (a to b, c null) that the slice itself shows to be repeats."""
    names = ["h", "c", "doc_id", "key", "a", "b"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for piece in slices(rows):
                data, ends = _joined(piece)
                at, h, c, first, last = anchors(data, ends, length)
                if not len(at):
                    continue
                doc = np.searchsorted(ends, at, "right")
                start = np.append(0, ends)[doc]
                ids = piece.column("doc_id").fill_null(NONE).to_numpy(zero_copy_only=False)
                keys = piece.column("key").to_numpy()
                order = np.lexsort((keys, ids))
                new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0))
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.cumsum(new)  # rows that count as one document have one rank
                twin = np.empty(len(ids), bool)
                twin[order] = ~new
                by = np.flatnonzero(~twin[doc])
                by = by[np.lexsort((at[by] - start[by], rank[doc[by]], c[by], h[by]))]
                again = np.append(False, (h[by][1:] == h[by][:-1]) & (c[by][1:] == c[by][:-1]))
                one, more = by[~again], by[again]
                a = pack(at - start, at - last, at - first)
                # bits that the hash loses only cost work: the class is compared as well
                out = [(h[one] >> np.uint64(16)).view(np.int64), c[one].view(np.int64), doc[one], a[one], np.zeros(len(one), np.int64)]
                if len(more):
                    d, lo, hi = merged(doc[more], (first - start)[more], (last - start)[more])
                    spread = (scramble((lo + d * 977).astype(np.uint64)) | np.uint64(1 << 63)).view(np.int64)
                    out = [np.concatenate(x) for x in zip(out, (spread, np.zeros(len(d), np.int64), d, lo, hi))]
                null = np.arange(len(out[0])) >= len(one)
                doc_ids = pa.array(ids[out[2]], mask=ids[out[2]] == NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(out[1], mask=null), doc_ids, pa.array(keys[out[2]]), pa.array(out[3]), pa.array(out[4], mask=~null)],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _splitters(docs: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Seeds that cut those of a sample of documents into even parts.  The sample decides on balance only."""
    if buckets < 2:
        return np.empty(0, f"S{GRAM}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seed", pa.binary())])
        for rows in batches:
            for piece in slices(rows):
                data, ends = _joined(piece)
                at, h, *_ = anchors(data, ends, length)
                at = at[h % np.uint64(8) == 0]
                yield batch(schema, [[data[i : i + GRAM] for i in at.tolist()]])

    every = max(1, docs.count() // SAMPLED)
    some = docs.where(F.pmod(row_key(), F.lit(every)) == 0).select("text").mapInArrow(run, "seed binary")
    found = np.sort(np.array([bytes(r.seed) for r in some.collect()], f"S{GRAM}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of `words`, compared word by word.

    All parts are worked on at once: each is split in three by its middle row's word at the part's level
    (less, equal, greater), equal ones go on with the next word, and parts of one row are done.
    """
    n, width = words.shape
    order = np.arange(n)
    start, size, level = np.array([0] * (n > 0)), np.array([n] * (n > 0)), np.array([0] * (n > 0))
    while len(start):
        go = (size > 1) & (level < width)
        start, size, level = start[go], size[go], level[go]
        part = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(part)) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) if len(start) else part
        rows = order[place]
        pivot = words[order[start + size // 2], level]
        w, p = words[rows, level[part]], pivot[part]
        side = part * 3 + (w >= p) + (w > p)
        by = np.argsort(side, kind="stable")
        order[place] = rows[by]
        counts = np.bincount(side, minlength=3 * len(start))
        new = np.repeat(start, 3) + (np.cumsum(counts.reshape(-1, 3), 1) - counts.reshape(-1, 3)).ravel() if len(start) else start
        deeper = np.repeat(level, 3) + np.tile([0, 1, 0], len(level))
        start, size, level = new, counts, deeper
    return order


def shared_words(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order, how many leading words it shares with the one before."""
    same = words[order[1:]] == words[order[:-1]]
    return np.append(0, np.logical_and.accumulate(same, axis=1).sum(1))


def repeated(doc_id: np.ndarray, key: np.ndarray, a: np.ndarray, ctx: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the anchors of a bucket, those with repeated windows: their rows, and ranges of window starts.

    ctx: for each the `length` bytes from the anchor on, then the length - GRAM before it, nearest first, with zeros
    for all that its windows don't cover.
    """
    side = length - GRAM
    back, fore = a >> 7 & 127, a & 127
    fill = -ctx.shape[1] % 8
    words = np.ascontiguousarray(np.pad(ctx, ((0, 0), (0, fill)))).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    shared = shared_words(words, order)
    seed = np.empty(len(order), np.int64)
    seed[order] = np.cumsum(shared < GRAM // 8)
    most = np.empty(len(order), np.int64)  # words shared with any other: a neighbour shares most
    most[order] = np.maximum(shared, np.append(shared[1:], 0))
    least = np.maximum(back, length - (8 * most + 7))  # windows that start nearer need more of the right side
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((a, key, doc_id))] = np.arange(len(order))
    who, dist, hashes = [], [], []
    some = np.flatnonzero((most >= GRAM // 8) & (least <= fore))
    for j in range(0, len(some), 4096):
        part = some[j : j + 4096]
        row = np.concatenate([ctx[part, length:][:, ::-1], ctx[part, :length]], 1)
        sums = np.zeros((len(part), length + side + 1), np.uint64)
        np.cumsum(SYMBOL[row] * POWERS[: length + side], axis=1, out=sums[:, 1:])
        h = (sums[:, length:] - sums[:, : side + 1]) * INVERSES[: side + 1]  # by start, from the leftmost on
        d = side - np.arange(side + 1)
        rows, starts = np.nonzero((least[part][:, None] <= d) & (d <= fore[part][:, None]))
        who.append(part[rows])
        dist.append(d[starts])
        hashes.append(h[rows, starts])
    if not who:
        none = np.empty(0, np.int64)
        return none, none, none
    who, dist, hashes = np.concatenate(who), np.concatenate(dist), np.concatenate(hashes)
    by = np.lexsort((rank[who], hashes, dist, seed[who]))
    who, dist, hashes = who[by], dist[by], hashes[by]
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (dist[1:] == dist[:-1]) & (seed[who[1:]] == seed[who[:-1]]))
    who, dist = who[again], dist[again]
    if not len(who):  # texts that agree around their anchors, but in no whole window
        return who, who, who
    start = (a[who] >> 14) - dist
    return merged(who, start, start)


def _surround(cuts: np.ndarray, length: int) -> Callable:
    """bucket, doc_id, key, a, ctx of the anchors of documents with their places."""
    side = length - GRAM
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("ctx", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for rows in batches:
            for piece in slices(rows):
                for doc_id, key, text, places in zip(
                    piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(),
                    texts_of(piece.column("text")), piece.column("places"),
                ):
                    a = np.unique(np.asarray(places.values, np.int64))
                    at = a >> 14
                    padded = np.zeros(len(text) + side + length, np.uint8)
                    padded[side : side + len(text)] = np.frombuffer(text, np.uint8)
                    around = np.lib.stride_tricks.sliding_window_view(padded, length + side)[at]
                    column = np.arange(length + side)  # only what the anchor's own windows cover
                    own = (column >= (side - (a & 127))[:, None]) & (column < (side + length - (a >> 7 & 127))[:, None])
                    around = np.where(own, around, np.uint8(0))
                    ctx = np.concatenate([around[:, side:], around[:, :side][:, ::-1]], 1)
                    seed = np.ascontiguousarray(ctx[:, :GRAM]).view(f"S{GRAM}")[:, 0]
                    bucket = np.searchsorted(cuts, seed, "right").astype(np.int32)
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length + side), len(a), [None, pa.py_buffer(ctx.tobytes())])
                    ids = pa.array([doc_id] * len(a), pa.int64())
                    columns = [pa.array(bucket), ids, pa.array([key] * len(a), pa.int64()), pa.array(a), data.cast(pa.binary())]
                    held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
                    count += len(a)
                    if count >= 20_000:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, count = [], 0
        if count:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


SPAN = "doc_id long, key long, lo long, hi long"
_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _sorted(length: int) -> Callable:
    """Ranges of repeated windows, bucket after bucket of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            doc_id = t.column("doc_id").combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False)
            key, a = t.column("key").to_numpy(), t.column("a").to_numpy()
            ctx = np.frombuffer(b"".join(t.column("ctx").to_pylist()), np.uint8).reshape(len(a), -1)
            by = np.lexsort((a, key, doc_id))
            same = (doc_id[by][1:] == doc_id[by][:-1]) & (key[by][1:] == key[by][:-1]) & (a[by][1:] == a[by][:-1])
            by = by[np.append(True, ~same)]  # rows that count as one document bring their anchors once each
            doc_id, key, a, ctx = doc_id[by], key[by], a[by], ctx[by]
            who, lo, hi = repeated(doc_id, key, a, ctx, length)
            if len(who):
                yield batch(_SPANS, [pa.array(doc_id[who], mask=doc_id[who] == NONE), key[who], lo, hi])

    return run


def _windowed(length: int) -> Callable:
    """A row for each window of the anchors: hashes of the seed and the window, and where it starts."""
    schema = pa.schema([(n, pa.int64()) for n in ("h", "w", "doc_id", "key", "lo")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for piece in slices(rows):
                for doc_id, key, text, places in zip(
                    piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(),
                    texts_of(piece.column("text")), piece.column("places"),
                ):
                    a = np.unique(np.asarray(places.values, np.int64))
                    at, low, high = a >> 14, (a >> 14) - (a & 127), (a >> 14) - (a >> 7 & 127)
                    by = np.argsort(high)  # an anchor whose windows lie in two chunks has two places, the further first
                    at, low, high = at[by], low[by], high[by]
                    starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(low, high)]))
                    anchor = at[np.searchsorted(high, starts)]  # ranges of different anchors of a document don't overlap
                    buf = np.frombuffer(text, np.uint8)
                    for j in range(0, len(starts), 4096):
                        s, p = starts[j : j + 4096], anchor[j : j + 4096]
                        view = np.lib.stride_tricks.sliding_window_view(buf, length)[s]
                        w = (SYMBOL[view] * POWERS[:length]).sum(1, dtype=np.uint64) + (p - s).astype(np.uint64) * ODD[9]
                        seed = (SYMBOL[np.lib.stride_tricks.sliding_window_view(buf, GRAM)[p]] * POWERS[:GRAM]).sum(1, dtype=np.uint64)
                        n = len(s)
                        yield batch(schema, [seed.view(np.int64), w.view(np.int64), [doc_id] * n, [key] * n, s])

    return run


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents that hold anchors, with these: doc_id, key, text, places."""
    lists = places.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.collect_set("a").alias("places"))
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text")
    return rows.join(lists, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "key", "text", "places")


def spans(spark: SparkSession, docs: DataFrame, length: int = 100) -> list[DataFrame]:
    """Tables of doc_id, key (the row's), lo, hi: all windows that start at lo to hi are repeats."""
    if not GRAM + 8 <= length <= GRAM + 127:
        raise ValueError(f"length must be from {GRAM + 8} to {GRAM + 127}")
    of_class = Window.partitionBy("h", "c").orderBy("doc_id", "key", "a")
    ranked = seeds(docs, length).repartition("h").withColumn("nth", F.rank().over(of_class))
    first = (F.col("nth") == 1) & F.col("c").isNotNull()
    ranked = ranked.withColumn("classes", F.sum(F.when(first, 1).otherwise(0)).over(Window.partitionBy("h")))
    ranked = ranked.where("c IS NULL OR nth > 1 OR classes > 1")
    at = F.shiftright("a", 14)
    whole = F.col("c").isNull()
    ranked = ranked.select(
        "doc_id", "key", "a", F.when(first, F.col("classes")).alias("classes"),
        F.when(whole, F.col("a")).otherwise(at - F.expr("a & 127")).alias("lo"),
        F.when(whole, F.col("b")).otherwise(at - F.expr("shiftright(a, 7) & 127")).alias("hi"),
    )
    found = cut(spark, ranked, "anchors")
    open_ = found.where(f"classes <= {MOST_CLASSES}")
    cuts = _splitters(docs, length, 1 + open_.count() // BUCKET)
    around = _with_places(docs, open_).mapInArrow(_surround(cuts, length), "bucket int, doc_id long, key long, a long, ctx binary")
    around = around.repartition("bucket").sortWithinPartitions("bucket")
    out = [found.where("classes IS NULL").select("doc_id", "key", "lo", "hi"), cut(spark, around.mapInArrow(_sorted(length), SPAN), "spans")]
    hot = found.where(f"classes > {MOST_CLASSES}")
    if hot.take(1):
        rows = cut(spark, _with_places(docs, hot).mapInArrow(_windowed(length), "h long, w long, doc_id long, key long, lo long"), "windows")
        earliest = rows.groupBy("h", "w").agg(F.min(F.struct("doc_id", "key", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = rows.join(earliest, ["h", "w"]).where(F.struct("doc_id", "key", "lo") > F.col("first"))
        out.append(cut(spark, later.select("doc_id", "key", "lo", F.col("lo").alias("hi")), "spans"))
        drop(spark, rows)
    return out


def _with_spans(spark: SparkSession, docs: DataFrame, length: int) -> tuple[DataFrame, str, str]:
    """The documents with lists of where repeated windows start, and the lists' names."""
    found, *more = spans(spark, docs, length)
    for m in more:
        found = found.unionByName(m)
    id_, key, k, lo, hi = (fresh(n, docs) for n in ("span_id", "span_key", "span_of", "span_lo", "span_hi"))
    lists = found.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(k)).agg(F.collect_list("lo").alias(lo), F.collect_list("hi").alias(hi))
    rows = docs.withColumn(key, row_key())
    same = (F.col(key) == F.col(k)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    return rows.join(lists, same, "left").drop(key, k, id_), lo, hi


def without(text: bytes, lo: pa.ListScalar, hi: pa.ListScalar, length: int) -> tuple[bytes, int]:
    """The text without the windows that start at lo to hi, and how many runs were cut."""
    if not lo.is_valid:
        return text, 0
    a, b = np.asarray(lo.values, np.int64), np.asarray(hi.values, np.int64) + length
    by = np.argsort(a)
    a, top = a[by], np.maximum.accumulate(b[by])
    start = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
    a, b = a[start].tolist(), top[np.append(start[1:], len(top)) - 1].tolist()
    return b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])), len(a)


def removed(spark: SparkSession, docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, lo, hi = _with_spans(spark, docs.select("doc_id", "text"), length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                out = [[], [], [], []]
                for text, x, y in zip(texts_of(piece.column("text")), piece.column(lo), piece.column(hi)):
                    kept, cuts = without(text, x, y, length)
                    for column, value in zip(out, (len(text), len(text) - len(kept), cuts, hashlib.sha256(kept).hexdigest())):
                        column.append(value)
                yield batch(schema, [piece.column("doc_id"), *out])

    rows = rows.select(F.col("doc_id").cast("long"), "text", lo, hi)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(spark: SparkSession, docs: DataFrame, length: int = 100, gone: str = "gone") -> DataFrame:
    """All columns of the documents, the text without repeated passages and without the rest of a character that a
    cut goes through; and a column `gone` with the bytes that were cut (null for a null text, which stays null)."""
    if gone in docs.columns:
        raise ValueError(f"the documents have a column {gone}")
    rows, lo, hi = _with_spans(spark, docs, length)
    names = docs.columns
    schema = StructType([*[StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema], StructField(gone, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b):
                texts, cut_off = [], []
                for text, is_null, x, y in zip(texts_of(piece.column("text")), piece.column("text").is_null().to_pylist(), piece.column(lo), piece.column(hi)):
                    kept, _ = without(text, x, y, length)
                    texts.append(None if is_null else kept.decode("utf-8", "ignore"))
                    cut_off.append(None if is_null else len(text) - len(kept))
                columns = [pa.array(texts, pa.string()) if n == "text" else piece.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut_off, pa.int64())], names=[*names, gone])

    return rows.select(*[F.col(f"`{n}`") for n in names], lo, hi).mapInArrow(run, schema)
