"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are packed into blocks of a bounded size.  Query blocks are dealt into rows of a grid and candidate
blocks into its columns, so that each cell is a task of bounded size and a block is shipped once to each
cell of its row or column.  Candidates are kept as postings: for each component, the vectors where it
isn't zero and their weights.  Component after component, the queries that have it scatter their weight times
the postings into a dense array of scores.  Of each query's scores the k-th largest is found by partition
selection, all above it and the smallest ids of its ties are kept; a cell merges its blocks' lists, and the
cells' lists are merged by rank.

Cases: null vectors and those with null or non-finite components take no part; nor do rows with a
null id; vectors may differ in length (a missing component is 0); rows that repeat an id are
candidates of their own but never one another's; fewer than k candidates give shorter lists; components of any
size are taken exactly (whole numbers of any length, in blocks of their own), and ranks go by exact scores; a score
beyond 64 bits is shown as the largest or smallest number of 64 bits; a component that times the scale
isn't finite counts as non-finite; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import batch, cut, fan_out

BLOCK = 4096
#: Components in a block, so that its size doesn't follow the width of the vectors.
CELLS = 1 << 20
SCORES = 1 << 18  # cells of the score array
#: Blocks of queries in a row of the grid, and of candidates in a column.
QUERY_BLOCKS, CANDIDATE_BLOCKS = 8, 32
LEAST, MOST = -(2**63), 2**63 - 1
#: Bytes of an exact score: two components of at most 2^1024 each, and as many products as a vector can have.
EXACT = 272


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of the vectors that take part, as doubles: those are exact for whole numbers of this origin."""
    v = F.col(vector_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    v = v.select("id", F.expr(f"transform(v, x -> {scale} * x)").alias("v"))
    v = v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    # From 2^53 on a double is a whole number, and floor() would be cut to 64 bits.
    return v.select("id", F.expr("transform(v, x -> if(abs(x) < 9007199254740992D, cast(floor(x) as double), x))").alias("q"))


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK vectors and CELLS components in one row: n, width, kind, ids, data (row by row).

    The kind is the smallest of int32, int64 and float64 that holds a row's components; rows of different
    kinds go to different blocks, so that a few large ones don't slow the others down."""
    schema = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, widest = [], 0, 1

        def flush(some: pa.Table) -> Iterator[pa.RecordBatch]:
            q = some.column("q").combine_chunks()
            sizes = np.diff(q.offsets.to_numpy())
            data = np.zeros((len(sizes), int(sizes.max(initial=0))))
            data[np.arange(data.shape[1]) < sizes[:, None]] = q.flatten().to_numpy()
            ids = some.column("id").to_numpy().astype("<i8")
            largest = np.abs(data).max(axis=1, initial=0)
            kinds = np.where(largest < 2.0**31, 0, np.where(largest < 2.0**63, 1, 2))
            for n, kind in enumerate(("int32", "int64", "float64")):
                at = np.flatnonzero(kinds == n)
                if len(at):
                    x = data[at].astype(kind)
                    row = {"n": len(at), "width": x.shape[1], "kind": kind, "ids": ids[at].tobytes(), "data": x.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            held.append(b)
            count += b.num_rows
            widest = max(widest, pc.max(pc.list_value_length(b.column("q"))).as_py() or 1)
            size = max(1, min(BLOCK, CELLS // widest))
            if count >= size:
                every = pa.Table.from_batches(held)
                for first in range(0, count - size + 1, size):
                    yield from flush(every.slice(first, size))
                held, count = every.slice(count - count % size).to_batches(), count % size
        if count:
            yield from flush(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "n int, width int, kind string, ids binary, data binary")


def peak(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best of a candidate block: rows of queries, candidate ids, scores; by query, best first."""
    order = np.argsort(c_ids, kind="stable")
    c, c_ids = c[order], c_ids[order]
    postings = []  # rows and weights; most rows: the whole column, where the zeros add nothing
    for d in range(c.shape[1]):
        rows = np.flatnonzero(c[:, d])
        dense = 2 * len(rows) > len(c)
        postings.append((None, c[:, d].copy()) if dense else (rows, c[rows, d]))
    out = [NONE]
    step = max(1, SCORES // max(1, len(c)))
    for first in range(0, len(q), step):
        some, ids = q[first : first + step], q_ids[first : first + step]
        some = some if some.dtype == object else some.astype(np.int64)
        most = peak(some) * peak(c) * max(1, c.shape[1])  # beyond 64 bits: Python's integers
        scores = np.zeros((len(some), len(c)), np.int32 if most < 2**31 else np.int64 if most < 2**63 else object)
        room = np.empty_like(scores)
        for d, (rows, weights) in enumerate(postings[: some.shape[1]]):
            having = np.flatnonzero(some[:, d])
            if not len(having) or not len(weights):
                continue
            weights = weights.astype(scores.dtype)
            if rows is None and 2 * len(having) > len(some):
                np.multiply(some[:, d, None].astype(scores.dtype), weights, out=room)
                scores += room
            else:
                at = np.ix_(having, np.arange(len(c)) if rows is None else rows)
                scores[at] += np.multiply.outer(some[having, d].astype(scores.dtype), weights)
        own = ids[:, None] == c_ids[None, :] if len(np.intersect1d(ids, c_ids)) else None
        if len(c) > 4 * k:
            low = scores if own is None else np.where(own, np.array(-most - 1, scores.dtype), scores)
            cut_at = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
            keep = low >= cut_at[:, None]
        else:
            keep = np.ones(scores.shape, bool)
        if own is not None:
            keep &= ~own
        r, col = np.nonzero(keep)
        out.append((r + first, c_ids[col], scores[r, col]))
    return top(*(np.concatenate(x) for x in zip(*out)), k)


#: No rows: positions of queries, ids, scores.
NONE = tuple(np.empty(0, np.int64) for _ in range(3))


def top(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row, by row, best first."""
    by = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[by], ids[by], scores[by]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], ids[keep], scores[keep]


def _opened(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a block; those beyond 64 bits as Python's integers."""
    data = np.frombuffer(block["data"], block["kind"])
    if block["kind"] == "float64":
        data = np.array([int(x) for x in data.tolist()], object)
    return np.frombuffer(block["ids"], "<i8"), data.reshape(block["n"], block["width"])


def _shown(scores: np.ndarray) -> tuple[list[int], list[bytes | None]]:
    """Scores cut to 64 bits, and for those at the ends bytes in the order of the exact scores."""
    if scores.dtype != object and not (scores.size and (scores.max() == MOST or scores.min() == LEAST)):
        return scores, [None] * len(scores)
    exact = [int(x) for x in scores.tolist()]
    keys = [None if LEAST < x < MOST else (x + (1 << (8 * EXACT - 1))).to_bytes(EXACT, "big") for x in exact]
    return [min(MOST, max(LEAST, x)) for x in exact], keys


def top_k(
    spark: SparkSession, vectors: DataFrame, queries: str, k: int = 20, scale: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each row for which `queries` (SQL on `id`) holds."""
    rows = quantized(vectors, id_col, vector_col, scale)
    tasks = max(1, rows.rdd.getNumPartitions())
    asked = cut(spark, packed(rows.where(queries).coalesce(max(1, tasks // 16))).withColumn("number", F.monotonically_increasing_id()), "queries")
    blocks = cut(spark, packed(rows).withColumn("number", F.monotonically_increasing_id()), "vectors")
    n_asked, n_blocks = asked.count(), blocks.count()
    height = max(1, -(-n_asked // QUERY_BLOCKS))
    width = max(1, -(-n_blocks // CANDIDATE_BLOCKS), min(n_blocks, -(-fan_out(spark) // height)))
    dealt = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    )
    left, right = dealt(asked, "r", height, "c", width), dealt(blocks, "c", width, "r", height)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.binary())])

    def run(key: tuple, some: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for x in some.to_pylist():
            q_ids, q = _opened(x)
            found = NONE
            for row in range(others.num_rows):
                c_ids, c = _opened(others.slice(row, 1).to_pylist()[0])
                new = best(q, q_ids, c, c_ids, k)
                found = top(*(np.concatenate(y) for y in zip(found, new)), k)
            out.append(batch(schema, [q_ids[found[0]], found[1], *_shown(found[2])]))
        return pa.Table.from_batches(out, schema=schema)

    columns = ["r", "c", "n", "width", "kind", "ids", "data"]
    cells = left.select(*columns).groupBy("r", "c").cogroup(right.select(*columns).groupBy("r", "c"))
    found = cells.applyInArrow(run, "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
