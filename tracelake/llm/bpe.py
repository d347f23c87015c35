"""Byte-level BPE by a rank queue: encoding and decoding of whole texts.

Each pre-token is a linked list of parts.  A bucket per merge rank holds the list positions whose
pair has that rank; a three-level bitmap over the ranks gives the lowest bucket in use by
find-first-set.  Merging a pair only changes the ranks of its two neighbours, which go into their
buckets; entries whose pair has changed since are stale and skipped when they come up.  The lists of
all new pre-tokens of a batch share one queue, so that a large bucket is merged with array
operations; pairs that touch an earlier one of the same rank wait for another turn, so the order
within a pre-token stays leftmost first.  The work grows with the merges, not with the square of a
pre-token's length, so very long ones are no special case.

Cases: a null or empty text has no ids and decodes to no bytes; other columns are not looked at;
repeated rows are encoded each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelake.llm.chunks import Table
from tracelake.llm.common import slices

WORD_BITS = 6
MASK = (1 << WORD_BITS) - 1
SHIFT = 20  # a pair of ids as one integer
PART = 1 << 20  # bytes of text that are encoded at once: cut into chunks they take some 30 times that
FEW = 24  # buckets up to this size are merged one position at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of positions by rank; the lowest bucket in use is found by three find-first-set steps."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((n_ranks >> WORD_BITS) + 1)
        self.mid = [0] * ((n_ranks >> 2 * WORD_BITS) + 1)
        self.top = 0

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        a, b = rank >> WORD_BITS, rank >> 2 * WORD_BITS
        self.low[a] |= 1 << (rank & MASK)
        self.mid[b] |= 1 << (a & MASK)
        self.top |= 1 << b

    def lowest(self) -> int:
        b = (self.top & -self.top).bit_length() - 1
        a = b << WORD_BITS | (self.mid[b] & -self.mid[b]).bit_length() - 1
        return a << WORD_BITS | (self.low[a] & -self.low[a]).bit_length() - 1

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its bucket, which is emptied."""
        rank = self.lowest()
        a, b = rank >> WORD_BITS, rank >> 2 * WORD_BITS
        self.low[a] &= ~(1 << (rank & MASK))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & MASK))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder over a rank table; `pattern` cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)])
        self.pairs = {
            ranks[token[:i]] << SHIFT | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.keys = np.array(sorted(self.pairs))
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where they don't merge; an id of -1 stands for no part."""
        key = np.where((left < 0) | (right < 0), -1, left << SHIFT | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each pre-token start and how many they are.  All their lists
        share one queue; position n ends every list."""
        queue, pair = self.queue, self.pairs.get
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum(lengths)
        part = np.append(self.byte_ids[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[lengths > 0] - 1] = after[n] = before[(ends - lengths)[lengths > 0]] = before[n] = n
        due = self.rank_of(part, part[after])
        order = np.argsort(due, kind="stable")
        order = order[np.searchsorted(due[order], 0) :]
        for group in np.split(order, np.flatnonzero(np.diff(due[order])) + 1) if len(order) else ():
            queue.push(int(due[group[0]]), group.tolist())
        parts, afters, befores, dues = memoryview(part), memoryview(after), memoryview(before), memoryview(due)
        while queue.top:
            rank, bucket = queue.take()
            if len(bucket) > FEW:
                p = np.unique(bucket)
                p = p[due[p] == rank]
                h = before[p]
                late = (due[h] == rank) | (due[before[h]] == rank)  # touches an earlier pair of this rank
            if len(bucket) > FEW and 2 * late.sum() <= len(p):  # else: few, or a long run, one by one
                if late.any():
                    queue.push(rank, p[late].tolist())
                    p, h = p[~late], h[~late]
                q = after[p]
                k = after[q]
                part[p], part[q], due[q], after[p], before[k] = rank, -1, -1, k, p
                before[n] = n
                due[p], due[h] = self.rank_of(part[p], part[k]), self.rank_of(part[h], part[p])
                due[n] = -1
                at = np.concatenate([p, h])
                new = due[at]
                for r, i in zip(new.tolist(), at.tolist()):
                    if r >= 0:
                        queue.push(r, [i])
                continue
            bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if dues[i] != rank:
                    continue
                q = afters[i]
                k = afters[q]
                parts[i], parts[q], dues[q], afters[i] = rank, -1, -1, k
                lower = False
                dues[i] = -1
                if k < n:
                    befores[k] = i
                    if (r := pair(rank << SHIFT | parts[k])) is not None:
                        dues[i] = r
                        queue.push(r, [i])
                        lower = r < rank
                if (h := befores[i]) < n:
                    r = pair(parts[h] << SHIFT | rank)
                    dues[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, [h])
                        lower |= r < rank
                if lower:  # what has come up now goes first
                    if bucket:
                        queue.push(rank, bucket)
                    break
        alive = np.append(0, np.cumsum(part[:n] >= 0))
        starts = alive[ends - lengths]
        return part[:n][part[:n] >= 0].astype(np.uint32), starts, alive[ends] - starts

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each chunk start and how many they are."""
        numbers: dict[str, int] = {}
        split = [[numbers.setdefault(w, len(numbers)) for w in self.split(chunk)] for chunk in chunks]
        if not numbers:
            return np.zeros(0, np.uint32), *np.zeros((2, len(chunks)), np.int64)
        ids, starts, lengths = self.encode_words([w.encode() for w in numbers])
        codes = np.fromiter(chain.from_iterable(split), np.int64)
        sizes = lengths[codes]
        ends = np.append(0, np.cumsum(sizes))
        at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], sizes)
        bounds = ends[np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))]
        return ids[at], bounds[:-1], np.diff(bounds)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[int, int, str], tuple[ByteBPE, Table, list[str]]] = {}


def _codec(ranks: dict[bytes, int], pattern: str) -> tuple[ByteBPE, Table, list[str]]:
    """One codec with its table of chunks for each rank table and worker process."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _CODECS:
        coder = ByteBPE(ranks, pattern)
        _CODECS[key] = coder, Table(coder.encode_chunks, limit=150_000), [str(i) for i in range(max(ranks.values()) + 1)]
    return _CODECS[key]


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """A row per document: its ids (if asked for), their count, and digests of the ids and of their decoding.

    `pattern` is that of the public tokenizers or another one under which the cuts of
    :mod:`tracelake.llm.chunks` never divide a match.  The rank table is read on the driver and travels with the tasks; its size is that of the
    vocabulary, not of the data.  There is no shuffle, and memory is bounded by a batch of texts.
    """
    ranks = read_ranks(ranks_path)
    schema = ENCODED if with_ids else T.StructType([f for f in ENCODED if f.name != "ids"])
    arrow = pa.schema(
        [("doc_id", pa.int64())]
        + [("ids", pa.list_(pa.field("element", pa.int32(), False)))] * with_ids
        + [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table, decimal = _codec(ranks, pattern)
        for rows in batches:
            for part in slices(rows, most=PART):
                packed = table.packed(part.column("text"))
                counts, of_ids, of_bytes = [], [], []
                for data in packed:
                    ids = np.frombuffer(data, "<u4").tolist()
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                out = [part.column("doc_id").cast(pa.int64())]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                    stops = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                    out.append(pa.ListArray.from_arrays(stops, flat, type=arrow.field("ids").type))
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], schema=arrow
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
