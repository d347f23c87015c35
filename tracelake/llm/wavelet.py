"""Token ids in one succinct file per shard: a wavelet matrix with rank and select.

File: the magic, the number of tokens n, of documents d and of bit-planes w, then d+1 token starts,
d document ids with a null flag, and for each plane, highest bit first, its bits packed eight to a
byte, the count of ones before each block of 512 bits, and the plane's count of zeros.  All integers
are little-endian.  A plane's bits stand in the order that stably sorting by the higher planes' bits
leaves.  Access, count and occurrence need the planes only; nothing is unpacked for them.

Cases: the literal of an added token is that token with `added_tokens`, and text like any other without;
a null or empty text is the end id alone; a null doc_id sorts before all others; rows that
repeat a doc_id are documents of their own, in the order of their texts; an empty table gives no
files; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.chunks import Table
from tracelake.llm.common import batch, cut, fan_out, new_folder, slices

MAGIC = b"WMTOK1\0\0"
BLOCK = 512
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of a shard."""
    n = len(ids)
    width = max(1, int(ids.max()).bit_length()) if n else 1
    ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
    out = [MAGIC, struct.pack("<QQQ", n, len(doc_ids), width), starts.astype("<u8").tobytes()]
    out.append(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.append(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    for level in range(width - 1, -1, -1):
        bits = (ids >> level & 1).astype(bool)
        plane = np.packbits(bits, bitorder="little")
        plane = np.append(plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8))
        ones = ONES[plane].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        before = np.append(0, np.cumsum(ones)).astype("<u8")
        low = ids[~bits]
        out += [plane.tobytes(), before.tobytes(), struct.pack("<Q", len(low))]
        ids = np.concatenate([low, ids[bits]])
    return b"".join(out)


class WaveletMatrix:
    """A shard's file, opened."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_docs, self.width = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        self.starts, ids, null = take("<u8", self.n_docs + 1), take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if b else a for a, b in zip(ids.tolist(), null.tolist())]
        blocks = -(-self.n // BLOCK)
        self.planes = [
            (take("u1", blocks * BLOCK // 8), take("<u8", blocks + 1), int(take("<u8", 1)[0]))
            for _ in range(self.width)
        ]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the plane's first i bits."""
        plane, before, _ = self.planes[level]
        block, rest = divmod(i, BLOCK)
        at = block * BLOCK // 8
        whole, bits = divmod(rest, 8)
        count = int(before[block]) + int(ONES[plane[at : at + whole]].sum())
        return count + (int(plane[at + whole] & ((1 << bits) - 1)).bit_count() if bits else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for level, (plane, _, zeros) in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for level, (_, _, zeros) in enumerate(self.planes):
            a, b = self._ones(level, start), self._ones(level, stop)
            start, stop = (zeros + a, zeros + b) if token >> (self.width - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of the token in [start, stop)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of the token, counted from 0."""
        start, stop = self._range(token, 0, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.width - 1, -1, -1):
            zeros = self.planes[level][2]
            bit, k = (1, i - zeros) if i >= zeros else (0, i)
            low, high = 0, self.n - 1
            while low < high:  # first position with k + 1 bits of this kind up to it
                mid = (low + high) // 2
                ones = self._ones(level, mid + 1)
                low, high = (low, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, high)
            i = low
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, undoing the planes' stable sorts from the lowest plane upwards."""
        ids = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            plane, _, zeros = self.planes[level]
            bits = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(ids)
            up[~bits] = ids[:zeros]
            up[bits] = ids[zeros:] | ids.dtype.type(1 << (self.width - 1 - level))
            ids = up
        return ids


class Coder:
    """The library, called for many chunks at once.

    Chunks that begin with a space and a character other than white space, and don't end in white
    space, are encoded as one text: no pre-token goes on past their ends.  A token of the byte-level
    alphabet has a character for each of its bytes, so the ids' lengths tell where each chunk ends.
    With `added_tokens` the library looks for those in the text, as it does by default; chunks with the
    literal of one are encoded alone.
    """

    JOINED = 4096

    def __init__(self, vocabulary: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(vocabulary)
        self.coder.encode_special_tokens = not added_tokens
        self.literals = [t.content for t in self.coder.get_added_tokens_decoder().values()] if added_tokens else []
        self.spaced = any(c.isspace() for t in self.literals for c in t)  # joining chunks could make one of these
        tokens = self.coder.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(tokens.values(), default=0) + 1, np.int64)
        for token, i in tokens.items():
            self.sizes[i] = len(token)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.coder.encode_batch_fast(["".join(chunks)], add_special_tokens=False)
        ids = np.array(found[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right"), prepend=0)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each chunk start and how many they are."""
        join = np.array([len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() for c in chunks], bool)
        for literal in self.literals:
            join &= np.array([not self.spaced and literal not in c for c in chunks], bool)
        order = np.argsort(join, kind="stable")
        alone = int(len(join) - join.sum())
        found = [x.ids for x in self.coder.encode_batch_fast([chunks[i] for i in order[:alone]], add_special_tokens=False)]
        counts = [np.fromiter(map(len, found), np.int64, alone)]
        ids = [np.fromiter(chain.from_iterable(found), np.uint32, int(counts[0].sum()))]
        for i in range(alone, len(chunks), self.JOINED):
            more, count = self._together([chunks[j] for j in order[i : i + self.JOINED]])
            ids.append(more)
            counts.append(count)
        lengths, starts = np.zeros((2, len(chunks)), np.int64)
        lengths[order] = np.concatenate(counts)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(ids), starts, lengths


_TABLES: dict[str, Table] = {}


def _table(vocabulary: str, added_tokens: bool) -> Table:
    """One table of chunks for each vocabulary and worker process."""
    key = f"{hash(vocabulary)} {added_tokens}"
    if key not in _TABLES:
        coder = Coder(vocabulary, added_tokens)
        _TABLES[key] = Table(coder.encode, literals=coder.literals)
    return _TABLES[key]


def write(
    spark: SparkSession, docs: DataFrame, vocabulary_path: str, end_id: int = 0, most_tokens: int = 1 << 24,
    added_tokens: bool = False,
) -> DataFrame:
    """Write the shards and return their manifest: shard, part, path, n_tokens.

    With `added_tokens` the ids are those of the unmodified library with add_special_tokens=False.

    Documents are range-partitioned by doc_id (sampled splitters), so a shard holds a run of ids and
    shard numbers ascend with them; a shard of over `most_tokens` tokens continues in further files.
    A task writes to names of its own and only what the manifest lists is read, so a task that runs
    twice after a lost executor does no harm.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    folder = new_folder(spark, "tokens")
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        table, shard = _table(vocabulary, added_tokens), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        part, held, sizes, doc_ids = 0, [], [0], []

        def flush() -> pa.RecordBatch:
            nonlocal part, held, sizes, doc_ids
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base)
            path = f"shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.wm"
            starts = np.cumsum(sizes)
            with store.open_output_stream(f"{base}/{path}") as out:
                out.write(build(np.frombuffer(b"".join(held), "<u4"), starts, doc_ids))
            row = batch(schema, [[shard], [part], [f"{folder}/{path}"], [int(starts[-1])]])
            part, held, sizes, doc_ids = part + 1, [], [0], []
            return row

        total = 0
        for rows in batches:
            for piece in slices(rows, most=16 << 20):
                for doc_id, packed in zip(piece.column("doc_id").to_pylist(), table.packed(piece.column("text"))):
                    held += [packed, end]
                    sizes.append(len(packed) // 4 + 1)
                    doc_ids.append(doc_id)
                    total += sizes[-1]
                    if total >= most_tokens:
                        yield flush()
                        total = 0
        if doc_ids:
            yield flush()

    sorted_docs = docs.select("doc_id", "text").repartitionByRange(fan_out(spark), "doc_id")
    sorted_docs = sorted_docs.sortWithinPartitions("doc_id", "text")
    return cut(spark, sorted_docs.mapInArrow(run, "shard int, part int, path string, n_tokens long"))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, base in zip(rows.column("path").to_pylist(), rows.column("base").to_pylist()):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner) as file:
                    matrix = WaveletMatrix(file.read())
                data = memoryview(matrix.tokens().astype("<u4").tobytes())
                starts = matrix.starts.tolist()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                counts = [b - a for a, b in zip(starts, starts[1:])]
                yield batch(schema, [matrix.doc_ids, [base + s for s in starts[:-1]], counts, sums])

    return (
        placed.select("path", "base")
        .repartition(fan_out(spark))
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
