"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Folders that this process has made, for :func:`clean_up`.
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the cluster names none, a temporary one is made in local
    mode; elsewhere that would be another folder on each machine, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def tidy(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Drop a query's shuffle files as it ends: what it made is then in the shared folder or on the driver."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def plain(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Run without generating code for whole stages, which the driver would compile and hold: for a few integers a
    row that takes longer, and more memory, than it saves."""
    return _setting(spark, "spark.sql.codegen.wholeStage", "false")


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.add(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _FOLDERS.discard(folder)


def clean_up(spark: SparkSession) -> None:
    """Delete all that the operators have left in the shared folder: for callers that have written their
    results elsewhere.  What an operator returned can't be read any more after this."""
    for folder in list(_FOLDERS):
        remove(spark, folder)


def cut(spark: SparkSession, df: DataFrame, name: str = "cut", narrow: bool = False) -> DataFrame:
    """Materialise in the shared folder as a compressed columnar table, and cut the lineage there.

    A `narrow` table, a step of many in an iteration, is made as :func:`plain` says."""
    path = new_folder(spark, name)
    with tidy(spark), plain(spark) if narrow else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_folder = path
    return out


#: The same by the name that whole stages use.
stored = cut


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        remove(spark, df._tracelake_folder)


def fan_out(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The table in as many partitions as there are cores, if its files give fewer (a file of one row
    group is one task); larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, or one like it that no column of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the decimal doc_id leaves remainder 1 modulo 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 3 == 1, F.lit(False))


def row_key() -> Column:
    """64 bits that tell rows of the same or null doc_id apart by their texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The column's values as UTF-8, a null as empty."""
    for value in column.cast(pa.binary()) if len(column) else ():
        yield value.as_py() or b""


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """A table for each run of rows with equal integers in the columns `names`, however the rows are cut
    into batches: groups of a sorted partition, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = [rows.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return freed memory to the system: workers live on, several to an executor, beside a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(rows: pa.RecordBatch, name: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text, so that memory doesn't follow the batch size."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(rows.column(name)), 0).to_pylist()):
        if total and total + n > most:
            yield rows.slice(start, i - start)
            start, total = i, 0
        total += n
    if rows.num_rows > start:
        yield rows.slice(start)
    give_back()
