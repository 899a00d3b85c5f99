"""Shared helpers: the shared folder, durable cuts of lineage, let-bindings and Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = " \t\n\x0b\x0c\r"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that losing an executor repeats no earlier work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what is no longer referred to: shuffle and checkpoint files of finished steps, not only when its heap fills up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors give back the heap that finished work leaves behind: it stays theirs until they collect, and counts with the memory of the Python workers that come next.

    Two tasks for each core, so that every executor has one; each asks its JVM for a full collection, after which the heap shrinks to what is in use.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def _folder(spark: SparkSession, path: str):
    """A path and its Hadoop file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the session's driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, system = _folder(spark, path)
    _leave_behind.append((system, place))
    return path


_leave_behind: list[tuple] = []


def _sweep() -> None:
    for system, place in _leave_behind:
        try:
            system.delete(place, True)
        except Exception:  # the driver's JVM has ended already
            return


atexit.register(_sweep)


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; for rows too wide for ``cut``."""
    path = temporary(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    place, system = _folder(df.sparkSession, df._written)
    system.delete(place, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise."""
    x = x.astype(U64, copy=True)
    half = x >> U64(30)
    x ^= half
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(27), out=half)
    x ^= half
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(31), out=half)
    x ^= half
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end], equal for equal runs wherever they stand; starts ascend, runs don't overlap.

    Each value is mixed with its place in the run before the sum, so no arithmetic structure of the text reaches the hash
    (a polynomial modulo 2**64 gives equal hashes to some unequal runs, whatever its base).
    """
    n = len(values)
    if not len(starts):
        return np.zeros(0, U64)
    place = np.arange(n, dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(values ^ (place.astype(U64) * U64(0xD1342543DE82EF95))), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in all; a larger row stands alone."""
    total, i, n = np.concatenate([[0], np.cumsum(sizes)]), 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield i, j
        i = j


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of them in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give freed memory back: workers stay for later tasks, and an executor's limit counts all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable) -> Callable:
    """A batch iterator that tidies up when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def tidied(run: Callable) -> Callable:
    """A group function that tidies up after each group. Spark tells one from two tables by the number of arguments."""
    if run.__code__.co_argcount == 1:
        return lambda rows: _after(run, rows)
    return lambda left, right: _after(run, left, right)


def _after(run: Callable, *tables: pa.Table) -> pa.Table:
    out = run(*tables)
    tidy()
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
