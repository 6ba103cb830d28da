"""Helpers that the training-data operators share: durable intermediates and Arrow columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times their width, and what a hashed row takes
#: besides, stay under this many bytes.
BROADCAST_BYTES = 40 << 20
ROW_BYTES = 64
#: Bits of a sieve for each of its ids, of one of its rows, and at most.
SIEVE_BITS, SIEVE_ROW, MOST_BITS = 16, 1 << 16, 1 << 26

#: Rows of an Arrow batch of documents.
BATCH_ROWS = 2_500


def small_batches(spark: SparkSession) -> None:
    """Send documents to Python in batches of ``BATCH_ROWS`` at most: Spark's 10,000 texts of some kilobytes are held several times over, by
    the executor and by its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a fresh temporary folder
    is used; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewheel-"))
    return named or context.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``pinned``, without the estimated size that a checkpoint takes over from its plan; for tables that a loop joins again.

    The estimate of a join is the product of its sides', so that its digits multiply with each round: after some rounds the driver
    spends its time and hundreds of megabytes on such numbers.
    """
    spark, rows = df.sparkSession, pinned(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.javaRDD(), rows.schema()), spark)


def small_enough(rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    return rows * (row_bytes + ROW_BYTES) <= most


def hinted(df: DataFrame, rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted size is under the bound; else Spark shuffles it."""
    return F.broadcast(df) if small_enough(rows, row_bytes, most) else df


def sieve(ids: DataFrame, count: int) -> Callable[..., DataFrame]:
    """A function of (df, column, inside=True) that keeps the rows of ``df`` whose ``column`` may be among ``ids``, a
    bigint column of ``count`` rows; or, not ``inside``, the rows whose ``column`` is surely not.

    It is a table of bits, broadcast in rows of 64 KB of bits: SIEVE_BITS for each id and ``MOST_BITS`` (8 MB) at most, whatever
    the count.  What passes by chance must be told apart by an exact join after it.
    """
    bits = min(MOST_BITS, max(SIEVE_ROW, 1 << (SIEVE_BITS * count - 1).bit_length() if count else 0))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(bits))
    div = lambda x, by: F.shiftright(x, by.bit_length() - 1)
    at = place(F.col(ids.columns[0]).cast("bigint"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    none = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    some = ids.select(at.alias("at")).select(div(F.col("at"), 64).alias("word"), bit.alias("bits"))
    words = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(div(F.col("word"), SIEVE_ROW // 64).alias("__row")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("x"))
    table = pinned(rows.select("__row", F.col("x.bits").alias("__bits")))

    def passing(df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        at = place(F.col(f"`{column}`").cast("bigint"))
        word = F.get(F.col("__bits"), F.pmod(div(at, 64), F.lit(SIEVE_ROW // 64)).cast("int"))
        on = (div(at, SIEVE_ROW) == F.col("__row")) & (F.call_function("bit_get", word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return df.join(F.broadcast(table), on, "left_semi" if inside else "left_anti")

    return passing


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the broadcasts, shuffles and checkpoints that nothing refers to any more: it learns of them from the
    driver's garbage collector only, which may not run for many rounds."""
    gc.collect()  # what Python refers to, the JVM keeps
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    column = column.view(kind) if pa.types.is_large_string(column.type) else column.cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    base, end = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, np.uint8, end - base, base) if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, at - base


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row makes a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow, handing freed memory back to the system at the end of each task.

    Workers are reused; without this, idle ones keep what their allocators once held.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return task


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cut lineage, and columns are read as needed."""
    folder = fresh_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, name: str, key: str, gather: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table in the shared folder, bucketed by ``key`` so that joins on it need no further
    shuffle of it; and a function that removes the table once nothing reads it any more.  ``gather``: what is done to the
    rows where they have been dealt by ``key``, within one key."""
    spark = df.sparkSession
    count, table, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}", fresh_dir(spark, name)
    gather(df.repartition(count, key)).write.bucketBy(count, key).option("path", folder).saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE {table}")
        removed(spark, folder)

    return spark.table(table), drop


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediates that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
