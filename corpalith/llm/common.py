"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is broadcast; beyond it the join shuffles both sides.
BROADCAST_BYTES = 32 << 20


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; where none is set, a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpalith"))
    return sc.getCheckpointDir()


#: Shuffle files go when the job that wrote them ends, instead of when the driver's garbage happens to be collected.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _alone(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a query of its own, whose shuffle files are removed as soon as it has run. What it gives is kept elsewhere, so they are of no more use."""
    spark = df.sparkSession
    before = spark.conf.get(LET_GO, None)
    spark.conf.set(LET_GO, "true")
    try:
        yield df.select("*")
    finally:
        spark.conf.unset(LET_GO) if before is None else spark.conf.set(LET_GO, before)


#: Bytes of a batch that goes to a task's Python. Spark's own bound is 64 MB and 10,000 rows, and the JVM, outside its heap, and Python each hold a batch more than once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Batches of ``size`` bytes, or one row, for the queries that run inside: all rows come, in more batches."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    with _alone(df) as own:
        return own.checkpoint()


#: The folders of ``stored`` tables.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, options: dict[str, int] | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: for large tables, as values that repeat take little room there.

    Left to its encodings, without a codec, whose native buffers would add to an executor's memory.
    ``dropped`` takes it away again.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    with _alone(df) as own:
        own.write.options(**{k: str(v) for k, v in (options or {}).items()}).option("compression", "none").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, of ``width`` bytes each, come to ``BROADCAST_BYTES`` or less."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def hot_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys AQE can split.

    AQE splits a large partition only if both sides were shuffled for the join itself. A side
    that was aggregated by the same key keeps that partitioning instead; with a hash of the keys
    as one more key both sides are shuffled for the join. Column names of the sides must differ.
    """
    same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in pairs])
    return left.join(right, same & (F.xxhash64(*(a for a, _ in pairs)) == F.xxhash64(*(b for _, b in pairs))), how)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``: the hold-out key (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int) -> Column:
    """Whether an id is in fold 2, which no model learns from; a null id is not, and isn't learned from either."""
    return F.coalesce(fold(column, modulus) == 2, F.lit(False)).alias("held_out")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of a batch as (first row, UTF-8 values), each of about ``limit`` bytes.

    A null counts as empty. One value larger than the limit makes a run of its own.
    """
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    first, held, size = 0, [], 0
    for row, value in enumerate(values):
        data = value.as_py() or b""
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = row, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def like(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns of the input can't clash with an operator's own."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
