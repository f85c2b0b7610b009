"""What the operators share: tables, the shared scratch folder and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that they share")
    if not root:  # on one machine, as in tests
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it again: later steps don't recompute it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the scratch folder, wherever that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: With it, Spark deletes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


#: Where the tables lie that jobs wrote as steps.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


class Steps:
    """The tables between a job's steps, each deleted as soon as no later step reads it, so that the disk holds a few of them at a time.

    A frame that reads a table is of no use after its drop(), so all that depends on it must have been written (or collected) by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """As cut(); of the query that writes df, no shuffle files stay."""
        path = scratch(self.spark, name)
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        _PATHS[out] = path
        return self.take(out)

    def take(self, table: DataFrame) -> DataFrame:
        """What another job's steps left as their result is dropped with this job's tables."""
        self.tables.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := _PATHS.pop(table, None):
                delete(self.spark, path)
        self.tables = [x for x in self.tables if x in _PATHS]

    def drop_all_but(self, kept: DataFrame) -> None:
        self.drop(*(x for x in self.tables if x is not kept))


def give_back() -> None:
    """Return a Python worker's free memory to the system, as the worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most so many text bytes (one row at least).

    Yields (slice, bytes of its texts back to back, row offsets into them); a null counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        if col.null_count:
            col = col.fill_null(b"")
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    col = data = off = batch = None
    give_back()


#: Bits of a bitmap() at most: 8 MB.
MOST_BITS = 1 << 26


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bits of the low bits of a column of well-mixed 64-bit hashes, at most MOST_BITS of them, whatever the rows' number.

    Rows whose bit is not set are not in df; what passes is still joined, so the bitmap saves shuffling and decides nothing.
    When df outgrows it more rows pass."""
    words = df.select(F.expr(f"({column} & {MOST_BITS - 1}) div 64").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # not as Python rows
    out = np.zeros(MOST_BITS // 64, np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64, copy=False).view(np.uint64) if h.dtype != np.uint64 else h
    return (bits[((h & np.uint64(MOST_BITS - 1)) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
