"""Shared helpers of the training-data operators: staging, shipping, Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Bytes of text that a numpy step holds at once; one longer document is held alone.
CHUNK_BYTES = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where that is unset, a local session (one process, one machine) gets a folder of its own; a cluster raises an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged path that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables (those that staged() returned) that nothing reads any more."""
    for df in tables:
        if df is not None:
            remove(df.sparkSession, df.staged_path)


def id_type(docs: DataFrame) -> str:
    """The type of doc_id, for schemas of rows that carry it on."""
    return docs.schema["doc_id"].dataType.simpleString()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes; a larger row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def text_chunks(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for each bounded run of rows of a batch."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in row_chunks(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def give_back() -> None:
    """Return freed memory to the system: workers live on, and stages to come count what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the workers' path; a worker gives its free memory back after each partition."""
    ship(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(rows, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that are equal in the first `keys` columns (integers), from batches sorted by them: one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        columns = [np.asarray(b.column(c)) for c in range(keys)]
        new = np.zeros(len(b), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), len(b)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != last:
                yield held
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield held


def by_group(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """df with equal keys together in one partition and in one run."""
    many = [parts] if parts else []
    return df.repartition(*many, *keys).sortWithinPartitions(*keys)


def bit_table(wanted: DataFrame, place: Column, bits: int) -> Broadcast:
    """A table of 2**bits bits with those at `place` of wanted set (26 bits: 8 MB), whatever the size of `wanted`.

    Such a filter only saves shuffling: what it lets through is decided by the join that follows,
    and a table that is full lets all through."""
    words = (wanted.select(F.pmod(place, F.lit(1 << bits).cast("long")).alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect())  # at most 2**(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    for w, v in words:
        table[w] = v
    return wanted.sparkSession.sparkContext.broadcast(table)


def may_hold(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places have their bit set; places are taken modulo the table's bits."""
    p = place.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table.view(np.uint64)[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def possible_rows(df: DataFrame, wanted: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """Rows of df whose `key` may be in `wanted`."""
    place = F.xxhash64(F.col(key))
    send = bit_table(wanted, place, bits)
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(names).filter(pa.array(may_hold(send.value, np.asarray(b.column(len(names))))))

    return arrow_map(df.select(*names, place.alias("__place")), rows, df.schema)
