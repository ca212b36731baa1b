"""Helpers shared by the operators: words, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space between words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Maximal runs of anything but space and \\t \\n \\v \\f \\r, unchanged; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can read and write: below spark.checkpoint.dir,
    or, where that is unset (tests), in the temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to shared storage and read back: lineage ends here, and a lost
    executor costs no recomputation of what lies before."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcast an object of this subpackage's classes, together with their code; call the
    result in a task to get it."""
    handle = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: cloudpickle.loads(handle.value)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array<bigint> column without nulls, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches, so that the items (bytes, array values) of ``column`` in a slice stay
    near ``limit``; a row larger than that comes alone, whole."""
    for batch in batches:
        arr = batch.column(column)
        if pa.types.is_list(arr.type):
            ends = arr.offsets.to_numpy()
        else:
            _, ends = bytes_of(arr)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
