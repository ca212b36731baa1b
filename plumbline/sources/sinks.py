"""Sinks and readers of the result tables. Paths belong to shared storage.

A detection table has two folders. ``data`` holds rows by date, then by write (every attempt
to save a batch is a write of its own), so looking up one date opens only that date. ``commits``
holds one small file per batch that names the write which counts: it is swapped in one step,
so readers see all of a batch or nothing of it, and a batch saved again replaces itself.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plumbline import fixed_values as fv
from plumbline.operators import history as H

COMMIT_SCHEMA = "batch string, write string, row_schema string, saved_at string"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _swap_in(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, replacing the one there: a new file renamed over the old."""
    jvm = spark._jvm
    target, fs = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(draft), fs.makeQualified(target), over)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", by: str = "detection_date") -> str:
    """Rows under a new write, which nobody sees yet; its name. ``by``: the column that comes
    first in the folder names."""
    write = uuid.uuid4().hex
    (df.withColumn("write", F.lit(write)).write.mode("append").partitionBy(by, "write")
       .format(fmt).save(f"{path.rstrip('/')}/data"))
    return write


def commit(spark: SparkSession, path: str, batch: str, write: str, schema: StructType) -> None:
    """From now on ``write`` is what the batch holds."""
    row = {"batch": batch, "write": write, "row_schema": schema.json(), "saved_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    _swap_in(spark, f"{path.rstrip('/')}/commits/{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}.json", json.dumps(row))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch. A table without any has none."""
    place, fs = _file_system(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(place):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).json(f"{path.rstrip('/')}/commits")


def written(spark: SparkSession, path: str, write: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The rows of one write, committed or not."""
    return _rows(spark, path, schema, fmt).filter(F.col("write") == write).drop("write")


def _rows(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    full = StructType([*(f for f in schema if f.name != "write")]).add("write", "string")
    return spark.read.schema(full).format(fmt).load(f"{path.rstrip('/')}/data")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All committed rows, with their ``batch``. The schema is the one committed last, so no
    file is opened to find it."""
    done = commits(spark, path)
    last = done.agg(F.max_by("row_schema", "saved_at").alias("s")).first().s
    if last is None:
        raise ValueError(f"nothing is committed in {path}")
    schema = StructType.fromJson(json.loads(last))
    return _rows(spark, path, schema, fmt).join(done.select("batch", "write"), "write").drop("write")


def remove_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete the folders of writes that no commit names (failed or replaced ones); how many.
    Not while a batch is being saved."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path.rstrip('/')}/data").select(
        F.regexp_extract("path", "^(.*/write=([0-9a-f]+))/", 1).alias("folder"), F.regexp_extract("path", "/write=([0-9a-f]+)/", 1).alias("write"))
    stale = names.distinct().join(commits(spark, path), "write", "left_anti").select("folder")
    gone = 0
    for row in stale.toLocalIterator():
        place, fs = _file_system(spark, row.folder)
        gone += bool(fs.delete(place, True))
    return gone


def append_history(detections: DataFrame, path: str, batch: str | None = None) -> None:
    """Add history rows, as a batch of their own unless one is named (which they then replace)."""
    _save(H.summary_rows(detections), path, batch or uuid.uuid4().hex)


def append_details(detections: DataFrame, path: str, batch: str | None = None) -> None:
    """As JSON lines."""
    _save(detections, path, batch or uuid.uuid4().hex, "json")


def _save(df: DataFrame, path: str, batch: str, fmt: str = "parquet") -> None:
    commit(df.sparkSession, path, batch, write_rows(df, path, fmt), df.schema)


def save_detections(detections: DataFrame, history_path: str, detail_path: str, batch: str) -> None:
    """Write the nested detail, then project the history from what was written.

    The comparison runs once and both tables agree. Details are committed first, so
    every history row that is seen has its detail; a batch repeated after a failure
    replaces itself, whatever dates it held before.
    """
    spark = detections.sparkSession
    detail = write_rows(detections, detail_path)
    summary = H.summary_rows(written(spark, detail_path, detail, detections.schema))
    history = write_rows(summary, history_path)
    commit(spark, detail_path, batch, detail, detections.schema)
    commit(spark, history_path, batch, history, summary.schema)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_history_csv(spark: SparkSession, path: str, display_headers: bool = False) -> DataFrame:
    """History as CSV text, every column a string; a wrong header is an error.

    ``display_headers`` reads files whose header shows the display names.
    """
    columns = H.HISTORY_COLUMNS
    shown = [fv.HISTORY_HEADERS[c] for c in columns] if display_headers else columns
    schema = ", ".join(f"`{c}` string" for c in shown)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .csv(path).toDF(*columns))


def read_details(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")
