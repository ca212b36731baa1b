"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A join side of at most so many bytes is broadcast.
BROADCAST_BYTES = 10 << 20
#: Parts that rows are dealt in, before small ones are put together: what one task sorts or
#: joins then does not grow with the input up to so many times Spark's 64 MB.
PARTS = 1024


def configure(spark: SparkSession, by_file_size: bool = False) -> SparkSession:
    """Adaptive execution with skew-join splitting, UTC timestamps.

    ``forceOptimizeSkewedJoin`` lets a skewed join be split even where a later
    aggregation by the same key then needs one more (small) exchange.

    A side of a join is broadcast only once its rows are made and measured: 5 MB of
    compressed Parquet can be a million records, which the driver would have to hold.
    ``by_file_size`` goes by the size of the files, as Spark does by itself.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES if by_file_size else -1),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if by_file_size:
        spark.conf.unset(parts)
    else:
        spark.conf.set(parts, str(PARTS))
    return spark


def new_folder(spark: SparkSession, kind: str = "saved") -> str:
    """Path of a new folder on shared storage: below spark.checkpoint.dir; where that is
    unset (one machine) in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to shared storage and read back.

    For results that several later steps start from: they are computed once, and a
    lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
