"""Records kept from run to run, by the digest of the text they were read from.

The digest is the version: a text that changes has another one, so nothing is ever
updated. Comparisons that start from stored records read no text, and filters on the
digest or the run reach the files. Files are laid out by the digest's first letter, so a
small batch of contents opens few of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.operators import extract as E, records as R
from plumbline.operators.skew import join_unique
from plumbline.session import saved
from plumbline.sources import sinks

DIGEST = "content_sha256"


def digest(text: Column) -> Column:
    """Digest of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def stored_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(content_sha256, ords, vals, norms, batch) of every content read so far; None before the first run."""
    if sinks.commits(spark, path).isEmpty():
        return None
    return sinks.read_table(spark, path).drop("shelf")


def extract_with_store(docs: DataFrame, key: str, text: str, path: str, cat: Catalogue = APPLIANCE,
                       run: str | None = None) -> DataFrame:
    """(key, content_sha256, known, record) of every document: records of contents that the
    store has are taken from it, the others are read from one text each and added to it.

    ``known`` says whether the store had the content before. The join that finds known
    contents is one on short digests (Spark adds a Bloom filter of its own where the store
    is the larger side); texts are shuffled for new contents only. Very frequent contents
    are met by broadcast (see skew). A run that is repeated under its name adds nothing.
    """
    spark = docs.sparkSession
    marked = docs.select(key, digest(F.col(text)).alias(DIGEST))
    counts = saved(marked.groupBy(DIGEST).agg(F.count("*").alias("n_copies")))
    old = stored_records(spark, path)
    run = run or uuid.uuid4().hex
    if old is not None:
        old = old.filter(F.col("batch") != run).drop("batch").dropDuplicates([DIGEST])
    new = counts if old is None else counts.join(old.select(DIGEST), DIGEST, "left_anti")
    fresh = (docs.select(F.col(text).alias("text"), digest(F.col(text)).alias(DIGEST)).join(new.select(DIGEST), DIGEST)
             .dropDuplicates([DIGEST]))
    rows = E.extract_fields(fresh, cat, "text").select(DIGEST, *R.RECORD).withColumn("shelf", F.substring(DIGEST, 1, 1))
    write = sinks.write_rows(rows, path, by="shelf")
    sinks.commit(spark, path, run, write, rows.schema)
    added = sinks.written(spark, path, write, rows.schema).select(DIGEST, *R.RECORD, F.lit(False).alias("known"))
    every = added if old is None else added.union(old.select(DIGEST, *R.RECORD, F.lit(True).alias("known")))
    return join_unique(marked, every.join(counts, DIGEST), [DIGEST], "n_copies", [key]).drop("n_copies")
