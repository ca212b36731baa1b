"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step. ``pairs`` (u, v): small stars join u's smaller neighbours to the
    smallest of them, large stars u's larger neighbours."""
    if large:
        sides = pairs.union(pairs.select("v", "u"))
    else:
        sides = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # written first: a join with an aggregate of the same exchange could not be split
    joined = sides.join(stored(least), "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # u itself joins the smallest too: its row with v = m becomes (u, m)
        moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: bigint); root is the smallest node
    reachable. Minima are combined before each shuffle and a node with very many links
    is met by a skew-split join, so no node's links come together in one task."""
    pairs = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        pairs = stored(_star(_star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select("v", "v").distinct())
        before = now
