"""Nearest neighbours by low-dimensional stable projections in kd-trees, with a chi-square stop."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import sent

#: Projected dimensions; 2-stable (Gaussian) projections keep distances in expectation.
PROJECTED = 8
#: Probability that a neighbour closer than the k-th found would have been met already.
CONFIDENCE = 0.95
#: Vectors of one kd-tree and queries of one request.
TREE_ROWS = 1 << 14
QUERY_ROWS = 1 << 10
LEAF = 64
NEIGHBOURS = 20

HIT_SCHEMA = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_square_quantile(p: float, dims: int) -> float:
    """The chi-square distribution's quantile, by bisection on the regularised gamma series."""
    def cdf(x: float) -> float:
        a, half = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= half / n
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if half > 0 else 0.0

    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


class Tree:
    """A kd-tree over projected points, split at medians down to LEAF points: the points'
    order and the box of every leaf."""

    def __init__(self, points: np.ndarray):
        order, parts = [], [np.arange(len(points))]
        while parts:
            rows = parts.pop()
            if len(rows) <= LEAF:
                order.append(rows)
                continue
            spread = np.ptp(points[rows], axis=0)
            by = np.argpartition(points[rows, spread.argmax()], len(rows) // 2)
            parts += [rows[by[len(rows) // 2:]], rows[by[:len(rows) // 2]]]
        self.leaves = order
        self.low = np.array([points[r].min(axis=0) for r in order])
        self.high = np.array([points[r].max(axis=0) for r in order])

    def leaf_distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            gap = np.maximum(self.low[:, d] - queries[:, d, None], queries[:, d, None] - self.high[:, d])
            out += np.maximum(gap, 0) ** 2
        return out


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """With one more component that gives all vectors the length ``largest``: among them the
    largest inner product with a query is the least distance to the query (lifted by 0)."""
    rest = np.sqrt(np.maximum(largest ** 2 - (vectors ** 2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, projection: np.ndarray,
           largest: float, k: int, stop: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of the best k found for each query among ``vectors``.

    Leaves are met in the order of their projected distance, those of all active queries
    together, one leaf for each at a time; every point met is verified on the original
    vectors. A query stops when the next leaf's projected distance exceeds ``stop`` times
    the distance of its k-th best: closer points would with the set confidence have
    projected nearer.
    """
    points = lifted(vectors, largest)
    aim = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    tree = Tree(points @ projection)
    near = tree.leaf_distances(aim @ projection)
    order = np.argsort(near, axis=1, kind="stable")
    n = len(queries)
    best = np.full((n, k), -np.inf)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    norm = (queries ** 2).sum(axis=1)
    active = np.arange(n)
    for turn in range(len(tree.leaves)):
        leaf = order[active, turn]
        # squared lifted distance to the k-th best: |q|^2 + largest^2 - 2 q.x
        kth = norm[active] + largest ** 2 - 2 * best[active, -1]
        go = near[active, leaf] <= stop * np.maximum(kth, 0)
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.nonzero(np.diff(leaf[by_leaf]))[0] + 1
        for rows in np.split(by_leaf, cuts):
            at, members = active[rows], tree.leaves[leaf[rows[0]]]
            score = queries[at] @ vectors[members].T
            score[query_ids[at][:, None] == ids[members][None, :]] = -np.inf
            better = score.max(axis=1) >= best[at, -1]  # most leaves hold none of the best
            at, score = at[better], score[better]
            if not len(at):
                continue
            both = np.concatenate([best[at], score], axis=1)
            names = np.concatenate([best_id[at], np.broadcast_to(ids[members], score.shape)], axis=1)
            top = np.lexsort((names, -both), axis=1)[:, :k]
            best[at], best_id[at] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
    q, j = np.nonzero(best > -np.inf)
    yield query_ids[q], best_id[q, j], best[q, j]


def _packed(rows: DataFrame, size: int, count: int, block: str) -> DataFrame:
    """Rows (vec_id, embedding) dealt by hash into blocks of about ``size``; a block is one
    row of two arrays."""
    blocks = max(1, -(-count // size))
    number = F.pmod(F.xxhash64("vec_id", F.lit(block)), F.lit(blocks)).cast("int")
    return rows.groupBy(number.alias(block)).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias(f"{block}_rows"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, projected: int = PROJECTED,
            confidence: float = CONFIDENCE, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row of ``queries`` (vec_id, embedding) the k rows of ``vectors`` of largest
    inner product that the search finds, but for the query itself: query_id, rank, vec_id, score.

    Vectors are dealt into kd-trees of about ``tree_rows`` and queries into blocks of about
    ``query_rows``; every block meets every tree in a task of its own, so a task holds one
    tree and one block, and no side is broadcast. Per query, the trees' best are merged.

    Null or zero vectors, and those with null or non-finite components, take no part, nor
    do null ids or vectors of another length than most have. Equal scores go by smaller
    vec_id. Rows that repeat an id are all candidates; repeated queries are searched once.
    Fewer candidates than k give fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.where("vec_id IS NOT NULL").where(usable(F.col("embedding"))).select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    rows, asked = clean(vectors), clean(queries)
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c"), F.max(squares).alias("s")).orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, total, largest = sizes.n, sizes.c, math.sqrt(sizes.s)
    rows, asked = (df.where(F.size("embedding") == dims) for df in (rows, asked))
    asked = asked.dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // query_rows))
    trees = _packed(rows, tree_rows, total, "tree").withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    requests = trees.join(_packed(asked, query_rows, blocks * query_rows, "ask"), "ask")
    projection = np.random.default_rng(11).standard_normal((dims + 1, projected))
    get_projection = sent(spark, projection)
    stop = chi_square_quantile(confidence, projected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = get_projection()
        for batch in batches:
            for at in range(batch.num_rows):
                (ids, x), (query_ids, q) = (_unpacked(batch.column(c)[at].values) for c in ("tree_rows", "ask_rows"))
                for hits in search(x, ids, q, query_ids, lines, largest, k, stop):
                    yield pa.RecordBatch.from_arrays([pa.array(h) for h in hits], ["query_id", "vec_id", "score"])

    def _unpacked(structs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = structs.field("vec_id").to_numpy(zero_copy_only=False)
        return ids, structs.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)

    hits = requests.select("tree_rows", "ask_rows").mapInArrow(run, HIT_SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
