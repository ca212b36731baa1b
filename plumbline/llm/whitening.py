"""Whitening of vectors by the covariance of the distinct ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import flat, stored

#: Fixed values of the integer form of a vector's entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are held at it, so that an integer form always exists.
MOST = 1 << 53
#: An eigenvalue counts as zero below so many times the largest one (and the dimension).
TINY = 1e-13

OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` without rows whose vector is null or holds null or non-finite entries, and
    with ``x`` (array<bigint>), the integer form of its entries."""
    e = F.col(vector).cast("array<double>")
    odd = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(float(-MOST)))
    x = F.transform(e, lambda c: F.floor(held(c)).cast("bigint") + SHIFT)
    return vectors.where(e.isNotNull() & ~odd).withColumn("x", x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return flat(column)[0].reshape(-1, width)


@dataclass
class Moments:
    """Of the fit list: total weight, exact sums by dimension, covariance."""
    n: int
    sums: list[int]
    covariance: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts subtracted exactly first, so large offsets cost no digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * near - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest.tolist())) for row in near.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Total weight and weighted sums by dimension: exact, in halves of 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, [0] * width, [0] * width
        for batch in batches:
            x, weight = _matrix(batch.column("x"), width), batch.column("weight").to_numpy()
            n += int(weight.sum())
            for half, total in ((x & 0xFFFFFFFF, low), (x >> 32, high)):
                for i, v in enumerate(np.dot(weight.astype(object), half.astype(object)) if weight.max(initial=0) > 1 << 10 else weight @ half):
                    total[i] += int(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *(h * (1 << 32) + s for h, s in zip(high, low)))])],
            ["dimension", "total"])

    rows = (distinct.select("x", "weight").mapInArrow(run, "dimension int, total string")
            .groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    by = {r.dimension: int(r.total) for r in rows}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def _scatter(rows: DataFrame, column: str, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of weight * z z' over ``rows``, z the centred ``column``: one matrix product a
    batch, one matrix a task, added up by Spark. What comes back has width^2 numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = centred(_matrix(batch.column(column), width))
            total += (z * batch.column("weight").to_numpy()[:, None]).T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((width, width))
    parts = rows.select(column, "weight").mapInArrow(run, "i bigint, j bigint, v double")
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def _means(rows: DataFrame, column: str, width: int, n: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += batch.column("weight").to_numpy() @ _matrix(batch.column(column), width)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(width)
    for r in rows.select(column, "weight").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v / n
    return out


def whiten(rows: DataFrame, x: str = "x", top: int = 16, weigh_copies: bool = False) -> DataFrame:
    """``rows`` by component: every column but ``x`` (array<bigint>), and component, n,
    deviation, whitened, explained, identity_error.

    Equal vectors are one vector of the fit list, of weight one or, with ``weigh_copies``,
    of as many as there are. n is the list's total weight, S its sums by dimension.
    Components are unit eigenvectors of the list's covariance (divisor n, centred before
    multiplying), by falling eigenvalue e. whitened is x - S/n projected on the component,
    over sqrt(e); explained is e over the covariance's trace; deviation is the exact sum
    of (n x - S)^2, null beyond 64 bits; identity_error is the largest absolute entry of
    the whitened list's own covariance minus the identity, measured anew on all of it.

    Each distinct vector is centred, multiplied and projected once; rows take their
    projection by the digest (SHA-256) of the vector. Copies are combined before a shuffle,
    so a vector that very many rows share is one row. What passes the driver are sums over
    dimensions and pairs of dimensions: their number follows the vectors' length alone.

    Vectors of another length than most (ties: the longer) cannot be multiplied with
    them and are dropped, and so are null and empty ones. Directions of no variance (a single distinct
    vector, constant dimensions, fewer vectors than dimensions) have no component, so rows
    can have less than ``top``, or none. Repeated rows give repeated rows; columns of
    ``rows`` with the names of new ones are replaced; an empty table stays empty.
    """
    new = [f.split()[0] for f in OUT.split(", ")]
    keep = [c for c in rows.columns if c != x and c not in new]
    ready = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(x).cast("array<bigint>").alias("x"))
    lengths = ready.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 1
    ready = ready.where(F.size("x") == d).withColumn("key", F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256))
    copies = F.count("*") if weigh_copies else F.lit(1).cast("bigint")
    distinct = stored(ready.groupBy("key").agg(F.first("x").alias("x"), copies.alias("weight")))

    n, sums = _sums(distinct, d)
    moments = Moments(n, sums, np.zeros((d, d)))
    e, vectors = np.zeros(0), np.zeros((d, 0))
    if n:
        moments.covariance = _scatter(distinct, "x", d, moments.centred) / n
        e, vectors = np.linalg.eigh(moments.covariance)
        largest = [i for i in np.argsort(-e)[:top] if e[i] > TINY * d * max(e.max(), 0) > 0]
        e, vectors = e[largest], vectors[:, largest]
    k, project = len(e), vectors / np.sqrt(e)
    trace = float(np.trace(moments.covariance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _matrix(batch.column("x"), d)
            z = moments.centred(at) @ project
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("weight"), pa.array(moments.deviation(at), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(z.ravel()))],
                ["key", "weight", "deviation", "z"])

    white = stored(distinct.mapInArrow(run, "key string, weight bigint, deviation bigint, z array<double>"))
    error = 0.0
    if k:
        means = _means(white, "z", k, n)
        error = float(np.abs(_scatter(white, "z", k, lambda z: z - means) / n - np.eye(k)).max())
    shares = F.lit([float(v) / trace for v in e]).cast("array<double>")
    return (ready.select("row", "key").join(white.drop("weight"), "key")
            .select("row", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("row.*", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
