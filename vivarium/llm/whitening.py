"""Whitening of embeddings by their leading principal components, without a covariance matrix.

A block of k + SPARE directions Q is iterated: one Spark pass computes Z = X'(XQ) of the centred rows X, a partial block per
task, added up in two steps. The driver holds only blocks of (dimensions x directions). From Z it takes the Ritz values and
vectors of the block (Rayleigh-Ritz) and their residuals |Zy - ey|, and from Z less a share of the block before it the next
block (QR). That share is the three-term rule of Chebyshev polynomials on [0, c], c the block's least Ritz value, which takes
about the root of the number of passes that bare powers take. Passes go on until the residuals of all k components are at most
RESIDUAL times the largest value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import cleaned, stage, struct

COMPONENTS, SPARE = 8, 24
SCALE, SHIFT = 1024, 100_000
#: A component is done when its residual is at most this share of the largest value.
RESIDUAL = 1e-13
#: Passes after which the best Chebyshev interval is estimated anew, and after which an unfinished iteration is an error.
CYCLE, MOST_PASSES = 12, 400
#: Largest deviation that a long holds; above it the column is null.
LONG = 2**63 - 1


@dataclass
class Whitening:
    """What the fit list gives: n, sums by dimension, trace of the covariance, values and directions (a column each)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    directions: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        """Centred rows times this are whitened."""
        return self.directions / np.sqrt(self.values)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty nor holds a null or an entry that isn't finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(F.col(column).cast("array<double>"), finite))


def integers(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): entries c become floor(1024 c) + 100000."""
    x = F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as a matrix of longs; all are of one length."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def summed(x: DataFrame, block, width: int) -> np.ndarray:
    """The sum over all batches of block(rows), an array of `width` doubles: by task first, then by about the root of the tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += block(rows_of(batch)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for z in batch.column(0).to_pylist():
                total += np.frombuffer(z)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

    parts = x.select("x").mapInArrow(part, "z binary")
    tasks = x.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merge, "z binary")
    return np.sum([np.frombuffer(r["z"]) for r in parts.collect()] or [np.zeros(width)], axis=0)


def moments(x: DataFrame) -> tuple[int, list[int], list[int]]:
    """n, and exact sums and sums of squares by dimension."""
    each = x.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    found = each.agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.sum(F.col("c").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")).alias("q"))
    got = sorted(found.collect(), key=lambda r: r["i"])  # a row for each dimension
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got], [int(r["q"]) for r in got]


def iterate(multiply, size: int, k: int = COMPONENTS, spare: int = SPARE, most: int = MOST_PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest values and their vectors of a positive semi-definite operator, and the passes that took.

    multiply(Q) gives the operator's product with a block Q. Fewer than k come back where the operator's rank is lower.
    """
    width = min(size, k + spare)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    before, weight, centre = np.zeros_like(q), np.zeros((width, width)), 0.0
    for step in range(1, most + 1):
        z = multiply(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)  # Rayleigh-Ritz
        values, turn = values[::-1], turn[:, ::-1]
        top = max(values[0], 0.0)
        good = int((values[:k] > top * size * 1e-14).sum())
        residual = np.linalg.norm(z @ turn[:, :good] - (q @ turn[:, :good]) * values[:good], axis=0)
        if not good or residual.max() <= RESIDUAL * top:
            return values[:good], q @ turn[:, :good], step
        if step % CYCLE == 1:  # a new interval: the three-term rule begins anew
            q, z = q @ turn, z @ turn
            before, centre = np.zeros_like(q), max(values[-1], 0.0) / 2
            weight = np.zeros((width, width))
        # the shifted operator has its unwanted values in [-centre, centre]; the share of the block before is (centre / 2) squared
        new = (z - centre * q) - (centre * centre / (2 if step % CYCLE == 2 else 4)) * (before @ weight)
        before = q
        q, r = np.linalg.qr(new)
        weight = np.linalg.inv(r) if np.abs(np.diag(r)).min() > 1e-12 * top else np.zeros((width, width))
    raise ArithmeticError(f"components not certified after {most} passes; worst residual {residual.max() / top:.2g} of the largest value")


def fit(x: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor n) of a staged table of vectors of one length."""
    n, sums, squares = moments(x)
    trace = float(sum(n * q - s * s for s, q in zip(sums, squares)) / n**2) if n else 0.0
    size = len(sums)
    if not trace:
        return Whitening(n, sums, trace, np.zeros(0), np.zeros((size, 0)), 0)
    mean = np.array([s / n for s in sums])

    def multiply(q: np.ndarray) -> np.ndarray:
        def block(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ q)

        return summed(x, block, q.size).reshape(q.shape) / n

    return Whitening(n, sums, trace, *iterate(multiply, size, k))


def identity_error(x: DataFrame, w: Whitening) -> float:
    """Largest entry, by size, of the whitened rows' covariance less the identity."""
    k, mean, weights = len(w.values), w.mean, w.weights

    def total(rows: np.ndarray) -> np.ndarray:
        return ((rows - mean) @ weights).sum(axis=0)

    centre = summed(x, total, k) / w.n

    def block(rows: np.ndarray) -> np.ndarray:
        y = (rows - mean) @ weights - centre
        return y.T @ y

    return float(np.abs(summed(x, block, k * k).reshape(k, k) / w.n - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1, by falling value), n, deviation, whitened, explained,
    identity_error.

    Vectors that are null, empty or hold a null or an entry that isn't finite go; so do those of another length than most
    (of lengths as frequent, the longest stays). vec_id may be null or repeated: each row counts. Equal values take any
    directions of their space. Where the covariance has fewer components (fewer dimensions, or rows that span less), there are
    fewer rows for each vector, and none if all vectors are equal or the table is empty. A deviation beyond a long is null.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    good = usable(vectors, column)
    lengths = good.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    most = [r["length"] for r in lengths.collect()]
    with cleaned(spark):
        x = stage(integers(good.filter(F.size(column) == (most[0] if most else 0)), column, key), "vectors")
    w = fit(x, components)
    error, k, n = identity_error(x, w), len(w.values), w.n
    mean, weights, sums = w.mean if n else np.zeros(0), w.weights, np.array(w.sums, np.int64)
    explained = w.values / w.trace if k else np.zeros(0)
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = struct(ddl).names

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            rows = rows_of(batch)
            white = (rows - mean) @ weights
            apart = rows * n - sums
            large = (apart.astype(float) ** 2).sum(axis=1)
            deviation = pa.array(np.where(large < LONG, (apart * apart).sum(axis=1), 0), pa.int64(), mask=large >= LONG * (1 - 1e-9))
            at = pa.array(np.repeat(np.arange(len(rows)), k))
            many = len(rows) * k
            columns = [
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(many, n)),
                deviation.take(at), pa.array(white.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return x.select("vec_id", "x").mapInArrow(project, ddl)
