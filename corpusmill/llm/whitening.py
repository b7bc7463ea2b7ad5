"""Whitening of embeddings by merged covariances.

A first pass gives every partition its count, its mean and its scatter centred on that
mean, batch by batch; Chan's formula merges two such moments, and ``treeReduce`` merges
all of them, in levels of four, so that the driver gets a few of them however many
partitions there are. The driver takes the eigenvectors of the covariance. Rows are
projected by an Arrow map, and a second pass over the fit list measures the covariance
of what came out against the identity.

Means are kept as whole numbers, sum and count: the difference of two means, and what a
mean takes from a vector, are exact before they are rounded once. So far from the origin
no digit is lost.

Each entry ``c`` becomes the whole number ``floor(scale * c) + offset``. Every distinct
vector of these counts once in the fit, however many rows have it: a vector that a third
of all rows share is pre-aggregated before the shuffle.

Defined cases: a row whose vector is null, empty, of another length than most have (of
lengths equally common the greater counts), or holds a null, a non-finite entry or one of
2^53 / scale or more has no result; null and repeated ids are rows like others; a deviation
beyond a long is null; a component whose variance is zero to double precision has a null
``whitened`` and explains 0; identity_error is taken over the other components, and 0
without any; an empty table gives an empty result; further columns are ignored.

The driver and each merge hold matrices of dimension squared: 32 kB for 64 dimensions, 8 MB
for 1024. More than ``MOST`` dimensions are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stash

SCALE, OFFSET, COMPONENTS, MOST = 64, 1_000_000, 16, 4096
MOMENTS = "n bigint, sums array<decimal(38,0)>, scatter binary"
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Moments:
    """Count, sums (whole numbers) and centred scatter of some vectors."""

    n: int
    sums: list[int]
    scatter: np.ndarray


def split_mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and a rest of at most a half, each rounded once."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole, rest = split_mean(n, sums)
    return (x - whole).astype(np.float64) - rest


def moments(x: np.ndarray) -> Moments:
    """Of the rows of ``x``. Sums are taken of halves of 32 bits, which cannot overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    sums = [(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)]
    c = centred(x, len(x), sums)
    return Moments(len(x), sums, c.T @ c)


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's formula; the difference of the means comes from whole numbers."""
    n = a.n + b.n
    apart = np.array([(s * a.n - r * b.n) / (a.n * b.n) for r, s in zip(a.sums, b.sums, strict=True)])
    return Moments(n, [r + s for r, s in zip(a.sums, b.sums, strict=True)], a.scatter + b.scatter + np.outer(apart, apart) * (a.n * (b.n / n)))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def gather(fit: DataFrame) -> Moments | None:
    """The moments of all vectors ``x``; None of none."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for some in batches:
            for at in range(0, some.num_rows, 4096):
                part = moments(matrix(some.column(0).slice(at, 4096), np.int64))
                total = part if total is None else merge(total, part)
        if total is not None:
            row = [pa.array([total.n], pa.int64()), pa.array([total.sums], pa.list_(pa.decimal128(38, 0))), pa.array([total.scatter.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["n", "sums", "scatter"])

    def read(row: object) -> Moments:
        sums = [int(s) for s in row.sums]
        return Moments(row.n, sums, np.frombuffer(row.scatter).reshape(len(sums), -1))

    found = fit.select("x").mapInArrow(run, MOMENTS).rdd.map(read)
    return tree_reduce(found, merge)


def tree_reduce(rdd: object, f: object) -> object:
    """``treeReduce`` in levels of about four; None of no rows."""

    def either(a: object, b: object) -> object:
        return b if a is None else a if b is None else f(a, b)

    parts = rdd.getNumPartitions()
    return rdd.treeAggregate(None, either, either, depth=max(2, math.ceil(math.log(max(2, parts), 4))))


@dataclass(frozen=True)
class Whitening:
    """A fit: n and sums of the fit list, unit vectors (a column a component), their variances and shares of the whole."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def sizes(self) -> np.ndarray:
        """What projections are divided by; NaN where the variance is zero."""
        return np.sqrt(np.where(self.variances > 0, self.variances, np.nan))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / self.sizes


def fit_components(m: Moments, components: int = COMPONENTS) -> Whitening:
    """The leading eigenvectors of the covariance; a variance below what rounding leaves is zero."""
    d = len(m.sums)
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    least = max(values[-1], 0.0) * d * np.finfo(np.float64).eps
    kept, whole = np.where(values[order] > least, values[order], 0.0), float(np.trace(m.scatter)) / m.n
    return Whitening(m.n, m.sums, vectors[:, order], kept, kept / whole if whole > 0 else np.zeros(len(order)))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Second pass: the largest absolute entry of the whitened fit list's covariance minus the identity."""
    live = np.flatnonzero(w.variances > 0)
    if not len(live):
        return 0.0

    def part(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        y = w.whiten(x)[:, live]
        mean = y.mean(axis=0)
        return len(y), mean, (y - mean).T @ (y - mean)

    def joined(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * (b[0] / n))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for some in batches:
            for at in range(0, some.num_rows, 4096):
                new = part(matrix(some.column(0).slice(at, 4096), np.int64))
                total = new if total is None else joined(total, new)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], ["n", "mean", "scatter"])

    read = lambda r: (r.n, np.frombuffer(r.mean), np.frombuffer(r.scatter).reshape(len(live), -1))
    n, _, scatter = tree_reduce(fit.select("x").mapInArrow(run, "n bigint, mean binary, scatter binary").rdd.map(read), joined)
    return float(np.abs(scatter / n - np.eye(len(live))).max())


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, x: vectors of whole numbers, of the rows that have a usable vector."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double") * scale) < F.lit(2.0**53), F.lit(False))  # noqa: E731  NaN is greater than any number
    vector = F.col(vector_col)
    sound = rows.where(vector.isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, entry))
    lengths = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    d = lengths[0].d if lengths else 0
    if d > MOST:
        raise ValueError(f"{d} dimensions: a covariance of more than {MOST} does not fit the driver")
    x = F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + offset).cast("long"))
    return sound.where(F.size(vector) == d).select(F.col(id_col).alias(id_col), x.alias("x"))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of the distinct vectors ``x`` of ``rows``, verified by a second pass; None without rows."""
    fit = stash(rows.select("x").distinct(), "fit")
    m = gather(fit)
    if m is None:
        return None
    w = fit_components(m, components)
    return Whitening(w.n, w.sums, w.vectors, w.variances, w.explained, identity_error(fit, w))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum of (n * x - sums)^2, exactly; null beyond a long.

    Where a sum in double precision is below half of a long, no product overflows; what is
    near the border is taken in Python's whole numbers.
    """
    whole, _ = split_mean(n, sums)
    rest = [s - n * int(w) for s, w in zip(sums, whole, strict=True)]
    near = (x - whole).astype(np.float64) * n - np.array(rest, np.float64)
    rough = np.einsum("ij,ij->i", near, near)
    out: list[int | None] = [None] * len(x)
    safe = np.flatnonzero(rough < 2.0**62)
    terms = (x[safe] - whole) * n - np.array(rest, np.int64)
    for i, v in zip(safe.tolist(), np.einsum("ij,ij->i", terms, terms).tolist(), strict=True):
        out[i] = v
    for i in np.flatnonzero((rough >= 2.0**62) & (rough < 2.0**63 * (1 + 1e-6))).tolist():
        v = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        out[i] = v if v <= LONGEST else None
    return pa.array(out, pa.int64())


def whiten(rows: DataFrame, w: Whitening, id_col: str = "vec_id") -> DataFrame:
    """id, deviation, whitened (an array, a number a component) of every row (id, x)."""
    kind = dict(rows.dtypes)[id_col]

    def run(w: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for at in range(0, some.num_rows, 4096):
                part = some.slice(at, 4096)
                x = matrix(part.column(1), np.int64)
                y = pa.array(w.whiten(x).ravel(), from_pandas=True)  # NaN becomes null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(w.variances)), y)
                yield pa.RecordBatch.from_arrays([part.column(0), deviations(x, w.n, w.sums), lists], ["id", "deviation", "whitened"])

    return rows.select(id_col, "x").mapInArrow(lean(partial(run, w)), f"id {kind}, deviation bigint, whitened array<double>").withColumnRenamed("id", id_col)


def whiten_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    vectors = whole_vectors(rows, id_col, vector_col, scale, offset)
    w = fit_whitening(vectors, components)
    if w is None:
        kind = dict(vectors.dtypes)[id_col]
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    share = F.lit([float(e) for e in w.explained])
    each = whiten(vectors, w, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(id_col, (F.col("_at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
