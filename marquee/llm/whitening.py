"""Whitening of embeddings: leading principal components of the distinct vectors, scaled to unit variance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries are finite and below this in absolute value, so that whole numbers hold them.
LARGEST = 2.0**56
#: Components whose variance is a smaller share of the first one's are rounding noise.
LEAST_VARIANCE = 1e-11
#: Eigenvalues closer than this share of the matrix are one cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
WIDE = 2**62


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): Householder's form of a symmetric matrix.

    The reflections I - 2vv' of the list, first to last, turn a vector of the matrix into one of the form.
    """
    a = np.array(matrix, dtype=np.float64)
    size, reflections = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.any(v[1:]) and length:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            w = rest @ v
            w -= (v @ w) * v
            rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] -= 2.0 * v[0] * (v @ a[k + 1 :, k])
        else:
            v[:] = 0.0
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def smaller(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm's count: how many eigenvalues lie below each of `at`."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, how_many: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection on Sturm's count."""
    size = len(diagonal)
    reach = np.zeros(size)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    span = max(np.max(np.abs(diagonal) + reach), np.finfo(np.float64).tiny)
    low, high = np.full(how_many, -1.001 * span), np.full(how_many, 1.001 * span)
    rank = size - 1 - np.arange(how_many)  # an eigenvalue has as many below it
    for _ in range(120):
        middle = 0.5 * (low + high)
        below = smaller(diagonal, off, middle) <= rank
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if np.all((middle == low) & (middle == high) | (high - low <= np.spacing(np.abs(middle)))):
            break
    return 0.5 * (low + high)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(form - shift) x = right by elimination with row exchange; pivots below `least` become it."""
    size = len(diagonal)
    d, up, b = (diagonal - shift).tolist(), [*off.tolist(), 0.0], right.tolist()
    low, second = off.tolist(), [0.0] * size
    for i in range(size - 1):
        if abs(low[i]) > abs(d[i]):
            factor = d[i] / low[i]
            d[i], up[i], d[i + 1], second[i], up[i + 1] = low[i], d[i + 1], up[i] - factor * d[i + 1], up[i + 1], -factor * up[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else least
            factor = low[i] / d[i]
            d[i + 1] -= factor * up[i]
            b[i + 1] -= factor * b[i]
    x = [0.0] * (size + 2)
    for i in range(size - 1, -1, -1):
        x[i] = (b[i] - up[i] * x[i + 1] - second[i] * x[i + 2]) / (d[i] if abs(d[i]) > least else least)
    return np.array(x[:size])


def leading_components(matrix: np.ndarray, how_many: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, the first `how_many`.

    Each vector comes from inverse iteration on the tridiagonal form; those of a cluster of eigenvalues are made
    orthogonal to each other in every step. Its entry of the largest absolute value (the first of them) is positive.
    """
    scale = float(np.max(np.abs(matrix))) or 1.0
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, how_many)
    size, random = len(diagonal), np.random.default_rng(7)
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    vectors = np.zeros((size, how_many))
    first = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # equal eigenvalues get shifts that differ a little
        shift, x = value - (k - first) * 2 * np.finfo(np.float64).eps * norm, random.standard_normal(size)
        for _ in range(6):
            y = _solve(diagonal, off, shift, x / np.linalg.norm(x), np.finfo(np.float64).eps * norm)
            for _ in range(2):
                y /= np.linalg.norm(y)
                y -= vectors[:, first:k] @ (vectors[:, first:k].T @ y)
            x = y
        vectors[:, k] = x / np.linalg.norm(x)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1 :] -= 2.0 * np.outer(v, v @ vectors[k + 1 :])
    vectors *= np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(how_many)])
    return values * scale, vectors


@dataclass
class Fit:
    """What the distinct vectors give: their number, sums by dimension, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: as 64-bit numbers where they fit, else as Python's."""
        most = max(int(np.max(np.abs(x), initial=0)), 1)
        if self.n * most < WIDE and max(map(abs, self.sums), default=0) < WIDE:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / float(self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, vector_column: str, name: str, extra: dict[str, str]) -> DataFrame:
    """Rows whose vector can be used, as whole numbers in the column `name`; `extra` maps output to input columns."""
    vector = F.col(vector_column).cast("array<double>")
    good = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(good).select(*[F.col(i).alias(o) for o, i in extra.items()], x.alias(name))


def _matrix(column: pa.ListArray | pa.ChunkedArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension; a row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(size), "n": np.full(size, n), "high": high, "low": low})

    parts = vectors.mapInArrow(add, "i long, n long, high long, low long").groupBy("i")
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = {r.i: r for r in parts.agg(*total).collect()}  # one row for each dimension
    if not found:
        return 0, [0] * size
    return int(found[0].n), [int(found[i].high) * 2**32 + int(found[i].low) for i in range(size)]


def _covariance(vectors: DataFrame, size: int, n: int, out: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance with divisor n of what `centred` makes of the vectors; `out` * (out + 1) / 2 numbers reach the driver.

    `centred` gives deviations from the mean, so products are of small numbers; what rounding leaves of the mean is
    taken off at the end.
    """
    at = np.triu_indices(out)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, left = np.zeros((out, out)), np.zeros(out)
        for batch in batches:
            whole = _matrix(batch.column(0), size)
            for start in range(0, len(whole), 4096):
                z = centred(whole[start : start + 4096])
                products += z.T @ z
                left += z.sum(axis=0)
        i, j = np.append(at[0], np.arange(out)), np.append(at[1], np.full(out, -1))
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": np.append(products[at], left)})

    parts = vectors.mapInArrow(multiply, "i long, j long, v double")
    matrix, mean = np.zeros((out, out)), np.zeros(out)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # bounded by the square of the dimensions
        if r.j < 0:
            mean[r.i] = r.v / n
        else:
            matrix[r.i, r.j] = matrix[r.j, r.i] = r.v / n
    return matrix - np.outer(mean, mean)


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    An entry c of a vector stands for x = floor(64 c) + 1000000. The fit takes each distinct x vector once: n of them,
    their sums S, and their covariance (divisor n, of deviations). Its leading eigenvectors are the components, from 1
    by falling eigenvalue e. `deviation` is the sum of (n x - S)^2, exact, as decimal(38,0) (null from 39 digits on);
    `whitened` is (x - S/n) on the component over sqrt(e); `explained` is e over the trace; `identity_error` is the
    largest absolute entry of the covariance of whitened distinct vectors minus the identity.

    Left out: null or empty vectors, those with a null, a NaN, an infinite entry or one of 2^56 or more, and where
    lengths differ, all but those of the most common length (ties: the longer). Null, equal and repeated ids keep their
    rows, each by itself. Components with less than 1e-11 of the first one's variance (also where there is but one
    distinct vector) and those beyond the number of dimensions do not exist, so their rows do not either; a sign is
    fixed by the largest entry of the component. An empty table gives an empty result; other columns are ignored.

    Distinct vectors are found with a partial aggregation, so a vector that many rows share is no hot key. Sums and
    products are formed where the vectors are and only a square matrix of the dimensions reaches the driver; the
    components go out with the task.
    """
    spark = rows.sparkSession
    kept = whole_vectors(rows, vector_column, "x", {"id": id_column})
    lengths = Counter({r.k: r.n for r in kept.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).limit(1).collect()})
    schema = T.StructType([T.StructField(id_column, rows.schema[id_column].dataType)])
    schema = schema.add("component", "integer").add("n", "long").add("deviation", T.DecimalType(38, 0))
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not lengths:
        return spark.createDataFrame([], schema)
    size = next(iter(lengths))
    kept = kept.where(F.size("x") == size)
    distinct = stored(kept.select("x").distinct(), "whitening")
    n, sums = _sums(distinct, size)
    fit = Fit(n, sums, np.ones(size), np.eye(size), 0.0)
    covariance = _covariance(distinct, size, n, size, fit.centred)
    fit.trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, min(components, size))
    true = int(np.sum(values > max(LEAST_VARIANCE * values[0], 0.0)))
    if not true:
        return spark.createDataFrame([], schema)
    fit.values, fit.vectors = values[:true], np.ascontiguousarray(vectors[:, :true])
    error = float(np.max(np.abs(_covariance(distinct, size, n, true, fit.whitened) - np.eye(true))))
    explained = fit.values / fit.trace
    limit, exact = 10**38, pa.decimal128(38, 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = _matrix(batch.column("x"), size)
                off = fit.deviations(x)
                if off.dtype != object and int(np.max(np.abs(off))) ** 2 * size < WIDE:
                    deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(exact)
                else:
                    each = (off.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(int(v)) if v < limit else None for v in each], exact)
                at = pa.array(np.repeat(np.arange(len(x)), true))
                made = {
                    id_column: batch.column("id").take(at),
                    "component": pa.array(np.tile(np.arange(1, true + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(at), n)),
                    "deviation": deviation.take(at),
                    "whitened": pa.array(fit.whitened(x).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(at), error)),
                }
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return kept.mapInArrow(project, schema)
