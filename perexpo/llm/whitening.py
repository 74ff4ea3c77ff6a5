"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become whole numbers (``floor(SCALE * c) + OFFSET``), so sums and deviations are exact.
The model is fitted on the different vectors, each once: one pass for the sums, one for the
products of centred entries, both reduced to one partial result a task before they meet.
The covariance has as many rows as a vector has entries, whatever the number of vectors; it is
all that reaches the driver, which finds the leading components: Householder
reflections to tridiagonal form, bisection on Sturm counts for the eigenvalues, inverse
iteration for the vectors, orthogonalised again within clusters of close eigenvalues. The
components, bounded by ``MOST`` times the entries of a vector, go to all tasks, which project
every row.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is dropped, a
zero vector is not. Vectors of another length than most different ones (of equally many, the longer)
are dropped too. Entries beyond 2^53 / SCALE in size are taken as that bound. Components without
variance (eigenvalue under 1e-12 of the largest) cannot be scaled and are left out, so fewer than
asked for come back where vectors span fewer dimensions, and none if all vectors are equal.
A deviation beyond the range of a long is null. Repeated rows come back as often as they occur,
and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from perexpo.llm.common import batches_of, stored

MOST = 16
#: Fixed values of the whole-number form.
SCALE, OFFSET = 64, 1_000_000
_NO_VARIANCE = 1e-12
_ROWS = 4096


def whole(vector: Column) -> Column:
    """A vector in whole-number form; null if it takes no part."""
    value = vector.cast("array<double>")
    good = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = F.lit(float(2**53))
    entries = F.transform(value, lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound)).cast("bigint") + OFFSET)
    return F.when(F.coalesce((F.size(value) > 0) & good, F.lit(False)), entries)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _total(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """Sum of ``partial`` over all rows, by blocks within a task and then by entry over the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64 if kind == "bigint" else np.float64)
        for batch in batches_of(batches, _ROWS):
            total += partial(_matrix(batch["x"]))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(total.size)), "part": pa.array(total.ravel())})

    parts = rows.select("x").mapInArrow(work, f"entry bigint, part {kind}")
    sums = parts.groupBy("entry").agg(F.sum("part").alias("total")).toArrow()
    out = np.zeros(int(np.prod(shape)), dtype=np.int64 if kind == "bigint" else np.float64)
    out[sums["entry"].to_numpy()] = sums["total"].to_numpy()
    return out.reshape(shape)


def _covariance(rows: DataFrame, n: int, mean: np.ndarray, form: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance, divisor ``n``, of what ``form`` makes of the rows, centred by ``mean`` before multiplying."""

    def products(x: np.ndarray) -> np.ndarray:
        centred = form(x) - mean
        return centred.T @ centred

    return _total(rows, products, (mean.size, mean.size), "double") / n


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    size, reflections = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1 :, k])
        reflections.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: float) -> int:
    """Number of eigenvalues of a tridiagonal matrix below ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = 0, 1.0
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] * off[k - 1] / q if k else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues in falling order, each bisected until its bounds are neighbours."""
    size = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    margin = max(abs(low), abs(high), 1e-300) * 1e-12
    low, high, out = low - margin, high + margin, []
    for k in range(min(most, size)):
        a, b = low, out[-1] + margin if out else high
        while True:
            middle = a + (b - a) / 2
            if middle <= a or middle >= b:
                break
            # At least k + 1 eigenvalues are not below the one that is wanted.
            if size - sturm_count(diagonal, off, middle) >= k + 1:
                a = middle
            else:
                b = middle
        out.append(a)
    return np.array(out)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of the shifted tridiagonal system by elimination with row exchanges."""
    size = len(diagonal)
    least = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max() if size > 1 else 0.0, 1e-300)
    d, e, f = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    x = right.copy()
    below = off.copy()
    for k in range(size - 1):
        if abs(below[k]) > abs(d[k]):
            d[k], below[k] = below[k], d[k]
            e[k], d[k + 1] = d[k + 1], e[k]
            f[k], e[k + 1] = e[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        d[k] = d[k] if abs(d[k]) > least else np.copysign(least, d[k])
        factor = below[k] / d[k]
        d[k + 1] -= factor * e[k]
        e[k + 1] -= factor * f[k]
        x[k + 1] -= factor * x[k]
    for k in range(size - 1, -1, -1):
        d[k] = d[k] if abs(d[k]) > least else np.copysign(least, d[k])
        tail = (e[k] * x[k + 1] if k + 1 < size else 0.0) + (f[k] * x[k + 2] if k + 2 < size else 0.0)
        x[k] = (x[k] - tail) / d[k]
    return x


def leading_eigenvectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (rows) of a symmetric matrix."""
    unit = np.abs(matrix).max(initial=0.0)
    if unit == 0:
        return np.zeros(min(most, len(matrix))), np.eye(len(matrix))[:most]
    diagonal, off, reflections = tridiagonal(matrix / unit)
    values = leading_eigenvalues(diagonal, off, most)
    size, scale = len(diagonal), max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0))
    rng, vectors, cluster = np.random.default_rng(5), [], []
    for k, value in enumerate(values):
        cluster = [*cluster, k - 1] if k and values[k - 1] - value < 1e-3 * scale else []
        shift = value - 4 * np.finfo(float).eps * scale * len(cluster)
        x = rng.normal(size=size)
        for _ in range(4):
            x = x / np.linalg.norm(x)
            x = _solve(diagonal, off, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                for j in cluster:
                    x -= (vectors[j] @ x) * vectors[j]
        vectors.append(x / np.linalg.norm(x))
    out = np.array(vectors).reshape(len(values), size)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    # The sign is free; the largest entry is taken to be positive, so reruns agree.
    largest = np.abs(out).argmax(axis=1) if len(out) else np.zeros(0, dtype=int)
    return values * unit, out * np.where(out[np.arange(len(out)), largest] < 0, -1.0, 1.0)[:, None]


@dataclass
class Model:
    """What is fitted: number and sums of the different vectors, and the components (rows) with their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of squares of n * x - sums; -1 where they leave the range of a long."""
        # n * x - sums from whole and broken parts of the mean, so no product is larger than it must be.
        away = np.abs((x - self.sums // self.n).astype(np.float64)).max(initial=0.0) + 1
        if (away * self.n) ** 2 * x.shape[1] < 2**62:
            exact = (x - self.sums // self.n) * self.n - self.sums % self.n
            return (exact * exact).sum(axis=1)
        wide = x.astype(object) * self.n - self.sums.astype(object)
        totals = (wide * wide).sum(axis=1)
        return np.array([t if t < 2**63 else -1 for t in totals], dtype=np.int64)


def _vectors(table: DataFrame, vector: str) -> DataFrame:
    return table.select(whole(F.col(f"`{vector}`")).alias("x")).where("x IS NOT NULL")


def fit(table: DataFrame, vector: str = "embedding", most: int = MOST) -> Model | None:
    """The model of all different vectors of ``table``; None if no vector takes part."""
    different = stored(_vectors(table, vector).distinct(), "vectors")
    # One row for each length that occurs.
    lengths = different.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None:
        return None
    size, n = usual["size"], usual["n"]
    rows = different.where(F.size("x") == size)
    sums = _total(rows, lambda x: x.sum(axis=0), (size,), "bigint")
    model = Model(n, sums, np.zeros((0, size)), np.zeros(0), 0.0)
    spread = _covariance(rows, n, np.zeros(size), model.centred)
    values, vectors = leading_eigenvectors(spread, most)
    real = values > _NO_VARIANCE * max(values[0], 0.0)
    model = Model(n, sums, vectors[real], values[real], float(np.trace(spread)))
    found = int(real.sum())
    if found:
        mean = _total(rows, lambda x: model.whitened(x).sum(axis=0), (found,), "double") / n
        model.identity_error = float(np.abs(_covariance(rows, n, mean, model.whitened) - np.eye(found)).max())
    return model


def transform(table: DataFrame, model: Model | None, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep`` of every row that takes part, ``deviation`` and ``whitened`` (one value a component)."""
    kept = table.select(*[F.col(f"`{c}`") for c in keep], whole(F.col(f"`{vector}`")).alias("x"))
    size = model.sums.size if model else -1
    rows = kept.where(F.size("x") == size)
    more = [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    schema = StructType([*rows.schema.fields[:-1], *more])
    if model is None:
        return rows.select(*rows.columns[:-1], F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, _ROWS):
            x = _matrix(batch["x"])
            away = model.deviation(x)
            values = model.whitened(x)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel())
            )
            columns = [*batch.columns[:-1], pa.array(away, mask=away < 0), lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
