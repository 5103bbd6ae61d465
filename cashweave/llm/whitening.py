"""Whitening of embeddings from a covariance of exact integers, assembled by polarisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SCALE, SHIFT = 64, 1_000_000   # an entry c is the integer floor(SCALE * c) + SHIFT
LARGEST = float(1 << 53)       # beyond which SCALE * c is taken as this
LIMB, LIMBS = 40, 6            # sums of up to 240 bits travel as six longs
SAFE = 1 << 62
ENTRIES = 1 << 19             # entries of vectors worked on at once


def whole_vectors(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not NULL and holds neither NULL nor non-finite entries."""
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vectors.where(F.col(vec_col).isNotNull() & F.forall(vec_col, finite))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """The entries of whole vectors as integers, one row per vector."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(np.clip(SCALE * np.clip(c, -LARGEST, LARGEST), -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _tables(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The vectors of all batches as integers, at most ``ENTRIES`` of them at once, with the first column beside."""
    step = max(1, ENTRIES // d)
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield integers(part.column("v"), d), part.column(0)


def _sum_and_squares(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact sums and sums of squares of the columns of an integer table."""
    most = int(np.abs(values).max(initial=0))
    if most * most * len(values) < SAFE:
        return values.sum(axis=0).tolist(), np.einsum("ij,ij->j", values, values).tolist()
    if most * most * 64 < SAFE:
        parts = [_sum_and_squares(values[at:at + 64]) for at in range(0, len(values), 64)]
        return [sum(x) for x in zip(*(p[0] for p in parts))], [sum(x) for x in zip(*(p[1] for p in parts))]
    wide = values.astype(object)
    return wide.sum(axis=0).tolist(), (wide * wide).sum(axis=0).tolist()


@dataclass(frozen=True)
class Fit:
    """Counts and sums of the fit list, and what is worked out from them."""
    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray       # eigenvalues, falling
    vectors: np.ndarray      # unit eigenvectors, a column each

    @property
    def used(self) -> np.ndarray:
        """Components that have a variance above rounding."""
        return self.values > 1e-12 * max(float(np.trace(self.covariance)), 0.0)

    def _parts(self) -> tuple[np.ndarray, np.ndarray]:
        """S = n * near + rest in every dimension, with rest below n: n * x - S is n * (x - near) - rest."""
        return (np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64))

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows: NaN in components without a variance."""
        near, rest = self._parts()
        off = (x - near).astype(np.float64) - rest.astype(np.float64) / self.n
        scale = np.where(self.used, self.values, np.nan)[:components] ** -0.5
        return off @ (self.vectors[:, :components] * scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum over dimensions of (n * x - S) squared; None beyond a long."""
        near, rest = self._parts()
        y = x - near
        bound = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < SAFE:
            off = self.n * y - rest
            return np.einsum("ij,ij->i", off, off).tolist()
        wide = self.n * y.astype(object) - rest
        return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def _dimension(rows: DataFrame) -> int | None:
    """The commonest vector length, ties to the longest."""
    first = rows.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return None if first is None else int(first["d"])


def _sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and the sum of every dimension: d rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * d
        for x, _ in _tables(batches, d):
            n, totals = n + len(x), [t + s for t, s in zip(totals, _sum_and_squares(x)[0])]
        yield _limbs([(i, i, t) for i, t in enumerate(totals)], n)

    got = _gathered(rows.mapInArrow(run, _SUMS))
    return got[0, 0][0], tuple(got[i, i][1] for i in range(d))


_SUMS = "i int, j int, n long, " + ", ".join(f"q{k} long" for k in range(LIMBS))


def _limbs(sums: list[tuple[int, int, int]], n: int) -> pa.RecordBatch:
    """Integers of any size as signed limbs, which add up independently of each other."""
    mask = (1 << LIMB) - 1
    parts = [[(abs(q) >> LIMB * k & mask) * (1 if q >= 0 else -1) for _, _, q in sums] for k in range(LIMBS)]
    return pa.RecordBatch.from_arrays(
        [pa.array([s[0] for s in sums], pa.int32()), pa.array([s[1] for s in sums], pa.int32()),
         pa.array([n] * len(sums), pa.int64()), *(pa.array(p, pa.int64()) for p in parts)],
        ["i", "j", "n", *(f"q{k}" for k in range(LIMBS))])


def _gathered(partial: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    rows = partial.groupBy("i", "j").agg(F.sum("n").alias("n"), *(F.sum(f"q{k}").alias(f"q{k}") for k in range(LIMBS)))
    return {(r["i"], r["j"]): (r["n"], sum(r[f"q{k}"] << LIMB * k for k in range(LIMBS))) for r in rows.collect()}


def _squares(rows: DataFrame, d: int, n: int, sums: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """Exact sums over all rows of the squared centred value, of every dimension (i, i) and of the sum of every two
    dimensions (i, j): with t = n * (x_i + x_j) - (S_i + S_j), the sum of t squared. (d + 1) * d / 2 rows reach the driver.

    A task holds t in two limbs of radix n, as n * u - v with a small u = x_i + x_j - (r_i + r_j) per row and one v per
    pair, so that its sum of squares comes exactly from the sums of u and of u squared.
    """
    near, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        first, second = ([[0] * (d - i) for i in range(d)] for _ in range(2))
        for x, _ in _tables(batches, d):
            y = x - near
            count += len(y)
            for i in range(d):
                u = y[:, i:] + y[:, i:i + 1]
                u[:, 0] = y[:, i]  # the dimension itself
                s, q = _sum_and_squares(u)
                first[i] = [a + c for a, c in zip(first[i], s)]
                second[i] = [a + c for a, c in zip(second[i], q)]
        out = []
        for i in range(d):
            for j in range(i, d):
                v = rest[i] + (rest[j] if j > i else 0)
                out.append((i, j, n * n * second[i][j - i] - 2 * n * v * first[i][j - i] + count * v * v))
        yield _limbs(out, count)

    return {pair: q for pair, (_, q) in _gathered(rows.mapInArrow(run, _SUMS)).items()}


def fit(vectors: DataFrame, vec_col: str = "embedding") -> Fit | None:
    """The covariance of all whole vectors of the commonest length, and its eigenvectors; None without any.

    Variances of every dimension and of the sum of every two are exact integers over n cubed; half of what the variance
    of a sum exceeds those of its parts is their covariance. The matrix is rounded to double once, when whole.
    """
    rows = whole_vectors(vectors, vec_col).select(F.col(vec_col).cast("array<double>").alias("v"))
    d = _dimension(rows)
    if d is None:
        return None
    rows = rows.where(F.size("v") == d)
    n, sums = _sums(rows, d)
    q = _squares(rows, d, n, sums)
    covariance = np.empty((d, d))
    for i in range(d):
        covariance[i, i] = q[i, i] / n ** 3
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (q[i, j] - q[i, i] - q[j, j]) / (2 * n ** 3)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, ::-1]
    signs = np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)  # the same on every run
    return Fit(n, sums, covariance, values[::-1], axes * signs)


def _identity_error(rows: DataFrame, model: Fit, components: int) -> float:
    """How far the covariance of the whitened rows, summed over all of them, is from the identity."""
    used = np.flatnonzero(model.used[:components])
    if not len(used):
        return 0.0
    k, d = len(used), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x, _ in _tables(batches, d):
            w = model.project(x, components)[:, used]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        a, b = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "s"])

    total = np.zeros((k + 1, k))
    for r in rows.mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
        total[r["a"], r["b"]] = r["s"] / model.n
    covariance = total[:k] - np.outer(total[k], total[k])
    return round(float(np.abs(covariance - np.eye(k)).max()), 12)  # beyond that the order of summing shows


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per whole vector and component: ``id_col``, ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Rows with a NULL vector or with NULL or non-finite entries take no part, nor do vectors of another length than the
    commonest (ties to the longest) and empty ones. An entry c is x = floor(64 * c) + 1,000,000, with 64 * c held to 2^53
    on either side. ``deviation`` is the exact sum over dimensions of (n * x - S) squared, NULL where that is no long.
    A component whose eigenvalue is not above 1e-12 of the trace has no ``whitened`` value (NULL) and takes no part in
    ``identity_error``; ``explained`` is 0 if all vectors are equal. Repeated rows and ids stay rows of their own; a NULL id is
    kept; no vectors give no rows; further columns are not read.

    Four scans, none with a shuffle of vectors: lengths, sums, squares, and the whitened covariance; tasks send
    on d * d / 2 sums at most, which Spark adds up, and the driver holds one matrix of that size.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    model = fit(vectors, vec_col)
    if model is None:
        return spark.createDataFrame([], schema)
    d = len(model.sums)
    rows = whole_vectors(vectors, vec_col).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") == d)
    k = min(components, d)
    error = _identity_error(rows.select("v"), model, k)
    trace = float(np.trace(model.covariance))
    share = model.values[:k] / trace if trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _tables(batches, d):
            each = np.repeat(np.arange(len(x)), k)
            w = model.project(x, k).ravel()
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error))],
                names=schema.names)

    return rows.mapInArrow(run, schema)
