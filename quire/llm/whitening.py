"""Whitening of embeddings by spectrum slicing.

The covariance of integer-quantised vectors is summed exactly on Spark. Its leading eigenvalues are found in the driver,
on a matrix of the vectors' dimension: the negative pivots of an LDLT factorisation of ``V - s I`` count the eigenvalues
below ``s`` (Sylvester's law of inertia), bisection on these counts isolates each leading eigenvalue, Rayleigh quotient
iteration inside its interval converges cubically, and two more counts beside the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
LARGEST = 1 << 40             # bound of |floor(SCALE * c)|, so that every sum of products fits 38 digits

_ALPHA = (1 + 17 ** 0.5) / 8  # bound of element growth in symmetric pivoting
_EPS = float(np.finfo(float).eps)
_EXACT = pa.decimal128(38, 0)


# --- spectrum slicing

def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, counted on the pivots (1x1 and 2x2) of its LDLT factorisation."""
    a, n, k, count = a.copy(), len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        two = False
        if k < n - 1:
            column = np.abs(a[k + 1:, k])
            r = k + 1 + int(column.argmax())
            largest, own = column[r - k - 1], abs(a[k, k])
            if own < _ALPHA * largest:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                if own * row.max() < _ALPHA * largest * largest:
                    two = abs(a[r, r]) < _ALPHA * row.max()
                    swap(k + 1 if two else k, r)
        if two:
            e, c = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            det = e[0, 0] * e[1, 1] - e[0, 1] * e[1, 0]
            count += 1 if det < 0 else 2 * int(e[0, 0] + e[1, 1] < 0)
            inverse = np.array([[e[1, 1], -e[0, 1]], [-e[1, 0], e[0, 0]]]) / det
            a[k + 2:, k + 2:] -= c @ inverse @ c.T
            k += 2
        else:
            pivot, c = a[k, k], a[k + 1:, k].copy()
            count += int(pivot < 0)
            if pivot != 0:
                a[k + 1:, k + 1:] -= np.outer(c, c / pivot)
            k += 1
    return count


class _Spectrum:
    """Counts of eigenvalues above a shift, each factorised once and used for every eigenvalue."""

    def __init__(self, v: np.ndarray):
        self.v, self.eye = v, np.eye(len(v))
        reach = np.abs(v).sum(axis=1).max()
        self.norm = reach
        self.seen: dict[float, int] = {-2 * reach: len(v), 2 * reach: 0}

    def above(self, s: float) -> int:
        if s not in self.seen:
            self.seen[s] = len(self.v) - negative_pivots(self.v - s * self.eye)
        return self.seen[s]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the ``k``-th largest eigenvalue."""
        return (max(s for s, n in self.seen.items() if n >= k), min(s for s, n in self.seen.items() if n < k))

    def isolate(self, k: int, width: float) -> tuple[float, float]:
        """Bisection until the interval holds that eigenvalue alone or is at most ``width`` wide."""
        lo, hi = self.interval(k)
        while hi - lo > width and self.above(lo) - self.above(hi) > 1:
            self.above((lo + hi) / 2)
            lo, hi = self.interval(k)
        return lo, hi


def _solve(a: np.ndarray, b: np.ndarray, nudge: float) -> np.ndarray:
    try:
        y = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(a + nudge * np.eye(len(a)), b)
    return y / np.linalg.norm(y)


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of the ``k`` largest eigenvalues of a symmetric positive semidefinite matrix, falling.

    Eigenvalues that rounding cannot tell from zero are left out. The number of each is certified by counts on both
    sides; a group that lies closer together than rounding can part is certified as a group, with orthonormal vectors.
    """
    d = len(v)
    if not d or not v.any():
        return np.zeros(0), np.zeros((0, d))
    s = _Spectrum(v)
    least = 16 * d * _EPS * s.norm
    k = min(k, d, s.above(least))
    values, vectors = np.zeros(k), np.zeros((k, d))
    narrow = 4 * max(16, d) * _EPS * s.norm  # rounding moves counts by less
    rng = np.random.default_rng(d)
    for i in range(k):
        done = vectors[:i]

        def clean(y: np.ndarray) -> np.ndarray:
            for _ in range(2):
                y = y - done.T @ (done @ y)
            return y / np.linalg.norm(y)

        lo, hi = s.isolate(i + 1, narrow)
        while True:
            y, middle = clean(rng.standard_normal(d)), (lo + hi) / 2
            for _ in range(3):
                y = clean(_solve(v - middle * s.eye, y, narrow / 16))
            best, slack = np.inf, 8 * narrow if hi - lo <= narrow else narrow  # the last try takes a member of a group
            for _ in range(12):
                value = float(y @ v @ y)
                off = float(np.linalg.norm(v @ y - value * y))
                if off >= best / 2 or not lo - slack <= value <= hi + slack:
                    break
                best, kept = off, (value, y)
                y = clean(_solve(v - value * s.eye, y, narrow / 16))
            if best <= 64 * d * _EPS * s.norm:
                value, y = kept
                near = max(slack, 4 * best)
                if s.above(value - near) >= i + 1 and s.above(value + near) <= i:
                    break
            if hi - lo <= narrow:
                raise ArithmeticError(f"eigenvalue {i + 1} could not be certified")
            s.above(middle)
            lo, hi = s.interval(i + 1)
        values[i], vectors[i] = value, y
    order = np.argsort(-values, kind="stable")  # inside a group only
    return values[order], vectors[order]


# --- exact sums on Spark

def _whole(batch: pa.RecordBatch, column: int, dimension: int | None) -> np.ndarray:
    """The batch's floor(SCALE * c) as a matrix of longs."""
    lists = batch.column(column)
    sizes = np.unique(np.asarray(lists.value_lengths()))
    if len(sizes) != 1 or dimension not in (None, int(sizes[0])):
        raise ValueError(f"vectors of one dimension are needed, found {sorted({*sizes.tolist(), *([dimension] if dimension is not None else [])})}")
    y = np.floor(SCALE * np.asarray(lists.flatten())).reshape(batch.num_rows, int(sizes[0]))
    if y.size and np.abs(y).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST // SCALE} are not supported")
    return y.astype(np.int64)


def _cells(keys: np.ndarray, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, kind)], names=["cell", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sum per dimension, its number of rows (cell -1) and, as a cell per dimension met, that dimension (cells -2 - d)."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            y = _whole(batch, 0, None if total is None else len(total))
            part = [int(c) for c in y.sum(axis=0)]  # at most a batch of rows of 41 bits each
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += batch.num_rows
    if n:
        yield _cells(np.append(np.arange(len(total)), [-1, -2 - len(total)]), [Decimal(t) for t in [*total, n, n]], _EXACT)


def _products(middle: np.ndarray):
    """A partition's exact sums of products of the entries less whole numbers ``middle``, upper triangle."""
    d = len(middle)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d), dtype=object), False
        for batch in batches:
            if not batch.num_rows:
                continue
            w, some = _whole(batch, 0, d) - middle, True
            largest = max(1, int(np.abs(w).max(initial=0)))
            rows = (1 << 53) // largest ** 2  # so many products sum up exactly in a double
            if rows:
                part = np.zeros((d, d), dtype=np.int64)
                for at in range(0, len(w), rows):
                    z = w[at:at + rows].astype(np.float64)
                    part += (z.T @ z).astype(np.int64)
                    if largest ** 2 * (at + 2 * rows) >> 62:
                        total, part = total + part, np.zeros((d, d), dtype=np.int64)
            else:
                z = w.astype(object)
                part = z.T @ z
            total = total + part
        if some:
            yield _cells(np.arange(len(upper[0])), [Decimal(int(c)) for c in total[upper]], _EXACT)
    return run


def _summed(vectors: DataFrame, run: Callable, kind: str) -> dict:
    """Cell sums over all partitions: their number depends on the dimension alone."""
    cells = vectors.mapInArrow(run, f"cell int, value {kind}")
    return {r["cell"]: r["value"] for r in cells.groupBy("cell").agg(F.sum("value").cast(kind).alias("value")).collect()}


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, exact sums of floor(SCALE * c), eigenvalues of the covariance and unit eigenvectors (rows)."""
    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def fit_whitening(df: DataFrame, components: int = 32, vector_col: str = "embedding") -> Whitening:
    """The whitening of all usable vectors of ``df``: up to ``components`` leading eigenpairs of their quantised covariance.

    Two passes over the table, no row is shuffled: partitions send their sums, one number per dimension or pair of
    dimensions. All sums are exact, so the result does not depend on partitions or their order. Vectors that are null or
    have null or non-finite entries take no part; the others must have one dimension and entries of at most 2^34 (else
    ``ValueError``). No usable vector, a single one, or only equal ones give no components.
    """
    vectors = df.select(_usable(vector_col).alias("v")).where("v is not null")
    sums = _summed(vectors, _sums, "decimal(38,0)")
    dimensions = sorted(-2 - c for c in sums if c < -1)
    if len(dimensions) > 1:
        raise ValueError(f"vectors of one dimension are needed, found {dimensions}")
    n, d = int(sums.get(-1, 0)), dimensions[0] if dimensions else 0
    s = tuple(int(sums[i]) for i in range(d))
    if not n or not d:
        return Whitening(n, s, 0.0, np.zeros(0), np.zeros((0, d)))
    middle = np.array([round(Fraction(t, n)) for t in s], dtype=np.int64)
    gram = _summed(vectors, _products(middle), "decimal(38,0)")
    rest = [t - n * int(m) for t, m in zip(s, middle)]
    v = np.zeros((d, d))
    for cell, (i, j) in enumerate(zip(*(x.tolist() for x in np.triu_indices(d)))):
        v[i, j] = v[j, i] = (n * int(gram[cell]) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    values, vectors_ = leading_eigenpairs(v, components)
    return Whitening(n, s, float(np.trace(v)), values, vectors_)


def _usable(vector_col: str) -> Column:
    """The vector as doubles, null where it is null or holds a null or non-finite entry."""
    v = F.col(vector_col).cast("array<double>")
    return F.when(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), v)


def _projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    middle = np.array([round(Fraction(t, model.n)) for t in model.sums], dtype=np.int64)
    rest = np.array([float(Fraction(t, model.n) - int(m)) for t, m in zip(model.sums, middle)])
    return ((y - middle) - rest) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened) for every usable vector of ``df``, whitened in the components of ``model``.

    ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2`` as a 38-digit number; ``whitened`` has a double
    per component. Null ids and repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    n, sums = model.n, np.array(model.sums, dtype=object)
    largest = max([abs(t) for t in model.sums], default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _whole(batch, 1, len(sums))
            k = len(model.values)
            if (n * int(np.abs(y).max(initial=0)) + largest) ** 2 * max(1, len(sums)) < 1 << 63:
                off = n * y - sums.astype(np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * y.astype(object) - sums
                deviation = (off * off).sum(axis=1).tolist()
            z = _projected(y, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([Decimal(t) for t in deviation], _EXACT),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), pa.array(z.ravel()))],
                names=["vec_id", "deviation", "whitened"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), _usable(vector_col).alias("v")).where("v is not null")
    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors of ``df`` less the identity, from one more pass."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            if batch.num_rows:
                z = _projected(_whole(batch, 0, len(model.sums)), model)
                total, means, n = total + z.T @ z, means + z.sum(axis=0), n + len(z)
        if n:
            yield _cells(np.arange(len(upper[0]) + k), [*total[upper].tolist(), *means.tolist()], pa.float64())

    if not k:
        return 0.0
    cells = _summed(df.select(_usable(vector_col).alias("v")).where("v is not null"), run, "double")
    mean = np.array([cells[len(upper[0]) + i] for i in range(k)]) / model.n  # rounding apart, zero
    return max(abs(cells[c] / model.n - mean[i] * mean[j] - (i == j)) for c, (i, j) in enumerate(zip(*upper)))


def whitened_rows(df: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    ``deviation`` is null where a long cannot hold it (some ten million vectors or more).
    """
    model = fit_whitening(df, components, vector_col)
    error = float(identity_error(df, model, vector_col))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.values) else F.array().cast("array<double>")
    return (whiten(df, model, id_col, vector_col)
            .select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")))
