"""Whitening of embeddings with exact sums: digit-slice GEMM.

Components become integers, floor(scale * component) + offset. The covariance
of numbers with a large common offset is lost if it is taken from rounded sums of
squares, so the sums are exact: integers are split into limbs of 16 bits, the
products of limbs are summed by float64 BLAS calls of so many rows that all
sums stay below 2^53, and limbs are put together again as big integers (Ozaki et
al., 2012, split for the same end). Each task gives one such matrix, in digits of 48 bits that Spark
adds up as decimals; what reaches the driver is bounded by the square of the
dimension, not by the rows. n * sum(x y) - sum(x) * sum(y) then is n^2 times the
covariance to the last digit, and is rounded once.

The eigenvectors come from LAPACK and are polished by Jacobi rotations in
extended precision, which makes small eigenvalues beside large ones right
relative to their own size. Rows are projected in a second pass; two more take the
mean and the centred products of the whitened values, for the deviation of their
covariance from the identity.

Defined results: vectors that are null or hold a null or non-finite component
are left out; rows with a null id, repeated rows and zero vectors count and are
returned; a vector shorter than the longest counts as filled up with zeros; scaled
components beyond 2^52 are cut off there; where a component has no variance (an
eigenvalue within rounding of zero) ``whitened`` is null and the component
takes no part in ``identity_error``; without any variance ``explained`` and
``identity_error`` are null; ``deviation`` is cut off at the largest long; other columns are
ignored; without vectors the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scaled_vectors

LIMB = 16  # bits
ROWS = 1 << 20  # whose products of two limbs, each below 2^32, sum up to less than 2^53
DIGIT = 48  # bits
LONGEST = (1 << 63) - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Limbs of integers, lowest first; all but the last are in 0..2^16-1, the last has the sign."""
    out = []
    while True:
        high = x >> LIMB
        if np.abs(x).max(initial=0) < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & (1 << LIMB) - 1).astype(np.float64))
        x = high


class Gram:
    """Exact sums of the products of all pairs of columns."""

    def __init__(self, dim: int):
        self.total = np.zeros((dim, dim), object)
        self.held: dict[int, np.ndarray] = {}  # sums of products by their limbs' places together, as longs
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), ROWS):
            part = limbs(x[at : at + ROWS])
            for a, left in enumerate(part):
                for b, right in enumerate(part):
                    self.held[a + b] = self.held.get(a + b, 0) + (left.T @ right).astype(np.int64)
            self.rows += len(part[0])
            if self.rows >= 1 << 28:  # four pairs of limbs at a place, each sum of so many below 2^60
                self.settle()

    def settle(self) -> np.ndarray:
        for place, s in self.held.items():
            self.total = self.total + (s.astype(object) << LIMB * place)
        self.held, self.rows = {}, 0
        return self.total


def digits(v: int) -> Iterator[int]:
    """Digits of 48 bits, lowest first; the last has the sign."""
    while not -(1 << DIGIT) <= v < 1 << DIGIT:
        yield v & (1 << DIGIT) - 1
        v >>= DIGIT
    yield v


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dim)


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gram(dim + 1)  # a leading one gives the count and the sums
        for b in batches:
            g.add(np.pad(_matrix(b, dim), ((0, 0), (1, 0)), constant_values=1))
        rows = [(i, j, place, d) for (i, j), v in np.ndenumerate(g.settle()) if i <= j for place, d in enumerate(digits(int(v)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "digit"])

    return run


def exact_sums(rows: DataFrame, dim: int) -> list[list[int]]:
    """The matrix of sums of products of (1, x), as whole numbers; ``rows`` are (vec_id, x)."""
    parts = rows.mapInArrow(_gram(dim), "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    out = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in parts.collect():
        out[r["i"]][r["j"]] += int(r["digit"]) << DIGIT * r["place"]
    return [[out[min(i, j)][max(i, j)] for j in range(dim + 1)] for i in range(dim + 1)]


@dataclass
class Whitening:
    """``mean`` + ``rest`` / ``n`` is the exact mean; columns of ``vectors`` are unit eigenvectors, ``values`` falls."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the components of (n * x - sum)^2, as longs."""
        off = x - self.mean
        if len(x) and (int(np.abs(off).max()) + 1) ** 2 * self.n**2 * len(self.mean) >= LONGEST:
            off = off.astype(object)
        exact = ((off * self.n - self.rest) ** 2).sum(axis=1)
        return np.array([min(int(v), LONGEST) for v in exact], np.int64) if exact.dtype == object else exact

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN where the component has no variance."""
        centred = (x - self.mean).astype(np.float64) - self.rest / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred @ self.vectors / np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)


def eigen(v: np.ndarray, sweeps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in extended precision, by cyclic Jacobi rotations after LAPACK's."""
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):  # orthogonal to extended precision too
        q = q @ (1.5 * np.eye(len(q), dtype=np.longdouble) - 0.5 * (q.T @ q))
    a = q.T @ v @ q
    least = np.finfo(np.longdouble).eps
    for _ in range(sweeps):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= 4 * least * np.sqrt(abs(a[i, i] * a[j, j])) or abs(a[i, j]) <= least**2 * abs(a[0, 0] + a[-1, -1]):
                    continue
                turned = True
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


def fit(sums: list[list[int]], most: int = 32) -> Whitening:
    """The first ``most`` components of exact sums of (1, x)."""
    n, dim = sums[0][0], len(sums) - 1
    total = sums[0][1:]
    wide = [[n * sums[i + 1][j + 1] - total[i] * total[j] for j in range(dim)] for i in range(dim)]
    square = n * n

    def rounded(v: int) -> np.longdouble:
        high = v / square  # Python divides whole numbers with one rounding
        return np.longdouble(high) + np.longdouble(float(Fraction(v, square) - Fraction(high)))

    v = np.array([[rounded(x) for x in row] for row in wide], np.longdouble).reshape(dim, dim)
    values, vectors = eigen(v) if dim else (np.zeros(0), np.zeros((0, 0)))
    trace = rounded(sum(wide[i][i] for i in range(dim)))
    values, vectors = values[:most], vectors[:, :most]
    # below this an eigenvalue is what rounding left of zero
    values = np.where(values > dim * np.finfo(np.longdouble).eps * trace * 4, values, 0)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    mean = [t // n for t in total]
    return Whitening(n, np.array(mean, np.int64), np.array([t - m * n for t, m in zip(total, mean)], np.int64), vectors.astype(float), values.astype(float), explained.astype(float))


def _sums(dim: int, made: Callable[[np.ndarray], np.ndarray]):
    """Sums over a task's rows of what ``made`` gives for a batch, as (place, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for b in batches:
            if b.num_rows:
                part = made(_matrix(b, dim))
                total = part if not total.size else total + part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.ravel(total))], names=["place", "value"])

    return run


def _added(rows: DataFrame, dim: int, size: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.zeros(size)
    for r in rows.mapInArrow(_sums(dim, made), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """The largest entry, in size, of the whitened values' covariance less the identity."""
    dim, live = len(w.mean), w.values > 0
    k = int(live.sum())
    if not k:
        return None
    mean = _added(rows, dim, k, lambda x: w.whitened(x)[:, live].sum(axis=0)) / w.n

    def products(x: np.ndarray) -> np.ndarray:
        y = w.whitened(x)[:, live] - mean
        return y.T @ y

    return float(np.abs(_added(rows, dim, k * k, products).reshape(k, k) / w.n - np.eye(k)).max())


def _writer(w: Whitening, error: float | None):
    dim, k = len(w.mean), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            x, rows = _matrix(part, dim), part.num_rows
            white = w.whitened(x).ravel()
            known = np.tile(w.explained, rows)
            cols = [
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, w.n)),
                pa.array(np.repeat(w.deviations(x), k)),
                pa.array(white, mask=np.isnan(white)),
                pa.array(known, mask=np.isnan(known)),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in OUT.split(", ")])

    return run


def whiten(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64, offset: int = 1_000_000, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and each of the first ``most`` components."""
    rows, dim, n = scaled_vectors(vectors, id_col, vector_col, scale, offset)
    if not n or not dim:
        return rows.sparkSession.createDataFrame([], OUT)
    w = fit(exact_sums(rows, dim), most)
    return rows.mapInArrow(_writer(w, identity_error(rows, w)), OUT)
