"""Whitening of embeddings by QDWH spectral divide-and-conquer.

1. Every component c becomes the long floor(64 * c) + 1000000. The fit list is each distinct vector once, stored.
2. One pass adds up the fit list, a second one the products of what is left after subtracting the rounded means. All sums are exact
   integers (matrix products of doubles where these stay exact, Python integers elsewhere), so the order in which tasks end doesn't
   matter; n * n * V follows exactly, and V is rounded once.
3. The components of V come from polar decompositions: the polar factor of V - s * I, by the QR- or Cholesky-based dynamically weighted
   Halley iteration, is its sign, so (sign + I) / 2 projects on the directions with eigenvalues above s. Bases of the projector's range
   and of its complement split V into two smaller symmetric matrices, and so on down to single components. Halves that can't
   hold one of the components asked for aren't split further. Only matrices of the size of V are on the driver.
4. The components, a matrix of the vectors' length by at most `COMPONENTS`, go to all tasks, which whiten their rows; a last two passes over the
   fit list measure how far the covariance of the whitened vectors is from the identity.

Rows whose vector is null or holds null or non-finite entries are dropped. Of vectors of different lengths only those of the most
frequent length take part (ties: the longer). Scaled entries saturate at 2 ** 61. Components without variance (below the
rounding of the largest eigenvalue) are not returned: a fit list of one vector has no components, and an empty one no rows. Repeated rows
and ids are returned as often as they occur, null ids as well. A deviation that no long can hold is null."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = float(1 << 61)
EPS = float(np.finfo(float).eps)
EXACT = 1 << 53  # integers up to here are exact as doubles
SLICE_ROWS = 4096


@dataclass
class Whitening:
    """n vectors of the fit list with sums S; per component a unit vector (a row), its eigenvalue, and the total variance."""
    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def rounded_means(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def integer_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of longs) of the rows that take part, whatever their length."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(LIMIT)), F.lit(-LIMIT))) + SHIFT)
    return vectors.where(v.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def of_one_length(rows: DataFrame, column: str = "x") -> tuple[DataFrame, int]:
    """The rows whose array is of the most frequent length, and this length (0 without rows)."""
    sizes = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = sizes["size"] if sizes else 0
    return rows.where(F.size(column) == width), width


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums as Python integers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top * max(1, len(x)) < 1 << 62:
        return x.sum(0).astype(object)
    return x.astype(object).sum(0)


def products(y: np.ndarray) -> np.ndarray:
    """Exact y' y as Python integers. Doubles hold every partial sum of a run of rows exactly, if the run is short enough."""
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1)
    if top * top > EXACT:
        return y.astype(object).T @ y.astype(object)
    run = max(1, EXACT // (top * top))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for begin in range(0, len(y), run):
        part = y[begin:begin + run].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _total_rows(values: np.ndarray) -> pa.RecordBatch:
    """The upper triangle of a square matrix, or a vector as a single row, one row a value."""
    values = np.atleast_2d(values)
    i, j = np.triu_indices(len(values)) if len(values) == values.shape[1] else np.indices(values.shape).reshape(2, -1)
    totals = pa.array([Decimal(int(v)) for v in values[i, j]], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), totals], names=["i", "j", "v"])


def _added_up(rows: DataFrame, width: int, exact) -> dict[tuple[int, int], int]:
    """Sum over all rows of what `exact` makes of a slice of them. Each task returns one value per place, which are added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                value = exact(matrix(batch.column("x").slice(begin, SLICE_ROWS), width))
                total = value if total is None else total + value
        if total is not None:
            yield _total_rows(total)

    sums = rows.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    return {(i, j): int(v) for i, j, v in zip(*(sums.column(c).to_pylist() for c in ("i", "j", "v")))}


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QDWH iteration; for these the factor is the matrix sign."""
    k = len(a)
    x = a / np.linalg.norm(a)
    low = 1e-16  # below any singular value that can be told from zero; six steps lift it to one
    for _ in range(30):
        square = low * low
        gamma = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + gamma)
        wa = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        before = x
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(k)]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:k] @ q[k:].T)
        else:
            factor = np.linalg.cholesky(np.eye(k) + wc * x.T @ x)
            half = np.linalg.solve(factor, x.T)
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, half).T
        x = (x + x.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1 - 1e-16)
        if 1 - low < 1e-14 and np.linalg.norm(x - before) < (5 * EPS) ** (1 / 3):
            break
    return x


def _halves(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces of `a` above and below a shift. Shifts that hit an eigenvalue, or leave all on one side,
    give way to the next; the mean, and places beside it, have eigenvalues on both sides."""
    k = len(a)
    mean = np.trace(a) / k
    spread = np.linalg.norm(a - mean * np.eye(k)) / k
    best = None
    for shift in (np.median(np.diag(a)), mean, *(mean + f * spread for f in (0.07, -0.07, 0.31, -0.31, 0.011, -0.011, 0.0013, -0.0013))):
        sign = polar_factor(a - shift * np.eye(k))
        projector = (sign + np.eye(k)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < k:
            continue
        error = np.linalg.norm(projector @ projector - projector)
        if best is None or error < best[0]:
            best = error, projector, rank
        if error < 1e-12 * k:
            break
    if best is None:  # the eigenvalues can't be told apart
        return np.eye(k), np.zeros((k, 0))
    _, projector, rank = best
    basis = rng.normal(size=(k, rank))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    full, _ = np.linalg.qr(np.hstack([basis, rng.normal(size=(k, k - rank))]))
    return full[:, :rank], full[:, rank:]


def spectrum(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows (their largest entry positive)."""
    rng = np.random.default_rng(3)
    size = np.linalg.norm(v)
    values, vectors, todo = [], [], [(v, np.eye(len(v)))]
    while todo and len(values) < most:  # the last entry holds the largest eigenvalues that are left
        a, basis = todo.pop()
        k = len(a)
        level = np.trace(a) / max(k, 1)
        upper = lower = None
        if k > 1 and np.linalg.norm(a - level * np.eye(k)) > 4 * EPS * size:
            upper, lower = _halves(a, rng)
        if upper is None or not lower.shape[1]:
            values += [level] * k
            vectors += list(basis.T)
            continue
        for half in (lower, upper):
            small = half.T @ a @ half
            todo.append(((small + small.T) / 2, basis @ half))
    if not values:
        return np.zeros(0), np.zeros((0, len(v)))
    vectors = np.array(vectors)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    values = np.einsum("ij,jk,ik->i", vectors, v, vectors)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[order]
    return values, vectors * np.where(vectors[np.arange(len(order)), np.abs(vectors).argmax(1)] < 0, -1, 1)[:, None]


def _whitener(fitted: Whitening):
    """deviation and whitened components of a slice: n * x - S is exact, its quotient by n is rounded once."""
    means = fitted.rounded_means()
    rest = np.array([s - fitted.n * int(m) for s, m in zip(fitted.sums, means)], object)  # |rest| <= n
    projection = (fitted.vectors / np.sqrt(fitted.eigenvalues)[:, None]).T

    def run(x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        y = x - means
        top = (max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1) * fitted.n
        z = y * fitted.n - rest.astype(np.int64) if top < 1 << 62 else y.astype(object) * fitted.n - rest
        square = z if top * top * max(1, x.shape[1]) < 1 << 62 else z.astype(object)
        deviation = [int(d) if d < 1 << 63 else None for d in (square * square).sum(1)]
        return deviation, (z / fitted.n).astype(np.float64) @ projection

    return run


def _identity_error(fit_list: DataFrame, width: int, fitted: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the whitened rows."""
    whiten, k = _whitener(fitted), len(fitted.eigenvalues)

    def totals(value):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                for begin in range(0, batch.num_rows, SLICE_ROWS):
                    total = total + value(whiten(matrix(batch.column("x").slice(begin, SLICE_ROWS), width))[1])
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "v"])

        rows = fit_list.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
        return np.asarray(rows.column("v")) / fitted.n

    mean = totals(lambda w: w.sum(0))
    covariance = totals(lambda w: (w - mean).T @ (w - mean)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of `rows` (as `integer_rows` gives them, of one length); None without rows. The fit list is kept in the checkpoint folder."""
    rows, width = of_one_length(rows)
    fit_list = checkpointed(rows.select("x").distinct())
    n = fit_list.count()
    if not n or not width:
        return None
    sums = _added_up(fit_list, width, lambda x: column_sums(x)[None] if width > 1 else column_sums(x))
    fitted = Whitening(n, [sums[0, j] for j in range(width)], np.zeros((0, width)), np.zeros(0), 0.0)
    means = fitted.rounded_means()
    squares = _added_up(fit_list, width, lambda x: products(x - means))
    rest = [s - n * int(m) for s, m in zip(fitted.sums, means)]
    v = np.zeros((width, width))
    for (i, j), total in squares.items():
        v[i, j] = v[j, i] = (n * total - rest[i] * rest[j]) / (n * n)  # one correctly rounded division of integers
    values, vectors = spectrum(v, min(components, width))
    some = values > 16 * width * EPS * max(values.max(initial=0.0), 0.0)
    fitted.vectors, fitted.eigenvalues, fitted.trace = vectors[some], values[some], float(np.trace(v))
    if some.any():
        fitted.identity_error = _identity_error(fit_list, width, fitted)
    return fitted


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """One row per row of `rows` and component; no shuffle."""
    if fitted is None or not len(fitted.eigenvalues):
        return rows.sparkSession.createDataFrame([], OUTPUT)
    whiten, k, width = _whitener(fitted), len(fitted.eigenvalues), len(fitted.sums)
    explained = fitted.eigenvalues / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                deviation, whitened = whiten(matrix(part.column("x"), width))
                rows = part.num_rows
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fitted.n)), pa.array(deviation, pa.int64()).take(each), pa.array(whitened.reshape(-1)),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, fitted.identity_error))],
                    names=[field.split()[0] for field in OUTPUT.split(", ")])

    return rows.where(F.size("x") == width).mapInArrow(run, OUTPUT)
