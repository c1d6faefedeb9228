"""Whitening of embeddings by the leading components of their covariance.

The covariance is gathered by Spark in two passes over the distinct vectors;
a matrix of the vectors' width comes to the driver. Its eigenvectors are found
by spectral divide and conquer: the unitary polar factor of the covariance,
shifted by a number inside its spectrum, is the matrix sign, and half of its sum
with the identity projects onto the eigenvalues above the shift. Bases of both
ranges split the matrix in two, which are split again, down to single
components. Polar factors come from the dynamically weighted Halley iteration
by QR. The components then go to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.functions.stage import cut

SCALE, SHIFT = 64, 1_000_000
# entries from here on are not told apart by a double times SCALE
LARGEST = 2.0 ** 47
_EPS = np.finfo(float).eps
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# ---- the eigensolver ------------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix, by the QR form of the dynamically weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS / 4                       # below every singular value that is told apart from zero
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        root = np.sqrt(1 + d)
        h = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        after = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        moved = np.linalg.norm(after - x)
        x = after
        if moved < np.sqrt(n) * _EPS * 8 or (moved < np.cbrt(_EPS) and 1 - low < _EPS * 16):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are one number."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * _EPS * scale:
        return None
    # the mean lies strictly inside the spectrum; the others step aside where a shift meets an eigenvalue
    best = None
    for shift in [float(np.median(np.diag(a))), mean, *(mean + t * spread / np.sqrt(n) for t in (0.37, -0.37, 0.11, -0.11, 0.71, -0.71))]:
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = np.random.default_rng(n).standard_normal((n, rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(basis, mode="complete")
        left = np.linalg.norm(whole[:, rank:].T @ a @ whole[:, :rank])
        if best is None or left < best[0]:
            best = (left, whole[:, :rank], whole[:, rank:])
        if left <= 30 * n * _EPS * scale:
            break
    return None if best is None else best[1:]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix."""
    scale = float(np.linalg.norm(covariance))
    open_ = [(covariance, np.eye(len(covariance)))]
    values, vectors = [], []
    while open_:
        a, basis = open_.pop()
        halves = _halves(a, scale) if len(a) > 1 else None
        if halves is None:
            values.append(np.diag(a))
            vectors.append(basis)
            continue
        for part in halves:
            small = part.T @ a @ part
            open_.append(((small + small.T) / 2, basis @ part))
    found, axes = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-found, kind="stable")
    return found[order], axes[:, order]


# ---- gathering over the vectors -------------------------------------------------------

class Center(NamedTuple):
    """Sums as whole parts and rests: S = n * whole + rest, so that n * x - S = n * (x - whole) - rest."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    def moved(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: small whole numbers before anything is rounded."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 by row, exact; None where it is no 64-bit number."""
        near = x - self.whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2 ** 63:
            far = self.n * near - self.rest
            return (far * far).sum(axis=1).tolist()
        far = self.n * near.astype(object) - self.rest.astype(object)
        return [v if v < 2 ** 63 else None for v in (far * far).sum(axis=1).tolist()]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _steps(vector: str) -> Column:
    """Entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + F.lit(SHIFT).cast("bigint"))


def whole_vectors(frame: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """(keys, x): vectors whose entries are all finite, as whole numbers. Null, empty and too large ones are left out."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    kept = frame.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(fine)
    return kept.select(*[F.col(k).cast("bigint").alias(k) for k in keys], _steps(vector).alias("x"))


def _sums(fit: DataFrame, width: int) -> Center | None:
    """One row per dimension comes to the driver."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, _exact_sums(x))]
        yield pa.RecordBatch.from_pylist([{"at": i, "n": n, "total": str(t)} for i, t in enumerate(total)],
                                         schema=pa.schema([("at", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

    found = fit.mapInArrow(emit, "at int, n bigint, total string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s"))
    rows = sorted(found.collect())
    if not rows or not rows[0].n:
        return None
    n = rows[0].n
    whole = [(2 * int(r.s) + n) // (2 * n) for r in rows]
    return Center(n, np.array(whole, np.int64), np.array([int(r.s) - n * w for r, w in zip(rows, whole)], np.int64))


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums that cannot overflow: halves of 32 bits apart."""
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    return high.astype(object) * 2 ** 32 + low.astype(object)


def _second_moments(fit: DataFrame, width: int, project) -> np.ndarray:
    """Sum of the outer products of ``project(x)``, and their sums as a last row; one matrix per task is added up by Spark."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = project(_matrix(batch.column("x"), width))
            part = np.vstack([z.T @ z, z.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            row, col = np.nonzero(np.tri(*total.shape, dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(total[row, col])], ["row", "col", "v"])

    found = fit.mapInArrow(emit, "row int, col int, v double").groupBy("row", "col").agg(F.sum("v").alias("v")).collect()
    size = max(r.row for r in found)
    total = np.zeros((size + 1, size))
    for r in found:
        total[r.row, r.col] = r.v
    total[:size] = np.tril(total[:size]) + np.tril(total[:size], -1).T
    return total


class Whitener(NamedTuple):
    """Center, axes (as columns) over the roots of their eigenvalues, shares of the trace, and the largest error against the identity."""
    center: Center
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitener(vectors: DataFrame, most: int = 16) -> Whitener | None:
    """Components of the distinct vectors ``x``; None where there are no vectors or all are one.

    Directions without variance beyond rounding are no components. The driver
    holds square matrices of the vectors' width, whatever the number of rows.
    """
    width = vectors.select(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    fit = cut(vectors.select("x").distinct())
    center = _sums(fit, width)
    moments = _second_moments(fit, width, center.moved)
    # the moved vectors add up to zero but for rounding
    covariance = moments[:width] / center.n - np.outer(moments[width], moments[width]) / center.n ** 2
    values, axes = components(covariance)
    count = int(np.sum(values[:most] > width * _EPS * max(values[0], 0)))
    if not count:
        return None
    scaled = axes[:, :count] / np.sqrt(values[:count])
    check = _second_moments(fit, width, lambda x: center.moved(x) @ scaled)
    error = check[:count] / center.n - np.outer(check[count], check[count]) / center.n ** 2 - np.eye(count)
    return Whitener(center, scaled, values[:count] / np.trace(covariance), float(np.abs(error).max()))


def whiten(frame: DataFrame, most: int = 16) -> DataFrame:
    """WHITENED: a row per vector of ``frame`` (vec_id, embedding) and component.

    Vectors that are null, empty, hold null or non-finite entries, or entries of
    2^47 and more (no double tells their steps apart) are left out, and so are
    vectors of another length than the most frequent one (the shorter if tied).
    Repeated vectors count once in the fit and have rows each; ids may be null
    or repeated; extra columns are ignored. An empty table, and one whose
    vectors are all one, have no components and give no rows. ``deviation`` is
    null where it is no 64-bit number.
    """
    frame = frame.select("vec_id", "embedding")
    usual = (frame.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "width").first())
    rows = whole_vectors(frame.filter(F.size("embedding") == (usual.width if usual else 0)))
    fitted = fit_whitener(rows, most)
    if fitted is None:
        return frame.sparkSession.createDataFrame([], WHITENED)
    width, count = fitted.axes.shape
    shared = frame.sparkSession.sparkContext.broadcast(fitted)       # a few numbers per dimension

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, axes, explained, error = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            each = np.repeat(np.arange(len(x)), count)
            deviation = pa.array(center.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), center.n, np.int64)), deviation.take(pa.array(each)), pa.array((center.moved(x) @ axes).reshape(-1)),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))], [c.split()[0] for c in WHITENED.split(", ")])

    return rows.mapInArrow(emit, WHITENED)
