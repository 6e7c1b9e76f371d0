"""Whitening of embeddings: float32 eigenvectors of a distributed covariance, refined in higher precision.

Tasks sum the covariance of the distinct vectors. The eigenvectors of its float32 copy are a rough start. Each step of
Ogita and Aishima's refinement then needs only matrix products: R = I - X'X tells how far the vectors are from
orthonormal, S = X'AX how far from diagonal, and from both follows the correction X + XE, which about squares the error. Where eigenvalues lie closer than the step can tell apart, only their common space is
right; there the matrix, less its mean eigenvalue and seen in that space, is solved anew, which sets its vectors apart by what was
lost in the digits before.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.scratch import written_once

#: The precision of the refinement's products; where it is no more than double, results are good to double's own rounding.
WIDE = np.longdouble

#: Entries are taken as floor(scale * entry); components returned.
SCALE, COMPONENTS = 256, 4

#: Numbers of a batch worked on at a time, and refinement steps at most.
NUMBERS, STEPS = 1 << 20, 30

#: Entries up to here are whole 64-bit numbers after scaling.
_LARGEST = float(1 << 62)


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Eigenvalues that are equal to the last digit share a space; any orthonormal vectors of it are returned.
    """
    a, d = matrix.astype(WIDE), len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if not size:
        return np.zeros(d), np.eye(d)
    x = np.linalg.eigh((matrix / size).astype(np.float32))[1].astype(WIDE)
    a, one = a / size, np.eye(d, dtype=WIDE)
    before = np.inf
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        # Exactly symmetric, so that what rounding does to close eigenvalues' corrections cancels within a pair.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(values)
        # What the step cannot tell apart: norms bounded by Frobenius's.
        close = 2 * (np.sqrt(np.square(rest).sum()) + np.sqrt(np.square(r).sum()))
        apart = values[None, :] - values[:, None]
        plain = np.abs(apart) > close
        e = np.where(plain, (s + values[None, :] * r) / np.where(plain, apart, 1), r / 2)
        x = x + x @ e
        step = np.abs(e).max()
        if step < np.finfo(np.float64).eps / 4 or before / 2 < step < 1e-6:
            break
        before = step
        x = _clusters_solved(a, x, values, close)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.square(x[:, order]).sum(axis=0))
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


def _clusters_solved(a: np.ndarray, x: np.ndarray, values: np.ndarray, close) -> np.ndarray:
    """Sets apart the vectors of eigenvalues that neighbours closer than ``close`` chain together."""
    order = np.argsort(values)
    edges = np.flatnonzero(np.diff(values[order]) > close) + 1
    for group in np.split(order, edges):
        if len(group) > 1:
            space = x[:, group]
            space = _orthonormal(space)
            shifted = a @ space - space * values[group].mean()
            small = (space.T @ shifted).astype(np.float64)
            spread = np.abs(small).max()
            if spread:
                small /= spread
                x[:, group] = space @ _orthonormal(np.linalg.eigh((small + small.T) / 2)[1].astype(WIDE))
    return x


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, made so; the error is squared."""
    return x @ (3 * np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2


@dataclass
class Whitening:
    """Of the distinct vectors their number and sums; eigenvalues, falling, components as columns, and their check."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """Columns that whiten; zero where a component has no variance."""
        least = len(self.values) * np.finfo(np.float64).eps * max(self.values.max(initial=0), 0)
        safe = np.where(self.values > least, self.values, np.inf)
        return self.vectors / np.sqrt(safe)


def vectors(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and x, the whole numbers floor(scale * entry), of the rows that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < _LARGEST))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return embeddings.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _portions(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole numbers of portions of a batch, zeros behind shorter vectors."""
    step = max(1, NUMBERS // max(width, 1))
    for first in range(0, len(batch), step):
        lists = batch.column("x").slice(first, step)
        sizes = np.diff(lists.offsets.to_numpy())
        rows = np.zeros((len(lists), width), np.int64)
        rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        yield first, rows


def _summed(width: int):
    """A task's number of vectors and sums, as text so that no sum overflows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            for _, rows in _portions(batch, width):
                small = float(np.abs(rows.astype(np.float64)).max(initial=0)) * len(rows) < _LARGEST
                part = rows.sum(axis=0) if small else rows.astype(object).sum(axis=0)
                n, sums = n + len(rows), [s + int(p) for s, p in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *range(width)], pa.int32()), "part": [str(n), *map(str, sums)]})

    return task


def _products(shared, width: int, columns: int):
    """A task's sums of products of centred vectors, seen along ``columns`` directions; the upper half, row by row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        total = np.zeros((columns, columns))
        for batch in batches:
            for _, rows in _portions(batch, width):
                centred = rows - mean
                seen = centred if directions is None else centred @ directions
                total += seen.T @ seen
        for i in range(columns):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i] * (columns - i), pa.int32()), "j": pa.array(range(i, columns), pa.int32()), "part": total[i, i:]})

    return task


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
    """Of the vectors, or of what they are along the directions; added up by entry, a number of rows that only the width bounds."""
    columns = len(mean) if directions is None else directions.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((mean, directions))
    parts = fit.mapInArrow(_products(shared, len(mean), columns), "i int, j int, part double")
    table = parts.groupBy("i", "j").agg(F.sum("part").alias("total")).toArrow()
    i, j, total = (table[c].to_numpy() for c in ("i", "j", "total"))
    out = np.zeros((columns, columns))
    out[i, j] = total / n
    out[j, i] = out[i, j]
    return out


def train(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``rows`` (x); None without rows.

    Equal vectors meet only after each task has put its own together. A vector that is shorter than the longest has zeros
    behind it and equals the longer one that has them written out. The driver gets width * width numbers.
    """
    fit = written_once(rows.select("x").distinct())
    sizes = fit.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    width = sizes["most"]
    if width is None:
        return None
    if sizes["least"] < width:
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
        fit = written_once(fit.select(filled.alias("x")).distinct())
    total = fit.mapInArrow(_summed(width), "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    total = {r["at"]: int(r["total"]) for r in total.collect()}
    n, sums = total[-1], [total[k] for k in range(width)]
    found = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    variance = _covariance(fit, n, found.mean)
    values, axes = refined(variance)
    found = Whitening(n, sums, values, axes, float(np.trace(variance)))
    scales = found.scales[:, :components]
    scales = scales[:, scales.any(axis=0)]
    if scales.shape[1]:
        found.identity_error = float(np.abs(_covariance(fit, n, found.mean, scales) - np.eye(scales.shape[1])).max())
    return found


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of squares of n * x - S, exact; null where they are beyond 64 bits."""
    most = n * int(np.abs(rows.astype(object)).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 63:
        return pa.array(np.square(n * rows - np.array(sums, np.int64)).sum(axis=1))
    exact = (n * rows.astype(object) - np.array(sums, object)) ** 2
    return pa.array([v if v < 1 << 63 else None for v in map(sum, exact)], pa.int64())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """For every row of ``embeddings`` (vec_id, embedding) that takes part, a row for each component.

    Returns vec_id, component from 1, n, deviation, whitened, explained and identity_error. Rows whose vector is null, holds null or
    non-finite entries, or entries of 2^62 or more after scaling take no part; null and repeated ids do, row by row. There are as many
    components as dimensions, at most ``components``; one without variance cannot be whitened: whitened is null, explained 0.
    A deviation beyond 64 bits is null. Ties between eigenvalues leave their components' order open. An empty table, or empty vectors
    alone, give no rows; other columns are ignored.
    """
    rows = vectors(embeddings, scale)
    found = train(rows, components)
    shared = embeddings.sparkSession.sparkContext.broadcast(found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model is None or not len(model.sums):
            return
        mean, scales, width = model.mean, model.scales[:, :components], len(model.sums)
        k = scales.shape[1]
        lost = ~scales.any(axis=0)
        explained = np.where(lost, 0, np.maximum(model.values[:k], 0) / (model.trace or 1))
        for batch in batches:
            for first, x in _portions(batch, width):
                m = len(x)
                ids = batch.column("vec_id").slice(first, m)
                told = _deviations(x, model.n, model.sums)
                at = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(at)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, model.n), "deviation": told.take(pa.array(at)),
                        "whitened": pa.array(((x - mean) @ scales).ravel(), mask=np.tile(lost, m)), "explained": np.tile(explained, m),
                        "identity_error": pa.array([model.identity_error] * (m * k), pa.float64()),
                    }
                )

    return rows.mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
