"""Embedding whitening by cyclic Jacobi rotations (operator 12).

Each entry c of a vector becomes the integer x = floor(64 * c) + 1000000. The fit list holds each distinct x vector once.
Its number of rows n and its sums S are exact integers; the scatter of the differences (n * x - S) / n is summed in
tasks, then over groups of tasks, so the driver gets a fixed number of small matrices whatever the size of the table. The driver
turns the covariance by Jacobi rotations, row by row over all pairs, until the entries beside the diagonal vanish. Each
rotation is orthogonal and small entries keep their own relative error, so small eigenvalues come out as accurately as the large ones.
The sorted whitening matrix goes to the executors (width x components numbers), where all rows are projected.

Defined results: a vector that is null or holds a null or non-finite entry takes no part; vectors of unequal length end in
zeros up to the longest one; an entry of 64 * c beyond 2 ** 52 counts as that; a null vec_id is kept; repeated rows give repeated results
(the fit list has them once); an empty table, or one of empty vectors, gives no rows. A component without variance (its eigenvalue
is at most ``width * 2 ** -52`` of the greatest) has no whitening and is left out, so a table of one distinct vector gives no
rows. A deviation beyond the range of a long is held at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, in_small_batches, materialise

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
_FAR, _MOST = float(1 << 52), 2**63 - 1
#: Groups of tasks whose matrices are added up before the driver gets them.
_GROUPS = 32


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """vec_id and x of the rows that take part, and the width that all x have."""
    given = vectors.filter(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    width = given.agg(F.max(F.size("v"))).first()[0] or 0
    held = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-_FAR)), F.lit(_FAR))) + F.lit(shift).cast("long"))
    padded = F.concat(held, F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("v")))
    return given.select("vec_id", padded.alias("x")), width


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold it, Python's otherwise."""
    if max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // n + 1) * n * 2 < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _difference(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the exact integers, rounded once."""
    d = _centred(x, n, sums)
    return d / n if d.dtype != object else np.array([[int(e) / n for e in row] for row in d], float).reshape(d.shape)


def count_and_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            low, high = x & 0xFFFFFFFF, x >> 32  # sums of halves stay within 64 bits
            sums = sums + low.sum(0).astype(object) + high.sum(0).astype(object) * (1 << 32)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, width), pa.int32()), "total": pa.array([str(s) for s in (n, *sums)])})

    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found = {r["at"]: int(r["total"]) for r in fit.mapInArrow(add, "at int, total string").groupBy("at").agg(total).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def scatter(rows: DataFrame, turn, size: int) -> np.ndarray:
    """Sum over the rows of ``rows`` of y y', where ``turn`` makes the rows y of a batch."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size))
        for batch in batches:
            y = turn(batch)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "m": [total.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_py()).reshape(size, size)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = rows.mapInArrow(own, "part int, m binary").repartition(_GROUPS, F.col("part") % _GROUPS)
    return sum((np.frombuffer(r["m"]).reshape(size, size) for r in parts.mapInArrow(added, "m binary").collect()), np.zeros((size, size)))


def jacobi(symmetric: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (as columns) of a symmetric matrix, by cyclic rotations."""
    a, v = np.array(symmetric, float), np.eye(len(symmetric))
    for _ in range(sweeps):
        turned = False
        for p, q in zip(*np.triu_indices(len(a), 1)):
            # an entry has vanished once it is below the rounding of both its diagonal entries
            if abs(a[p, q]) > 2.0**-54 * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s, h, app, aqq = t * c, t * a[p, q], a[p, p], a[q, q]
                ap, aq = a[p] * c - a[q] * s, a[p] * s + a[q] * c
                a[p], a[:, p], a[q], a[:, q] = ap, ap, aq, aq
                a[p, p], a[q, q], a[p, q], a[q, p] = app - h, aqq + h, 0.0, 0.0
                v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
        if not turned:
            break
    return np.diag(a).copy(), v


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows, width = integers(vectors, id_col, vector_col, scale, shift)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], out)
    if not width:
        return nothing
    fit = materialise(rows.select("x").distinct(), "fit")
    n, sums = count_and_sums(fit, width)
    covariance = scatter(fit, lambda batch: _difference(_matrix(batch, width), n, sums), width) / n
    values, axes = jacobi((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0) * width * 2.0**-52]
    if not len(order):
        return nothing
    axes, root, share = np.ascontiguousarray(axes[:, order]), np.sqrt(values[order]), values[order] / np.trace(covariance)
    k = len(order)

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return (_difference(_matrix(batch, width), n, sums) @ axes) / root

    error = float(np.abs(scatter(fit, project, k) / n - np.eye(k)).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _centred(_matrix(batch, width), n, sums)
            if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * width >= 2.0**62:
                d = d.astype(object)
            deviation = [min(int(e), _MOST) for e in (d * d).sum(1)]
            at = np.repeat(np.arange(len(d)), k)
            columns = [batch.column("vec_id").take(pa.array(at)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(d)), np.full(len(at), n), np.array(deviation, np.int64)[at]]
            columns += [project(batch).ravel(), np.tile(share, len(d)), np.full(len(at), error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in out.split(", ")])

    return in_small_batches(rows).mapInArrow(emit, out)
