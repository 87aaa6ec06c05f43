"""Embedding whitening by matrix-free block Lanczos; the covariance matrix is never formed.

A vector's entries c become whole numbers x = floor(1024 c) + 100000. With n vectors and exact sums S,
the centred row is y = (n x - S) / n, whose numerator is an exact 64-bit number. `Passes.product` maps a
block Q of a few columns to V Q = Y^T (Y Q) / n in one distributed pass: tasks add up blocks of d x b numbers, PARTS
tasks add up those, and the driver adds PARTS of them.

`lanczos` builds an orthonormal basis from such products. Each new block is orthogonalised against
the whole basis twice. Where it has lost rank (an invariant subspace: breakdown), the missing columns start anew
from random ones orthogonal to the basis; so equal eigenvalues are found too. It ends when the residuals
|V u - e u| of all wanted pairs are under TOLERANCE times the largest eigenvalue, or the basis spans the
whole space; a basis of MOST_BASIS columns is cut back to its best Ritz vectors before it goes on.

Memory: a task holds one Arrow batch and blocks of d x b; the driver d x (MOST_BASIS + b) doubles.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped; null and repeated
vec_ids and equal vectors are rows like others; vectors of unequal length are an error, as is a
deviation beyond 64 bits; components without variance (n of 1, equal vectors, fewer dimensions than
components) are left out, as nothing can be divided by 0; equal eigenvalues give some orthonormal
basis of their space; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
TOLERANCE = 1e-14
MOST_BASIS = 256
MOST_PASSES = 500
PARTS = 16
SEED = 42


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """x of the rows of a batch, as (rows, d) whole numbers."""
    column = batch.column("v")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.astype(np.float64).reshape(batch.num_rows, -1)).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """The exact sums of (n x - S)^2 over the dimensions."""
    y = n * x - s
    if y.size and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(1)
    out = [sum(v * v for v in row) for row in y.tolist()]
    if max(out, default=0) >> 63:
        raise OverflowError("a deviation does not fit 64 bits")
    return np.array(out, np.int64)


class Passes:
    """The distributed passes over the vectors of a table."""

    def __init__(self, rows: DataFrame):
        """rows: v (array<double>) and columns to keep, rows without usable vectors already dropped."""
        self.rows = rows
        ship(rows.sparkSession)
        sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        self.n, self.d = sizes["n"], sizes["most"] or 0
        if self.n and sizes["least"] != sizes["most"]:
            raise ValueError(f"vectors of {sizes['least']} to {sizes['most']} entries")
        self.s = self._sum(lambda x: x.sum(0), self.d, np.int64) if self.d else np.zeros(0, np.int64)

    def _sum(self, part: Callable[[np.ndarray], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
        """The sum of part(x) over all batches, in the tasks, then in PARTS tasks, then here."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros(size, kind), 0
            for batch in batches:
                if batch.num_rows:
                    total, some = total + part(_vectors(batch)).ravel(), int(batch.column("at")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([some % PARTS], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, kind)
            for batch in batches:
                for raw in batch.column("total"):
                    total = total + np.frombuffer(raw.as_py(), kind)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

        schema = "part long, total binary"
        sums = self.rows.select("v", F.spark_partition_id().cast("long").alias("at")).mapInArrow(run, schema).repartition(PARTS, "part").mapInArrow(add, schema)
        return sum((np.frombuffer(r["total"], kind) for r in sums.collect()), np.zeros(size, kind))  # PARTS rows

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q of a block of columns."""
        n, s = self.n, self.s

        def part(x: np.ndarray) -> np.ndarray:
            y = (n * x - s) / n
            return y.T @ (y @ q)

        return self._sum(part, q.size).reshape(q.shape) / n

    def trace(self) -> float:
        """The trace of V from the rows' deviations."""
        n, s = self.n, self.s
        return float(self._sum(lambda x: np.array([deviations(x, n, s).astype(float).sum()]), 1)[0]) / n / n / n

    def covariance(self, w: np.ndarray) -> np.ndarray:
        """The covariance of y w, which is centred by its own mean before it is multiplied."""
        n, s, k = self.n, self.s, w.shape[1]
        mean = self._sum(lambda x: ((n * x - s) / n @ w).sum(0), k) / n

        def part(x: np.ndarray) -> np.ndarray:
            z = (n * x - s) / n @ w - mean
            return z.T @ z

        return self._sum(part, k * k).reshape(k, k) / n


def _orthonormal(w: np.ndarray, basis: np.ndarray, columns: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """`columns` orthonormal columns orthogonal to the basis: those that w spans, then fresh random ones."""

    def clear(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        return x

    u, size, _ = np.linalg.svd(clear(w), full_matrices=False)
    out = clear(u[:, size > 1e-12 * max(scale, np.finfo(float).tiny)])
    while True:
        out = np.linalg.qr(out)[0][:, :columns] if out.shape[1] else np.zeros((len(basis), 0))
        out = np.linalg.qr(clear(out))[0] if out.shape[1] else out
        lacking = columns - out.shape[1]
        if not lacking:
            return out
        fresh = clear(rng.standard_normal((len(basis), lacking)))
        for _ in range(2):
            fresh = clear(fresh - out @ (out.T @ fresh))
        out = np.concatenate([out, np.linalg.qr(fresh)[0]], 1)


def lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = COMPONENTS, tolerance: float = TOLERANCE, most: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator of d dimensions.

    A pass takes `block` columns, `wanted` at least: as many random ones meet every copy of a repeated eigenvalue.
    """
    wanted, rng = min(wanted, d), np.random.default_rng(SEED)
    block = min(max(block, wanted), d)
    most = min(d, max(most, wanted + 2 * block))
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q = _orthonormal(np.zeros((d, 0)), basis, block, 1.0, rng)
    for _ in range(MOST_PASSES):
        w = product(q)
        basis, image = np.concatenate([basis, q], 1), np.concatenate([image, w], 1)
        projected = basis.T @ image
        e, u = np.linalg.eigh((projected + projected.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        scale = max(abs(e[0]), abs(e[-1]))
        residual = np.linalg.norm(image @ u[:, :wanted] - basis @ u[:, :wanted] * e[:wanted], axis=0)
        if basis.shape[1] == d or (basis.shape[1] >= wanted + block and (residual <= tolerance * scale).all()):
            return e[:wanted], basis @ u[:, :wanted]
        if basis.shape[1] + block > most and most < d:  # keep the best Ritz vectors and go on from their residuals
            keep = wanted + block
            basis, image, e = basis @ u[:, :keep], image @ u[:, :keep], e[:keep]
            w = image - basis * e
        q = _orthonormal(w, basis, min(block, d - basis.shape[1]), scale, rng)
    raise ArithmeticError(f"no convergence in {MOST_PASSES} passes")


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every usable vector."""
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(df[vec_id].cast("long").alias("vec_id"), df[embedding].cast("array<double>").alias("v")).filter(good)
    passes = Passes(rows)
    n, s = passes.n, passes.s
    e, u = lanczos(passes.product, passes.d, components) if passes.d and n > 1 else (np.zeros(0), np.zeros((passes.d, 0)))
    trace = passes.trace() if len(e) else 0.0
    use = e > max(len(s), 1) * np.finfo(float).eps * (e[0] if len(e) else 1.0)
    e, w = e[use], u[:, use] / np.sqrt(e[use])
    k = len(e)
    error = float(np.abs(passes.covariance(w) - np.eye(k)).max()) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = _vectors(batch)
            z = (n * x - s) / n @ w
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(deviations(x, n, s), k)), pa.array(z.ravel()), pa.array(np.tile(e / trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
