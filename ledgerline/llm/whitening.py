"""Embedding whitening by polarisation covariance.

Vectors become integers, ``x = floor(scale * c) + offset``, and every distinct
integer vector counts once.  Two aggregations over the distinct vectors give
the whole covariance:

1. their number n and the sum S of every dimension;
2. for every dimension, and for the sum of every pair of dimensions, the sum of
   squared centred values.  Values are centred on the integer part of their
   mean; the fraction that is left is corrected exactly, so the numerators
   ``sum((n * z - S_z) ** 2)`` are exact integers at any n.

The variance of a sum holds twice the covariance of its parts, so the
difference ``(var(x_i + x_j) - var(x_i) - var(x_j)) / 2`` recovers every cross
covariance; no product of two dimensions is ever aggregated.  The matrix,
``dims ** 2`` numbers, is assembled on the driver, rounded once to double and
decomposed by ``eigh``.  A third pass over the distinct vectors measures how far
the whitened covariance is from the identity.

Sums leave the tasks as 32-bit limbs of whole numbers, one row per partition
and statistic, so they are exact for any size; per task one Arrow batch and
``dims ** 2`` numbers are held.  The vectors travel packed, in the fewest bytes
per component that hold all of a vector's integers; equal vectors are reduced
before they are shuffled, so a vector that a third of all rows holds is a few
rows.

Edge cases: rows whose vector is null, empty, or holds null or non-finite
entries give nothing; vectors whose length is not the most frequent one (the
shorter of equals) take no part; integers beyond +-2**60 saturate there;
repeated rows and rows with a null id are kept, one result each; directions
without variance (eigenvalue at most 1e-12 of the trace: constant or dependent
dimensions, fewer vectors than dimensions) are no components, so equal vectors
alone, or an empty table, give an empty result; a deviation that no long holds
is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

LIMBS, LIMB_BITS = 7, 32
SATURATED = 1 << 60
MIN_SHARE = 1e-12


def packed(df: DataFrame, id_col: str, vec_col: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, dims, width, x): the integer vectors, less ``offset``, as bytes."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.size(v) > 0).where(
        F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            with np.errstate(over="ignore"):
                x = np.floor(col.flatten().to_numpy() * scale)
            x = np.clip(x, -SATURATED - offset, SATURATED - offset).astype(np.int64)
            size = np.where(x < 0, ~x, x)
            need = np.select([size < 1 << 7, size < 1 << 15, size < 1 << 31], [1, 2, 4], 8)
            width = np.maximum.reduceat(need, ends[:-1]) if len(batch) else need
            forms = {w: x.astype(f"<i{w}") for w in set(width.tolist())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(width, pa.int32()),
                 pa.array([forms[w][a:b].tobytes() for w, a, b in zip(width.tolist(), ends[:-1].tolist(), ends[1:].tolist())],
                          pa.binary())], names=["vec_id", "dims", "width", "x"])

    return rows.mapInArrow(run, "vec_id long, dims int, width int, x binary")


def matrices(batch: pa.RecordBatch, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their integer vectors) of a batch, by byte width."""
    width = batch.column(batch.schema.get_field_index("width")).to_numpy(zero_copy_only=False)
    x = batch.column(batch.schema.get_field_index("x"))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw = b"".join(x.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(raw, f"<i{w}").reshape(len(rows), -1).astype(np.int64) + offset


def exact_totals(frame: DataFrame, offset: int, values: Callable[[np.ndarray], list]) -> list[int]:
    """Sum over all rows of ``values(matrix)``, lists of whole numbers of any size."""
    mask = (1 << LIMB_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            for _, x in matrices(batch, offset):
                part = values(x)
                total = [a + int(b) for a, b in zip(total or [0] * len(part), part)]
        limbs = [[t >> LIMB_BITS * k & mask for t in total] for k in range(LIMBS - 1)]
        limbs.append([t >> LIMB_BITS * (LIMBS - 1) for t in total])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), *(pa.array(v, pa.int64()) for v in limbs)],
            names=["at", *(f"l{k}" for k in range(LIMBS))])

    names = [f"l{k}" for k in range(LIMBS)]
    rows = (frame.select("width", "x").mapInArrow(run, "at int, " + ", ".join(f"{c} long" for c in names))
            .groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).orderBy("at").collect())
    return [sum(r[c] << LIMB_BITS * k for k, c in enumerate(names)) for r in rows]


def column_sums(x: np.ndarray) -> list:
    if np.abs(x).max(initial=0) < (1 << 62) // max(1, len(x)):
        return [len(x), *x.sum(axis=0).tolist()]
    return [len(x), *x.astype(object).sum(axis=0).tolist()]


def squared_sums(centre: list[int]) -> Callable[[np.ndarray], list]:
    """Sums of squares of every centred dimension, then of every pair's sum."""
    def values(x: np.ndarray) -> list:
        y = x - np.array(centre, np.int64)
        dims = y.shape[1]
        reach = 2 * int(np.abs(y).max(initial=0))
        if reach * reach * max(1, len(y)) >= 1 << 63:
            y = y.astype(object)
        out = (y * y).sum(axis=0).tolist()
        for i in range(dims - 1):
            z = y[:, i:i + 1] + y[:, i + 1:]
            out += (z * z).sum(axis=0).tolist()
        return out

    return values


def polarised(n: int, rest: list[int], squares: list[int]) -> list[list[int]]:
    """Exact covariances times n cubed.

    ``rest``: the sums of the centred values; ``squares`` as ``squared_sums``
    gives them.
    """
    dims = len(rest)
    numerator = lambda square, left: n * (n * square - left * left)  # noqa: E731  sum((n z - left)^2)
    alone = [numerator(squares[i], rest[i]) for i in range(dims)]
    cov = [[0] * dims for _ in range(dims)]
    at = dims
    for i in range(dims):
        cov[i][i] = alone[i]
        for j in range(i + 1, dims):
            cov[i][j] = cov[j][i] = (numerator(squares[at], rest[i] + rest[j]) - alone[i] - alone[j]) // 2
            at += 1
    return cov


@dataclass
class Whitening:
    """Centre (exact: sums over n) and components of the fitted vectors."""
    n: int
    sums: list[int]
    offset: int
    eigenvalues: np.ndarray      # falling, those with variance only
    components: np.ndarray       # dims x components
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - part) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S) ** 2) per row, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        left = np.array([s % self.n for s in self.sums], np.int64)
        y = x - whole
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n ** 2 * self.dims < 1 << 63:
            return ((self.n * y - left) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - left.astype(object)) ** 2).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in exact]


def fit(distinct: DataFrame, offset: int, n_components: int) -> Whitening | None:
    """The whitening of distinct packed vectors of one length; None without variance."""
    totals = exact_totals(distinct, offset, column_sums)
    if not totals:
        return None
    n, sums = totals[0], totals[1:]
    centre = [s // n for s in sums]
    cov = polarised(n, [s - n * m for s, m in zip(sums, centre)],
                    exact_totals(distinct, offset, squared_sums(centre)))
    trace = sum(cov[i][i] for i in range(len(sums)))
    if trace == 0:
        return None
    # a true quotient of whole numbers is rounded once
    values, vectors = np.linalg.eigh(np.array([[c / n ** 3 for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(n_components, int((values > MIN_SHARE * float(Fraction(trace, n ** 3))).sum()))
    model = Whitening(n, sums, offset, values[:keep].copy(), vectors[:, :keep].copy(),
                      values[:keep] / float(Fraction(trace, n ** 3)))
    model.identity_error = identity_error(distinct, model)
    return model


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened covariance less the identity."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in matrices(batch, model.offset):
                w = model.project(x)
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())],
                                         names=["at", "part"])

    rows = (distinct.select("width", "x").mapInArrow(run, "at int, part double")
            .groupBy("at").agg(F.sum("part").alias("part")).orderBy("at").collect())
    total = np.array([r.part for r in rows]).reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0,
           offset: int = 1_000_000, n_components: int = 16) -> DataFrame:
    """One row per kept row and component: (vec_id, component, n, deviation,
    whitened, explained, identity_error)."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = stored(packed(df, id_col, vec_col, scale, offset))
    length = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if length is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.col("dims") == length.dims).select("vec_id", "width", "x")
    model = fit(stored(rows.select("width", "x").distinct()), offset, n_components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.eigenvalues)
        for batch in batches:
            for at, x in matrices(batch, offset):
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(ids), model.n)),
                     pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                     pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(at))),
                     pa.array(np.full(len(ids), model.identity_error))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)
