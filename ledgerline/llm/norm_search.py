"""Exact top-k inner products over norm-sorted vectors.

Vectors are turned to integers, ``floor(scale * x)``, and rotated by the
eigenvectors of their Gram matrix (a singular value decomposition of all
vectors), which moves most of the length into the first components and keeps
inner products.  Items are cut into bands of falling length, each of one or
more blocks, and a query visits only the bands whose longest item can reach its
k-th best score so far.  Inside a block items are processed by descending length, a chunk at a time: a whole chunk is
left out for a query when (query length) x (longest item) cannot reach the
query's k-th best score; otherwise partial sums over the first components plus
the Cauchy-Schwarz bound of the residuals prune pairs step by step, and only
the survivors get the exact integer product.  Each query starts from the k-th
best score among the ``seed_rows`` longest items (a bounded table).

Edge cases: as in ``vectors.valid_vectors``, but zero vectors take part; an
empty table or no query gives an empty result; equal scores go by the smaller
id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import vectors as V


class Best:
    """The k highest (score, smaller id) of every query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * queries
        self.floor = floor  # a score below cannot be among the k best

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((i, -s))[:self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(s[order[-1]]))


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int,
         floor: np.ndarray, chunk: int, steps: tuple[int, ...]) -> Best:
    """Exact search of integer queries in integer items, both as float64."""
    best = Best(len(q), k, floor.astype(float).copy())
    length = np.sqrt((x * x).sum(axis=1))
    order = np.lexsort((ids, -length))
    ids, x, length = ids[order], x[order], length[order]
    rx, rq = x @ rotation, q @ rotation
    q_length = np.sqrt((q * q).sum(axis=1))
    steps = tuple(h for h in steps if h < q.shape[1])
    left_x = {h: np.sqrt((rx[:, h:] ** 2).sum(axis=1)) for h in steps}
    left_q = {h: np.sqrt((rq[:, h:] ** 2).sum(axis=1)) for h in steps}
    for a in range(0, len(ids), chunk):
        b = min(len(ids), a + chunk)
        # rounding of the rotated sums: far below one unit of the score
        slack = 1e-9 * q_length * length[a] + 1e-6
        live = np.flatnonzero(q_length * length[a] + slack >= best.floor)
        if not len(live):
            break  # later items are shorter still
        qi, xi, partial, done = None, None, None, 0
        for h in steps:
            if qi is None:
                part = rq[live, :h] @ rx[a:b, :h].T
                bound = part + left_q[h][live, None] * left_x[h][None, a:b] + slack[live, None]
                r, c = np.nonzero(bound >= best.floor[live, None])
                qi, xi, partial = live[r], c + a, part[r, c]
            else:
                partial = partial + V.row_products(rq[qi, done:h], rx[xi, done:h])
                keep = partial + left_q[h][qi] * left_x[h][xi] + slack[qi] >= best.floor[qi]
                qi, xi, partial = qi[keep], xi[keep], partial[keep]
            done = h
        if qi is None:
            qi, xi = (m.ravel() for m in np.meshgrid(live, np.arange(a, b), indexing="ij"))
        other = ids[xi] != q_ids[qi]
        qi, xi = qi[other], xi[other]
        # products of integers below 2**53: exact in double precision
        score = V.row_products(q[qi], x[xi]).astype(np.int64)
        edge = np.searchsorted(qi, np.arange(len(q) + 1))
        for n in np.unique(qi):
            best.add(n, score[edge[n]:edge[n + 1]], ids[xi[edge[n]:edge[n + 1]]])
    return best


def rotation_of(items: DataFrame) -> np.ndarray:
    """Eigenvectors of the Gram matrix, strongest first; its dims**2 cells are
    all that reaches the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = V.matrix(pa.Table.from_batches([batch]))
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())],
                                             names=["cell", "value"])

    got = items.select("v").mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect()
    if not got:
        return np.eye(1)
    gram = np.zeros(len(got))
    for cell, value in got:
        gram[cell] = value
    size = int(round(len(got) ** 0.5))
    _, vectors = np.linalg.eigh(gram.reshape(size, size))
    return np.ascontiguousarray(vectors[:, ::-1])


@dataclass
class Bands:
    """Bands of falling length and the blocks that they are dealt into."""

    cuts: np.ndarray  # ascending lengths between the bands
    longest: np.ndarray  # longest item of every band, falling
    first: np.ndarray  # first block of every band, and the end

    def band(self, norm: np.ndarray) -> np.ndarray:
        return len(self.cuts) - np.searchsorted(self.cuts, norm, side="right")

    def block(self, norm: np.ndarray, h: np.ndarray) -> np.ndarray:
        band = self.band(norm)
        parts = self.first[band + 1] - self.first[band]
        return (self.first[band] + h % np.maximum(parts, 1)).astype(np.int32)

    def reach(self, length: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many blocks, from the first, may hold a score of ``floor`` or more."""
        bound = np.where(length > 0, (floor - 1e-6) / np.maximum(length, 1e-300), -np.inf) * (1 - 1e-9) - 1e-9
        bands = np.searchsorted(-self.longest, -bound, side="right")
        return self.first[bands].astype(np.int32)


def bands_of(items: DataFrame, blocks: int, block_rows: int, max_bands: int) -> Bands:
    """At most ``max_bands`` bands of similar size; a band of more rows than a
    block holds (many blocks in all, or one length shared by many rows) is
    several blocks, so what the driver holds does not grow with the items."""
    wanted = min(blocks, max_bands)
    cuts = items.agg(F.percentile_approx("norm", [i / wanted for i in range(1, wanted)], 10_000)).first()[0] \
        if wanted > 1 else []
    edges = Bands(np.unique(np.array(cuts or [], float)), np.empty(0), np.empty(0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column(0).to_numpy()
            band = edges.band(norm)
            count = np.bincount(band, minlength=len(edges.cuts) + 1)
            longest = np.zeros(len(count))
            np.maximum.at(longest, band, norm)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.flatnonzero(count)), pa.array(count[count > 0]), pa.array(longest[count > 0])],
                names=["band", "n", "longest"])

    count, longest = np.zeros(len(edges.cuts) + 1, np.int64), np.zeros(len(edges.cuts) + 1)
    for band, n, length in (items.select("norm").mapInArrow(measure, "band long, n long, longest double")
                            .groupBy("band").agg(F.sum("n"), F.max("longest")).collect()):
        count[band], longest[band] = n, length
    # an empty band reaches as far as the next one
    longest = np.maximum.accumulate(longest[::-1])[::-1]
    return Bands(edges.cuts, longest, np.concatenate([[0], np.cumsum(-(-count // block_rows))]))


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
           vec_col: str = "embedding", block_rows: int = 8192, query_rows: int = 2048, seed_rows: int = 1024,
           max_bands: int = 1024, chunk: int = 512, steps: tuple[int, ...] = (16, 32)) -> DataFrame:
    """(query_id, rank, vec_id, score) with integer scores."""
    items = V.valid_vectors(df, id_col, vec_col, zero_ok=True)
    # written once: the statistics, the rotation, the seeds and the blocks read the copy
    items = stored(items.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"),
                                F.coalesce(is_query, F.lit(False)).alias("_is_query")).dropDuplicates(["vec_id", "v"])
                   .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))))
    stats = items.agg(F.count("*").alias("n"), F.sum(F.col("_is_query").cast("int")).alias("q")).first()
    rotation = rotation_of(items)
    bands = bands_of(items, -(-stats.n // block_rows), block_rows, max_bands)
    seeds = items.orderBy(F.desc("norm"), "vec_id").limit(seed_rows).select("vec_id", "v").toArrow()
    seed_ids, seed = seeds["vec_id"].to_numpy(), V.matrix(seeds)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = V.matrix(pa.Table.from_batches([batch]))
            if len(q):
                got = scan(batch.column(0).to_numpy(), q, seed_ids, seed, rotation, k,
                           np.full(len(q), -np.inf), chunk, steps)
                reach = pa.array(bands.reach(np.sqrt((q * q).sum(axis=1)), got.floor))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.floor), reach],
                                                 names=["vec_id", "v", "floor", "reach"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = bands.block(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)],
                                             names=["vec_id", "v", "block"])

    def best(key, queries, members):
        out: list[list] = [[], [], []]
        if len(queries) and len(members):
            q_ids = queries["vec_id"].to_numpy()
            got = scan(q_ids, V.matrix(queries), members["vec_id"].to_numpy(), V.matrix(members), rotation, k,
                       queries["floor"].to_numpy(), chunk, steps)
            for n, q_id in enumerate(q_ids.tolist()):
                out[0] += [q_id] * len(got.ids[n])
                out[1] += got.ids[n].tolist()
                out[2] += got.scores[n].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out)})

    queries = items.where("_is_query").select("vec_id", "v").mapInArrow(
        start, "vec_id long, v array<double>, floor double, reach int")
    members = items.select("vec_id", "v", "norm", F.xxhash64("vec_id").alias("h")).mapInArrow(
        place, "vec_id long, v array<double>, block int")
    found = V.blocked(queries, members, F.col("block"), F.col("reach"), max(1, -(-(stats.q or 0) // query_rows)),
                      best, "query_id long, vec_id long, score long")
    return V.merged(found, k)
