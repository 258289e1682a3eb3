"""Approximate nearest neighbours: multi-probe p-stable hashing.

Largest inner product is turned into smallest Euclidean distance by one more
component (items scaled into the unit ball, queries to unit length).  Each of
``tables`` hash tables cuts ``width`` wide cells along ``hashes`` Gaussian
directions.  A query visits its own cell and then perturbed ones: a template
of perturbation sets, ordered by the expected squared distance of their cell
borders, is applied to the query's own order of border distances, so cells
come by estimated success.  The members of all visited cells of all tables
are merged and ranked by the exact inner product of the original vectors.

The index is split by a hash of the id into blocks of about ``block_rows``
items; every item is indexed, each block holds all tables for its items, and
copies of one vector share one entry.  Nothing is fitted on a sample.

``PRODUCTION`` is set for recall: the given vectors are close to uniform on
the sphere (a query's 20th neighbour has a cosine of about 0.35), where few
cells hold few neighbours; measured recall is in the README.

Edge cases: see ``vectors.valid_vectors``; an empty table or no query gives an
empty result; equal scores go by the smaller id; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

PRODUCTION = {"hashes": 4, "width": 1.0, "tables": 12, "probes": 48}


def probe_template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets as ranks of border distances, likeliest first.

    Rank j stands for the j-th nearest of the 2 * hashes cell borders; the
    expected square of its distance is known in closed form.  A set may not
    hold both borders of one direction (ranks j and 2 * hashes - 1 - j).
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    far = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)),
                    1 - far / (m + 1) + far * (far + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return out


class Tables:
    """Directions and offsets of all tables, the same in every task."""

    def __init__(self, dims: int, hashes: int, width: float, tables: int, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, self.hashes = width, hashes
        self.directions = rng.normal(size=(tables, dims, hashes))
        self.offsets = rng.uniform(0, width, size=(tables, hashes))
        self.mixers = rng.integers(1, 1 << 40, size=(tables, hashes)) * 2 + 1
        self.template = probe_template(hashes, probes)

    def cells(self, t: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions[t] + self.offsets[t]) / self.width

    def keys(self, t: int, x: np.ndarray) -> np.ndarray:
        return (np.floor(self.cells(t, x)).astype(np.int64) * self.mixers[t]).sum(axis=1)

    def probes(self, t: int, x: np.ndarray):
        """Keys of every query's cells, in the order of the template."""
        place = self.cells(t, x)
        cell = np.floor(place).astype(np.int64)
        below = place - cell
        order = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
        rows = np.arange(len(x))
        for ranks in self.template:
            at = cell.copy()
            for r in ranks:
                border = order[:, r]
                at[rows, border % self.hashes] += np.where(border < self.hashes, -1, 1)
            yield (at * self.mixers[t]).sum(axis=1)


def candidates(tables: Tables, items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Boolean matrix query x item of the merged table candidates."""
    out = np.zeros((len(queries), len(items)), bool)
    for t in range(len(tables.directions)):
        keys = tables.keys(t, items)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for probe in tables.probes(t, queries):
            lo, hi = np.searchsorted(keys, probe), np.searchsorted(keys, probe, "right")
            for q in np.flatnonzero(hi > lo):
                out[q, order[lo[q]:hi[q]]] = True
    return out


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           block_rows: int = 8192, query_rows: int = 4096, **options) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found."""
    options = PRODUCTION | options
    items = V.valid_vectors(df, id_col, vec_col, zero_ok=False).withColumn("_is_query", F.coalesce(is_query, F.lit(False)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = items.agg(F.count("*").alias("n"), F.sum(F.col("_is_query").cast("int")).alias("q"),
                      F.max(norm).alias("longest")).first()
    longest = stats.longest or 1.0

    def nearest(key, queries, members):
        got: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(members):
            q, x = V.matrix(queries), V.matrix(members)
            q_ids, ids = queries["vec_id"].to_numpy(), members["vec_id"].to_numpy()
            # copies share an entry; their ids stay, smallest first
            order = np.argsort(ids, kind="stable")
            _, first, which = np.unique(x[order].view(f"V{x.shape[1] * 8}").ravel(), return_index=True,
                                        return_inverse=True)
            ids, distinct = ids[order], x[order][first]
            by_entry = np.argsort(which, kind="stable")
            edge = np.searchsorted(which[by_entry], np.arange(len(first) + 1))
            tables = Tables(x.shape[1] + 1, **options)
            unit = distinct / longest
            rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
            unit = np.concatenate([unit, rest[:, None]], axis=1)
            asks = np.concatenate([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1)
            for a in range(0, len(q), 128):
                found = candidates(tables, unit, asks[a:a + 128])
                rough = np.where(found, q[a:a + 128] @ distinct.T, -np.inf)
                # a query's own id may take one place of its entry
                best = np.argpartition(-rough, min(k, rough.shape[1] - 1), axis=1)[:, :k + 1]
                for i, entries in enumerate(best):
                    entries = entries[found[i, entries]]
                    exact = V.row_products(np.broadcast_to(q[a + i], (len(entries), q.shape[1])), distinct[entries])
                    rows = []
                    for e, s in zip(entries.tolist(), exact.tolist()):
                        own = ids[by_entry[edge[e]:min(edge[e + 1], edge[e] + k + 1)]].tolist()
                        rows += [(-s, v) for v in own if v != q_ids[a + i]][:k]
                    for s, v in sorted(rows)[:k]:
                        got["query_id"].append(int(q_ids[a + i]))
                        got["vec_id"].append(v)
                        got["score"].append(-s)
        return pa.table({"query_id": pa.array(got["query_id"], pa.int64()),
                         "vec_id": pa.array(got["vec_id"], pa.int64()),
                         "score": pa.array(got["score"], pa.float64())})

    blocks = max(1, -(-stats.n // block_rows))
    items = items.dropDuplicates(["vec_id", "v"])
    found = V.blocked(items.where("_is_query").select("vec_id", "v"), items.select("vec_id", "v"),
                      F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), blocks,
                      max(1, -(-(stats.q or 0) // query_rows)), nearest, "query_id long, vec_id long, score double")
    return V.merged(found, k)
