"""The pruned scorers of the knowledge search (X8) over one block of store rows.

A row is a bag of buckets; its vector holds their counts.  Many queries are
answered together (:meth:`Postings.top_all`): rows that share their heaviest
buckets are put into groups of ``GROUP_ROWS``, and a group keeps the largest
weight (count / norm) of any of its rows for every bucket.  A matrix product of
queries and groups bounds the score of all rows of a group; the exact scores of
the likeliest groups give a floor, and only groups whose bound reaches it are
opened, each with one exact matrix product for all queries that ask for it.

One query, or vectors too wide for dense groups, go by posting lists with
per-list maxima (:meth:`Postings.top`).  For every bucket a list names the rows that hold it, with the largest weight (count / norm) of any
of them.  A query walks its lists by falling bound (own weight times the list's
largest).  What the lists not yet walked can add at most is their summed bound:
once that lies under the k-th best score so far, no unseen row can enter, and
rows seen whose partial score plus that sum lies under it are dropped too.  The
others get their exact integer product.  The test leaves room for scores that
are rounded to four digits, so ties in the rounded score are all kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

UNIT = 1.01e-4  # two scores this far apart differ after rounding
SLACK = 1e-4  # more than single precision loses of a bound up to one
GROUP_ROWS = 32
HEAVIEST = 7  # buckets by which rows are put side by side
LIKELIEST = 6  # groups that give a query's floor, besides those that k rows fill
DENSE_DIM = 4096
QUERIES = 1024  # queries whose bounds are held at once
ROUND = 8  # of them that open groups together
OPENED = 1 << 22  # (query, group) pairs, and rows found, that are held at once
SHORT = 4096  # longer lists do not raise the floor: testing all their rows costs more than it saves


def bags(buckets) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every token of a column of bucket lists (null: none)."""
    rows = [np.asarray(b, np.int64) if b is not None else np.empty(0, np.int64) for b in buckets]
    return np.repeat(np.arange(len(rows)), [len(b) for b in rows]), np.concatenate([*rows, np.empty(0, np.int64)])


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of every query: by the score of four digits, then in row order."""
    order = np.lexsort((row, -np.floor(score * 1e4 + 0.5), query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))[:len(query)]
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    best = rank < k
    return query[best], row[best], score[best]


class Postings:
    def __init__(self, buckets, dim: int):
        """``buckets``: a bucket list per row, or (number of rows, row, bucket) of every token."""
        self.n, self.dim = (buckets[0] if isinstance(buckets, tuple) else len(buckets)), dim
        row, bucket = buckets[1:] if isinstance(buckets, tuple) else bags(buckets)
        entry, count = np.unique(row * dim + bucket, return_counts=True)
        row, self.bucket, self.count = entry // dim, entry % dim, count
        self.norm = np.sqrt(np.bincount(row, count * count, self.n))
        self.row_at = np.searchsorted(row, np.arange(self.n + 1))
        order = np.argsort(self.bucket, kind="stable")
        self.list_row, self.list_count = row[order], count[order]
        self.list_at = np.searchsorted(self.bucket[order], np.arange(dim + 1))
        self.largest = np.zeros(dim)
        np.maximum.at(self.largest, self.bucket, count / self.norm[row])
        self.walked = self.held = 0  # postings walked, postings of the queries' buckets
        self.opened = 0  # groups whose rows were scored, over all queries

    def _products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact products of some rows with a dense query."""
        n = self.row_at[rows + 1] - self.row_at[rows]
        at = np.repeat(self.row_at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(np.arange(len(rows)), n), query[self.bucket[at]] * self.count[at], len(rows))

    def top(self, buckets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores): all rows that may be among the query's k best."""
        first = np.arange(min(k, self.n))  # rows without a common bucket tie in store order
        query = np.bincount(buckets, minlength=self.dim)
        length = np.sqrt((query * query).sum())
        if not length:
            return first, np.zeros(len(first))
        own = np.flatnonzero(query)
        bound = query[own] / length * self.largest[own]
        order = np.argsort(-bound, kind="stable")
        own, bound = own[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        size = self.list_at[own + 1] - self.list_at[own]
        self.held += int(size.sum())
        dot, floor, done = np.zeros(self.n), 0.0, len(own)
        for i, b in enumerate(own):
            if rest[i] < floor - UNIT:
                done = i
                break
            a, z = self.list_at[b], self.list_at[b + 1]
            rows = self.list_row[a:z]
            dot[rows] += query[b] * self.list_count[a:z]
            if k <= len(rows) <= SHORT or i == 0:
                partial = dot[rows] / (length * self.norm[rows])
                if len(rows) >= k:
                    floor = max(floor, np.partition(partial, len(rows) - k)[len(rows) - k])
        self.walked += int(size[:done].sum())
        rows = np.flatnonzero(dot)
        rows = rows[dot[rows] / (length * self.norm[rows]) + rest[done] >= floor - UNIT]
        if floor < UNIT:
            rows = np.union1d(rows, first)
        product = self._products(rows, query) if done < len(own) else dot[rows]
        norm = self.norm[rows]
        return rows, np.where(norm > 0, product / (length * np.where(norm > 0, norm, 1.0)), 0.0)

    def _grouped(self) -> None:
        """Rows side by side that share their heaviest buckets, and every group's largest weights."""
        entry_row = np.repeat(np.arange(self.n), np.diff(self.row_at))
        heavy = np.lexsort((self.bucket, -self.count, entry_row))
        rank = np.arange(len(heavy)) - self.row_at[entry_row]
        lead = np.full((HEAVIEST, self.n), -1, np.int32)
        told = np.flatnonzero(rank < HEAVIEST)
        lead[rank[told], entry_row[told]] = self.bucket[heavy[told]]
        self.order = np.lexsort(lead[::-1])
        group = np.empty(self.n, np.int64)
        group[self.order] = np.arange(self.n) // GROUP_ROWS
        self.groups = -(-self.n // GROUP_ROWS)
        largest = np.zeros(self.groups * self.dim, np.float32)
        weight = (self.count / self.norm[entry_row]).astype(np.float32)
        np.maximum.at(largest, group[entry_row] * self.dim + self.bucket, weight)
        self.group_largest = largest.reshape(self.groups, self.dim)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the rows, position) of the buckets of some rows."""
        n = self.row_at[rows + 1] - self.row_at[rows]
        return np.repeat(np.arange(len(rows)), n), np.repeat(self.row_at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _open(self, dense: np.ndarray, length: np.ndarray, least: np.ndarray, query: np.ndarray, group: np.ndarray
              ) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, row, score) of the rows of the groups asked for that reach their query's least score."""
        order = np.argsort(group, kind="stable")
        query, group = query[order], group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        exact = np.float32 if length.max(initial=0.0) * self.norm.max(initial=0.0) < 2 ** 24 else np.float64
        dense = dense.astype(exact, copy=False)
        for a, b in zip(first, np.append(first[1:], len(group))):
            rows = self.order[group[a] * GROUP_ROWS:(group[a] + 1) * GROUP_ROWS]
            which, at = self._entries(rows)
            held = np.zeros((self.dim, len(rows)), exact)
            held[self.bucket[at], which] = self.count[at]
            asked = query[a:b]
            product = dense[asked] @ held
            norm = self.norm[rows]
            score = product / (length[asked, None] * np.where(norm > 0, norm, 1.0))
            i, j = np.nonzero((score >= least[asked, None]) & (product > 0))
            yield asked[i], rows[j], score[i, j]

    def top_all(self, n: int, row: np.ndarray, bucket: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, row, score): the k best rows of ``n`` queries, given the query and bucket of every token in order.

        The same as :meth:`top` of each, cut to k.
        """
        if not self.n:
            return
        if self.dim > DENSE_DIM:
            at = np.searchsorted(row, np.arange(n + 1))
            for i in range(n):
                rows, scores = self.top(bucket[at[i]:at[i + 1]], k)
                yield best_of(np.full(len(rows), i), rows, scores, k)
            return
        self._grouped()
        for start in range(0, n, QUERIES * ROUND):
            yield from self._round(start, min(n, start + QUERIES * ROUND), row, bucket, k)

    def _round(self, start: int, stop: int, row: np.ndarray, bucket: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        a, b = np.searchsorted(row, (start, stop))
        dense = np.bincount((row[a:b] - start) * self.dim + bucket[a:b], minlength=(stop - start) * self.dim)
        dense = dense.reshape(-1, self.dim).astype(np.float64)
        length = np.sqrt((dense * dense).sum(axis=1))
        weight = (dense / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
        if length.max() < 2 ** 24:
            dense = dense.astype(np.float32)
        lead = min(self.groups, LIKELIEST + -(-k // GROUP_ROWS))  # hold k rows or all
        least = np.zeros(len(length))
        found: list[tuple] = []
        pairs: list[tuple] = []
        opened = held = 0
        for s in range(0, len(length), QUERIES):
            z = min(s + QUERIES, len(length))
            bound = weight[s:z] @ self.group_largest.T
            likely = np.argpartition(-bound, lead - 1, axis=1)[:, :lead]
            place = (likely[:, :, None] * GROUP_ROWS + np.arange(GROUP_ROWS)).reshape(z - s, -1)
            there = place < self.n
            rows = self.order[np.minimum(place, self.n - 1)]
            which, at = self._entries(rows.ravel())
            product = np.bincount(which, dense[s + which // rows.shape[1], self.bucket[at]].astype(float) * self.count[at], rows.size)
            norm = self.norm[rows]
            score = np.where(there, product.reshape(rows.shape) / (np.where(length > 0, length, 1.0)[s:z, None]
                                                                  * np.where(norm > 0, norm, 1.0)), -1.0)
            floor = np.partition(score, -k, axis=1)[:, -k] if k <= score.shape[1] else np.zeros(z - s)
            least[s:z] = np.maximum(floor, 0.0) - UNIT
            near = np.flatnonzero(floor < UNIT)
            if len(near):  # rows without a common bucket tie in row order
                first = np.arange(min(k, self.n))
                i = np.repeat(near, len(first))
                j = np.tile(first, len(near))
                which, at = self._entries(j)
                product = np.bincount(which, dense[s + i[which], self.bucket[at]].astype(float) * self.count[at], len(j))
                blank = product == 0  # the others are found in their groups
                found.append((s + i[blank], j[blank], product[blank]))
            i, j = np.nonzero(bound >= np.maximum(least[s:z] - SLACK, 1e-30)[:, None])
            pairs.append((s + i, j))
            opened += len(i)
            if opened < OPENED and z < len(length):
                continue
            for part in self._open(dense, length, least, *map(np.concatenate, zip(*pairs))):
                found.append(part)
                held += len(part[0])
                if held >= OPENED:
                    found = [best_of(*map(np.concatenate, zip(*found)), k)]
                    held = len(found[0][0])
            self.opened += opened
            pairs, opened = [], 0
        query, rows, scores = best_of(*map(np.concatenate, zip(*found)), k)
        yield start + query, rows, scores
