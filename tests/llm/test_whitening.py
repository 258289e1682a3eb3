"""Whitening against a plain exact statement of its rules."""
from fractions import Fraction

import numpy as np

from conftest import SF_SMALL
from ledgerline.llm import queries, whitening


def plain(rows, k):
    """vec_id rows -> exact sums, deviations and numpy's whitening."""
    kept = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[Fraction(n * x[d] - s[d], n) for d in range(dims)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        out[i] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), y @ vectors / np.sqrt(values))
    return out, values / np.trace(cov)


def check(rows, got, k):
    want, explained = plain(rows, k)
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, {})[r.component] = r
    assert set(seen) == set(want)
    ids = sorted(want, key=lambda i: (i is None, i))
    for c in range(1, len(explained) + 1):
        a = np.array([seen[i][c].whitened for i in ids])
        b = np.array([want[i][2][c - 1] for i in ids])
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, atol=1e-7)
        for i in ids:
            r = seen[i][c]
            assert (r.n, r.deviation) == want[i][:2]
            assert abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-8


def test_matches_plain_arithmetic_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [1, 2, 3, 4, 300]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all rows
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5),
             (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, rows[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<double>, x string, n int").repartition(7)
    got = whitening.whiten(df, n_components=3).collect()
    assert len(got) == 451 * 3
    check([r for r in rows if r[1] is None or len(r[1]) == 5], got, 3)
    # a repeated row is two results, a vector of another length none
    again = whitening.whiten(df.union(df.where("vec_id = 3")).union(
        spark.createDataFrame([(5000, [1.0], "x", 1)], df.schema)), n_components=3)
    assert again.where("vec_id = 3").count() == 6 and again.where("vec_id = 5000").count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(i * 10 ** 9), float((i * 7919) % 13) * 10 ** 8, float(i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, n_components=2).collect()
    want, _ = plain(rows, 2)
    assert all(r.deviation == (want[r.vec_id][1] if want[r.vec_id][1] < 1 << 63 else None) for r in got)
    assert whitening.exact_totals(
        whitening.packed(df, "vec_id", "embedding", 64.0, 10 ** 6), 10 ** 6, whitening.squared_sums([0, 0, 0]))[:3] \
        == [sum((int(v[d] * 64) + 10 ** 6) ** 2 for _, v in rows) for d in range(3)]
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 7.0])], df.schema)
    assert whitening.whiten(huge).where("deviation is null").count() > 0


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    # two vectors span one direction
    two = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.5, 0.0])], df.schema)
    assert {r.component for r in whitening.whiten(two).collect()} == {1}


def test_query_matches_plain_arithmetic(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op12_embedding_whitening"](spark, SF_SMALL).collect(), 16)
