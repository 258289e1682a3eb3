"""Many questions against groups of similar rows: the brute-force top-k, and what is not opened."""
import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import postings as P
from ledgerline.operators import retrieval as RT


def brute(queries, rows, dim, k):
    count = lambda bags: np.array([np.bincount(b, minlength=dim) for b in bags], float).reshape(len(bags), dim)
    q, s = count(queries), count(rows)
    qn, sn = (np.sqrt((x * x).sum(axis=1)) for x in (q, s))
    den = qn[:, None] * sn[None, :]
    score = np.where(den > 0, (q @ s.T) / np.where(den > 0, den, 1.0), 0.0)
    out = []
    for i in range(len(queries)):
        best = np.argsort(-np.floor(score[i] * 1e4 + 0.5), kind="stable")[:k]
        out += [(i, int(j), float(score[i, j])) for j in best]
    return out


def found(queries, rows, dim, k):
    lists = P.Postings([np.asarray(b, np.int64) for b in rows], dim)
    row, bucket = P.bags(queries)
    parts = [*lists.top_all(len(queries), row, bucket, k)]
    return lists, [(int(a), int(b), float(c)) for p in parts for a, b, c in zip(*p)]


def bags_of(n, dim, rng, kinds=9):
    base = [rng.randint(0, dim, 4) for _ in range(kinds)]
    return [np.concatenate([np.repeat(base[rng.randint(kinds)], rng.randint(1, 6)), rng.randint(0, dim, rng.randint(0, 3))])
            for _ in range(n)]


def test_top_of_many_queries_is_that_of_all_pairs(monkeypatch):
    rng = np.random.RandomState(1)
    for dim, n, k, opened, dense in [(32, 300, 3, 1 << 22, 4096), (32, 300, 40, 50, 4096), (16, 5, 9, 1, 4096),
                                     (64, 257, 1, 1, 4096), (32, 90, 3, 1, 8)]:
        monkeypatch.setattr(P, "OPENED", opened)
        monkeypatch.setattr(P, "DENSE_DIM", dense)
        monkeypatch.setattr(P, "QUERIES", 7)
        monkeypatch.setattr(P, "ROUND", 2)
        rows = bags_of(n, dim, rng) + [np.empty(0, np.int64)]
        queries = bags_of(40, dim, rng, 20) + [np.empty(0, np.int64), np.repeat(rng.randint(0, dim, 3), 5)]
        assert found(queries, rows, dim, k)[1] == brute(queries, rows, dim, k)
    assert found([[1]], [], 4, 3)[1] == []


def test_counts_beyond_single_precision_stay_exact():
    rows = [[0] * 5000 + [1], [0] * 5000 + [1, 1], [0] * 4999 + [1]]
    queries = [[0] * 4000 + [1], [0] * 3999 + [1, 1, 1]]
    assert found(queries, rows, 2, 3)[1] == brute(queries, rows, 2, 3)


def test_groups_that_cannot_reach_the_top_stay_closed():
    rng = np.random.RandomState(2)
    rows = bags_of(6400, 256, rng, kinds=200)
    queries = [rows[i] for i in range(0, 6400, 100)]
    lists, _ = found(queries, rows, 256, 3)
    assert lists.opened < 0.2 * len(queries) * lists.groups


def test_rows_travel_once_for_all_questions_of_a_block(spark):
    """Not once for every 2,048 questions; and every pair of blocks is a task of its own."""
    q = spark.range(5000).select("id", F.array((F.col("id") % 16).cast("int")).alias("bag"))
    s = spark.range(2600).select(F.col("id").alias("sid"), F.array((F.col("id") % 16).cast("int"), F.lit(3)).alias("buckets"))
    hits = RT.search_bags(q, ["id"], "bag", s, s_order=["sid"], k=1, dim=16, s_block=1000)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "qb" not in [line for line in plan.splitlines() if "explode" in line.lower()][-1]
    blocks = max(3, min(spark.sparkContext.defaultParallelism, 2600 // 256))
    assert plan.count("RepartitionByExpression [task") == 2 and f"{blocks}" in plan
    assert hits.count() == 5000
