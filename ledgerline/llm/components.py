"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges, so a hub's edges
stay splittable; the edges are checkpointed after every round, in the shared
folder, and no label or edge reaches the driver.  A round's tasks follow the
number of edges: every task of a shuffle writes files of its own, which take more
disk than the rows of a small graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

TASK_EDGES = 20_000  # edges a task of a round


def _star(both: DataFrame, lowest: DataFrame) -> DataFrame:
    return both.join(lowest, "u")


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = _star(both, lowest).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return tied.coalesce(tasks).distinct().coalesce(tasks)


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them (edges have v < u)."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = _star(edges, lowest).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (tied.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v")
            .coalesce(tasks).distinct().coalesce(tasks))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node.

    The component is its least node.  Null ends, loops and repeated edges are
    ignored.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v").distinct())
    e = checkpointed(e)

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    while before[0]:
        tasks = -(-before[0] // TASK_EDGES)
        e = e.coalesce(tasks)
        e = checkpointed(_small(_large(e, tasks), tasks))
        after = state(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
