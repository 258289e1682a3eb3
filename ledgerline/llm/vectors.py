"""What the two vector searches share: valid rows, blocks, merged ranks.

Items are dealt into blocks of a bounded size and queries into blocks of
theirs; every pair of a query block and an item block is one task that
returns at most k rows per query.  No row pairs are materialised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id, v) of the rows that take part.

    Left out: null ids, null or empty vectors, null or non-finite components,
    zero vectors unless ``zero_ok``, and vectors whose length is not the most
    frequent one (the shorter of equals).  Repeated (id, vector) rows are one
    item.
    """
    v = df.select(F.col(id_col).cast("long").alias("vec_id"),
                  F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zero_ok:
        v = v.where(F.exists("v", lambda x: x != 0))
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (length.n if length else 0))


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    col = table[column].combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, 0))


def blocked(queries: DataFrame, items: DataFrame, item_block: Column, item_blocks: int | Column, query_blocks: int,
            fn, schema: str) -> DataFrame:
    """``fn(key, queries, items)`` on every pair of blocks.

    ``item_blocks`` may be a column of the queries: how many blocks, from the
    first, a query visits.
    """
    if isinstance(item_blocks, Column):
        queries = queries.where(item_blocks > 0)
        item_blocks = item_blocks.cast("int")
    else:
        item_blocks = F.lit(item_blocks)
    q = (queries.withColumn("_q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
         .withColumn("_i", F.explode(F.sequence(F.lit(0), item_blocks - 1))))
    v = (items.withColumn("_i", item_block.cast("int"))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    return q.groupBy("_q", "_i").cogroup(v.groupBy("_q", "_i")).applyInArrow(fn, schema)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query's blocks."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same bits for the same pair of rows."""
    return np.einsum("ij,ij->i", a, b)
