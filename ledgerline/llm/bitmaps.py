"""Bitmaps of fixed size over 64-bit keys: a filter before a join.

A key whose bit is unset is surely not among the keys; the join that follows
settles the rest.  The size is a parameter, not a function of the data, so
what is sent to the tasks has a fixed bound; with far more keys than bits the
filter lets everything through and the join alone decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
PARTS = 64


def slots(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bit of each (already well mixed) 64-bit key: its topmost bits."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Packed bits (little bit order) of a column of mixed 64-bit keys."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (df.select((slot / 32).cast("long").alias("word"), (slot % 32).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    size = (1 << bits) // 32 // PARTS

    def piece(key, table):
        out = np.zeros(size, np.uint32)
        out[table["word"].to_numpy() % size] = table["mask"].to_numpy().astype(np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((PARTS, size), np.uint32)
    for part, raw in (words.withColumn("part", (F.col("word") / size).cast("int")).groupBy("part")
                      .applyInArrow(piece, "part int, bits binary").collect()):
        out[part] = np.frombuffer(raw, np.uint32)
    return out.ravel().view(np.uint8)


def among(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the bitmap."""
    slot = slots(keys, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
