"""Spark session helpers.

The library never hard-codes cluster resources.  ``get_spark`` is for
local runs and tests; on a cluster the caller passes its own session and
every function here only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on.  ANSI mode stays on (Spark 4 default):
# the library uses try_cast / try_divide wherever input may be dirty.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # AQE sizes reduce partitions from the shuffle statistics; the advisory
    # size keeps a partition well inside an executor's execution memory and
    # splits skewed ones (a key with a third of the rows) for joins.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerline", driver_memory: str | None = "8g") -> SparkSession:
    """Return (or create) a session with the library's base settings.

    ``driver_memory`` only applies when this call starts the JVM (local
    runs); on a cluster the launcher sizes the processes.
    """
    builder = SparkSession.builder.appName(app_name)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system path and is only
    read; without it this raises, because no machine-local folder would do.
    A local session (tests) gets a scratch folder.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        path = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again.

    For wide intermediate tables: a checkpoint holds them uncompressed.
    """
    path = scratch_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


MOST_APART = 1 << 10  # keys up to which it pays to give each a partition of its own


def keys_apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers, each the only one in its partition of ``repartition(n, key)``.

    Consecutive numbers share partitions by chance, and a task with three
    groups takes three times as long.
    """
    found, tried = {}, 8 * n + 64
    while len(found) < n:
        found = {r.part: r.key for r in spark.range(tried, numPartitions=1).select(F.col("id").cast("int").alias("key")).groupBy(
            F.pmod(F.hash("key"), F.lit(n)).alias("part")).agg(F.min("key").alias("key")).collect()}
        tried *= 4
    return [found[part] for part in range(n)]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerline/{name}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
