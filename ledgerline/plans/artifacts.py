"""Curated tables and model artifacts that several queries share.

Each is built once per application and state of the input files, written under
the shared scratch folder, and read back by every query that needs it (S3/S4,
S7): no query repeats the master's joins or a training run, and nothing stays
cached in executors or in this process.  A changed, added or removed input file
changes the folder, so the next query reads it; threads of one application that
ask for the same table wait for one build.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapter import LINE_KEY
from ..models import clustering as CM
from ..models import demand as DM
from ..models import isoforest as IF
from ..operators import features as feat
from ..operators.master import MASTER_COLUMNS, master_from_sf
from ..session import scratch_path, stored
from ..sources import io as IO


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """What the files under ``sf_dir`` are now: names, sizes, modification times.

    Listed through the file system of the path, one entry per file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(conf).listFiles(path, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return hashlib.md5(json.dumps(sorted(found)).encode()).hexdigest()[:16]


def shared_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of this application for what derives from the present files of ``sf_dir``."""
    return scratch_path(spark, f"{spark.sparkContext.applicationId}-{fingerprint(spark, sf_dir)}/{name}")


_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


def built(spark: SparkSession, path: str, build) -> str:
    """``build(path)`` unless it ended before; returns the path.

    The mark is written last, so an interrupted build starts again.
    """
    with _LOCKS[path]:
        if not IO.path_exists(spark, f"{path}-done"):
            build(path)
            spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
    return path


def curated_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master columns with the row order, written once and scanned with pruned columns.

    What ``line_key`` repeats of the master's columns is not written again.
    """
    key = {f"k{i}": own for i, own in enumerate(LINE_KEY.values(), 1)}

    def build(path):
        master = master_from_sf(spark, sf_dir)
        rest = []
        for part, own in key.items():
            value = F.col(f"line_key.{part}")
            if own in MASTER_COLUMNS:  # a struct where the column was filled, else null
                value = F.when(~value.eqNullSafe(F.col(own)), F.struct(value.alias("value")))
            rest.append(value.alias(f"__{part}"))
        IO.write_curated(master.select(*MASTER_COLUMNS, *rest), path, compression="zstd")

    table = IO.read_curated(spark, built(spark, shared_path(spark, sf_dir, "master"), build))
    parts = [F.when(F.col(f"__{part}").isNotNull(), F.col(f"__{part}.value")).otherwise(F.col(own))
             if own in MASTER_COLUMNS else F.col(f"__{part}") for part, own in key.items()]
    return table.select(*MASTER_COLUMNS, F.struct(*(v.alias(part) for v, part in zip(parts, key))).alias("line_key"))


def whole_master(spark: SparkSession, sf_dir: str) -> str:
    """S3: the path of the master table with every column of the raw tables (P10), for its export."""
    return built(spark, shared_path(spark, sf_dir, "master-whole"),
                 lambda p: IO.write_curated(master_from_sf(spark, sf_dir), p))


def demand_artifact(spark: SparkSession, sf_dir: str):
    """The demand model with its fill values and metrics, from its files."""
    def build(path):
        model, modes, metrics = DM.train(feat.demand_features(curated_master(spark, sf_dir)))
        DM.save(model, modes, spark, path)
        metrics.write.mode("overwrite").parquet(f"{path}-metrics")

    path = built(spark, shared_path(spark, sf_dir, "demand-model"), build)
    return (*DM.load(spark, path), spark.read.parquet(f"{path}-metrics"))


def forest_artifact(spark: SparkSession, sf_dir: str):
    """The isolation forest and the scored training rows."""
    def build(path):
        model, flagged = IF.fit(feat.anomaly_features(curated_master(spark, sf_dir)), feat.ANOMALY_FEATURES,
                                key=["order_id", "product_id", "customer_id", "quantity", "total_amount"],
                                partitions=spark.sparkContext.defaultParallelism)
        model.save(spark, path)
        flagged.write.mode("overwrite").parquet(f"{path}-scored")

    path = built(spark, shared_path(spark, sf_dir, "anomaly-model"), build)
    return IF.IsolationForestModel.load(spark, path), spark.read.parquet(f"{path}-scored")


def segment_artifact(spark: SparkSession, sf_dir: str):
    """The segmentation model and the customers with their cluster."""
    def build(path):
        # read several times, aggregated once
        customers = stored(feat.customer_features(curated_master(spark, sf_dir)))
        model = CM.fit(customers, k=3, n_init=20, seed=42)
        model.save(spark, path)
        model.predict(customers).write.mode("overwrite").parquet(f"{path}-segments")

    path = built(spark, shared_path(spark, sf_dir, "segment-model"), build)
    return CM.ClusterModel.load(spark, path), spark.read.parquet(f"{path}-segments")


def products_with_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6's right side: the product keys of dated lines, no demand table."""
    master = curated_master(spark, sf_dir)
    return master.where(F.col("product_id").isNotNull() & F.col("order_date").isNotNull()).select("product_id").distinct()
