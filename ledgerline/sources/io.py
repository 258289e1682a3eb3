"""Sources and sinks.

Readers take explicit schemas where the format has none; writers use the
job commit protocol (a write is visible only after every task committed),
which replaces the reference's temp-file-and-rename.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


class DataValidationError(Exception):
    """A required input is missing."""


class ModelNotFoundError(Exception):
    """A required model artifact or curated table is missing."""


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds any file, as Spark's own readers see it."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """Header CSV scan; a missing path raises ``DataValidationError``.

    Without a schema every column is read as string and coerced later by
    the repair functions (inference would need an extra pass over the data).
    """
    if not path_exists(spark, path):
        raise DataValidationError(f"Missing file: {path}")
    # doubled quotes inside quotes, as spreadsheet tools write them.  Line
    # breaks inside quotes need ``multi_line``: such a file is read by one task
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


@dataclass
class Raw:
    products: DataFrame
    customers: DataFrame
    orders: DataFrame


def load_raw_data(spark: SparkSession, raw_dir: str, fmt: str = "csv",
                  names: dict[str, str] | None = None) -> Raw:
    """The three required raw tables."""
    names = names or {"products": "product_details", "customers": "customer_data",
                      "orders": "order_data"}
    out = {}
    for k, n in names.items():
        p = os.path.join(raw_dir, f"{n}.{fmt}")
        if fmt == "csv":
            out[k] = load_csv(spark, p)
        else:
            if not path_exists(spark, p):
                raise DataValidationError(f"Missing file: {p}")
            out[k] = spark.read.format(fmt).load(p)
    return Raw(**out)


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they are written as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields
              if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return df.withColumns(nested) if nested else df


MOST_OPEN = 32  # files that a task writes at once; rows of further partition values are sorted first


@contextmanager
def _open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Tasks write up to ``n`` partition values without sorting their rows by them, if any."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    if n:
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        if n:
            spark.conf.set(name, before)


def write_curated(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  fmt: str = "parquet", sort_within: list[str] | None = None, compression: str | None = None,
                  in_place: bool = False) -> None:
    """S3: overwrite a curated table (optionally partitioned, K1 sorted
    within partitions instead of a global sort, ``compression`` instead of the
    format's own).

    ``in_place`` leaves the rows where they are: for few partition values, of
    which every task then writes one file each, all of them open at once."""
    if partition_by and not in_place:
        # rows of one partition value meet in a few tasks (large values are
        # split), so a write does not leave a file per task and value
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with _open_files(df.sparkSession, MOST_OPEN if in_place else 0):
        if fmt == "csv":
            _flat(df).write.mode("overwrite").partitionBy(*(partition_by or [])).option("header", True) \
                .option("escape", '"').csv(path)
        else:
            w.format(fmt).save(path)


def read_curated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rescan a curated table (types survive in parquet)."""
    if not path_exists(spark, path):
        raise ModelNotFoundError(f"Curated table missing: {path}")
    return spark.read.format(fmt).load(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """S5 sink: nested summary record(s) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S5 source: the ``metrics`` sub-record; empty when the file is absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema["metrics"].dataType)
    return spark.read.schema(schema).json(path).select("metrics.*")


def export_report_csv(spark: SparkSession, master_path: str, out_path: str,
                      single_file: bool = False) -> str:
    """Copy the master table to a reporting CSV; error if missing.

    The files are compressed (gzip): as plain text the products' long texts
    stand in every line.  ``single_file`` funnels all rows through one task;
    keep it off for large tables (the CSV folder is readable by the reporting
    tool).
    """
    df = read_curated(spark, master_path)
    if single_file:
        df = df.coalesce(1)
    _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(out_path, compression="gzip")
    return out_path


def write_store(store: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Vector store sink (job commit makes it atomic)."""
    store.write.mode("overwrite").format(fmt).save(path)


STORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])


def load_store(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType = STORE_SCHEMA) -> DataFrame:
    """Read a vector store.

    ``parquet`` / ``jsonl`` are the scalable formats (split across tasks).
    ``json`` reads the reference's single-document layout, a JSON list or
    ``{"records": [...]}``; such a file is parsed by one task, so it is
    meant for migration only.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Vector store not found at {path}")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return spark.read.schema(schema).json(path)
    if fmt == "json":
        wrapped = T.StructType([T.StructField("records", T.ArrayType(schema))])
        raw = spark.read.option("multiLine", True).schema(wrapped).json(path)
        recs = raw.filter(F.col("records").isNotNull())
        as_list = spark.read.option("multiLine", True).schema(schema).json(path)
        return recs.select(F.explode("records").alias("r")).select("r.*").unionByName(
            as_list.filter(F.col("id").isNotNull()))
    raise ValueError(f"unknown store format {fmt}")


def unique_scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (one per call)."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
