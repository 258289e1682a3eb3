"""Streaming transaction scoring (R1) and log append (R2).

The reference scores one transaction per request; here the same rules run
as one Structured Streaming query over an unbounded table of transactions:

  readStream (parquet folder, explicit schema)
    -> foreachBatch: L8 validation once per batch (errors array per row)
       -> valid rows: M8 isolation-forest scoring (Arrow ``mapInPandas``),
          written to the scored table
       -> invalid rows: written to the quarantine table

Both tables are partitioned by ``batch_id``, and a batch overwrites its own
partition.  A batch that failed between its two writes, or before its commit,
is replayed under the same id with the same files, so nothing is doubled and
nothing is lost.  No aggregation and no state, so no watermark is needed.
Checkpoints live under the shared checkpoint folder, so a restarted driver or
lost executor resumes from the last committed batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models.isoforest import IsolationForestModel, score_transactions
from ..operators.quality import quarantine

# Bytes of a row group of the source's files: only whole groups are dealt to
# tasks, and a batch of few files shall keep every core scoring.
SOURCE_GROUP = 4 << 20

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("discount_pct", T.DoubleType()),
    T.StructField("promotion_flag", T.IntegerType()),
])


@dataclass
class StreamPaths:
    source: str
    scored: str
    quarantined: str
    checkpoint: str


def batch_writer(model: IsolationForestModel, paths: StreamPaths):
    """``foreachBatch`` function: one validation, two sinks."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = quarantine(batch).persist()
        try:
            now = F.current_timestamp()
            scored = score_transactions(model, checked.where("is_valid").drop("errors", "is_valid"))
            to_sink(scored.withColumn("type", F.lit("anomaly_detection")).withColumn("created_at", now),
                    paths.scored, batch_id)
            to_sink(checked.where("not is_valid").drop("is_valid").withColumn("created_at", now),
                    paths.quarantined, batch_id)
        finally:
            checked.unpersist()

    return write


def to_sink(rows: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rows as its own partition of a table; written again on replay."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def scoring_stream(spark: SparkSession, model: IsolationForestModel, paths: StreamPaths,
                   schema: T.StructType = TRANSACTION_SCHEMA, available_now: bool = True,
                   processing_time: str | None = None, max_files_per_trigger: int | None = None):
    """Start the query that feeds both sinks; returns its handle."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (reader.parquet(paths.source).writeStream.foreachBatch(batch_writer(model, paths))
         .option("checkpointLocation", f"{paths.checkpoint}/scoring"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_available_now(spark: SparkSession, model: IsolationForestModel, paths: StreamPaths,
                      **kw) -> None:
    """Process everything currently in the source folder, then stop.

    Waits until the query ends, however long that takes; a failed batch
    raises its error.
    """
    scoring_stream(spark, model, paths, available_now=True, **kw).awaitTermination()
