"""Structured Streaming fold of the report-status log.

Status events arrive as parquet files in a log folder.  A streaming aggregation
keeps the fold state per (organization_id, report_id) in Spark's state store, under the
query's checkpoint; a restarted query resumes exactly where it stopped.  The
state *is* the table of items: ``read_items`` reads it with Spark's state-store
reader as of the last committed micro-batch, so nothing else is written, and a
micro-batch costs what its own events cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import status


def start_status_fold(spark: SparkSession, log_dir: str, checkpoint: str, files_per_batch: int | None = None, available_now: bool = True):
    """Start the streaming fold; returns the StreamingQuery."""
    reader = spark.readStream.schema(status.LOG_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(log_dir).groupBy(*status.KEY).agg(*status.fold_aggregates())
    w = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_items(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Current status items (deleted keys absent), as of the last committed micro-batch or of ``batch``."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    store = reader.load(checkpoint)
    wanted = status.fold(spark.createDataFrame([], status.LOG_SCHEMA)).schema
    values = [f for f in wanted.fields if f.name not in status.KEY]
    # the store names aggregates in its own way; their order is that of the fold
    names = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in values)
    named = store.select("key.*", store["value"].cast(f"struct<{names}>").alias("v"))
    return status.finalize(named.select(*status.KEY, "v.*"))


def fold_log_stream(spark: SparkSession, log: DataFrame, root: str) -> DataFrame:
    """Write ``log`` as files, fold them with the streaming job and return the resulting status items."""
    root = root.rstrip("/")
    log.write.mode("append").parquet(f"{root}/log")
    q = start_status_fold(spark, f"{root}/log", f"{root}/checkpoint")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_items(spark, f"{root}/checkpoint")


__all__ = ["start_status_fold", "read_items", "fold_log_stream"]
