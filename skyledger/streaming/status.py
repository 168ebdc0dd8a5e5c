"""Status streams: the latest state per upload."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skyledger.operators.status import latest_status
from skyledger.sources.catalog import missing_path

def write_batch(path: str):
    """``foreachBatch`` sink with one folder per batch; a replay replaces its own folder."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def start_latest_status(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest status per upload: every batch logs the uploads that changed."""
    return (
        latest_status(events)
        .writeStream.outputMode("update")
        .foreachBatch(write_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_latest_status(spark: SparkSession, path: str, target: str, schema) -> None:
    """Write the change log anew with one row per upload; read ``target`` with ``path``'s later batches from then on."""
    read_latest_status(spark, path, schema).write.mode("overwrite").parquet(target)


def read_latest_status(spark: SparkSession, path: str, schema) -> DataFrame:
    """Current status per upload from the change log; none before the first batch."""
    try:
        log = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not missing_path(error):
            raise
        log = spark.createDataFrame([], schema)
    return latest_status(log)


def start_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to Parquet until the source is drained."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
