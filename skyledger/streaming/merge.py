"""Merge of pending sidecars into the partitioned catalog, as a stream or in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skyledger.sources.buckets import BUCKETS, merge_buckets
from skyledger.sources.pending import stream_pending


def merge_batch(root: str, order: str = "id", buckets: int = BUCKETS):
    """``foreachBatch`` function: the catalog in ``root`` with the batch merged in.

    A replayed batch merges rows that are there already, which changes nothing. An empty batch writes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(batch, root, order, buckets)

    return apply


def start_merge(
    spark: SparkSession,
    pending: str,
    root: str,
    checkpoint: str,
    order: str = "id",
    max_files: int | None = None,
    archive: str | None = None,
    every: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Merge what is pending now and stop, or keep merging ``every`` interval (such as ``1 hour``).

    The checkpoint remembers the merged sidecars. With ``archive`` Spark moves them there, once the batch after theirs begins.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream_pending(spark, pending, max_files, archive)
        .writeStream.foreachBatch(merge_batch(root, order, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def rebuild_catalog(
    spark: SparkSession, pending: str, root: str, order: str = "id", archive: str | None = None, buckets: int = BUCKETS
) -> int:
    """Merge everything that is pending and not merged yet; gives the number of sidecar rows merged.

    The list of merged sidecars is the checkpoint below ``root``. Sidecars may be removed any time after this returns.
    """
    query = start_merge(spark, pending, root, f"{root}/merged", order, archive=archive, buckets=buckets)
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)
