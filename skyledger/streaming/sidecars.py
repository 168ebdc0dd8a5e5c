"""Catalog rows of processed uploads while rasters and their metadata arrive as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.operators.ingest import given_metadata, sidecar_columns


def stream_sidecar_rows(
    rasters: DataFrame,
    metadata: DataFrame,
    key: str,
    processed_at: str,
    base_url: str,
    staged: str = "staged_at",
    written: str = "written_at",
    within: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """``ingest.sidecar_rows`` of two streams: an outer join within ``within`` of the raster's time.

    A raster waits for metadata written up to ``within`` before or after it was staged, and gives a row without as soon as the watermark
    says that none can come any more; state on both sides goes with it. The watermark trails the latest times by ``delay``. Of
    several metadata records of an upload the first to arrive counts. ``rasters`` has ``bounds`` (see ``ingest.with_mercator_bounds``).
    """
    given = given_metadata(metadata, key, written).withWatermark(written, delay).dropDuplicatesWithinWatermark([key])
    given = given.withColumnRenamed(key, "_given_key").withColumnRenamed(written, "_written")
    near = F.expr(f"_written BETWEEN `{staged}` - INTERVAL {within} AND `{staged}` + INTERVAL {within}")
    joined = rasters.withWatermark(staged, delay).join(given, (F.col(key) == F.col("_given_key")) & near, "left_outer")
    return sidecar_columns(joined, key, processed_at, base_url)
