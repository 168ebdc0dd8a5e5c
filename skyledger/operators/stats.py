"""Catalog statistics and extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """One row: count, date range, distinct platforms and total size.

    An empty catalog gives zeros and NULL dates. Distinct platforms are
    case-sensitive and ignore NULL.
    """
    return catalog.agg(
        F.count("*").alias("total_images"),
        F.min("datetime").alias("earliest"),
        F.max("datetime").alias("latest"),
        F.count_distinct("platform_type").alias("platform_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
    )


def stats_partials(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers for each part (``keys``) and platform, from which ``merge_partials`` makes the statistics."""
    return catalog.groupBy(*keys, "platform_type").agg(
        F.count("*").alias("images"), F.min("datetime").alias("earliest"), F.max("datetime").alias("latest"),
        F.sum("file_size").alias("bytes"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """``catalog_stats`` from the parts' numbers. The platforms themselves are kept, so that they are counted exactly."""
    return partials.agg(
        F.coalesce(F.sum("images"), F.lit(0)).cast("bigint").alias("total_images"),
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
        F.count_distinct("platform_type").alias("platform_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: record count and first and last day."""
    return catalog.agg(
        F.count("*").alias("records"),
        F.substring(F.min("datetime"), 1, 10).alias("first_day"),
        F.substring(F.max("datetime"), 1, 10).alias("last_day"),
    )


def catalog_extent(catalog: DataFrame, bbox: str = "bbox") -> DataFrame:
    """One row: the box around all boxes."""
    return catalog.agg(
        F.min(f"{bbox}.xmin").alias("xmin"),
        F.min(f"{bbox}.ymin").alias("ymin"),
        F.max(f"{bbox}.xmax").alias("xmax"),
        F.max(f"{bbox}.ymax").alias("ymax"),
    )
