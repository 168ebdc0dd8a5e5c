"""Joins without their own salting: the adaptive split takes hot keys apart."""

import contextlib

import pytest
from pyspark.sql import functions as F

from rows import plan
from skyledger.operators import merge, raster, spatial_join
from skyledger.schema import to_catalog_schema


@pytest.fixture
def tight(spark):
    """No side is small enough to broadcast, and a partition counts as large early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    with contextlib.ExitStack() as stack:
        for key, value in settings.items():
            spark.conf.set(key, value)
            restore = (spark.conf.unset, key) if old[key] is None else (spark.conf.set, key, old[key])
            stack.callback(*restore)
        yield


def hot(spark, n):
    """A third of the rows have key 0."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(0, n, 1, 8).withColumn("k", k)


def test_hot_image_in_stretch(spark, tight):
    pixels = hot(spark, 60_000).select(
        F.col("k").alias("image_id"), F.col("id").alias("row"), F.lit(0).alias("col"), (F.col("id") * 7919 % 4096).alias("value")
    )
    ranges = raster.percentile_range(pixels)
    out = raster.stretch(pixels, ranges)
    assert out.count() == 60_000
    out.collect()
    assert "SortMergeJoin(skew=true)" in plan(out, "simple")


def test_hot_image_in_masks(spark, tight):
    masks = hot(spark, 60_000).select(
        F.col("k").alias("image_id"), F.col("id").alias("row"), F.lit(0).alias("col"), F.when(F.col("k") % 2 == 0, 7).otherwise(255).alias("mask")
    )
    alpha = raster.lookup_join(masks, raster.mask_flags(masks).where("has_mask"), "image_id", "left_semi")
    rows = alpha.select("image_id", "row", "mask").collect()
    assert len(rows) == masks.where("image_id % 2 = 0").count() and {r["mask"] for r in rows} == {7}
    whole = raster.with_alpha(masks.drop("mask"), masks)
    assert whole.count() == 60_000 and whole.where("alpha IS NOT NULL").count() == len(rows)


def test_hot_image_in_hit_features(spark, tight):
    hits = hot(spark, 60_000).select(F.col("id").alias("p"), F.format_string("i%d", "k").alias("id"))
    images = to_catalog_schema(spark.range(500).select(F.format_string("i%d", "id").alias("id"), F.lit("t").alias("title")))
    out = spatial_join.hit_features(hits, images, ["p"])
    assert len(out.collect()) == 60_000
    assert "SortMergeJoin(skew=true)" in plan(out, "simple")


def test_merge_keeps_every_base_row_without_broadcast(spark, tight):
    base = to_catalog_schema(spark.range(2000).select(F.format_string("i%d", "id").alias("id"), F.lit("1").alias("uploaded_at")))
    late = to_catalog_schema(
        hot(spark, 900).select(F.format_string("i%d", "k").alias("id"), F.format_string("2%04d", "id").alias("uploaded_at"))
    )
    full = merge.merge_catalog(base, late)
    part = merge.merge_catalog(base, late, base_unique=True)
    assert full.count() == part.count() == 2000
    assert full.select("id", "uploaded_at").exceptAll(part.select("id", "uploaded_at")).count() == 0
