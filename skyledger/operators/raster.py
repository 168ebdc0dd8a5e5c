"""Raster jobs over pixel tables ``(image_id, band, row, col, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.skew import lookup_join

# Thumbnail side and percentiles.
THUMBNAIL_SIZE = 512
LOW, HIGH = 0.02, 0.98

def compose_rgb(pixels: DataFrame) -> DataFrame:
    """One row per position with ``r, g, b``; bands are numbered from 1.

    Images with at least three bands use the first three, others repeat band 1.
    A group is one position, so it never holds more rows than the image has bands.
    """
    def band(n: int) -> Column:
        return F.max(F.when(F.col("band") == n, F.col("value")))

    cells = pixels.groupBy("image_id", "row", "col").agg(
        band(1).alias("_b1"), band(2).alias("_b2"), band(3).alias("_b3"), F.max("band").alias("_bands")
    )
    colour = F.col("_bands") >= 3
    return cells.select(
        "image_id", "row", "col",
        F.col("_b1").alias("r"),
        F.when(colour, F.col("_b2")).otherwise(F.col("_b1")).alias("g"),
        F.when(colour, F.col("_b3")).otherwise(F.col("_b1")).alias("b"),
    )


def unpivot_rgb(rgb: DataFrame) -> DataFrame:
    """``(image_id, row, col, channel, value)`` rows of a composed image."""
    return rgb.unpivot(["image_id", "row", "col"], ["r", "g", "b"], "channel", "value")


def percentile_range(pixels: DataFrame, image: str = "image_id", value: str = "value") -> DataFrame:
    """``vmin`` and ``vmax`` per image: exact 2nd and 98th percentiles of its values above zero.

    Values are counted first, so an image contributes its different values to the selection,
    not its pixels: at most 65,536 rows for rasters of 16 bits, and at most 3 * 512 * 512 for
    thumbnails of any type (see ``render``). NaN pixels count as no data. Images without
    values above zero are absent; ``stretch`` gives them (0, 1).
    """
    shown = (F.col(value) > 0) & ~F.isnan(F.col(value).cast("double"))
    counts = pixels.where(shown).groupBy(image, value).agg(F.count("*").alias("_n"))
    ranked = _running(counts, [image], value)
    # The value at a rank is the smallest one with more than that many values up to it.
    picked = ranked.groupBy(image).agg(
        *[F.min(F.when(F.col("_upto") > rank, F.col(value))).cast("double").alias(f"_v{i}")
          for i, rank in enumerate(_ranks())],
        F.max("_total").alias("_total"),
    )

    def between(share: float, low: str, high: str) -> Column:
        place = (F.col("_total") - 1) * share
        part, step = place - F.floor(place), F.col(high) - F.col(low)
        return F.when(part >= 0.5, F.col(high) - step * (1 - part)).otherwise(F.col(low) + step * part)

    return picked.select(image, between(LOW, "_v0", "_v1").alias("vmin"), between(HIGH, "_v2", "_v3").alias("vmax"))


def _ranks() -> list[Column]:
    """Zero-based ranks on both sides of the two percentiles, among ``_total`` values."""
    places = [(F.col("_total") - 1) * share for share in (LOW, HIGH)]
    return [edge(place) for place in places for edge in (F.floor, F.ceil)]


def _running(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add ``_upto``, the running count in ``order``, and ``_total`` per group."""
    totals = Window.partitionBy(*group)
    running = totals.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"_upto": F.sum("_n").over(running), "_total": F.sum("_n").over(totals)})


def _byte(value: Column) -> Column:
    """8-bit stretch of ``value`` between ``vmin`` and ``vmax``; NaN gives 0."""
    vmin, vmax = F.coalesce("vmin", F.lit(0.0)), F.coalesce("vmax", F.lit(1.0))
    scaled = (value - vmin) / F.when(vmax > vmin, vmax - vmin) * 255
    byte = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).cast("int")
    return F.when((vmax > vmin) & ~F.isnan(value.cast("double")), byte).when(value.isNotNull(), 0)


def stretch(pixels: DataFrame, ranges: DataFrame, image: str = "image_id", value: str = "value") -> DataFrame:
    """Replace ``value`` by its 8-bit stretch between the image's percentiles."""
    return lookup_join(pixels, ranges, image).withColumn(value, _byte(F.col(value))).select(*pixels.columns)


def normalise(pixels: DataFrame, bits: int, image: str = "image_id", value: str = "value") -> DataFrame:
    """8-bit input stays as it is, anything else is stretched."""
    return pixels if bits == 8 else stretch(pixels, percentile_range(pixels, image, value), image, value)


def mask_flags(masks: DataFrame) -> DataFrame:
    """Per image: does any mask value differ from 255?"""
    return masks.groupBy("image_id").agg(F.max(F.col("mask") != 255).alias("has_mask"))


def with_alpha(rgb: DataFrame, masks: DataFrame) -> DataFrame:
    """Add the mask as ``alpha`` where the image has one; NULL elsewhere. Meant for masks of thumbnail size."""
    alpha = lookup_join(masks, mask_flags(masks).where("has_mask"), "image_id", "left_semi")
    return rgb.join(
        alpha.select("image_id", "row", "col", F.col("mask").alias("alpha")), ["image_id", "row", "col"], "left"
    )


def _targets(source: Column, length: Column, size: int) -> Column:
    """Target indices whose nearest source index ``floor((i + 0.5) * length / size)`` is ``source``."""
    # In whole numbers: source * 2 * size <= (2 i + 1) * length < (source + 1) * 2 * size.
    source, length = source.cast("bigint"), length.cast("bigint")
    first = F.call_function("div", source * (2 * size) - length + length * 2 - 1, length * 2)
    last = F.call_function("div", (source + 1) * (2 * size) - 1 - length + length * 2, length * 2) - 1
    last = F.least(last, F.lit(size - 1))
    return F.when(last >= first, F.sequence(first, last))


def thumbnail(pixels: DataFrame, size: int = THUMBNAIL_SIZE, height: str = "height", width: str = "width") -> DataFrame:
    """Nearest-pixel resampling to a ``size`` × ``size`` grid; the aspect ratio is not kept.

    Each source pixel knows the grid cells it serves, so the job is a filter and an
    explode inside each partition: no grid table, join or shuffle.
    """
    keep = [c for c in pixels.columns if c not in ("row", "col")]
    return (
        pixels.select("*", F.explode(_targets(F.col("row"), F.col(height), size)).alias("_row"))
        .select("*", F.explode(_targets(F.col("col"), F.col(width), size)).alias("_col"))
        .select(*keep, F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"))
    )


def render(pixels: DataFrame, masks: DataFrame | None = None, size: int = THUMBNAIL_SIZE) -> DataFrame:
    """Thumbnails: ``image_id, row, col, r, g, b, alpha`` for each cell of the grid.

    ``pixels`` has ``image_id, band, row, col, value, height, width`` and may have ``bits`` (bits per
    sample; images of 8 bits keep their values), ``masks`` has ``image_id, row, col, mask, height, width``.
    Everything is first read at the size of the grid, inside each partition; bands, percentiles and masks
    then work on at most ``size`` * ``size`` positions per image. ``alpha`` is NULL for images
    without a mask or with one of 255 only.
    """
    grid = thumbnail(pixels, size)
    rgb = compose_rgb(grid)
    ranges = percentile_range(unpivot_rgb(rgb))
    if "bits" in pixels.columns:
        plain = grid.groupBy("image_id").agg((F.max("bits") == 8).alias("_plain"))
        ranges = plain.join(ranges, "image_id", "left")
    else:
        ranges = ranges.withColumn("_plain", F.lit(False))
    looked = lookup_join(rgb, ranges, "image_id")
    kept = F.coalesce("_plain", F.lit(False))
    shown = looked.select(
        "image_id", "row", "col", *[F.when(kept, F.col(c).cast("int")).otherwise(_byte(F.col(c))).alias(c) for c in ("r", "g", "b")]
    )
    if masks is None:
        return shown.withColumn("alpha", F.lit(None).cast("int"))
    return with_alpha(shown, thumbnail(masks, size).select("image_id", "row", "col", "mask"))
