"""Upload and import jobs: validation, sidecar rows, nested JSON to catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import geo, text
from skyledger.functions.numbers import round_half_even
from skyledger.functions.wkb import box_wkb, geojson_wkb
from skyledger.operators.merge import one_per_key
from skyledger.schema import to_catalog_schema

# Limits and defaults of the upload path.
MIN_PIXELS = 10
MAX_BYTES = 500 * 1024 * 1024
UPLOAD_TITLE = "Untitled"
UPLOAD_LICENSE = "CC-BY 4.0"
IMPORT_LICENSE = "CC-BY-4.0"
WEB_MERCATOR = 3857


def rejection(strict: bool = False, bounds: str = "bounds") -> Column:
    """Message of the first rule a raster breaks, NULL for a valid one.

    A raster whose metadata is not known could not be read, and breaks the first rule.

    Columns read: ``bands``, ``width``, ``height``, ``file_size``; with ``strict`` also
    ``epsg`` and the longitude/latitude struct named by ``bounds``.
    """
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    megabytes = round_half_even(F.col("file_size") / text.MIB, 0).cast("bigint")
    known = F.col("bands").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("file_size").isNotNull()
    message = (
        F.when(~known, "Image metadata missing")
        .when(F.col("bands") == 0, "Image has no bands")
        .when((F.col("width") < MIN_PIXELS) | (F.col("height") < MIN_PIXELS), F.concat(F.lit("Image too small: "), size))
        .when(
            F.col("file_size") > MAX_BYTES,
            F.concat(F.lit("File too large: "), megabytes.cast("string"), F.lit("MB (max 500MB)")),
        )
    )
    if not strict:
        return message
    box = F.col(bounds)
    valid = (
        (box["xmin"] < box["xmax"]) & (box["ymin"] < box["ymax"])
        & (box["xmin"] >= -180) & (box["xmax"] <= 180) & (box["ymin"] >= -90) & (box["ymax"] <= 90)
    )
    at_origin = (box["xmin"] <= 0) & (box["xmax"] >= 0) & (box["ymin"] <= 0) & (box["ymax"] >= 0)
    return (
        message.when(F.col("epsg").isNull(), "Image has no CRS")
        .when(~F.coalesce(valid, F.lit(False)), "Invalid bounds")
        .when(at_origin, "Bounds at null island")
    )


def validate(rasters: DataFrame, strict: bool = False, bounds: str = "bounds") -> DataFrame:
    """All rows with a ``reason`` column, NULL where the raster is valid."""
    return rasters.withColumn("reason", rejection(strict, bounds))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows (with ``reason``)."""
    return (
        checked.where(F.col("reason").isNull()).drop("reason"),
        checked.where(F.col("reason").isNotNull()),
    )


def object_uploads(keys: DataFrame, key: str = "object_key") -> DataFrame:
    """Upload id of every staged object key, or the reason it has none."""
    return keys.withColumns(
        {"upload_id": text.upload_id_of_key(F.col(key)), "reason": text.key_problem(F.col(key))}
    )


def tiff_uploads(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Files with a TIFF name and the title their name gives."""
    return files.where(text.is_tiff_name(F.col(name))).withColumn("title", text.title_from_name(F.col(name)))


def with_mercator_bounds(rasters: DataFrame) -> DataFrame:
    """Add ``bounds`` (longitude/latitude) from the Web Mercator corner, size and resolution."""
    x0, y0 = F.col("mx0"), F.col("my0")
    return rasters.withColumn(
        "bounds",
        geo.mercator_bounds(
            x0, y0, x0 + F.col("width") * F.col("res_x"), y0 + F.col("height") * F.col("res_x")
        ),
    )


def given_metadata(metadata: DataFrame, key: str, *others: str) -> DataFrame:
    """``key``, the fields of user metadata as ``_meta_…`` (NULL if the source lacks them) and ``others``."""
    wanted = {"title": "string", "platform": "string", "license": "string", "acquired": "string", "provider": "string"}
    return metadata.select(
        key,
        *[
            (F.col(n) if n in metadata.columns else F.lit(None).cast(t)).alias(f"_meta_{n}")
            for n, t in wanted.items()
        ],
        *others,
    )


def sidecar_rows(rasters: DataFrame, metadata: DataFrame, key: str, processed_at: str, base_url: str) -> DataFrame:
    """Catalog rows for processed uploads.

    Every raster with ``bounds`` gives a row; user metadata is optional and may lack any
    field. A JSON null counts as missing; of several metadata rows for one upload the largest
    by its fields in turn counts. ``bbox`` stays NULL: the merge fills it in.
    """
    joined = rasters.join(one_per_key(given_metadata(metadata, key), key), key, "left")
    return sidecar_columns(joined, key, processed_at, base_url)


def sidecar_columns(joined: DataFrame, key: str, processed_at: str, base_url: str) -> DataFrame:
    """Catalog rows of rasters with their ``given_metadata``, of a batch or of a stream."""

    def meta(name: str, default: str) -> Column:
        return F.coalesce(F.col(f"_meta_{name}"), F.lit(default))

    upload_id = F.col(key).cast("string")
    box = F.col("bounds")
    return to_catalog_schema(
        joined.select(
            upload_id.alias("id"),
            meta("title", UPLOAD_TITLE).alias("title"),
            meta("acquired", processed_at[:10]).alias("datetime"),
            round_half_even(F.col("res_x"), 4).alias("gsd"),
            meta("platform", "").alias("platform_type"),
            meta("provider", "").alias("producer_name"),
            meta("license", UPLOAD_LICENSE).alias("license"),
            text.image_href(base_url, upload_id).alias("cog_href"),
            text.thumbnail_href(base_url, upload_id).alias("thumbnail_href"),
            "file_size",
            "width",
            "height",
            "bands",
            F.lit(WEB_MERCATOR).alias("epsg"),
            F.lit("").alias("uploaded_by"),
            F.lit(processed_at).alias("uploaded_at"),
            box_wkb(box["xmin"], box["ymin"], box["xmax"], box["ymax"]).alias("geometry"),
        )
    )


def _located(records: DataFrame, acquired_from: str, limit: int | None) -> DataFrame:
    """The fetched records with ``_geometry``, NULL where there is none that can be read."""
    acquired = F.coalesce("acquisition_start", "uploaded_at", F.lit(""))
    if acquired_from:
        records = records.where(acquired >= acquired_from)
    if limit is not None:
        records = records.orderBy(F.desc_nulls_last(acquired), F.asc_nulls_last("_id")).limit(limit)
    return records.withColumn("_geometry", geojson_wkb(F.col("geojson"), once=True))


def import_rejects(records: DataFrame, acquired_from: str = "", limit: int | None = None) -> DataFrame:
    """``id`` and ``reason`` of the fetched records that ``import_records`` drops."""
    reason = F.when(F.col("geojson").isNull(), "No geometry").otherwise("Geometry cannot be read")
    dropped = _located(records, acquired_from, limit).where(F.col("_geometry").isNull())
    return dropped.select(F.col("_id").alias("id"), reason.alias("reason"))


def import_records(records: DataFrame, base_url: str, acquired_from: str = "", limit: int | None = None) -> DataFrame:
    """Catalog rows from imported image records (see ``sources.pages``).

    Records without a usable geometry are dropped (``import_rejects`` lists them). A missing
    acquisition time falls back to the upload time; the thumbnail address is the re-hosted one.
    ``acquired_from`` and ``limit`` are the source's own fetch parameters.
    """
    located = _located(records, acquired_from, limit).where(F.col("_geometry").isNotNull())
    acquired = F.coalesce("acquisition_start", "uploaded_at", F.lit(""))
    thumbnail = F.nullif(F.col("properties.thumbnail"), F.lit(""))
    return to_catalog_schema(
        located.select(
            F.col("_id").alias("id"),
            F.coalesce("title", F.lit("Untitled")).alias("title"),
            acquired.alias("datetime"),
            geo.degrees_to_metres(F.col("gsd")).alias("gsd"),
            F.lower(text.or_default(F.col("platform"), "unknown")).alias("platform_type"),
            F.coalesce("provider", F.lit("Unknown")).alias("producer_name"),
            F.lit(IMPORT_LICENSE).alias("license"),
            F.coalesce("uuid", F.lit("")).alias("cog_href"),
            F.when(
                thumbnail.isNotNull(),
                text.thumbnail_href(base_url, F.col("_id"), text.thumbnail_extension(thumbnail)),
            ).alias("thumbnail_href"),
            F.coalesce("file_size", F.lit(0)).alias("file_size"),
            F.lit(3).alias("bands"),
            F.lit(4326).alias("epsg"),
            F.coalesce("contact", F.lit("")).alias("uploaded_by"),
            F.coalesce("uploaded_at", F.lit("")).alias("uploaded_at"),
            F.col("_geometry").alias("geometry"),
            geo.geojson_extent(F.col("geojson")).alias("bbox"),
        )
    )
