"""Search rows as display records, GeoJSON features and STAC items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import geo, text
from skyledger.functions.dates import display_date

# The STAC version and the media types of the assets.
STAC_VERSION = "1.1.0"
COG_MEDIA_TYPE = "image/tiff; application=geotiff; profile=cloud-optimized"
WEBP_MEDIA_TYPE = "image/webp"

_PASSED = (
    "cog_href", "thumbnail_href", "file_size", "width", "height", "bands", "epsg", "uploaded_by", "uploaded_at",
)


def property_columns() -> list[Column]:
    """Feature properties with display defaults and the duplicate short names."""
    producer = text.or_default(F.col("producer_name"), text.DEFAULT_NAME)
    return [
        F.col("id"),
        text.or_default(F.col("title"), text.DEFAULT_TITLE).alias("title"),
        F.col("datetime"),
        F.col("datetime").alias("date"),
        F.col("gsd"),
        text.or_default(F.col("platform_type"), text.DEFAULT_PLATFORM).alias("platform"),
        F.col("platform_type"),
        producer.alias("producer_name"),
        producer.alias("provider"),
        text.or_default(F.col("license"), text.DEFAULT_NAME).alias("license"),
        F.col("thumbnail_href").alias("thumbnail"),
        *[F.col(name) for name in _PASSED],
    ]


def feature_properties(found: DataFrame) -> DataFrame:
    return found.select(*property_columns())


def _result_bbox() -> Column:
    return F.struct(
        F.col("bbox_west").alias("xmin"), F.col("bbox_south").alias("ymin"),
        F.col("bbox_east").alias("xmax"), F.col("bbox_north").alias("ymax"),
    )


def geojson_features(found: DataFrame) -> DataFrame:
    """One ``feature`` struct per search result."""
    return found.withColumn("_box", _result_bbox()).select(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(
                F.lit("Polygon").alias("type"), F.array(geo.bbox_ring(F.col("_box"))).alias("coordinates")
            ).alias("geometry"),
            F.struct(*property_columns()).alias("properties"),
        ).alias("feature")
    )


def geojson_lines(found: DataFrame) -> DataFrame:
    """Features as JSON text, one per row; NULL properties are kept as ``null``."""
    return geojson_features(found).select(
        F.to_json("feature", {"ignoreNullFields": "false"}).alias("value")
    )


def centroids(features: DataFrame) -> DataFrame:
    """Point per feature; rings with fewer than four points are dropped."""
    ring = F.col("feature.geometry.coordinates")[0]
    middle = geo.ring_centroid(ring)
    return (
        features.select(F.col("feature.properties.id").alias("id"), middle.alias("_middle"))
        .where(F.col("_middle").isNotNull())
        .select("id", F.col("_middle.lon").alias("lon"), F.col("_middle.lat").alias("lat"))
    )


def stac_items(catalog: DataFrame, collection: str = "community", prefix: str = "img") -> DataFrame:
    """One STAC Item ``item`` struct per image.

    ``prefix`` names the extension the platform and producer properties belong to.
    """
    box = F.col("bbox")

    def asset(href: str, media_type: str, title: str, roles: list[str]) -> Column:
        return F.when(
            F.col(href).isNotNull(),
            F.struct(
                F.col(href).alias("href"), F.lit(media_type).alias("type"), F.lit(title).alias("title"),
                F.array(*[F.lit(r) for r in roles]).alias("roles"),
            ),
        )

    return catalog.select(
        F.struct(
            F.lit("Feature").alias("type"),
            F.lit(STAC_VERSION).alias("stac_version"),
            F.col("id"),
            F.lit(collection).alias("collection"),
            F.when(
                box.isNotNull(),
                F.struct(F.lit("Polygon").alias("type"), F.array(geo.bbox_ring(box)).alias("coordinates")),
            ).alias("geometry"),
            F.when(
                box.isNotNull(), F.array(box["xmin"], box["ymin"], box["xmax"], box["ymax"])
            ).alias("bbox"),
            F.struct(
                F.col("datetime"),
                F.col("gsd"),
                F.col("platform_type").alias(f"{prefix}:platform_type"),
                F.col("producer_name").alias(f"{prefix}:producer_name"),
                F.col("license"),
                F.col("epsg").alias("proj:epsg"),
                F.col("uploaded_at").alias("created"),
                F.col("uploaded_at").alias("updated"),
            ).alias("properties"),
            F.struct(
                asset("cog_href", COG_MEDIA_TYPE, "COG", ["data", "visual"]).alias("visual"),
                asset("thumbnail_href", WEBP_MEDIA_TYPE, "Thumbnail", ["thumbnail"]).alias("thumbnail"),
            ).alias("assets"),
        ).alias("item")
    )


def stac_lines(catalog: DataFrame, collection: str = "community", prefix: str = "img") -> DataFrame:
    return stac_items(catalog, collection, prefix).select(F.to_json("item").alias("value"))


def display_fields(catalog: DataFrame, box: str = "bbox") -> DataFrame:
    """The texts an image card shows."""
    return catalog.select(
        "id",
        display_date(F.col("datetime")).alias("date_text"),
        text.platform_label(F.col("platform_type")).alias("platform_text"),
        text.file_size_text(F.col("file_size")).alias("size_text"),
        text.upload_size_text(F.col("file_size")).alias("upload_size_text"),
        text.gsd_text(F.col("gsd")).alias("gsd_text"),
        text.area_text(geo.bbox_area_m2(F.col(box))).alias("area_text"),
    )


def editor_links(catalog: DataFrame, box: str = "bbox", title_prefix: str = "") -> DataFrame:
    middle = geo.bbox_centroid(F.col(box))
    return catalog.select(
        "id",
        text.id_editor_link(middle["lon"], middle["lat"]).alias("id_link"),
        text.josm_link(F.col("title"), F.col("id"), F.col("cog_href"), title_prefix).alias("josm_link"),
    )
