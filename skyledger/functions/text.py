"""Display text, labels, links and key parsing as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyledger.functions.numbers import to_fixed

# Display defaults, units and label texts.
DEFAULT_TITLE = "Untitled Image"
DEFAULT_PLATFORM = "unknown"
DEFAULT_NAME = "Unknown"
GIB = 1073741824
MIB = 1048576
PLATFORM_FILTER_LABELS = {"satellite": "Satellite", "uav": "Drone", "aircraft": "Other"}
TIFF_NAME = r"(?i)\.tiff?$"
ID_EDITOR = "https://www.openstreetmap.org/edit?editor=id#map=16/"
JOSM_REMOTE = "http://127.0.0.1:8111/imagery"


def or_default(text: Column, default: str) -> Column:
    """``default`` for NULL and for empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def platform_label(platform: Column) -> Column:
    lowered = F.lower(platform)
    return (
        F.when(platform.isNull() | (platform == ""), "Unknown")
        .when(lowered.isin("uav", "drone"), "Drone")
        .otherwise(F.concat(F.upper(F.substring(platform, 1, 1)), F.lower(F.substr(platform, F.lit(2)))))
    )


def file_size_text(size: Column) -> Column:
    return (
        F.when(size.isNull() | (size == 0), "Unknown")
        .when(size >= GIB, F.concat(to_fixed(size / GIB, 2), F.lit(" GB")))
        .otherwise(F.format_string("%d MB", half_up(size / MIB)))
    )


def upload_size_text(size: Column) -> Column:
    return F.concat(to_fixed(size / MIB, 1), F.lit(" MB"))


def gsd_text(gsd: Column) -> Column:
    return F.when(gsd.isNull() | (gsd == 0), "N/A").otherwise(F.concat(to_fixed(gsd, 2), F.lit(" m")))


def area_text(area_m2: Column) -> Column:
    return (
        F.when(area_m2.isNull(), "Unknown")
        .when(area_m2 >= 1e6, F.concat(to_fixed(area_m2 / 1e6, 2), F.lit(" km²")))
        .when(area_m2 >= 1e4, F.concat(to_fixed(area_m2 / 1e4, 1), F.lit(" ha")))
        .otherwise(F.format_string("%d m²", half_up(area_m2)))
    )


def count_text(count: Column) -> Column:
    return (
        F.when(count == 0, "No images in view")
        .when(count == 1, "1 image in view")
        .otherwise(F.concat(count.cast("string"), F.lit(" images in view")))
    )


def overlap_text(count: Column) -> Column:
    """Heading for several images under one point; NULL for fewer than two."""
    return F.when(count > 1, F.concat(count.cast("string"), F.lit(" images here")))


def platform_filter_label(value: Column) -> Column:
    label = F.lit("All Platforms")
    for key, text in PLATFORM_FILTER_LABELS.items():
        label = F.when(value == key, text).otherwise(label)
    return label


def license_filter_label(value: Column) -> Column:
    return (
        F.when(value.isNull() | (value == ""), "Any License")
        .when(value.contains("SA"), "CC BY-SA")
        .when(value.contains("NC"), "CC BY-NC")
        .otherwise("CC BY")
    )


def canonical_license(value: Column) -> Column:
    """One spelling for ``CC-BY 4.0`` and ``CC-BY-4.0``."""
    return F.regexp_replace(value, "[ -]", "-")


def is_tiff_name(name: Column) -> Column:
    return name.rlike(TIFF_NAME)


def title_from_name(name: Column) -> Column:
    return F.regexp_replace(name, TIFF_NAME, "")


def upload_id_of_key(key: Column) -> Column:
    """Second part of ``staging/<id>/<file>``; NULL for fewer than three parts."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) >= 3, F.get(parts, 1))


def key_problem(key: Column) -> Column:
    return F.when(
        key.isNull() | (F.size(F.split(key, "/")) < 3),
        F.concat(F.lit("Unexpected key format: "), F.coalesce(key, F.lit(""))),
    )


def image_href(base: str, upload_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/imagery/"), upload_id, F.lit(".tif"))


def thumbnail_href(base: str, upload_id: Column, extension: Column | None = None) -> Column:
    extension = F.lit(".webp") if extension is None else extension
    return F.concat(F.lit(base.rstrip("/") + "/thumbnails/"), upload_id, extension)


def thumbnail_extension(source_url: Column) -> Column:
    return F.when(source_url.endswith(".png"), ".png").otherwise(".webp")


def encode_uri_component(text: Column) -> Column:
    """Percent-encoding that leaves ``A-Z a-z 0-9 - _ . ! ~ * ' ( )`` as they are."""
    encoded = F.url_encode(text)
    for found, wanted in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def number_text(value: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    return F.regexp_replace(value.cast("decimal(38,28)").cast("string"), r"\.?0+$", "")


def id_editor_link(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit(ID_EDITOR), number_text(lat), F.lit("/"), number_text(lon))


def josm_link(title: Column, image_id: Column, href: Column, title_prefix: str = "") -> Column:
    """Remote-control link; NULL without an image address."""
    shown = F.concat(F.lit(title_prefix), F.coalesce(F.nullif(title, F.lit("")), image_id))
    return F.when(
        href.isNotNull() & (href != ""),
        F.concat(
            F.lit(JOSM_REMOTE + "?title="), encode_uri_component(shown),
            F.lit("&type=tms&url="), encode_uri_component(href),
        ),
    )
