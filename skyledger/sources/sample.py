"""Synthetic catalog rows, one per key, reproducible from key and seed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.wkb import box_wkb
from skyledger.schema import make_bbox, to_catalog_schema

# Places, licenses and producers to draw from.
PLACES = [
    ("Arequipa", "Peru", -71.54, -16.41), ("Bamako", "Mali", -8.00, 12.64),
    ("Bergen", "Norway", 5.32, 60.39), ("Cebu", "Philippines", 123.90, 10.32),
    ("Cusco", "Peru", -71.97, -13.53), ("Da Nang", "Vietnam", 108.22, 16.07),
    ("Gdansk", "Poland", 18.65, 54.35), ("Hobart", "Australia", 147.33, -42.88),
    ("Izmir", "Turkey", 27.14, 38.42), ("Jaipur", "India", 75.79, 26.91),
    ("Kigali", "Rwanda", 30.06, -1.95), ("La Paz", "Bolivia", -68.12, -16.49),
    ("Mombasa", "Kenya", 39.67, -4.04), ("Noumea", "New Caledonia", 166.46, -22.28),
    ("Oaxaca", "Mexico", -96.72, 17.07), ("Porto", "Portugal", -8.61, 41.15),
    ("Quito", "Ecuador", -78.47, -0.18), ("Recife", "Brazil", -34.88, -8.05),
    ("Sapporo", "Japan", 141.35, 43.06), ("Tamale", "Ghana", -0.84, 9.40),
]
# What is drawn, with its shares.
PLATFORMS = ["satellite", "uav", "uav", "uav", "satellite", "aircraft"]
LICENSES = ["CC-BY-4.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
# Own values.
PRODUCERS = [f"Survey Team {letter}" for letter in "ABCDEFGHIJKL"]

# Fixed values per platform: half width and half height in degrees, resolution in metres.
HALF_WIDTH = {"satellite": (0.05, 0.2), "uav": (0.005, 0.02), "aircraft": (0.02, 0.08)}
HALF_HEIGHT = {"satellite": (0.05, 0.15), "uav": (0.005, 0.015), "aircraft": (0.02, 0.06)}
RESOLUTION = {"satellite": (0.3, 5.0), "uav": (0.02, 0.15), "aircraft": (0.1, 1.0)}
UAV_WIDTHS = [4000, 5472, 6000, 8000]
UAV_HEIGHTS = [3000, 3648, 4000, 6000]
LARGE_SIDES = [10000, 15000, 20000, 25000]
MAX_AGE_DAYS = 730

_DRAWS = (
    "place", "platform", "license", "producer", "age", "half_w", "half_h", "off_lon", "off_lat",
    "gsd", "width", "height", "bytes", "bands", "user", "hours",
)


def sample_catalog(
    keys: DataFrame, key: str, as_of: dt.date, base_url: str, seed: int = 0, geometry: bool = True
) -> DataFrame:
    """One plausible catalog row per row of ``keys``.

    Draws come from MD5 of seed, key and block number, so a lost task recomputes the
    same rows and no row depends on another.
    """
    blocks = (len(_DRAWS) + 3) // 4

    def digest(block: int) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(block))))

    hashed = keys.select(key, *[digest(b).alias(f"_h{b}") for b in range(blocks + 1)])

    def uniform(index: int) -> Column:
        digits = F.substring(f"_h{index // 4}", 1 + 8 * (index % 4), 8)
        return F.conv(digits, 16, 10).cast("bigint") / 4294967296.0

    drawn = hashed.select(
        F.col(f"_h{blocks}").alias("_id"), *[uniform(i).alias(f"_{name}") for i, name in enumerate(_DRAWS)]
    )

    def draw(name: str) -> Column:
        return F.col(f"_{name}")

    def whole(name: str, low: int, high: int) -> Column:
        return F.floor(draw(name) * (high - low + 1)).cast("int") + low

    def pick(name: str, values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), whole(name, 0, len(values) - 1))

    def ranged(name: str, ranges: dict[str, tuple[float, float]]) -> Column:
        return F.when(F.col("platform_type") == "satellite", _between(draw(name), *ranges["satellite"])).when(
            F.col("platform_type") == "uav", _between(draw(name), *ranges["uav"])
        ).otherwise(_between(draw(name), *ranges["aircraft"]))

    day = F.date_sub(F.lit(as_of), whole("age", 1, MAX_AGE_DAYS))
    uav = F.col("platform_type") == "uav"
    rows = drawn.select(
        "*",
        pick("place", [p[0] for p in PLACES]).alias("_name"),
        pick("place", [p[1] for p in PLACES]).alias("_country"),
        pick("place", [p[2] for p in PLACES]).alias("_lon"),
        pick("place", [p[3] for p in PLACES]).alias("_lat"),
        pick("platform", PLATFORMS).alias("platform_type"),
        day.alias("_day"),
        whole("hours", 1, 48).alias("_later"),
    ).select(
        "*",
        F.concat(F.substring("_id", 1, 8), F.lit("-"), F.substring("_id", 9, 3)).alias("id"),
        (F.col("_lon") + _between(draw("off_lon"), -0.1, 0.1)).alias("_mid_lon"),
        (F.col("_lat") + _between(draw("off_lat"), -0.1, 0.1)).alias("_mid_lat"),
        ranged("half_w", HALF_WIDTH).alias("_hw"),
        ranged("half_h", HALF_HEIGHT).alias("_hh"),
        F.when(uav, pick("width", UAV_WIDTHS)).otherwise(pick("width", LARGE_SIDES)).alias("width"),
        F.when(uav, pick("height", UAV_HEIGHTS)).otherwise(pick("height", LARGE_SIDES)).alias("height"),
    )
    w, e = F.col("_mid_lon") - F.col("_hw"), F.col("_mid_lon") + F.col("_hw")
    s, n = F.col("_mid_lat") - F.col("_hh"), F.col("_mid_lat") + F.col("_hh")
    day_text = F.col("_day").cast("string")
    uploaded = F.concat(
        F.date_add("_day", F.floor(F.col("_later") / 24).cast("int")).cast("string"), F.lit("T"),
        F.lpad((F.col("_later") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"),
    )
    columns = [
        "id",
        F.concat("_name", F.lit(" "), "_country", F.lit(" - "), F.initcap("platform_type"), F.lit(" "), day_text)
        .alias("title"),
        F.concat(day_text, F.lit("T00:00:00Z")).alias("datetime"),
        F.round(ranged("gsd", RESOLUTION), 2).alias("gsd"),
        "platform_type",
        pick("producer", PRODUCERS).alias("producer_name"),
        pick("license", LICENSES).alias("license"),
        F.concat(F.lit(base_url + "/imagery/"), "id", F.lit(".tif")).alias("cog_href"),
        F.concat(F.lit(base_url + "/thumbnails/"), "id", F.lit(".webp")).alias("thumbnail_href"),
        F.floor(F.col("width").cast("bigint") * F.col("height") * 3 * _between(draw("bytes"), 0.3, 0.8))
        .alias("file_size"),
        "width",
        "height",
        F.when(F.col("platform_type") == "satellite", whole("bands", 3, 4)).otherwise(3).alias("bands"),
        F.lit(3857).alias("epsg"),
        F.concat(F.lit("user-"), whole("user", 1000, 9999).cast("string")).alias("uploaded_by"),
        uploaded.alias("uploaded_at"),
        make_bbox(w, s, e, n).alias("bbox"),
    ]
    if geometry:
        columns.append(box_wkb(w, s, e, n).alias("geometry"))
    return to_catalog_schema(rows.select(*columns))


def _between(draw: Column, low: float, high: float) -> Column:
    return F.lit(low) + draw * (high - low)
