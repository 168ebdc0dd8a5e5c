"""Every registered query, over whole tables, with its checking SQL."""

from __future__ import annotations

import datetime as dt
import functools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions import dates, geo, text, tiles, utm
from skyledger.functions.wkb import wkb_bounds
from skyledger.operators import features, ingest, merge, raster, spatial_join, stats, status
from skyledger.operators.search import (
    SearchParams, get_item, legacy_hrefs, next_page, number_pages, page_of, search,
)
from skyledger.plans import fixtures as fx
from skyledger.plans.registry import query
from skyledger.schema import CATALOG_SCHEMA, make_bbox, to_catalog_schema
from skyledger.session import scratch_path
from skyledger.sources import buckets, clustered, jobs, kept
from skyledger.sources import catalog as store
from skyledger.sources import pending as sidecars
from skyledger.sources import records
from skyledger.sources.sample import sample_catalog
from skyledger.streaming import merge as merge_stream
from skyledger.streaming import sidecars as sidecar_stream
from skyledger.streaming import state
from skyledger.streaming import status as status_stream

VIEW = (-20.0, -40.0, 60.0, 40.0)
BASE_URL = "https://store.example"
AS_OF = dt.date(1998, 7, 1)
PROCESSED_AT = "2024-03-01T09:30:00+00:00"
EDGES = ("xmin", "ymin", "xmax", "ymax")

RESULT = """id, title, datetime, gsd, platform_type, producer_name, license, cog_href, thumbnail_href,
  file_size, width, height, bands, epsg, uploaded_by, uploaded_at,
  bbox_xmin AS bbox_west, bbox_ymin AS bbox_south, bbox_xmax AS bbox_east, bbox_ymax AS bbox_north"""
IN_VIEW = "bbox_xmax >= -20 AND bbox_xmin <= 60 AND bbox_ymax >= -40 AND bbox_ymin <= 40"
NEWEST = "ORDER BY datetime DESC NULLS LAST, id ASC NULLS LAST"
FLAT = """id, title, datetime, gsd, platform_type, producer_name, license, cog_href, thumbnail_href,
  file_size, width, height, bands, epsg, uploaded_by, uploaded_at"""


def flat(df: DataFrame, *extra: str) -> DataFrame:
    """Catalog rows with the bbox edges as columns and without geometry bytes."""
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    return df.select(*plain, *[F.col(f"bbox.{n}").alias(f"bbox_{n}") for n in EDGES], *extra)


def rounded(box: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(f"{box}.{n}"), digits).alias(n) for n in EDGES]


# --- search ---------------------------------------------------------------------------


def search_query(name: str, where: str, params: SearchParams) -> None:
    tail = f"{NEWEST} LIMIT {params.limit}" if params.limit else ""

    @query(name, f"SELECT {RESULT} FROM catalog {'WHERE ' + where if where else ''} {tail}", ("catalog",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(fx.catalog(spark, sf_dir), params)


search_query("search_bbox", IN_VIEW, SearchParams(bbox=VIEW, limit=None))
search_query(
    "search_bbox_within",
    "bbox_xmin >= -20 AND bbox_xmax <= 60 AND bbox_ymin >= -40 AND bbox_ymax <= 40",
    SearchParams(bbox=VIEW, bbox_mode="within", limit=None),
)
search_query(
    "search_wrap",
    "(bbox_xmax >= 165 OR bbox_xmin <= -170) AND bbox_ymax >= -40 AND bbox_ymin <= 40",
    SearchParams(bbox=(165, -40, -170, 40), wrap=True, limit=None),
)
search_query(
    "search_dates",
    "datetime >= '1996-01-01' AND datetime <= '1998-06-30T23:59:59.999Z'",
    SearchParams(date_start="1996-01-01", date_end="1998-06-30", limit=None),
)
search_query(
    "search_dates_timestamp",
    "CAST(substr(datetime, 1, 10) AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'",
    SearchParams(date_start="1996-01-01", date_end="1998-06-30", date_mode="timestamp", limit=None),
)
search_query(
    "search_platform", "lower(platform_type) IN ('uav', 'drone')", SearchParams(platform="uav", limit=None)
)
search_query(
    "search_platform_exact", "lower(platform_type) = 'uav'", SearchParams(platform="UAV", limit=None)
)
search_query(
    "search_license", "lower(license) LIKE '%cc-by-4.0%'", SearchParams(license="CC-BY-4.0", limit=None)
)
search_query("search_gsd", "gsd <= 3", SearchParams(max_gsd=3, limit=None))
search_query(
    "search_text", "lower(title) LIKE '%0% mosaic_a%'", SearchParams(query="0% Mosaic_A", limit=None)
)
search_query(
    "search_text_literal", "contains(lower(title), '0% mosaic_a')",
    SearchParams(query="0% Mosaic_A", literal=True, limit=None),
)
search_query("search_newest", "", SearchParams())
FULL = SearchParams(
    bbox=VIEW, date_start="1996-01-01", date_end="1998-06-30", platform="uav", license="CC-BY-4.0", max_gsd=3
)
FULL_WHERE = f"""{IN_VIEW} AND datetime >= '1996-01-01' AND datetime <= '1998-06-30T23:59:59.999Z'
  AND lower(platform_type) IN ('uav', 'drone') AND lower(license) LIKE '%cc-by-4.0%' AND gsd <= 3"""
search_query("search_full", FULL_WHERE, FULL)
PRESET = dates.date_preset("month", AS_OF)
search_query(
    "search_preset", "datetime >= '1998-06-01' AND datetime <= '1998-07-01T23:59:59.999Z'",
    SearchParams(date_start=PRESET[0], date_end=PRESET[1], limit=None),
)


@query("get_item", f"SELECT {FLAT}, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax FROM catalog WHERE id = 'img-0000000042'",
       ("catalog",))
def run_get_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(get_item(fx.catalog(spark, sf_dir), "img-0000000042"))


@query("legacy_hrefs", "SELECT id, cog_href FROM catalog WHERE cog_href LIKE '%legacy-store%'", ("catalog",))
def run_legacy_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy_hrefs(fx.catalog(spark, sf_dir), "legacy-store")


@query(
    "search_pages",
    """SELECT id, datetime, rank, CAST((rank - 1) // 10 + 1 AS INTEGER) AS page,
      total - least(((rank - 1) // 10 + 1) * 10, total) AS remaining
    FROM (SELECT id, datetime, CAST(row_number() OVER (ORDER BY datetime DESC, id) AS INTEGER) AS rank, count(*) OVER () AS total
      FROM (SELECT * FROM catalog ORDER BY datetime DESC, id LIMIT 200) t) r""",
    ("catalog",),
)
def run_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = number_pages(search(fx.catalog(spark, sf_dir)))
    return pages.select("id", "datetime", "rank", "page", "remaining")


@query(
    "search_all_pages",
    """SELECT id, datetime, rank, CAST((rank - 1) // 10 + 1 AS INTEGER) AS page,
      total - least(((rank - 1) // 10 + 1) * 10, total) AS remaining
    FROM (SELECT id, datetime, CAST(row_number() OVER (ORDER BY datetime DESC, id) AS INTEGER) AS rank, count(*) OVER () AS total
      FROM catalog) r""",
    ("catalog",),
)
def run_search_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = number_pages(search(fx.catalog(spark, sf_dir), SearchParams(limit=None)))
    return pages.select("id", "datetime", "rank", "page", "remaining")


@query(
    "search_next_page",
    f"SELECT id, datetime FROM catalog WHERE datetime < '1997-03-01' OR (datetime = '1997-03-01' AND id > 'img-0000000100') {NEWEST} LIMIT 10",
    ("catalog",),
)
def run_search_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = search(fx.catalog(spark, sf_dir), SearchParams(limit=None))
    return next_page(results, ("1997-03-01", "img-0000000100")).select("id", "datetime")


@query("search_page_3", f"SELECT id, datetime FROM catalog {NEWEST} LIMIT 10 OFFSET 20", ("catalog",))
def run_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_of(search(fx.catalog(spark, sf_dir), SearchParams(limit=None)), 3).select("id", "datetime")


# --- statistics -----------------------------------------------------------------------


@query(
    "catalog_stats",
    """SELECT count(*) AS total_images, min(datetime) AS earliest, max(datetime) AS latest,
      count(DISTINCT platform_type) AS platform_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size_bytes
    FROM catalog""",
    ("catalog",),
)
def run_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.catalog_stats(fx.catalog(spark, sf_dir))


@query(
    "catalog_summary",
    """SELECT count(*) AS records, substr(min(datetime), 1, 10) AS first_day, substr(max(datetime), 1, 10) AS last_day
    FROM catalog""",
    ("catalog",),
)
def run_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.catalog_summary(fx.catalog(spark, sf_dir))


@query(
    "catalog_extent",
    """SELECT min(bbox_xmin) AS xmin, min(bbox_ymin) AS ymin, max(bbox_xmax) AS xmax, max(bbox_ymax) AS ymax
    FROM catalog""",
    ("catalog",),
)
def run_catalog_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.catalog_extent(fx.catalog(spark, sf_dir))


@query(
    "extent",
    "SELECT id, geom_xmin AS xmin, geom_ymin AS ymin, geom_xmax AS xmax, geom_ymax AS ymax FROM catalog",
    ("catalog",),
)
def run_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.bbox_ring(F.col("footprint"))
    around = fx.catalog_with_footprint(spark, sf_dir).select("id", geo.points_extent(ring).alias("around"))
    return around.select("id", "around.*")


# --- merge ----------------------------------------------------------------------------

MERGED = """merged AS (SELECT * FROM catalog UNION ALL BY NAME SELECT * FROM pending),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY uploaded_at DESC, title DESC NULLS LAST) AS rn FROM merged) m
  WHERE rn = 1)"""
FILLED = ", ".join(f"coalesce(bbox_{n}, geom_{n}) AS bbox_{n}" for n in EDGES)


def base_and_pending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        fx.with_geometry(fx.catalog_with_footprint(spark, sf_dir)),
        fx.with_geometry(fx.pending_with_footprint(spark, sf_dir)).drop("bbox"),
    )


@query(
    "union_by_name",
    f"""SELECT {FLAT}, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax FROM catalog
    UNION ALL SELECT {FLAT}, NULL, NULL, NULL, NULL FROM pending""",
    ("catalog", "pending"),
)
def run_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = fx.pending_with_footprint(spark, sf_dir).drop("bbox", "footprint")
    reordered = late.select(*sorted(late.columns, reverse=True)).withColumn("width", F.col("width").cast("bigint"))
    return flat(merge.union_by_name(fx.catalog(spark, sf_dir), reordered))


@query(
    "dedup_latest",
    f"SELECT {FLAT}, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax FROM latest",
    ("catalog", "pending"), MERGED,
)
def run_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = fx.pending_with_footprint(spark, sf_dir).drop("footprint")
    return flat(merge.latest_per_id(merge.union_by_name(fx.catalog(spark, sf_dir), late)))


@query(
    "bbox_backfill",
    f"SELECT id, {FILLED} FROM catalog",
    ("catalog",),
)
def run_bbox_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.with_geometry(fx.catalog_with_footprint(spark, sf_dir))
    return merge.backfill_bbox(base).select("id", *[F.col(f"bbox.{n}").alias(f"bbox_{n}") for n in EDGES])


@query("merge_catalog", f"SELECT {FLAT}, {FILLED} FROM latest", ("catalog", "pending"), MERGED)
def run_merge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.merge_catalog(*base_and_pending(spark, sf_dir)))


@query("merge_incremental", f"SELECT {FLAT}, {FILLED} FROM latest", ("catalog", "pending"), MERGED)
def run_merge_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.merge_catalog(*base_and_pending(spark, sf_dir), base_unique=True))


def land_pending(spark: SparkSession, sf_dir: str) -> str:
    """Write the pending rows as sidecars in five folders with one file each."""
    path = scratch_path(spark, "pending")
    late = base_and_pending(spark, sf_dir)[1]
    part = (F.substring("id", 5, 10).cast("bigint") % 5).alias("part")
    late.select("*", part).repartition(5, "part").write.partitionBy("part").parquet(path)
    return path


@query(
    "pending_scan",
    f"SELECT {FLAT}, geom_xmin, geom_ymin, geom_xmax, geom_ymax FROM pending",
    ("pending",),
)
def run_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sidecars.read_pending(spark, land_pending(spark, sf_dir))
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    around = rows.select(*plain, wkb_bounds(F.col("geometry")).alias("around"))
    return around.select(*plain, *[F.col(f"around.{n}").alias(f"geom_{n}") for n in EDGES])


@query(
    "merge_report",
    """SELECT (SELECT count(*) FROM merged) AS rows_before,
      (SELECT count(DISTINCT CAST(substr(id, 5) AS BIGINT) % 5) FROM pending) AS merged,
      (SELECT count(*) FROM latest) AS rows_after,
      (SELECT count(coalesce(bbox_xmin, geom_xmin)) FROM latest) AS rows_with_bbox""",
    ("catalog", "pending"), MERGED,
)
def run_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_and_pending(spark, sf_dir)[0]
    late = sidecars.read_pending(spark, land_pending(spark, sf_dir))
    return merge.merge_report(base, late, merge.merge_catalog(base, late.drop("source_file")))


@query(
    "update_hrefs",
    """SELECT c.id, coalesce(u.new_href, c.cog_href) AS cog_href, c.title
    FROM catalog c LEFT JOIN href_updates u ON c.id = u.id""",
    ("catalog", "href_updates"),
)
def run_update_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = merge.update_hrefs(fx.catalog(spark, sf_dir), fx.href_updates(spark, sf_dir))
    return updated.select("id", "cog_href", "title")


def roundtrip(spark: SparkSession, sf_dir: str, order: str, row_group: int = store.ROW_GROUP) -> DataFrame:
    path = scratch_path(spark, f"catalog-{order}")
    store.write_catalog(fx.catalog(spark, sf_dir), path, order, row_group)
    return flat(store.read_catalog(spark, path))


ALL_FLAT = f"SELECT {FLAT}, bbox_xmin, bbox_ymin, bbox_xmax, bbox_ymax FROM catalog"


@query("write_catalog_roundtrip", ALL_FLAT, ("catalog",))
def run_write_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "id")


@query("write_clustered_roundtrip", ALL_FLAT, ("catalog",))
def run_write_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "hilbert", store.SMALL_ROW_GROUP)


@query("write_datetime_roundtrip", ALL_FLAT, ("catalog",))
def run_write_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "datetime", store.SMALL_ROW_GROUP)


# --- joins ----------------------------------------------------------------------------

HITS = """hits AS (SELECT p.event_id, c.id, c.title AS hit_title FROM points p JOIN catalog c
  ON c.bbox_xmax >= p.lon AND c.bbox_xmin <= p.lon AND c.bbox_ymax >= p.lat AND c.bbox_ymin <= p.lat)"""


def hits_to_find(spark: SparkSession, sf_dir: str) -> spatial_join.Hits:
    images = fx.catalog(spark, sf_dir).withColumnRenamed("title", "hit_title")
    return spatial_join.Hits(images, fx.points(spark, sf_dir), ["id", "hit_title"], ["event_id"], spatial_join.point_hits)


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hits_to_find(spark, sf_dir)
    return spatial_join.point_hits(hits.images, hits.points, hits.image_keys, hits.point_keys)


@query("point_hits", "SELECT event_id, id FROM hits", ("points", "catalog"), HITS)
def run_point_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_hits(spark, sf_dir).select("event_id", "id")


@query(
    "overlap_counts",
    """SELECT event_id, count(DISTINCT id) AS images,
      CASE WHEN count(DISTINCT id) > 1 THEN count(DISTINCT id) || ' images here' END AS heading
    FROM hits GROUP BY event_id""",
    ("points", "catalog"), HITS,
)
def run_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spatial_join.overlap_counts(all_hits(spark, sf_dir), ["event_id"])
    return counts.withColumn("heading", text.overlap_text(F.col("images")))


@query(
    "hit_features",
    """SELECT h.event_id, h.id, coalesce(c.title, h.hit_title) AS title, c.gsd, c.producer_name
    FROM (SELECT DISTINCT event_id, id, hit_title FROM hits WHERE id IS NOT NULL AND id <> '') h
    LEFT JOIN (SELECT * FROM catalog WHERE gsd <= 3) c ON h.id = c.id""",
    ("points", "catalog"), HITS,
)
def run_hit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = search(fx.catalog(spark, sf_dir), SearchParams(max_gsd=3, limit=None))
    full = spatial_join.hit_features(hits_to_find(spark, sf_dir), shown, ["event_id"], {"title": "hit_title"})
    return full.select("event_id", "id", "title", "gsd", "producer_name")


# Winding numbers: a ring holds what lies on its border or inside; a polygon holds what its first ring holds and no hole has inside.
POLYGON_HITS = """boxes AS (SELECT id, min(x1) AS x0, min(y1) AS y0, max(x1) AS x3, max(y1) AS y3 FROM outlines GROUP BY id),
sides AS (SELECT event_id, o.id, polygon, ring, lon, lat, x1, y1, x2, y2, (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1) AS side
  FROM points JOIN boxes b ON lon BETWEEN x0 AND x3 AND lat BETWEEN y0 AND y3 JOIN outlines o ON o.id = b.id),
rings AS (SELECT event_id, id, polygon, ring, sum(CASE WHEN y1 <= lat AND y2 > lat AND side > 0 THEN 1 WHEN y1 > lat AND y2 <= lat AND side < 0 THEN -1 ELSE 0 END) <> 0 AS inside,
    bool_or(side = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS border
  FROM sides GROUP BY event_id, id, polygon, ring),
held AS (SELECT event_id, id, polygon FROM rings GROUP BY event_id, id, polygon HAVING bool_and(CASE WHEN ring = 0 THEN inside OR border ELSE border OR NOT inside END)),
drawn AS (SELECT DISTINCT event_id, id FROM held)"""


def drawn_hits_to_find(spark: SparkSession, sf_dir: str) -> spatial_join.Hits:
    images = spatial_join.drawn_images(fx.outlined(spark, sf_dir), ["id"], box=None)
    find = functools.partial(spatial_join.polygon_hits, drawn=True)
    return spatial_join.Hits(images, fx.points(spark, sf_dir), ["id"], ["event_id"], find)


@query("polygon_hits", "SELECT event_id, id FROM drawn", ("points", "outlines"), POLYGON_HITS)
def run_polygon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_join.polygon_hits(fx.outlined(spark, sf_dir), fx.points(spark, sf_dir), ["id"], ["event_id"], box=None)


@query(
    "polygon_features",
    """SELECT d.event_id, d.id, c.title, c.gsd, c.producer_name, count(*) OVER (PARTITION BY d.event_id) AS images
    FROM drawn d LEFT JOIN catalog c ON c.id = d.id""",
    ("points", "outlines", "catalog"), POLYGON_HITS,
)
def run_polygon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = drawn_hits_to_find(spark, sf_dir)
    counts = spatial_join.overlap_counts(hits, ["event_id"])
    shown = fx.catalog(spark, sf_dir).select("id", "title", "gsd", "producer_name")
    full = spatial_join.hit_features(hits, shown, ["event_id"], of_points=counts)
    return full.select("event_id", "id", "title", "gsd", "producer_name", "images")


@query(
    "viewport_counts",
    """SELECT v.view_id, v.name, count(c.id) AS images,
      CASE count(c.id) WHEN 0 THEN 'No images in view' WHEN 1 THEN '1 image in view'
        ELSE count(c.id) || ' images in view' END AS heading
    FROM viewports v LEFT JOIN catalog c ON c.bbox_xmax >= v.west AND c.bbox_xmin <= v.east
      AND c.bbox_ymax >= v.south AND c.bbox_ymin <= v.north
    GROUP BY v.view_id, v.name""",
    ("viewports", "catalog"),
)
def run_viewport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spatial_join.viewport_counts(fx.catalog(spark, sf_dir), fx.viewports(spark, sf_dir), ["view_id"])
    return counts.select("view_id", "name", "images", text.count_text(F.col("images")).alias("heading"))


# --- features and display texts -------------------------------------------------------

PROPERTIES = """id, coalesce(nullif(title, ''), 'Untitled Image') AS title, datetime, datetime AS date, gsd,
  coalesce(nullif(platform_type, ''), 'unknown') AS platform, platform_type,
  coalesce(nullif(producer_name, ''), 'Unknown') AS producer_name,
  coalesce(nullif(producer_name, ''), 'Unknown') AS provider,
  coalesce(nullif(license, ''), 'Unknown') AS license, thumbnail_href AS thumbnail,
  cog_href, thumbnail_href, file_size, width, height, bands, epsg, uploaded_by, uploaded_at"""


@query("feature_props", f"SELECT {PROPERTIES} FROM catalog", ("catalog",))
def run_feature_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_properties(search(fx.catalog(spark, sf_dir), SearchParams(limit=None)))


@query(
    "geojson_features",
    """SELECT id, 'Feature' AS type, 'Polygon' AS geometry_type, 5 AS points,
      coalesce(nullif(title, ''), 'Untitled Image') AS title, coalesce(nullif(platform_type, ''), 'unknown') AS platform,
      bbox_xmin AS lon1, bbox_ymin AS lat1, bbox_xmax AS lon2, bbox_ymin AS lat2, bbox_xmax AS lon3, bbox_ymax AS lat3,
      bbox_xmin AS lon4, bbox_ymax AS lat4, bbox_xmin AS lon5, bbox_ymin AS lat5
    FROM catalog""",
    ("catalog",),
)
def run_geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "geojson")
    found = search(fx.catalog(spark, sf_dir), SearchParams(limit=None))
    records.write_lines(features.geojson_lines(found), path)
    shape = (
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties struct<id: string, title: string, platform: string>"
    )
    lines = spark.read.schema(shape).json(path)
    ring = F.col("geometry.coordinates")[0]
    return lines.select(
        "properties.id", "type", F.col("geometry.type").alias("geometry_type"), F.size(ring).alias("points"),
        "properties.title", "properties.platform",
        *[ring[i][j].alias(f"{axis}{i + 1}") for i in range(5) for j, axis in enumerate(("lon", "lat"))],
    )


@query(
    "stac_items",
    """SELECT id, '1.1.0' AS stac_version, 'community' AS collection, bbox_xmin AS west, bbox_ymin AS south,
      bbox_xmax AS east, bbox_ymax AS north, bbox_xmax AS third_lon, bbox_ymax AS third_lat, datetime, gsd,
      platform_type, producer_name, license, epsg, uploaded_at AS created, cog_href AS visual, thumbnail_href AS thumbnail
    FROM catalog""",
    ("catalog",),
)
def run_stac_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = features.stac_items(fx.catalog(spark, sf_dir))
    item, p = F.col("item"), F.col("item.properties")
    third = item["geometry"]["coordinates"][0][2]
    return items.select(
        item["id"].alias("id"), item["stac_version"].alias("stac_version"), item["collection"].alias("collection"),
        *[item["bbox"][i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))],
        third[0].alias("third_lon"), third[1].alias("third_lat"), p["datetime"].alias("datetime"), p["gsd"].alias("gsd"),
        p["img:platform_type"].alias("platform_type"), p["img:producer_name"].alias("producer_name"),
        p["license"].alias("license"), p["proj:epsg"].alias("epsg"), p["created"].alias("created"),
        item["assets"]["visual"]["href"].alias("visual"), item["assets"]["thumbnail"]["href"].alias("thumbnail"),
    )


@query(
    "display_fields",
    """SELECT id, strftime(CAST(substr(datetime, 1, 10) AS DATE), '%-d %b %Y') AS date_text,
      CASE WHEN platform_type IS NULL OR platform_type = '' THEN 'Unknown'
        WHEN lower(platform_type) IN ('uav', 'drone') THEN 'Drone'
        ELSE upper(substr(platform_type, 1, 1)) || lower(substr(platform_type, 2)) END AS platform_text,
      CASE WHEN file_size IS NULL OR file_size = 0 THEN 'Unknown'
        WHEN file_size >= 1073741824 THEN printf('%.2f GB', file_size / 1073741824.0)
        ELSE CAST(floor(file_size / 1048576.0 + 0.5) AS BIGINT) || ' MB' END AS size_text,
      CASE WHEN file_size IS NULL THEN NULL ELSE printf('%.1f MB', file_size / 1048576.0) END AS upload_size_text,
      CASE WHEN gsd IS NULL OR gsd = 0 THEN 'N/A' ELSE printf('%.2f m', gsd) END AS gsd_text,
      CASE WHEN area IS NULL THEN 'Unknown' WHEN area >= 1e6 THEN printf('%.2f km²', area / 1e6)
        WHEN area >= 1e4 THEN printf('%.1f ha', area / 1e4) ELSE CAST(floor(area + 0.5) AS BIGINT) || ' m²' END AS area_text
    FROM (SELECT *, abs(radians(bbox_xmax - bbox_xmin) * (sin(radians(bbox_ymax)) - sin(radians(bbox_ymin)))
        * (6371000.0 * 6371000.0)) AS area FROM catalog) c""",
    ("catalog",),
)
def run_display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.display_fields(fx.catalog(spark, sf_dir))


JOSM_ESCAPES = [("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")]


def encoded_sql(value: str) -> str:
    value = f"url_encode({value})"
    for found, wanted in JOSM_ESCAPES:
        value = f"replace({value}, '{found}', '{wanted}')"
    return value


@query(
    "editor_links",
    f"""SELECT id, 'https://www.openstreetmap.org/edit?editor=id#map=16/'
      || regexp_replace(CAST((geom_ymin + geom_ymax) / 2 AS VARCHAR), '\\.0$', '') || '/'
      || regexp_replace(CAST((geom_xmin + geom_xmax) / 2 AS VARCHAR), '\\.0$', '') AS id_link,
      'http://127.0.0.1:8111/imagery?title=' || {encoded_sql("'Image - ' || coalesce(nullif(title, ''), id)")}
      || '&type=tms&url=' || {encoded_sql("cog_href")} AS josm_link
    FROM catalog""",
    ("catalog",),
)
def run_editor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.editor_links(fx.catalog_with_footprint(spark, sf_dir), "footprint", "Image - ")


@query(
    "license_labels",
    """SELECT license, count(*) AS images,
      CASE WHEN license IS NULL OR license = '' THEN 'Any License' WHEN contains(license, 'SA') THEN 'CC BY-SA'
        WHEN contains(license, 'NC') THEN 'CC BY-NC' ELSE 'CC BY' END AS label,
      regexp_replace(license, '[ -]', '-', 'g') AS canonical
    FROM catalog GROUP BY license""",
    ("catalog",),
)
def run_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.catalog(spark, sf_dir).groupBy("license").agg(F.count("*").alias("images"))
    value = F.col("license")
    return counts.select(
        "license", "images", text.license_filter_label(value).alias("label"), text.canonical_license(value).alias("canonical")
    )


@query(
    "platform_labels",
    """SELECT platform_type, count(*) AS images,
      CASE platform_type WHEN 'satellite' THEN 'Satellite' WHEN 'uav' THEN 'Drone' WHEN 'aircraft' THEN 'Other'
        ELSE 'All Platforms' END AS label
    FROM catalog GROUP BY platform_type""",
    ("catalog",),
)
def run_platform_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.catalog(spark, sf_dir).groupBy("platform_type").agg(F.count("*").alias("images"))
    return counts.withColumn("label", text.platform_filter_label(F.col("platform_type")))


@query(
    "date_labels",
    """SELECT range_start, range_end, count(*) AS images,
      CASE WHEN range_start = '' AND range_end = '' THEN 'Any Date'
        WHEN range_start = '1998-06-24' AND range_end = '1998-07-01' THEN 'Past Week'
        WHEN range_start = '1998-06-01' AND range_end = '1998-07-01' THEN 'Past Month'
        WHEN range_start = '1998-01-01' THEN 'This Year' ELSE 'Custom Date' END AS label
    FROM (SELECT CASE WHEN gsd IS NULL THEN '' ELSE substr(datetime, 1, 10) END AS range_start,
        CASE WHEN gsd IS NULL THEN '' ELSE '1998-07-01' END AS range_end FROM catalog) r
    GROUP BY range_start, range_end""",
    ("catalog",),
)
def run_date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.col("gsd").isNull()
    ranges = fx.catalog(spark, sf_dir).select(
        F.when(none, "").otherwise(F.substring("datetime", 1, 10)).alias("range_start"),
        F.when(none, "").otherwise(AS_OF.isoformat()).alias("range_end"),
    )
    counts = ranges.groupBy("range_start", "range_end").agg(F.count("*").alias("images"))
    return counts.withColumn("label", dates.date_range_label(F.col("range_start"), F.col("range_end"), AS_OF))


# --- geometry -------------------------------------------------------------------------


@query(
    "viewport_ring",
    """SELECT view_id, west AS lon1, north AS lat1, east AS lon2, north AS lat2, east AS lon3, south AS lat3,
      west AS lon4, south AS lat4, west AS lon5, north AS lat5 FROM viewports""",
    ("viewports",),
)
def run_viewport_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a gazetteer gives it: south, north, west, east, as text.
    named = F.array(*[F.col(n).cast("string") for n in ("south", "north", "west", "east")])
    areas = fx.viewports(spark, sf_dir).select("view_id", geo.reorder_gazetteer_box(named).alias("area"))
    rings = areas.select("view_id", geo.bbox_ring(F.col("area"), "outline").alias("ring"))
    return rings.select(
        "view_id",
        *[F.col("ring")[i][j].alias(f"{axis}{i + 1}") for i in range(5) for j, axis in enumerate(("lon", "lat"))],
    )


@query(
    "centroids",
    """SELECT id, (bbox_xmin + bbox_xmax) / 2 AS lon, (bbox_ymin + bbox_ymax) / 2 AS lat
    FROM catalog WHERE bbox_xmin IS NOT NULL""",
    ("catalog",),
)
def run_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(fx.catalog(spark, sf_dir), SearchParams(limit=None)).where("bbox_west IS NOT NULL")
    return features.centroids(features.geojson_features(found))


@query(
    "footprint_area",
    """SELECT id, round(area, 3) AS box_km2, round(area, 3) AS ring_km2
    FROM (SELECT id, abs(radians(geom_xmax - geom_xmin) * (sin(radians(geom_ymax)) - sin(radians(geom_ymin)))
        * (6371000.0 * 6371000.0)) / 1e6 AS area FROM catalog) a""",
    ("catalog",),
)
def run_footprint_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.col("footprint")
    return fx.catalog_with_footprint(spark, sf_dir).select(
        "id",
        F.round(geo.bbox_area_m2(box) / 1e6, 3).alias("box_km2"),
        F.round(geo.ring_area_m2(geo.bbox_ring(box)) / 1e6, 3).alias("ring_km2"),
    )


HILBERT = """walk AS (
  SELECT id, CAST(least(65535, greatest(0, floor(((geom_xmin + geom_xmax) / 2 + 180) * (65536 / 360.0)))) AS BIGINT) AS x,
    CAST(least(65535, greatest(0, floor(((geom_ymin + geom_ymax) / 2 + 90) * (65536 / 180.0)))) AS BIGINT) AS y,
    CAST(32768 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM catalog
  UNION ALL
  SELECT id,
    CASE WHEN (y & s) <> 0 THEN x WHEN (x & s) <> 0 THEN 65535 - y ELSE y END,
    CASE WHEN (y & s) <> 0 THEN y WHEN (x & s) <> 0 THEN 65535 - x ELSE x END,
    s // 2, d + s * s * CASE WHEN (x & s) <> 0 THEN CASE WHEN (y & s) <> 0 THEN 2 ELSE 3 END
      ELSE CASE WHEN (y & s) <> 0 THEN 1 ELSE 0 END END
  FROM walk WHERE s > 0)"""


def hilbert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.catalog_with_footprint(spark, sf_dir).select("id", "footprint")
    return geo.with_hilbert_key(boxes, "footprint").select("id", "hilbert")


@query("hilbert_key", "SELECT id, d AS hilbert FROM walk WHERE s = 0", ("catalog",), HILBERT, recursive=True)
def run_hilbert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_keys(spark, sf_dir)


@query(
    "hilbert_order", "SELECT id, d AS hilbert FROM walk WHERE s = 0 ORDER BY d, id", ("catalog",), HILBERT, recursive=True
)
def run_hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_keys(spark, sf_dir).orderBy("hilbert", "id")


@query(
    "wkb_bounds",
    "SELECT id, geom_xmin AS xmin, geom_ymin AS ymin, geom_xmax AS xmax, geom_ymax AS ymax FROM catalog",
    ("catalog",),
)
def run_wkb_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.with_geometry(fx.catalog_with_footprint(spark, sf_dir))
    return base.select("id", wkb_bounds(F.col("geometry")).alias("around")).select("id", "around.*")


BOUNDS = """placed AS (SELECT *, degrees(mx0 / 6378137.0) AS lon0, degrees((mx0 + width * res_x) / 6378137.0) AS lon1,
  degrees(2 * atan(exp(my0 / 6378137.0)) - pi() / 2) AS lat0,
  degrees(2 * atan(exp((my0 + height * res_x) / 6378137.0)) - pi() / 2) AS lat1 FROM raster_meta)"""


@query(
    "reproject_bounds",
    """SELECT upload_key, round(lon0, 6) AS xmin, round(lat0, 6) AS ymin, round(lon1, 6) AS xmax, round(lat1, 6) AS ymax
    FROM placed""",
    ("raster_meta",), BOUNDS,
)
def run_reproject_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ingest.with_mercator_bounds(fx.raster_meta(spark, sf_dir))
    return placed.select("upload_key", *rounded("bounds"))


TILES = """tiles AS (SELECT id,
  CAST(least(63, greatest(0, floor((bbox_xmin + 180) / 360 * 64))) AS BIGINT) AS x0,
  CAST(least(63, greatest(0, floor((bbox_xmax + 180) / 360 * 64))) AS BIGINT) AS x1,
  CAST(least(63, greatest(0, floor((1 - ln(tan(radians(bbox_ymax)) + 1 / cos(radians(bbox_ymax))) / pi()) / 2 * 64))) AS BIGINT) AS y0,
  CAST(least(63, greatest(0, floor((1 - ln(tan(radians(bbox_ymin)) + 1 / cos(radians(bbox_ymin))) / pi()) / 2 * 64))) AS BIGINT) AS y1
  FROM catalog WHERE bbox_xmin IS NOT NULL)"""


@query(
    "tile_cover",
    """SELECT id, 6 AS z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y
    FROM (SELECT id, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM tiles) a) b""",
    ("catalog",), TILES,
)
def run_tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.explode_tiles(fx.catalog(spark, sf_dir).select("id", "bbox"), 6).select("id", "z", "x", "y")


PYRAMID = """edges AS (SELECT id, (bbox_xmin + 180) / 360 AS w, (bbox_xmax + 180) / 360 AS e,
    (1 - ln(tan(radians(bbox_ymax)) + 1 / cos(radians(bbox_ymax))) / pi()) / 2 AS n,
    (1 - ln(tan(radians(bbox_ymin)) + 1 / cos(radians(bbox_ymin))) / pi()) / 2 AS s FROM wide),
deep AS (SELECT *, CAST(least(14, 3 + least(14, floor(-log2(greatest(e - w, s - n))))) AS INTEGER) AS deepest FROM edges),
grids AS (SELECT *, CAST(1 << z AS DOUBLE) AS size FROM (SELECT *, unnest(range(0, deepest + 1)) AS z FROM deep) d),
touched AS (SELECT *, unnest(range(CAST(least(size - 1, floor(w * size)) AS BIGINT), CAST(least(size - 1, floor(e * size)) AS BIGINT) + 1)) AS x FROM grids),
cells AS (SELECT *, unnest(range(CAST(least(size - 1, floor(n * size)) AS BIGINT), CAST(least(size - 1, floor(s * size)) AS BIGINT) + 1)) AS y FROM touched),
kept_cells AS (SELECT id, z, x, y, deepest, x >= w * size AND x + 1 <= e * size AND y >= n * size AND y + 1 <= s * size AS whole FROM cells
  WHERE z = 0 OR NOT (x >> 1 >= w * size / 2 AND (x >> 1) + 1 <= e * size / 2 AND y >> 1 >= n * size / 2 AND (y >> 1) + 1 <= s * size / 2)),
wide AS (SELECT 0)"""
WIDE = """wide AS (SELECT id, bbox_xmin, bbox_ymin, CASE WHEN k % 300 = 0 THEN least(bbox_xmin + 50 + k % 90, 180) ELSE bbox_xmax END AS bbox_xmax,
    CASE WHEN k % 300 = 0 THEN least(bbox_ymin + 20 + k % 50, 85) ELSE bbox_ymax END AS bbox_ymax
  FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k FROM catalog) c WHERE bbox_xmin IS NOT NULL AND k % 4 = 0)"""
PYRAMID = WIDE + ",\n" + PYRAMID.replace(",\nwide AS (SELECT 0)", "")


@query(
    "tile_pyramid",
    """SELECT id, CAST(z AS INTEGER) AS z, count(*) AS tiles, count(*) FILTER (whole) AS whole, count(*) FILTER (whole OR z = deepest) AS leaves,
      CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x * y) AS BIGINT) AS sum_xy FROM kept_cells GROUP BY id, z""",
    ("catalog",), PYRAMID,
)
def run_tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the footprints, of which one in 75 is as large as a country."""
    k, box = F.substring("id", 5, 10).cast("bigint"), F.col("bbox")
    grown = make_bbox(
        box["xmin"], box["ymin"], F.least(box["xmin"] + 50 + k % 90, F.lit(180.0)), F.least(box["ymin"] + 20 + k % 50, F.lit(85.0))
    )
    wide = fx.catalog(spark, sf_dir).where((k % 4 == 0) & box.isNotNull()).select("id", F.when(k % 300 == 0, grown).otherwise(box).alias("bbox"))
    rows = tiles.tile_pyramid(wide, detail=3)
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    return rows.groupBy("id", "z").agg(
        F.count("*").alias("tiles"), F.count_if("whole").alias("whole"), F.count_if("leaf").alias("leaves"),
        F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"), F.sum(x * y).alias("sum_xy"),
    )


def utm_sql(x: str, y: str) -> str:
    """Longitude and latitude of a UTM position in ``zone``, north or ``south``."""
    xi, eta = f"(({y}) - CASE WHEN south THEN 10000000.0 ELSE 0.0 END) / {utm.RADIUS_M!r}", f"(({x}) - 500000.0) / {utm.RADIUS_M!r}"
    beta = [f"{b!r}" for b in utm.BETA]
    xi1 = "xi" + "".join(f" - {b} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, b in enumerate(beta, 1))
    eta1 = "eta" + "".join(f" - {b} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, b in enumerate(beta, 1))
    lat = "chi" + "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(utm.DELTA, 1))
    return f"""SELECT upload_key, zone * 6 - 183 + degrees(atan2((exp(eta1) - exp(-eta1)) / 2, cos(xi1))) AS lon, degrees({lat}) AS lat
      FROM (SELECT *, asin(sin(xi1) / ((exp(eta1) + exp(-eta1)) / 2)) AS chi
      FROM (SELECT *, {xi1} AS xi1, {eta1} AS eta1 FROM (SELECT *, {xi} AS xi, {eta} AS eta FROM sides) a) b) c"""


UTM = f"""rasters AS (SELECT upload_key, 1 + upload_key % 60 AS zone, upload_key % 2 = 1 AS south,
    180000.0 + upload_key * 9973 % 600000 AS x0, CASE WHEN upload_key % 2 = 1 THEN 1200000.0 ELSE 0.0 END + upload_key * 7817 % 8700000 AS y0,
    (100 + upload_key % 900) * 20.0 AS w, (100 + upload_key % 700) * 20.0 AS h FROM raster_meta),
steps AS (SELECT *, CAST(i AS DOUBLE) / 21 AS t FROM (SELECT *, unnest(range(0, 22)) AS i FROM rasters) r),
sides AS (SELECT upload_key, zone, south, x0 + w * t AS px, y0 AS py FROM steps UNION ALL SELECT upload_key, zone, south, x0 + w * t, y0 + h FROM steps
  UNION ALL SELECT upload_key, zone, south, x0, y0 + h * t FROM steps UNION ALL SELECT upload_key, zone, south, x0 + w, y0 + h * t FROM steps),
spots AS ({utm_sql("px", "py")})"""


@query(
    "utm_bounds",
    """SELECT upload_key, round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax
    FROM spots GROUP BY upload_key""",
    ("raster_meta",), UTM,
)
def run_utm_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 20 m pixels in all zones, north and south."""
    key = F.col("upload_key")
    rasters = fx.raster_meta(spark, sf_dir).select(
        "upload_key", (F.when(key % 2 == 1, 32701).otherwise(32601) + key % 60).alias("epsg"),
        (180000.0 + key * 9973 % 600000).alias("x0"), (F.when(key % 2 == 1, 1200000.0).otherwise(0.0) + key * 7817 % 8700000).alias("y0"),
        ((100 + key % 900) * 20.0).alias("w"), ((100 + key % 700) * 20.0).alias("h"),
    )
    bounds = utm.projected_bounds(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"), F.col("epsg"))
    # Few bytes but much arithmetic for each raster: a small file must not be one task.
    rasters = rasters.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rasters.withColumn("bounds", bounds).select("upload_key", *rounded("bounds"))


# --- ingest ---------------------------------------------------------------------------

REASON = """CASE WHEN bands IS NULL OR width IS NULL OR height IS NULL OR file_size IS NULL THEN 'Image metadata missing'
  WHEN bands = 0 THEN 'Image has no bands'
  WHEN width < 10 OR height < 10 THEN 'Image too small: ' || width || 'x' || height
  WHEN file_size > 524288000 THEN printf('File too large: %.0fMB (max 500MB)', file_size / 1048576.0)"""


@query("validate_rasters", f"SELECT upload_key, {REASON} END AS reason FROM raster_meta", ("raster_meta",))
def run_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(fx.raster_meta(spark, sf_dir)).select("upload_key", "reason")


@query(
    "validate_strict",
    f"""SELECT upload_key, {REASON} WHEN upload_key % 11 = 0 THEN 'Image has no CRS'
      WHEN NOT (lon0 < lon1 AND lat0 < lat1 AND lon0 >= -180 AND lon1 <= 180 AND lat0 >= -90 AND lat1 <= 90)
        THEN 'Invalid bounds'
      WHEN lon0 <= 0 AND lon1 >= 0 AND lat0 <= 0 AND lat1 >= 0 THEN 'Bounds at null island' END AS reason
    FROM (SELECT *, degrees(mx / 6378137.0) AS lon0, degrees((mx + width * res_x) / 6378137.0) AS lon1,
        degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2) AS lat0,
        degrees(2 * atan(exp((my + height * res_x) / 6378137.0)) - pi() / 2) AS lat1
      FROM (SELECT *, CASE WHEN upload_key % 7 = 1 THEN -5.0 WHEN upload_key % 7 = 2 THEN 20037500.0 ELSE mx0 END AS mx,
          CASE WHEN upload_key % 7 = 1 THEN -5.0 ELSE my0 END AS my FROM raster_meta) r) p""",
    ("raster_meta",),
)
def run_validate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("upload_key")
    moved = fx.raster_meta(spark, sf_dir).withColumns(
        {
            "epsg": F.when(k % 11 == 0, None).otherwise(F.col("epsg")),
            "mx0": F.when(k % 7 == 1, -5.0).when(k % 7 == 2, 20037500.0).otherwise(F.col("mx0")),
            "my0": F.when(k % 7 == 1, -5.0).otherwise(F.col("my0")),
        }
    )
    return ingest.validate(ingest.with_mercator_bounds(moved), strict=True).select("upload_key", "reason")


@query(
    "sidecar_rows",
    f"""SELECT CAST(r.upload_key AS VARCHAR) AS id, coalesce(m.title, 'Untitled') AS title, '2024-03-01' AS datetime,
      round(res_x, 4) AS gsd, coalesce(m.platform, '') AS platform_type, '' AS producer_name,
      coalesce(m.license, 'CC-BY 4.0') AS license,
      'https://store.example/imagery/' || r.upload_key || '.tif' AS cog_href,
      'https://store.example/thumbnails/' || r.upload_key || '.webp' AS thumbnail_href,
      file_size, width, height, bands, 3857 AS epsg, '' AS uploaded_by, '2024-03-01T09:30:00+00:00' AS uploaded_at,
      round(lon0, 6) AS xmin, round(lat0, 6) AS ymin, round(lon1, 6) AS xmax, round(lat1, 6) AS ymax
    FROM placed r LEFT JOIN upload_meta m ON r.upload_key = m.upload_key WHERE ({REASON} END) IS NULL""",
    ("raster_meta", "upload_meta"), BOUNDS,
)
def run_sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = ingest.split_valid(ingest.validate(fx.raster_meta(spark, sf_dir)))
    rows = ingest.sidecar_rows(
        ingest.with_mercator_bounds(valid), fx.upload_meta(spark, sf_dir), "upload_key", PROCESSED_AT, BASE_URL
    )
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    return rows.select(*plain, wkb_bounds(F.col("geometry")).alias("around")).select(*plain, *rounded("around"))


def import_pages(spark: SparkSession, sf_dir: str) -> str:
    """Land the catalog as nested JSON pages of at most one hundred records, one page per line."""
    k = F.substring("id", 5, 10).cast("bigint")
    box = F.col("footprint")
    ring = geo.bbox_ring(box)
    # Of the records to be dropped some have no geometry, others one that cannot be read.
    shape = F.when(k % 39 == 13, "{}").when(k % 39 == 26, '{"type":"Blob","coordinates":[1]}').when(k % 13 == 0, None).when(
        k % 11 == 5, F.format_string('{"type":"Point","coordinates":[%s,%s]}', box["xmin"], box["ymin"])
    ).when(
        k % 4 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.to_json(F.array(ring)), F.lit("]}"))
    ).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array(ring)), F.lit("}")))
    thumbnail = F.when(k % 3 == 0, F.concat(F.lit("https://src.example/"), "id", F.lit(".png"))).when(
        k % 3 == 1, F.concat(F.lit("https://src.example/"), "id", F.lit(".jpg"))
    ).otherwise("")
    plain = F.struct(
        F.col("id").alias("_id"), "title", F.col("producer_name").alias("provider"),
        F.col("platform_type").alias("platform"), F.col("uploaded_by").alias("contact"), F.col("cog_href").alias("uuid"),
        F.when(k % 19 == 0, 0.0).otherwise(F.col("gsd") / 100000).alias("gsd"), "file_size",
        F.when(k % 23 != 0, F.col("datetime")).alias("acquisition_start"), "uploaded_at",
        F.struct(thumbnail.alias("thumbnail")).alias("properties"),
    )
    # The geometry is appended as raw JSON, as the source nests it.
    record = F.concat(
        F.regexp_replace(F.to_json(plain), r"\}$", ""),
        F.when(shape.isNotNull(), F.concat(F.lit(',"geojson":'), shape)).otherwise(""), F.lit("}"),
    )
    rows = fx.catalog_with_footprint(spark, sf_dir).select(F.floor(k / 100).alias("page"), record.alias("record"))
    pages = rows.groupBy("page").agg(F.concat_ws(",", F.collect_list("record")).alias("records"))
    path = scratch_path(spark, "pages")
    records.write_lines(
        pages.select(F.concat(F.lit('{"meta":{"found":1},"results":['), "records", F.lit("]}")).alias("value")), path
    )
    return path


@query(
    "import_json",
    """SELECT id, coalesce(title, 'Untitled') AS title, acquired AS datetime,
      CASE WHEN k % 19 = 0 THEN NULL ELSE round(gsd / 100000 * 111320, 2) END AS gsd,
      lower(coalesce(nullif(platform_type, ''), 'unknown')) AS platform_type,
      coalesce(producer_name, 'Unknown') AS producer_name, 'CC-BY-4.0' AS license, cog_href,
      CASE k % 3 WHEN 0 THEN 'https://store.example/thumbnails/' || id || '.png'
        WHEN 1 THEN 'https://store.example/thumbnails/' || id || '.webp' END AS thumbnail_href,
      coalesce(file_size, 0) AS file_size, CAST(NULL AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height,
      3 AS bands, 4326 AS epsg, uploaded_by, uploaded_at,
      geom_xmin AS bbox_xmin, geom_ymin AS bbox_ymin,
      CASE WHEN k % 11 = 5 THEN geom_xmin ELSE geom_xmax END AS bbox_xmax,
      CASE WHEN k % 11 = 5 THEN geom_ymin ELSE geom_ymax END AS bbox_ymax,
      geom_xmin AS wkb_xmin, CASE WHEN k % 11 = 5 THEN geom_ymin ELSE geom_ymax END AS wkb_ymax
    FROM (SELECT *, CASE WHEN k % 23 <> 0 THEN datetime ELSE uploaded_at END AS acquired
      FROM (SELECT *, CAST(substr(id, 5) AS BIGINT) AS k FROM catalog) c) a
    WHERE k % 13 <> 0 AND acquired >= '1997-01-01'""",
    ("catalog",),
)
def run_import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = records.read_pages(spark, import_pages(spark, sf_dir))
    rows = ingest.import_records(landed, BASE_URL, acquired_from="1997-01-01")
    around = rows.withColumn("around", wkb_bounds(F.col("geometry")))
    return flat(around, "around").select(
        "*", F.col("around.xmin").alias("wkb_xmin"), F.col("around.ymax").alias("wkb_ymax")
    ).drop("around")


@query(
    "import_rejects",
    """SELECT id, CASE WHEN k % 39 = 0 THEN 'No geometry' ELSE 'Geometry cannot be read' END AS reason
    FROM (SELECT id, CAST(substr(id, 5) AS BIGINT) AS k FROM catalog) c WHERE k % 13 = 0""",
    ("catalog",),
)
def run_import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_rejects(records.read_pages(spark, import_pages(spark, sf_dir)))


@query(
    "import_version",
    """SELECT id, coalesce(title, 'Untitled') AS title, cog_href, geom_xmin AS bbox_xmin, geom_ymin AS bbox_ymin
    FROM catalog WHERE CAST(substr(id, 5) AS BIGINT) % 13 <> 0""",
    ("catalog",),
)
def run_import_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "imports")
    jobs.import_catalog(records.read_pages(spark, import_pages(spark, sf_dir)), root, BASE_URL, buckets=8)
    return flat(buckets.read_buckets(spark, root)).select("id", "title", "cog_href", "bbox_xmin", "bbox_ymin")


@query(
    "convert_version",
    """SELECT id, title, CASE WHEN cog_href LIKE '%legacy-store%' AND CAST(substr(id, 5) AS BIGINT) % 12 = 0
      THEN 'https://store.example/imagery/' || id || '.tif' ELSE cog_href END AS cog_href FROM catalog""",
    ("catalog",),
)
def run_convert_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "addresses")
    buckets.write_buckets(fx.catalog(spark, sf_dir), root, 8)
    own = F.substring("id", 5, 10).cast("bigint") % 12 == 0
    buckets.convert_buckets(spark, root, "legacy-store", F.when(own, text.image_href(BASE_URL, F.col("id"))))
    return buckets.read_buckets(spark, root).select("id", "title", "cog_href")


@query("search_ranges", f"SELECT {RESULT} FROM catalog WHERE {IN_VIEW}", ("catalog",))
def run_search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "places")
    clustered.write_places(fx.catalog(spark, sf_dir), path, store.SMALL_ROW_GROUP)
    return search(clustered.read_places(spark, path, VIEW), SearchParams(bbox=VIEW, limit=None))


@query(
    "search_ranges_wrap",
    f"SELECT {RESULT} FROM catalog WHERE (bbox_xmax >= 165 OR bbox_xmin <= -170) AND bbox_ymax >= -40 AND bbox_ymin <= 40",
    ("catalog",),
)
def run_search_ranges_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, view = scratch_path(spark, "places"), (165, -40, -170, 40)
    clustered.write_places(fx.catalog(spark, sf_dir), path)
    return search(clustered.read_places(spark, path, view, wrap=True), SearchParams(bbox=view, wrap=True, limit=None))


@query("viewport_files", f"SELECT id, title, bbox_xmin, bbox_ymin FROM catalog WHERE {IN_VIEW}", ("catalog",))
def run_viewport_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog ordered by cells, and files added after that; the viewport as ranges of cells."""
    path = scratch_path(spark, "places")
    rows, late = fx.catalog(spark, sf_dir), F.substring("id", 5, 10).cast("bigint") % 10 == 3
    clustered.write_places(rows.where(~late), path, partitions=8)
    clustered.write_places(rows.where(late), path, partitions=2, mode="append")
    near = search(clustered.read_places(spark, path, VIEW), SearchParams(bbox=VIEW, limit=None))
    return near.select("id", "title", F.col("bbox_west").alias("bbox_xmin"), F.col("bbox_south").alias("bbox_ymin"))


@query(
    "object_keys",
    """SELECT object_key, CASE WHEN len(string_split(object_key, '/')) >= 3 THEN string_split(object_key, '/')[2] END AS upload_id,
      CASE WHEN len(string_split(object_key, '/')) < 3 THEN 'Unexpected key format: ' || object_key END AS reason
    FROM (SELECT CASE WHEN upload_key % 17 = 0 THEN upload_key || '/image.tif' ELSE object_key END AS object_key
      FROM raster_meta) k""",
    ("raster_meta",),
)
def run_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("upload_key")
    keys = fx.raster_meta(spark, sf_dir).select(
        F.when(k % 17 == 0, F.concat(k.cast("string"), F.lit("/image.tif"))).otherwise(F.col("object_key")).alias("object_key")
    )
    return ingest.object_uploads(keys)


@query(
    "tiff_names",
    r"""SELECT file_name, regexp_replace(file_name, '\.tiff?$', '', 'i') AS title
    FROM (SELECT source || '-' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.tiff'
      WHEN 3 THEN '.png' ELSE '.tif.zip' END AS file_name FROM documents) f
    WHERE regexp_matches(file_name, '\.tiff?$', 'i')""",
)
def run_tiff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    ending = F.when(k == 0, ".tif").when(k == 1, ".TIFF").when(k == 2, ".tiff").when(k == 3, ".png").otherwise(".tif.zip")
    names = fx.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), ending).alias("file_name")
    )
    return ingest.tiff_uploads(names)


def md5_draw(index: int) -> str:
    return (
        f"(CAST('0x' || substr(md5('0:' || o_orderkey || ':{index // 4}'), {1 + 8 * (index % 4)}, 8) AS BIGINT)"
        " / 4294967296.0)"
    )


def sample_sql() -> str:
    from skyledger.sources import sample as s

    def pick(index: int, values: list) -> str:
        listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
        return f"[{listed}][CAST(floor({md5_draw(index)} * {len(values)}) AS BIGINT) + 1]"

    def ranged(index: int, ranges: dict) -> str:
        cases = " ".join(
            f"WHEN '{name}' THEN {low} + {md5_draw(index)} * {high - low!r}" for name, (low, high) in ranges.items()
        )
        return f"CASE platform_type {cases} END"

    return f"""SELECT substr(h, 1, 8) || '-' || substr(h, 9, 3) AS id,
      place || ' ' || country || ' - ' || upper(platform_type[1]) || platform_type[2:] || ' ' || day AS title,
      day || 'T00:00:00Z' AS datetime, round({ranged(9, s.RESOLUTION)}, 2) AS gsd, platform_type,
      {pick(3, s.PRODUCERS)} AS producer_name, {pick(2, s.LICENSES)} AS license,
      'https://store.example/imagery/' || substr(h, 1, 8) || '-' || substr(h, 9, 3) || '.tif' AS cog_href,
      'https://store.example/thumbnails/' || substr(h, 1, 8) || '-' || substr(h, 9, 3) || '.webp' AS thumbnail_href,
      CAST(floor(CAST(width AS BIGINT) * height * 3 * (0.3 + {md5_draw(12)} * {0.8 - 0.3!r})) AS BIGINT) AS file_size,
      width, height,
      CAST(CASE platform_type WHEN 'satellite' THEN 3 + floor({md5_draw(13)} * 2) ELSE 3 END AS INTEGER) AS bands,
      3857 AS epsg, 'user-' || CAST(1000 + floor({md5_draw(14)} * 9000) AS BIGINT) AS uploaded_by,
      CAST(CAST(day AS DATE) + CAST(later // 24 AS INTEGER) AS VARCHAR) || 'T' || lpad(CAST(later % 24 AS VARCHAR), 2, '0')
        || ':00:00Z' AS uploaded_at,
      round(lon - hw, 9) AS xmin, round(lat - hh, 9) AS ymin, round(lon + hw, 9) AS xmax, round(lat + hh, 9) AS ymax
    FROM (SELECT *, {ranged(5, s.HALF_WIDTH)} AS hw, {ranged(6, s.HALF_HEIGHT)} AS hh,
        CAST(CASE platform_type WHEN 'uav' THEN {pick(10, s.UAV_WIDTHS)} ELSE {pick(10, s.LARGE_SIDES)} END AS INTEGER) AS width,
        CAST(CASE platform_type WHEN 'uav' THEN {pick(11, s.UAV_HEIGHTS)} ELSE {pick(11, s.LARGE_SIDES)} END AS INTEGER) AS height
      FROM (SELECT o_orderkey, md5('0:' || o_orderkey || ':4') AS h,
          {pick(0, [p[0] for p in s.PLACES])} AS place, {pick(0, [p[1] for p in s.PLACES])} AS country,
          {pick(0, [p[2] for p in s.PLACES])} + (-0.1 + {md5_draw(7)} * 0.2) AS lon,
          {pick(0, [p[3] for p in s.PLACES])} + (-0.1 + {md5_draw(8)} * 0.2) AS lat,
          {pick(1, s.PLATFORMS)} AS platform_type,
          CAST(DATE '1998-07-01' - CAST(1 + floor({md5_draw(4)} * 730) AS INTEGER) AS VARCHAR) AS day,
          CAST(1 + floor({md5_draw(15)} * 48) AS BIGINT) AS later FROM orders) a) b"""


@query("sample_catalog", f"SELECT *, xmin AS wkb_xmin, ymin AS wkb_ymin, xmax AS wkb_xmax, ymax AS wkb_ymax FROM ({sample_sql()}) made")
def run_sample_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.table(spark, sf_dir, "orders").select("o_orderkey")
    rows = sample_catalog(keys, "o_orderkey", AS_OF, BASE_URL).withColumn("around", wkb_bounds(F.col("geometry")))
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    drawn = [c.alias(f"wkb_{n}") for n, c in zip(EDGES, rounded("around", 9), strict=True)]
    return rows.select(*plain, *rounded("bbox", 9), *drawn)


# --- rasters --------------------------------------------------------------------------

# Every image has 4 bands of 4 x 4 pixels; some keep only one or two bands.
BANDS = """banded AS (SELECT image_id, px % 4 + 1 AS band, px // 4 // 4 AS row, px // 4 % 4 AS col, value FROM pixels
  WHERE px % 4 < CASE image_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END),
rgb AS (SELECT image_id, row, col, b1 AS r, CASE WHEN n >= 3 THEN b2 ELSE b1 END AS g, CASE WHEN n >= 3 THEN b3 ELSE b1 END AS b
  FROM (SELECT image_id, row, col, max(value) FILTER (WHERE band = 1) AS b1, max(value) FILTER (WHERE band = 2) AS b2,
    max(value) FILTER (WHERE band = 3) AS b3, max(band) AS n FROM banded GROUP BY image_id, row, col) q),
channels AS (SELECT image_id, row, col, 'r' AS channel, r AS value FROM rgb
  UNION ALL SELECT image_id, row, col, 'g', g FROM rgb UNION ALL SELECT image_id, row, col, 'b', b FROM rgb),
sorted AS (SELECT image_id, list_sort(list(value)) AS v FROM channels WHERE value > 0 GROUP BY image_id),
ranges AS (SELECT image_id, {LERP_LOW} AS vmin, {LERP_HIGH} AS vmax FROM sorted)"""


def lerp_sql(share: float) -> str:
    """Linear interpolation between the neighbouring ranks, rounded as NumPy rounds it."""
    place = f"((len(v) - 1) * CAST({share} AS DOUBLE))"
    low, high = f"v[CAST(floor{place} AS BIGINT) + 1]", f"v[CAST(ceil{place} AS BIGINT) + 1]"
    part = f"({place} - floor{place})"
    return (
        f"CASE WHEN {part} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {part}) ELSE {low} + ({high} - {low}) * {part} END"
    )


BANDS = BANDS.replace("{LERP_LOW}", lerp_sql(raster.LOW)).replace("{LERP_HIGH}", lerp_sql(raster.HIGH))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("px")
    kept = F.when(F.col("image_id") % 5 == 0, 1).when(F.col("image_id") % 5 == 1, 2).otherwise(4)
    return fx.pixels(spark, sf_dir).where(px % 4 < kept).select(
        "image_id", (px % 4 + 1).alias("band"), F.floor(px / 16).cast("int").alias("row"),
        (F.floor(px / 4) % 4).cast("int").alias("col"), "value",
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.unpivot_rgb(raster.compose_rgb(banded(spark, sf_dir)))


@query("rgb_compose", "SELECT image_id, row, col, r, g, b FROM rgb", ("pixels",), BANDS)
def run_rgb_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.compose_rgb(banded(spark, sf_dir))


@query(
    "pixel_percentiles", "SELECT image_id, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM ranges", ("pixels",), BANDS
)
def run_pixel_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = raster.percentile_range(channels(spark, sf_dir))
    return ranges.select("image_id", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query(
    "pixel_stretch",
    """SELECT c.image_id, row, col, channel, CASE WHEN coalesce(vmax, 1) > coalesce(vmin, 0)
      THEN CAST(floor(least(255.0, greatest(0.0, (value - coalesce(vmin, 0)) / (coalesce(vmax, 1) - coalesce(vmin, 0)) * 255)))
        AS INTEGER) ELSE 0 END AS value
    FROM channels c LEFT JOIN ranges r ON c.image_id = r.image_id""",
    ("pixels",), BANDS,
)
def run_pixel_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.normalise(channels(spark, sf_dir), bits=16)


MASKS = """masks AS (SELECT image_id, row, col, CASE WHEN value > 1000 THEN 0 ELSE 255 END AS mask FROM banded WHERE band = 1)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = banded(spark, sf_dir).where("band = 1")
    return first.select("image_id", "row", "col", F.when(F.col("value") > 1000, 0).otherwise(255).alias("mask"))


@query(
    "mask_flag", "SELECT image_id, max(mask <> 255) AS has_mask FROM masks GROUP BY image_id", ("pixels",),
    BANDS + "," + MASKS,
)
def run_mask_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mask_flags(masks(spark, sf_dir))


@query(
    "mask_alpha",
    """SELECT c.image_id, c.row, c.col, r, g, b, CASE WHEN has_mask THEN mask END AS alpha
    FROM rgb c JOIN masks m ON c.image_id = m.image_id AND c.row = m.row AND c.col = m.col
    JOIN (SELECT image_id, max(mask <> 255) AS has_mask FROM masks GROUP BY image_id) f ON c.image_id = f.image_id""",
    ("pixels",), BANDS + "," + MASKS,
)
def run_mask_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.with_alpha(raster.compose_rgb(banded(spark, sf_dir)), masks(spark, sf_dir))


@query(
    "thumbnail_grid",
    """SELECT image_id, CAST(g.i AS INTEGER) AS row, CAST(h.i AS INTEGER) AS col, value
    FROM (SELECT image_id, px // w AS row, px % w AS col, value, 64 // w AS h, w
      FROM (SELECT *, CASE image_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 32 END AS w FROM pixels) s) p
    JOIN (SELECT unnest(range(6)) AS i) g ON p.row = (2 * g.i + 1) * p.h // 12
    JOIN (SELECT unnest(range(6)) AS i) h ON p.col = (2 * h.i + 1) * p.w // 12""",
    ("pixels",),
)
def run_thumbnail_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 8 x 8, 16 x 4 and 2 x 32 images onto 6 x 6: both directions shrink and grow.
    width = F.when(F.col("image_id") % 3 == 0, 8).when(F.col("image_id") % 3 == 1, 4).otherwise(32)
    sized = fx.pixels(spark, sf_dir).withColumn("width", width).select(
        "image_id", F.floor(F.col("px") / F.col("width")).cast("int").alias("row"),
        (F.col("px") % F.col("width")).alias("col"), "value",
        F.floor(64 / F.col("width")).cast("int").alias("height"), "width",
    )
    return raster.thumbnail(sized, 6).select("image_id", "row", "col", "value")


# Images of 4 bands and 4 x 4, 2 x 8 or 16 x 1 pixels; some keep one or two bands. One in four has NaN
# pixels, one in seven 8 bits. Masks have the size of their image.
RENDER = """sized AS (SELECT image_id, px % 4 + 1 AS band, px // 4 // w AS row, px // 4 % w AS col, 16 // w AS h, w,
    image_id % 7 = 0 AS plain, CASE WHEN image_id % 7 = 0 THEN CAST(least(value, 255) AS DOUBLE)
      WHEN image_id % 4 = 2 AND px % 11 = 3 THEN CAST('NaN' AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS value
  FROM (SELECT *, CASE image_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 1 END AS w FROM pixels) s
  WHERE px % 4 < CASE image_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END),
grid AS (SELECT image_id, band, plain, CAST(g.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, value FROM sized p
  JOIN (SELECT unnest(range(6)) AS i) g ON p.row = (2 * g.i + 1) * p.h // 12
  JOIN (SELECT unnest(range(6)) AS i) c ON p.col = (2 * c.i + 1) * p.w // 12),
rgb AS (SELECT image_id, plain, row, col, b1 AS r, CASE WHEN n >= 3 THEN b2 ELSE b1 END AS g, CASE WHEN n >= 3 THEN b3 ELSE b1 END AS b
  FROM (SELECT image_id, plain, row, col, max(value) FILTER (WHERE band = 1) AS b1, max(value) FILTER (WHERE band = 2) AS b2,
    max(value) FILTER (WHERE band = 3) AS b3, max(band) AS n FROM grid GROUP BY ALL) q),
channels AS (SELECT image_id, r AS value FROM rgb UNION ALL SELECT image_id, g FROM rgb UNION ALL SELECT image_id, b FROM rgb),
sorted AS (SELECT image_id, list_sort(list(value)) AS v FROM channels WHERE NOT isnan(value) AND value > 0 GROUP BY image_id),
ranges AS (SELECT image_id, {LERP_LOW} AS vmin, {LERP_HIGH} AS vmax FROM sorted),
flags AS (SELECT image_id, max(value > 1000 AND NOT isnan(value)) AS has_mask FROM grid WHERE band = 1 GROUP BY image_id),
shown AS (SELECT c.*, coalesce(vmin, 0) AS lo, coalesce(vmax, 1) AS hi, has_mask FROM rgb c
  LEFT JOIN ranges g ON c.image_id = g.image_id JOIN flags f ON c.image_id = f.image_id)"""
RENDER = RENDER.replace("{LERP_LOW}", lerp_sql(raster.LOW)).replace("{LERP_HIGH}", lerp_sql(raster.HIGH))


def byte_sql(name: str) -> str:
    return f"""CAST(CASE WHEN plain THEN {name} WHEN isnan({name}) OR hi <= lo THEN 0
      ELSE floor(least(255.0, greatest(0.0, ({name} - lo) / (hi - lo) * 255))) END AS INTEGER) AS {name}"""


@query(
    "thumbnail_render",
    f"""SELECT image_id, row, col, {byte_sql("r")}, {byte_sql("g")}, {byte_sql("b")},
      CASE WHEN has_mask THEN CASE WHEN r > 1000 AND NOT isnan(r) THEN 0 ELSE 255 END END AS alpha FROM shown""",
    ("pixels",), RENDER,
)
def run_thumbnail_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, px, value = F.col("image_id"), F.col("px"), F.col("value").cast("double")
    width = F.when(image % 3 == 0, 4).when(image % 3 == 1, 8).otherwise(1)
    bands = F.when(image % 5 == 0, 1).when(image % 5 == 1, 2).otherwise(4)
    plain = image % 7 == 0
    shown = F.when(plain, F.least(value, F.lit(255.0))).when((image % 4 == 2) & (px % 11 == 3), float("nan")).otherwise(value)
    sized = fx.pixels(spark, sf_dir).where(px % 4 < bands).withColumn("width", width).select(
        "image_id", (px % 4 + 1).alias("band"), F.floor(F.floor(px / 4) / F.col("width")).cast("int").alias("row"),
        (F.floor(px / 4) % F.col("width")).cast("int").alias("col"), shown.alias("value"),
        F.floor(16 / F.col("width")).cast("int").alias("height"), "width", F.when(plain, 8).otherwise(16).alias("bits"),
    )
    above = (F.col("value") > 1000) & ~F.isnan("value")
    mask = sized.where("band = 1").withColumn("mask", F.when(above, 0).otherwise(255))
    return raster.render(sized, mask, 6)


# --- status and streams ---------------------------------------------------------------

LATEST = """newest AS (SELECT upload_id, arg_max(step, ts) AS step, arg_max(status, ts) AS status, max(ts) AS ts
  FROM status_events GROUP BY upload_id)"""
STEP_LIST = "['downloading', 'validating', 'converting', 'thumbnail', 'uploading', 'cataloging', 'done']"
LIMIT = "INTERVAL 363 SECOND"
STATUS_AS_OF = "2024-01-30 12:00:00"


def as_of_status() -> Column:
    return F.lit(STATUS_AS_OF).cast("timestamp_ntz")


def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of status writes."""
    schema = fx.table(spark, sf_dir, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return fx.derive(spark, fx.STATUS_EVENTS, events=feed)


@query(
    "latest_status_ties",
    f"""SELECT upload_id, day AS ts, step, status FROM (SELECT *, row_number() OVER (PARTITION BY upload_id
        ORDER BY day DESC, status IN ('complete', 'error') DESC, list_position({STEP_LIST}, step) DESC, status DESC) AS place
      FROM (SELECT *, date_trunc('day', ts) AS day FROM status_events) d) r WHERE place = 1""",
    ("status_events",),
)
def run_latest_status_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.status_events(spark, sf_dir)
    kind = events.schema["ts"].dataType
    return status.latest_status(events.withColumn("ts", F.date_trunc("day", "ts").cast(kind)))


@query("latest_status", "SELECT upload_id, ts, step, status FROM newest", ("status_events",), LATEST)
def run_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "status")
    feed = status_feed(spark, sf_dir)
    status_stream.start_latest_status(feed, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return status_stream.read_latest_status(spark, f"{path}/log", feed.schema)


@query(
    "status_json",
    """SELECT upload_id, CASE status
      WHEN 'complete' THEN '{"status":"complete","step":"done","upload_id":"' || upload_id
        || '","cog_url":"https://store.example/imagery/' || upload_id || '.tif","thumbnail_url":"https://store.example/thumbnails/'
        || upload_id || '.webp","title":"Upload ' || upload_id || '","completed_at":"2024-03-01T09:30:00+00:00"}'
      WHEN 'error' THEN '{"status":"error","upload_id":"' || upload_id || '","error":"failed at ' || step || '"}'
      ELSE '{"status":"processing","upload_id":"' || upload_id || '","step":"' || step || '"}' END AS value
    FROM newest""",
    ("status_events",), LATEST,
)
def run_status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = status.latest_status(fx.status_events(spark, sf_dir)).withColumns(
        {
            "title": F.concat(F.lit("Upload "), F.col("upload_id").cast("string")),
            "completed_at": F.lit(PROCESSED_AT),
            "error": F.concat(F.lit("failed at "), "step"),
        }
    )
    return status.status_record(latest, BASE_URL)


@query(
    "upload_outcomes",
    f"""SELECT CAST(upload_key AS VARCHAR) AS upload_id, CASE WHEN reason IS NULL
      THEN '{{"status":"complete","step":"done","upload_id":"' || upload_key || '","cog_url":"https://store.example/imagery/'
        || upload_key || '.tif","thumbnail_url":"https://store.example/thumbnails/' || upload_key
        || '.webp","title":"","completed_at":"2024-03-01T09:30:00+00:00"}}'
      ELSE '{{"status":"error","upload_id":"' || upload_key || '","error":"' || reason || '"}}' END AS value
    FROM (SELECT upload_key, {REASON} END AS reason FROM raster_meta) c""",
    ("raster_meta",),
)
def run_upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ingest.validate(fx.raster_meta(spark, sf_dir))
    return status.status_record(status.outcomes(checked, "upload_key", PROCESSED_AT), BASE_URL)


@query(
    "step_progress",
    f"""SELECT upload_id, CAST(i AS INTEGER) AS position, ({STEP_LIST})[i + 1] AS step,
      CASE WHEN reached > i THEN 'done' WHEN reached = i THEN 'active' ELSE 'pending' END AS state
    FROM (SELECT upload_id, coalesce(list_position({STEP_LIST}, step), 0) - 1 AS reached, unnest(range(7)) AS i FROM newest) s""",
    ("status_events",), LATEST,
)
def run_step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.step_progress(status.latest_status(fx.status_events(spark, sf_dir)))


@query(
    "step_funnel",
    f"""SELECT CAST(i AS INTEGER) AS position, ({STEP_LIST})[i + 1] AS step, count(*) FILTER (WHERE reached > i) AS done,
      count(*) FILTER (WHERE reached = i) AS active, count(*) FILTER (WHERE reached < i) AS pending
    FROM (SELECT coalesce(list_position({STEP_LIST}, step), 0) - 1 AS reached, unnest(range(7)) AS i FROM newest) s GROUP BY i""",
    ("status_events",), LATEST,
)
def run_step_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.step_funnel(status.latest_status(fx.status_events(spark, sf_dir)))


@query(
    "stale_uploads",
    f"""SELECT upload_id, ts, step, status FROM newest
    WHERE status NOT IN ('complete', 'error') AND ts < TIMESTAMP '{STATUS_AS_OF}' - {LIMIT}""",
    ("status_events",), LATEST,
)
def run_stale_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.stale_uploads(fx.status_events(spark, sf_dir), as_of_status())


TIMED = """spans AS (SELECT upload_id, min(ts) AS started, min(CASE WHEN status IN ('complete', 'error') THEN ts END) AS ended
  FROM status_events GROUP BY upload_id)"""
TIMED_OUT = "'Processing timed out. The image may still be processing — check back later.'"


@query(
    "poll_timeouts",
    f"""SELECT upload_id, started, 'error' AS status, {TIMED_OUT} AS error FROM spans
    WHERE started + {LIMIT} < TIMESTAMP '{STATUS_AS_OF}' AND (ended IS NULL OR ended > started + {LIMIT})""",
    ("status_events",), TIMED,
)
def run_poll_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.poll_timeouts(fx.status_events(spark, sf_dir), as_of_status())


# A write after the time-out, however late, raises no second error.
@query(
    "stream_poll_timeouts",
    f"""SELECT CAST(upload_id AS VARCHAR) AS upload_id, 'error' AS status, {TIMED_OUT} AS error, epoch_us(started) AS started FROM spans
    WHERE started + {LIMIT} < (SELECT max(ts) FROM status_events) AND (ended IS NULL OR ended > started + {LIMIT})""",
    ("status_events",), TIMED,
)
def run_stream_poll_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "timeouts")
    feed = status_feed(spark, sf_dir)
    late = state.poll_timeout_stream(feed.withColumn("ts", F.col("ts").cast("timestamp")))
    status_stream.start_append(late, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    told = spark.read.schema(late.schema).parquet(f"{path}/out")
    return told.select("upload_id", "status", "error", F.unix_micros("started").alias("started"))


@query(
    "stream_funnel",
    f"""SELECT CAST(i AS INTEGER) AS position, ({STEP_LIST})[i + 1] AS step, count(*) FILTER (WHERE reached > i) AS done,
      count(*) FILTER (WHERE reached = i) AS active, count(*) FILTER (WHERE reached < i) AS pending
    FROM (SELECT coalesce(list_position({STEP_LIST}, step), 0) - 1 AS reached, unnest(range(7)) AS i FROM newest) s GROUP BY i""",
    ("status_events",), LATEST,
)
def run_stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status writes in five files by their time, so that most uploads move on several times."""
    path = scratch_path(spark, "funnel")
    events = fx.status_events(spark, sf_dir)
    for day in range(5):
        events.where((F.dayofmonth("ts") % 5 == day)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    moves = state.step_funnel_stream(feed)
    status_stream.start_append(moves, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return state.read_funnel(spark, f"{path}/out")


@query(
    "stream_sidecars",
    f"SELECT {FLAT}, {', '.join(f'geom_{n} AS bbox_{n}' for n in EDGES)} FROM pending",
    ("pending",),
)
def run_stream_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "arrivals")
    arriving = sidecars.stream_pending(spark, land_pending(spark, sf_dir), max_files=2)
    status_stream.start_append(arriving, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    arrived = spark.read.schema(arriving.schema).parquet(f"{path}/out")
    return flat(arrived.withColumn("bbox", wkb_bounds(F.col("geometry"))))


@query(
    "stream_sidecar_join",
    f"""SELECT CAST(r.upload_key AS VARCHAR) AS id, coalesce(m.title, 'Untitled') AS title, '2024-03-01' AS datetime,
      round(res_x, 4) AS gsd, coalesce(m.platform, '') AS platform_type, '' AS producer_name,
      coalesce(m.license, 'CC-BY 4.0') AS license,
      'https://store.example/imagery/' || r.upload_key || '.tif' AS cog_href,
      'https://store.example/thumbnails/' || r.upload_key || '.webp' AS thumbnail_href,
      file_size, width, height, bands, 3857 AS epsg, '' AS uploaded_by, '2024-03-01T09:30:00+00:00' AS uploaded_at,
      round(lon0, 6) AS xmin, round(lat0, 6) AS ymin, round(lon1, 6) AS xmax, round(lat1, 6) AS ymax
    FROM placed r LEFT JOIN upload_meta m ON r.upload_key = m.upload_key WHERE ({REASON} END) IS NULL""",
    ("raster_meta", "upload_meta"), BOUNDS,
)
def run_stream_sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters in three files by time; metadata up to two minutes off, a quarter one file later, a third never."""
    path = scratch_path(spark, "join")
    key, start = F.col("upload_key"), 1_700_000_000
    valid, _ = ingest.split_valid(ingest.validate(fx.raster_meta(spark, sf_dir)))
    staged = ingest.with_mercator_bounds(valid).withColumn("staged_at", F.timestamp_seconds(start + key % 3000))
    written = fx.upload_meta(spark, sf_dir).withColumn("written_at", F.timestamp_seconds(start + key % 3000 + (key % 5 - 2) * 60))
    turn, later = F.floor(key % 3000 / 1000), F.when(key % 4 == 1, 1).otherwise(0)
    streams = []
    for name, rows, at, number in (("rasters", staged, "staged_at", turn), ("uploads", written, "written_at", turn + later)):
        for n in range(4):
            rows.where(number == n).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
        # A last raster and upload, days later, that close the time before them and are left out below.
        rows.limit(1).withColumns({"upload_key": F.lit(-1).cast("bigint"), at: F.timestamp_seconds(F.lit(start + 10**6))}).coalesce(
            1).write.mode("append").parquet(f"{path}/{name}")
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}"))
    made = sidecar_stream.stream_sidecar_rows(*streams, "upload_key", PROCESSED_AT, BASE_URL, delay="1 hour")
    status_stream.start_append(made, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.schema(made.schema).parquet(f"{path}/out").where("id <> '-1'")
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    return rows.select(*plain, wkb_bounds(F.col("geometry")).alias("around")).select(*plain, *rounded("around"))


@query(
    "merge_first",
    f"SELECT {FLAT}, {', '.join(f'geom_{n} AS bbox_{n}' for n in EDGES)} FROM pending",
    ("pending",),
)
def run_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars merged where there is no catalog yet."""
    root = scratch_path(spark, "first")
    base = store.read_catalog_or_empty(spark, f"{root}/catalog")
    late = sidecars.read_pending(spark, land_pending(spark, sf_dir)).drop("source_file")
    buckets.write_buckets(merge.merge_catalog(base, late), root, 8, unique=True)
    return flat(buckets.read_buckets(spark, root))


@query(
    "sidecar_files",
    f"SELECT {FLAT}, geom_xmin AS xmin, geom_ymin AS ymin, geom_xmax AS xmax, geom_ymax AS ymax FROM pending",
    ("pending",),
)
def run_sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars appended in three batches of uploads and read again."""
    path, rows = scratch_path(spark, "sidecars"), base_and_pending(spark, sf_dir)[1]
    for n in range(3):
        sidecars.append_sidecars(to_catalog_schema(rows.where(F.substring("id", 5, 10).cast("bigint") % 3 == n)), path)
    plain = [n for n in CATALOG_SCHEMA.names if n not in ("geometry", "bbox")]
    return sidecars.read_pending(spark, path).select(*plain, wkb_bounds(F.col("geometry")).alias("around")).select(*plain, "around.*")


def kept_catalog(spark: SparkSession, sf_dir: str) -> str:
    """A catalog with postings and partial statistics, renewed where a merge has touched it."""
    root = scratch_path(spark, "kept")
    base, late = base_and_pending(spark, sf_dir)
    buckets.write_buckets(merge.backfill_bbox(to_catalog_schema(base)), root, 8)
    kept.renew(spark, root)
    some = late.where(F.substring("id", 5, 10).cast("bigint") % 5 == 0)
    kept.renew(spark, root, buckets.merge_buckets(some, root))
    return root


KEPT = """fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY uploaded_at DESC, title DESC NULLS LAST) AS rn
    FROM (SELECT * FROM catalog UNION ALL BY NAME SELECT * FROM pending WHERE CAST(substr(id, 5) AS BIGINT) % 5 = 0) m) r WHERE rn = 1)"""


@query(
    "kept_stats",
    """SELECT count(*) AS total_images, min(datetime) AS earliest, max(datetime) AS latest,
      count(DISTINCT platform_type) AS platform_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size_bytes
    FROM fresh""",
    ("catalog", "pending"), KEPT,
)
def run_kept_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept.kept_stats(spark, kept_catalog(spark, sf_dir))


@query(
    "search_text_kept",
    """SELECT id, title, license, 'wildcards' AS how FROM fresh WHERE lower(title) LIKE '%0% mosaic_a%'
    UNION ALL SELECT id, title, license, 'literal' FROM fresh WHERE contains(lower(title), '0% mosaic_a')
    UNION ALL SELECT id, title, license, 'new' FROM fresh WHERE lower(title) LIKE '%urgent%v2%'
    UNION ALL SELECT id, title, license, 'short' FROM fresh WHERE lower(title) LIKE '%v2%'
    UNION ALL SELECT id, title, license, 'license' FROM fresh WHERE lower(license) LIKE '%cc-by-4.0%'""",
    ("catalog", "pending"), KEPT,
)
def run_search_text_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = kept_catalog(spark, sf_dir)
    wanted = {
        "wildcards": ("0% Mosaic_A", "title", False), "literal": ("0% Mosaic_A", "title", True), "new": ("Urgent%v2", "title", False),
        "short": ("V2", "title", False), "license": ("CC-BY-4.0", "license", False),
    }
    found = [kept.search_kept(spark, root, *how).select("id", "title", "license", F.lit(name).alias("how")) for name, how in wanted.items()]
    return reduce(DataFrame.unionAll, found)


@query(
    "upload_metadata",
    """SELECT CAST(upload_key AS VARCHAR) AS upload_id, CASE WHEN upload_key % 40 <> 0 THEN title END AS title,
      CASE WHEN upload_key % 40 <> 0 THEN platform END AS platform, CASE WHEN upload_key % 40 <> 0 THEN license END AS license
    FROM upload_meta WHERE upload_key % 10 = 0""",
    ("upload_meta",),
)
def run_upload_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth upload's metadata as a JSON file in a folder of its own, one in four of them unreadable."""
    path, key = scratch_path(spark, "staging"), F.col("upload_key")
    text_of = F.when(key % 40 == 0, F.lit('{"title": ')).otherwise(F.to_json(F.struct("title", "platform", "license")))
    rows = fx.upload_meta(spark, sf_dir).where(key % 10 == 0).select(key.alias("upload"), text_of.alias("value"))
    # A file each: the work is in opening and renaming them, so tasks are not joined by their few bytes, and each task renames its own.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "upload")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("upload").text(path)
    read = records.read_upload_metadata(spark, path, "part-*.txt")
    return read.select(F.regexp_replace("upload_id", "^upload=", "").alias("upload_id"), "title", "platform", "license")


@query("stream_merge", f"SELECT {FLAT}, {FILLED} FROM latest", ("catalog", "pending"), MERGED)
def run_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "merged")
    buckets.write_buckets(merge.backfill_bbox(to_catalog_schema(base_and_pending(spark, sf_dir)[0])), root, 8)
    merge_stream.start_merge(
        spark, land_pending(spark, sf_dir), root, f"{root}/checkpoint", max_files=3
    ).awaitTermination()
    return flat(buckets.read_buckets(spark, root))
