"""SQL of the input tables that the registered queries derive from the test data.

Each text runs unchanged in Spark and in the checking engine (``pixels`` has two
dialects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.wkb import box_wkb, geojson_wkb
from skyledger.schema import make_bbox, to_catalog_schema

CATALOG = r"""
SELECT 'img-' || lpad(CAST(k AS STRING), 10, '0') AS id,
  CASE k % 50 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Survey ' || o_orderpriority || ' ' || CAST(k AS STRING) || CASE k % 6 WHEN 0 THEN ' 100% mosaic_a' WHEN 3 THEN ' 100x mosaicXa' ELSE '' END END AS title,
  substr(CAST(o_orderdate AS STRING), 1, 10) || CASE k % 5 WHEN 0 THEN 'T10:30:00Z' WHEN 1 THEN '' WHEN 2 THEN 'T23:59:59Z' WHEN 3 THEN 'T23:59:59+00:00' ELSE 'T08:15:30.123456+00:00' END AS datetime,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(1 + (k * 7) % 500 AS DOUBLE) / 100 END AS gsd,
  CASE k % 8 WHEN 0 THEN 'uav' WHEN 1 THEN 'UAV' WHEN 2 THEN 'drone' WHEN 3 THEN 'satellite' WHEN 4 THEN 'Satellite' WHEN 5 THEN 'aircraft' WHEN 6 THEN '' ELSE NULL END AS platform_type,
  CASE o_custkey % 20 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Producer ' || CAST(o_custkey % 97 AS STRING) END AS producer_name,
  CASE k % 6 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'CC-BY 4.0' WHEN 2 THEN 'CC-BY-SA-4.0' WHEN 3 THEN 'CC-BY-NC-4.0' WHEN 4 THEN 'CC0 1.0' ELSE NULL END AS license,
  CASE WHEN k % 4 = 0 THEN 'https://legacy-store.example/' ELSE 'https://store.example/' END || 'imagery/' || CAST(k AS STRING) || '.tif' AS cog_href,
  CASE WHEN k % 9 = 0 THEN NULL ELSE 'https://store.example/thumbnails/' || CAST(k AS STRING) || '.webp' END AS thumbnail_href,
  CASE WHEN k % 31 = 0 THEN NULL ELSE (k * 7919 * 1009) % 3000000000 END AS file_size,
  CAST(4000 + (k % 8) * 500 AS INT) AS width, CAST(3000 + (k % 5) * 750 AS INT) AS height,
  CAST(CASE WHEN k % 10 = 0 THEN 4 ELSE 3 END AS INT) AS bands, CAST(3857 AS INT) AS epsg,
  'user-' || CAST(o_custkey AS STRING) AS uploaded_by,
  substr(CAST(o_orderdate AS STRING), 1, 10) || 'T12:00:00Z' AS uploaded_at,
  gx AS geom_xmin, gy AS geom_ymin, gx + w AS geom_xmax, gy + h AS geom_ymax,
  CASE WHEN k % 29 = 0 THEN NULL ELSE gx END AS bbox_xmin, CASE WHEN k % 29 = 0 THEN NULL ELSE gy END AS bbox_ymin,
  CASE WHEN k % 29 = 0 THEN NULL ELSE gx + w END AS bbox_xmax, CASE WHEN k % 29 = 0 THEN NULL ELSE gy + h END AS bbox_ymax
FROM (SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority,
        CAST((o_orderkey * 37) % 35000 AS DOUBLE) / 100 - 180 AS gx, CAST((o_orderkey * 91) % 16000 AS DOUBLE) / 100 - 80 AS gy,
        CAST(1 + o_orderkey % 40 AS DOUBLE) / 100 AS w, CAST(1 + o_orderkey % 30 AS DOUBLE) / 100 AS h FROM orders) b
"""

PENDING = r"""
SELECT id, title || ' v2' AS title, datetime, gsd, platform_type, producer_name, license, cog_href, thumbnail_href,
  file_size, width, height, bands, epsg, uploaded_by, substr(uploaded_at, 1, 11) || CASE WHEN title IS NULL OR CAST(substr(id, 5) AS BIGINT) % 3 = 2 THEN '18:00:00Z' WHEN CAST(substr(id, 5) AS BIGINT) % 3 = 1 THEN '12:00:00Z' ELSE '06:00:00Z' END AS uploaded_at,
  geom_xmin, geom_ymin, geom_xmax, geom_ymax,
  CAST(NULL AS DOUBLE) AS bbox_xmin, CAST(NULL AS DOUBLE) AS bbox_ymin, CAST(NULL AS DOUBLE) AS bbox_xmax, CAST(NULL AS DOUBLE) AS bbox_ymax
FROM catalog WHERE CAST(substr(id, 5) AS BIGINT) % 7 = 0
"""

HREF_UPDATES = r"""
SELECT id, 'https://store.example/imagery/' || id || '.tif' AS new_href
FROM catalog WHERE cog_href LIKE '%legacy-store%' AND CAST(substr(id, 5) AS BIGINT) % 12 = 0
"""

POINTS = r"""
SELECT event_id, CAST((event_id * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon,
  CAST((event_id * 6007) % 16000 AS DOUBLE) / 100 - 80 AS lat FROM events
"""

# Drawn footprints of four shapes by ``k % 4``: polygons as lists of rings, rings as lists of corners (x, y) around the
# center (cx, cy), ``a`` wide and ``b`` high to each side.
OUTLINES = [
    [[[("cx - 0.6 * a + 0.8 * b", "cy - 0.8 * a - 0.6 * b"), ("cx + 0.6 * a + 0.8 * b", "cy + 0.8 * a - 0.6 * b"),
       ("cx + 0.6 * a - 0.8 * b", "cy + 0.8 * a + 0.6 * b"), ("cx - 0.6 * a - 0.8 * b", "cy - 0.8 * a + 0.6 * b")]]],
    [[[("cx - a", "cy"), ("cx", "cy - b"), ("cx + a", "cy"), ("cx", "cy + b")],
      [("cx - 0.5 * a", "cy"), ("cx", "cy + 0.5 * b"), ("cx + 0.5 * a", "cy"), ("cx", "cy - 0.5 * b")]]],
    [[[("cx - a", "cy - b"), ("cx", "cy - b"), ("cx - a", "cy + b")]], [[("cx + a", "cy + b"), ("cx", "cy + b"), ("cx + a", "cy - b")]]],
    [[[("cx - a", "cy - b"), ("cx + a", "cy - b"), ("cx + a", "cy + b"), ("cx + 0.5 * a", "cy + b"), ("cx + 0.5 * a", "cy"),
       ("cx - 0.5 * a", "cy"), ("cx - 0.5 * a", "cy + b"), ("cx - a", "cy + b")]]],
]

CENTERS = r"""
SELECT id, k, gx AS cx, gy AS cy, w * 6 AS a, h * 5 AS b FROM (
  SELECT 'img-' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS id, o_orderkey AS k,
    CAST((o_orderkey * 37) % 35000 AS DOUBLE) / 100 - 175 AS gx, CAST((o_orderkey * 91) % 15000 AS DOUBLE) / 100 - 75 AS gy,
    CAST(1 + o_orderkey % 40 AS DOUBLE) / 100 AS w, CAST(1 + o_orderkey % 30 AS DOUBLE) / 100 AS h FROM orders) c
"""


def outline_edges_sql() -> str:
    """A row for each edge of each footprint: id, polygon, ring, x1, y1, x2, y2 (for the checking engine)."""
    parts = []
    for shape, polygons in enumerate(OUTLINES):
        for polygon, rings in enumerate(polygons):
            for ring, corners in enumerate(rings):
                for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
                    parts.append(
                        f"SELECT id, {polygon} AS polygon, {ring} AS ring, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM centers WHERE k % 4 = {shape}"
                    )
    return " UNION ALL ".join(parts)


VIEWPORTS = r"""
SELECT n_nationkey AS view_id, n_name AS name,
  CAST((n_nationkey * 53) % 320 AS DOUBLE) - 170 AS west, CAST((n_nationkey * 29) % 120 AS DOUBLE) - 70 AS south,
  CAST((n_nationkey * 53) % 320 AS DOUBLE) - 170 + 12.5 AS east, CAST((n_nationkey * 29) % 120 AS DOUBLE) - 70 + 9.5 AS north FROM nation
"""

STATUS_EVENTS = r"""
SELECT user_id AS upload_id, ts,
  CASE event_id % 7 WHEN 0 THEN 'downloading' WHEN 1 THEN 'validating' WHEN 2 THEN 'converting' WHEN 3 THEN 'thumbnail'
    WHEN 4 THEN 'uploading' WHEN 5 THEN 'cataloging' ELSE 'done' END AS step,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 7 = 6 THEN 'complete' ELSE 'processing' END AS status
FROM events
"""

RASTER_META = r"""
SELECT p_partkey AS upload_key, 'staging/' || CAST(p_partkey AS STRING) || '/image.tif' AS object_key,
  CAST(CASE WHEN p_partkey % 53 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN 0 ELSE 1 + p_partkey % 4 END AS INT) AS bands,
  CAST(CASE WHEN p_partkey % 37 = 0 THEN 9 ELSE 10 + (p_partkey * 13) % 9000 END AS INT) AS width,
  CAST(CASE WHEN p_partkey % 43 = 0 THEN 1 ELSE 10 + (p_partkey * 17) % 9000 END AS INT) AS height,
  CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE (p_partkey * 104729 * 31) % 600000000 END AS file_size,
  CAST((p_partkey * 9973) % 30000000 AS DOUBLE) - 15000000 AS mx0, CAST((p_partkey * 7817) % 20000000 AS DOUBLE) - 10000000 AS my0,
  CAST(1 + p_partkey % 50 AS DOUBLE) / 100 AS res_x, CAST(3857 AS INT) AS epsg
FROM part
"""

UPLOAD_META = r"""
SELECT p_partkey AS upload_key,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'UAV' WHEN p_partkey % 4 = 1 THEN 'Balloon/Kite' WHEN p_partkey % 4 = 2 THEN NULL ELSE 'Satellite' END AS platform,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'CC-BY-SA 4.0' END AS license
FROM part WHERE p_partkey % 3 <> 0
"""

PIXELS_SPARK = r"""
SELECT vec_id AS image_id, CAST(pos AS INT) AS px, greatest(CAST(floor(CAST(v AS DOUBLE) * 4000) AS INT), 0) AS value
FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) e
"""

PIXELS_DUCKDB = r"""
SELECT vec_id AS image_id, CAST(pos AS INT) AS px, greatest(CAST(floor(CAST(v AS DOUBLE) * 4000) AS INT), 0) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sql: str, **inputs: DataFrame) -> DataFrame:
    """Run a text above with its ``FROM <name>`` tables bound to DataFrames."""
    for name in inputs:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **inputs)


def _packed(flat: DataFrame) -> DataFrame:
    """Replace the flat edges by a ``bbox`` struct and a ``footprint`` struct (its true extent)."""
    edges = ("xmin", "ymin", "xmax", "ymax")
    dropped = [f"{kind}_{edge}" for kind in ("geom", "bbox") for edge in edges]
    return flat.withColumns(
        {
            "footprint": make_bbox(*[F.col(f"geom_{edge}") for edge in edges]),
            "bbox": make_bbox(*[F.col(f"bbox_{edge}") for edge in edges]),
        }
    ).drop(*dropped)


def catalog_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, CATALOG, orders=table(spark, sf_dir, "orders"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows in the declared schema; ``geometry`` is not filled in."""
    return to_catalog_schema(_packed(catalog_flat(spark, sf_dir)).drop("footprint"))


def catalog_with_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(catalog_flat(spark, sf_dir))


def pending_with_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(derive(spark, PENDING, catalog=catalog_flat(spark, sf_dir)))


def with_geometry(df: DataFrame) -> DataFrame:
    """Encode ``footprint`` as the WKB ``geometry`` column."""
    box = F.col("footprint")
    geometry = box_wkb(box["xmin"], box["ymin"], box["xmax"], box["ymax"])
    return df.withColumn("geometry", geometry).drop("footprint")


def href_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, HREF_UPDATES, catalog=catalog_flat(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, POINTS, events=table(spark, sf_dir, "events"))


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` and the WKB ``geometry`` of drawn footprints, without a box."""
    centers = derive(spark, CENTERS, orders=table(spark, sf_dir, "orders"))

    def listed(parts: list) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))

    def corner(x: str, y: str) -> Column:
        return listed([F.expr(x).cast("string"), F.expr(y).cast("string")])

    shapes = F.lit(None).cast("string")
    for number, polygons in enumerate(OUTLINES):
        rings = [listed([listed([corner(*c) for c in [*ring, ring[0]]]) for ring in polygon]) for polygon in polygons]
        kind, inside = ("Polygon", rings[0]) if len(rings) == 1 else ("MultiPolygon", listed(rings))
        made = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), inside, F.lit("}"))
        shapes = F.when(F.col("k") % 4 == number, made).otherwise(shapes)
    return centers.select("id", geojson_wkb(shapes).alias("geometry"))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, VIEWPORTS, nation=table(spark, sf_dir, "nation"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, STATUS_EVENTS, events=table(spark, sf_dir, "events"))


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, RASTER_META, part=table(spark, sf_dir, "part"))


def upload_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, UPLOAD_META, part=table(spark, sf_dir, "part"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, PIXELS_SPARK, embeddings=table(spark, sf_dir, "embeddings"))
