"""Geometry expressions over rings and bounding boxes, all evaluated in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.numbers import round_half_even
from skyledger.schema import make_bbox, quoted

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0
METRES_PER_DEGREE = 111320
MERCATOR_MAX_LAT = 85.0511287798066
WORLD = (-180.0, -90.0, 180.0, 90.0)

# Any coordinate pair in GeoJSON text, whatever the nesting depth.
_PAIR = r"\[\s*(-?[0-9][0-9.eE+-]*)\s*,\s*(-?[0-9][0-9.eE+-]*)"


def bbox_ring(bbox: Column, order: str = "ccw") -> Column:
    """Closed five-point ring of a box as ``array<array<double>>``.

    ``ccw`` starts south-west (footprints); ``outline`` starts north-west and
    runs clockwise (viewport rectangles).
    """
    w, s, e, n = bbox["xmin"], bbox["ymin"], bbox["xmax"], bbox["ymax"]
    corners = {
        "ccw": [(w, s), (e, s), (e, n), (w, n), (w, s)],
        "outline": [(w, n), (e, n), (e, s), (w, s), (w, n)],
    }[order]
    return F.when(bbox.isNotNull(), F.array(*[F.array(x, y) for x, y in corners]))


def points_extent(points: Column) -> Column:
    """bbox struct around an array of ``[lon, lat]`` points."""
    lons = F.transform(points, lambda p: p[0])
    lats = F.transform(points, lambda p: p[1])
    return make_bbox(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def ring_centroid(ring: Column) -> Column:
    """Middle of the ring's extent as ``struct<lon,lat>``; NULL for fewer than four points."""
    extent = points_extent(ring)
    middle = F.struct(
        ((extent["xmin"] + extent["xmax"]) / 2).alias("lon"),
        ((extent["ymin"] + extent["ymax"]) / 2).alias("lat"),
    )
    return F.when(F.size(ring) >= 4, middle)


def bbox_centroid(bbox: Column) -> Column:
    middle = F.struct(
        ((bbox["xmin"] + bbox["xmax"]) / 2).alias("lon"),
        ((bbox["ymin"] + bbox["ymax"]) / 2).alias("lat"),
    )
    return F.when(bbox.isNotNull(), middle)


def ring_area_m2(ring: Column) -> Column:
    """Spherical area of a closed ring; NULL for fewer than four points."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.radians(b[0] - a[0]) * (2 + F.sin(F.radians(a[1])) + F.sin(F.radians(b[1]))),
    )
    total = F.aggregate(edges, F.lit(0.0), lambda acc, edge: acc + edge)
    return F.when(F.size(ring) >= 4, F.abs(total * (EARTH_RADIUS_M * EARTH_RADIUS_M / 2)))


def bbox_area_m2(bbox: Column) -> Column:
    """What ``ring_area_m2`` gives for a box, in closed form and without arrays."""
    width = F.radians(bbox["xmax"] - bbox["xmin"])
    band = F.sin(F.radians(bbox["ymax"])) - F.sin(F.radians(bbox["ymin"]))
    return F.abs(width * band * (EARTH_RADIUS_M * EARTH_RADIUS_M))


def geojson_extent(geojson: Column) -> Column:
    """Extent of a GeoJSON geometry of any type, given as text."""
    text = F.coalesce(
        F.get_json_object(geojson, "$.coordinates"), F.get_json_object(geojson, "$.geometries")
    )
    lons = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), lambda v: v.cast("double"))
    lats = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)), lambda v: v.cast("double"))
    return make_bbox(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def degrees_to_metres(gsd_degrees: Column) -> Column:
    """Resolution in metres, two decimals; NULL and 0 give NULL."""
    return round_half_even(F.nullif(gsd_degrees, F.lit(0.0)) * METRES_PER_DEGREE, 2)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - math.pi / 2)


def mercator_bounds(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Web Mercator metres to a longitude/latitude bbox."""
    return make_bbox(mercator_lon(x0), mercator_lat(y0), mercator_lon(x1), mercator_lat(y1))


def reorder_gazetteer_box(box: Column) -> Column:
    """``[south, north, west, east]`` text values to a bbox struct."""
    south, north, west, east = (F.get(box, i).try_cast("double") for i in range(4))
    return make_bbox(west, south, east, north)


def tile_x(lon: Column, zoom: int) -> Column:
    tiles = 1 << zoom
    return F.least(F.lit(tiles - 1), F.greatest(F.lit(0), F.floor((lon + 180) / 360 * tiles).cast("int")))


def tile_y(lat: Column, zoom: int) -> Column:
    tiles = 1 << zoom
    phi = F.radians(F.least(F.lit(MERCATOR_MAX_LAT), F.greatest(F.lit(-MERCATOR_MAX_LAT), lat)))
    down = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
    return F.least(F.lit(tiles - 1), F.greatest(F.lit(0), F.floor(down * tiles).cast("int")))


def explode_tiles(df: DataFrame, zoom: int, bbox: str = "bbox") -> DataFrame:
    """One row per map tile (``z, x, y``) the box touches; rows without a box vanish."""
    box = F.col(bbox)
    columns = F.sequence(tile_x(box["xmin"], zoom), tile_x(box["xmax"], zoom))
    rows = F.sequence(tile_y(box["ymax"], zoom), tile_y(box["ymin"], zoom))
    return (
        df.where(box.isNotNull())
        .select("*", F.lit(zoom).alias("z"), F.explode(columns).alias("x"))
        .select("*", F.explode(rows).alias("y"))
    )


def with_hilbert_key(
    df: DataFrame,
    bbox: str = "bbox",
    out: str = "hilbert",
    frame: tuple[float, float, float, float] = WORLD,
) -> DataFrame:
    """Add the order-16 Hilbert distance of each box's middle within ``frame``; no box, no key.

    Walking the curve bit by bit would be an interpreted fold. Instead, note that
    the orientation below a quadrant is two bits, swapped axes ``s`` and
    complemented axes ``c``, and that each quadrant changes them by an affine map
    over bits: with ``e = x xor y``, ``(s, c)`` becomes ``(c^x, s^x)`` where e is 1
    and ``(s^c^not x, c)`` where e is 0. Affine maps compose, so all sixteen
    orientations come from a prefix scan of four doubling rounds of bit operations,
    which stay in generated code. Every round is a projection of its own, so that no
    expression is repeated.
    """
    keep = [quoted(name) for name in df.columns]

    def grid(axis: str, low: float, high: float) -> str:
        middle = f"({bbox}.{axis}min + {bbox}.{axis}max) / 2"
        return f"CAST(least(65535, greatest(0, floor(({middle} - ({low!r}D)) * {65536 / (high - low)!r}D))) AS INT)"

    w, s, e, n = (float(v) for v in frame)
    step = df.selectExpr(*keep, f"{grid('x', w, e)} AS _hx", f"{grid('y', s, n)} AS _hy")
    # Matrix rows (p q), (r t) and offsets u, v of every bit's map.
    step = step.selectExpr(
        *keep, "_hx", "_hx ^ _hy AS _he",
        "_hx ^ _hy ^ 65535 AS _p", "65535 AS _q", "_hy ^ 65535 AS _u",
        "_hx ^ _hy AS _r", "_hx ^ _hy ^ 65535 AS _t", "(_hx ^ _hy) & _hx AS _v",
    )
    for span in (1, 2, 4):
        p, q, u, r, t, v = (f"shiftright(_{name}, {span})" for name in "pqurtv")
        step = step.selectExpr(
            *keep, "_hx", "_he",
            f"(_p & {p}) ^ (_q & {r}) AS _p", f"(_p & {q}) ^ (_q & {t}) AS _q", f"(_p & {u}) ^ (_q & {v}) ^ _u AS _u",
            f"(_r & {p}) ^ (_t & {r}) AS _r", f"(_r & {q}) ^ (_t & {t}) AS _t", f"(_r & {u}) ^ (_t & {v}) ^ _v AS _v",
        )
    step = step.selectExpr(
        *keep, "_hx", "_he",
        "shiftright((_p & shiftright(_u, 8)) ^ (_q & shiftright(_v, 8)) ^ _u, 1) AS _s",
        "shiftright((_r & shiftright(_u, 8)) ^ (_t & shiftright(_v, 8)) ^ _v, 1) AS _c",
    )
    # Interleave: the high bit of every base-4 digit, then the low one, which is x xor y.
    step = step.selectExpr(
        *keep, "CAST(_hx ^ (_s & _he) ^ _c AS BIGINT) AS _hi", "CAST(_he AS BIGINT) AS _lo"
    )
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        step = step.selectExpr(
            *keep, *[f"({word} | shiftleft({word}, {shift})) & {mask}L AS {word}" for word in ("_hi", "_lo")]
        )
    known = f"{bbox}.xmin + {bbox}.ymin + {bbox}.xmax + {bbox}.ymax IS NOT NULL"
    return step.selectExpr(*keep, f"CASE WHEN {known} THEN shiftleft(_hi, 1) | _lo END AS {quoted(out)}")
