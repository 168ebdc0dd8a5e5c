"""Tile pyramids against all tiles, and UTM positions against known ones and the forward series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rows import catalog, image
from skyledger.functions import tiles, utm


def map_edges(box):
    def down(lat):
        if abs(lat) >= tiles.MERCATOR_MAX_LAT:
            return 0.0 if lat > 0 else 1.0
        return (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2

    inside = lambda v: min(1.0, max(0.0, v))
    return inside((box[0] + 180) / 360), inside((box[2] + 180) / 360), inside(down(box[3])), inside(down(box[1]))


def boxes(seed, n):
    draw = random.Random(seed)
    out = [(-180, -85.0511287798066, 180, 85.0511287798066), (0, 0, 0, 0), (-180, 0, 0, 85.0511287798066), (10, 10, 9, 11), (-200, -95, 200, 95), (45, 0, 90, 40.97989806962013)]
    for _ in range(n):
        size = draw.choice([0.01, 1, 20, 100, 300])
        x, y = draw.uniform(-180, 175), draw.uniform(-80, 70)
        out.append((x, y, min(180, x + size), min(85, y + size * draw.random())))
    return out


@pytest.mark.parametrize("detail", [1, 4])
def test_pyramid_finds_what_touches_a_tile(spark, detail):
    shapes = boxes(detail, 60)
    df = catalog(spark, *[image(str(i), b) for i, b in enumerate(shapes)], image("none"), image("nan", (float("nan"), 0, 1, 1))).select("id", "bbox")
    rows = tiles.tile_pyramid(df, detail=detail).cache()
    counts = rows.groupBy("id").count().collect()
    assert max(r["count"] for r in counts) <= tiles.most_rows(detail) and {r.id for r in counts} == {str(i) for i, b in enumerate(shapes) if b[0] <= b[2]}
    whole_world = rows.where("id = '0'").collect()
    assert [(r.z, r.x, r.y, r.whole) for r in whole_world] == [(0, 0, 0, True)]
    draw = random.Random(9)
    edges = [map_edges(b) for b in shapes]
    for z in (0, 1, 3, 6, 9, 14):
        for _ in range(3):
            n = 1 << z
            w, e, north, south = edges[draw.randrange(6, len(shapes))]
            x, y = min(n - 1, int(draw.choice([w, e]) * n)), min(n - 1, int(draw.choice([north, south]) * n))
            touch = {str(i) for i, (w, e, a, b) in enumerate(edges) if shapes[i][0] <= shapes[i][2] and min(n - 1, int(w * n)) <= x <= min(n - 1, int(e * n)) and min(n - 1, int(a * n)) <= y <= min(n - 1, int(b * n))}
            found = rows.where(tiles.in_tile(z, x, y)).collect()
            assert len({r.id for r in found}) == len(found)
            assert touch <= {r.id for r in found}
            assert {r.id for r in found if r.z == z or r.whole} <= touch
            sure = {r.id for r in found if r.z == z or r.whole}
            assert all(not (r.z < z) or r.whole or r.leaf for r in found) and sure | {r.id for r in found if not r.whole} >= touch
    rows.unpersist()


def test_rows_keep_columns_and_empty_input(spark):
    df = catalog(spark, image("a", (0, 0, 1, 1)))
    assert tiles.tile_pyramid(df).columns == [*df.columns, "z", "x", "y", "whole", "leaf"]
    assert tiles.tile_pyramid(df.limit(0)).collect() == []


def forward(lon, lat, zone, south):
    """Krüger's forward series."""
    n = utm.FLATTENING / (2 - utm.FLATTENING)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500_000 + utm.RADIUS_M * x, (10_000_000 if south else 0) + utm.RADIUS_M * y


def test_positions(spark):
    draw, rows, want = random.Random(2), [], []
    for _ in range(300):
        zone, lat = draw.randrange(1, 61), draw.uniform(-80, 84)
        lon = zone * 6 - 183 + draw.uniform(-3.5, 3.5)
        rows.append((*forward(lon, lat, zone, lat < 0), (32700 if lat < 0 else 32600) + zone))
        want.append((lon, lat))
    # The equator at Greenwich, and the middle of a zone.
    rows += [(166021.4431, 0.0, 32631), (500000.0, 0.0, 32633), (500000.0, 10000000.0, 32733)]
    want += [(0.0, 0.0), (15.0, 0.0), (15.0, 0.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x double, y double, epsg int")
    got = frame.select("i", utm.utm_point(F.col("x"), F.col("y"), F.col("epsg")).alias("p")).orderBy("i").collect()
    for row, (lon, lat) in zip(got, want, strict=True):
        assert row.p.lon == pytest.approx(lon, abs=1e-9) and row.p.lat == pytest.approx(lat, abs=1e-9)


def test_bounds_of_projected_boxes(spark):
    rows = [(32633, 300000.0, 5500000.0, 420000.0, 5600000.0), (3857, 0.0, 0.0, 111319.49079327358, 0.0), (4326, 1.0, 2.0, 3.0, 4.0), (2154, 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0), (32661, 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "epsg int, x0 double, y0 double, x1 double, y1 double")
    found = frame.select("epsg", utm.projected_bounds(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "epsg")]).alias("b")).collect()
    boxes = {r.epsg: r.b for r in found}
    assert tuple(boxes[4326]) == (1, 2, 3, 4) and boxes[3857].xmax == pytest.approx(1) and boxes[2154] is None and boxes[None] is None and boxes[32661] is None
    corners = frame.where("epsg = 32633").select(*[utm.utm_point(F.col(x), F.col(y), F.col("epsg")).alias(x + y) for x in ("x0", "x1") for y in ("y0", "y1")]).first()
    b = boxes[32633]
    assert b.xmin == pytest.approx(min(p.lon for p in corners)) and b.ymin == pytest.approx(min(p.lat for p in corners))
    # The side nearest to the pole bends beyond its corners.
    middle = frame.where("epsg = 32633").select(utm.utm_point(F.lit(420000.0), F.lit(5600000.0), F.col("epsg")).alias("p")).first().p
    assert b.ymax >= middle.lat
