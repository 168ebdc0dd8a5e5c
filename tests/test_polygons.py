"""Points in polygons against crossing counts in exact integers."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rows import plan
from skyledger.functions import polygons
from skyledger.functions.polygons import polygon_covers
from skyledger.operators import spatial_join as sj


def wkb(kind, body, order="<", code=0):
    return struct.pack("B", order == "<") + struct.pack(order + "I", kind + code) + body


def rings_body(rings, order="<", dims=2):
    out = struct.pack(order + "I", len(rings))
    for ring in rings:
        out += struct.pack(order + "I", len(ring))
        for x, y in ring:
            out += struct.pack(f"{order}{dims}d", x, y, *[7.0] * (dims - 2))
    return out


def polygon(rings, order="<"):
    return wkb(3, rings_body(rings, order), order)


def several(kind, parts, order="<"):
    return wkb(kind, struct.pack(order + "I", len(parts)) + b"".join(parts), order)


def closed(ring):
    return [*ring, ring[0]]


def place(ring, x, y):
    """1 inside, 0 on the border, -1 outside: crossings to the right, in integers."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
            odd = not odd
    return 1 if odd else -1


def holds(rings, x, y):
    return place(rings[0], x, y) >= 0 and all(place(hole, x, y) <= 0 for hole in rings[1:])


def star(rng, cx, cy, size):
    """A simple ring with integer corners: points around a center, by their angle; clockwise or not."""
    corners = {}
    for _ in range(rng.randrange(3, 9)):
        x, y = rng.randrange(-size, size + 1), rng.randrange(-size, size + 1)
        if (x, y) != (0, 0):
            corners[math.gcd(x, y) and (x // math.gcd(x, y), y // math.gcd(x, y))] = (x, y)
    ordered = sorted(corners.values(), key=lambda c: math.atan2(c[1], c[0]))
    ring = [(cx + x, cy + y) for x, y in ordered]
    return ring[:: rng.choice([1, -1])]


def verdicts(spark, pairs):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, g binary, x double, y double").repartition(3)
    rows = frame.select("i", polygon_covers(F.col("g"), F.col("x"), F.col("y")).alias("hit")).collect()
    return [hit for _, hit in sorted(tuple(r) for r in rows)]


@pytest.mark.parametrize("edges", [polygons.MOST_EDGES, 1])
def test_equals_crossing_counts(spark, monkeypatch, edges):
    monkeypatch.setattr(polygons, "MOST_EDGES", edges)
    rng, pairs, want = random.Random(3), [], []
    for _ in range(300):
        rings = [star(rng, 0, 0, 12)]
        rings += [star(rng, rng.randrange(-3, 4), rng.randrange(-3, 4), 2) for _ in range(rng.randrange(3))]
        rings = [r for r in rings if len(r) > 2] or [[(0, 0), (1, 0), (0, 1)]]
        other = [[(20, 20), (30, 20), (20, 30)]]
        order = rng.choice("<>")
        body = [closed(r) if rng.random() < 0.8 else r for r in rings]
        shape = rng.choice([polygon(body, order), several(6, [polygon([closed(other[0])]), polygon(body, order)], order)])
        multi = shape[1 if order == "<" else 4] == 6
        for _ in range(20):
            x, y = rng.choice([(rng.randrange(-13, 14), rng.randrange(-13, 14)), (25, 22), rng.choice(rings[0])])
            pairs.append((shape, float(x), float(y)))
            want.append(holds(rings, x, y) or (multi and holds(other, x, y)))
    assert verdicts(spark, pairs) == want and 0.2 < sum(want) / len(want) < 0.8


def test_borders_of_rings_and_holes(spark):
    square, hole = closed([(0, 0), (4, 0), (4, 4), (0, 4)]), closed([(1, 1), (3, 1), (3, 3), (1, 3)])
    ring = polygon([square, hole])
    assert verdicts(spark, [(ring, x, 2.0) for x in (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 4.1)]) == [True, True, True, False, True, True, False]
    assert verdicts(spark, [(ring, 4.0, 4.0), (ring, 1.0, 1.0), (ring, float("nan"), 2.0), (ring, None, 2.0)]) == [True, True, False, False]


def test_other_geometries(spark):
    square = closed([(0, 0), (4, 0), (4, 4), (0, 4)])
    high = struct.pack("<BI", 1, 3 | 0x80000000) + rings_body([square], dims=3)
    measured = struct.pack("<BI", 1, 3003) + rings_body([square], dims=4)
    system = struct.pack("<BII", 1, 3 | 0x20000000, 4326) + rings_body([square])
    point, line = wkb(1, struct.pack("<2d", 2, 2)), wkb(2, struct.pack("<I4d", 2, 0, 0, 4, 4))
    mixed = several(7, [point, line, several(7, [polygon([square])])])
    inside = [high, measured, system, mixed, several(6, [several(6, [polygon([square], ">")], ">")])]
    assert verdicts(spark, [(g, 2.0, 1.0) for g in inside]) == [True] * 5
    outside = [point, line, several(7, []), polygon([]), polygon([[], square]), None, b"", b"\x01", polygon([square])[:-9], wkb(17, b"")]
    assert verdicts(spark, [(g, 2.0, 2.0) for g in outside]) == [False] * 10


def test_hits_equal_nested_loop(spark):
    rng, shapes = random.Random(5), []
    for i in range(120):
        rings = [star(rng, *rng.choice([(13, 52), (rng.randrange(-150, 150), rng.randrange(-70, 70))]), rng.choice([2, 15]))]
        shapes.append(rings if len(rings[0]) > 2 else [[(0, 0), (9, 0), (0, 9)]])
    spots = [(rng.randrange(-160, 160), rng.randrange(-80, 80)) for _ in range(300)] + [(13, 52)] * 40 + [(14, 53)] * 40
    images = spark.createDataFrame([(i, polygon([closed(r) for r in rings])) for i, rings in enumerate(shapes)] + [(500, None), (501, b"x")], "id int, geometry binary")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(900, None, 1.0)], "spot int, lon double, lat double")
    want = {(i, j) for i, rings in enumerate(shapes) for j, (x, y) in enumerate(spots) if holds(rings, x, y)}
    for share, least in ((1000, 10**6), (5, 10)):
        got = sj.polygon_hits(images, points, ["id"], ["spot"], box=None, share=share, min_pairs=least)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    boxes = sj.point_hits(images.selectExpr("id", "named_struct('xmin', 10D, 'ymin', 50D, 'xmax', 16D, 'ymax', 55D) AS bbox"), points, ["id"], ["spot"])
    assert boxes.count() > 0 and "ArrowEvalPython" in plan(got)


def test_given_boxes_are_filled_in(spark):
    square = polygon([closed([(0, 0), (4, 0), (4, 4), (0, 4)])])
    box = "named_struct('xmin', 0D, 'ymin', 0D, 'xmax', 4D, 'ymax', 4D)"
    images = spark.createDataFrame([(1, square), (2, square)], "id int, geometry binary").selectExpr("*", f"CASE WHEN id = 1 THEN {box} END AS bbox")
    points = spark.createDataFrame([(7, 1.0, 1.0)], "spot int, lon double, lat double")
    assert sorted(tuple(r) for r in sj.polygon_hits(images, points, ["id"], ["spot"]).collect()) == [(1, 7), (2, 7)]
    assert sj.polygon_hits(images.limit(0), points, ["id"], ["spot"]).collect() == []
