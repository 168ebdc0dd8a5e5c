"""Hits of drawn polygons by streams of cells, against nested loops and against pairs compared one by one."""

import functools
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from rows import catalog, image, plan
from skyledger.functions import polygon_cells
from skyledger.functions.polygons import polygon_covers
from skyledger.operators import spatial_join as sj
from skyledger.plans import queries
from test_polygons import closed, holds, polygon, several, star


def scene(rng, images, spots):
    """Outlines of one or two polygons, some with holes, many in one place; (rings of each polygon, corners in integers)."""
    shapes = []
    for _ in range(images):
        x, y = rng.choice([(13, 52), (rng.randrange(-150, 150), rng.randrange(-70, 70))])
        parts = []
        for at in range(rng.choice([1, 1, 2])):
            rings = [star(rng, x + 9 * at, y, rng.choice([2, 15]))]
            rings += [star(rng, x + 9 * at, y, 2) for _ in range(rng.randrange(2))]
            rings = [r for r in rings if len(r) > 2]
            parts.append(rings or [[(0, 0), (9, 0), (0, 9)]])
        shapes.append(parts)
    places = [(rng.randrange(-160, 160), rng.randrange(-80, 80)) for _ in range(spots)]
    places += [(13 + rng.randrange(-9, 10), 52 + rng.randrange(-9, 10)) for _ in range(spots)] + [(13, 52)] * 20
    return shapes, places


def frames(spark, shapes, places):
    drawn = [several(6, [polygon([closed(r) for r in rings]) for rings in parts]) for parts in shapes]
    images = spark.createDataFrame(list(enumerate(drawn)), "id int, geometry binary")
    points = spark.createDataFrame([(i, str(i % 3), float(x), float(y)) for i, (x, y) in enumerate(places)], "spot int, kind string, lon double, lat double")
    return images.repartition(3), points.repartition(3)


@pytest.mark.parametrize("least", [1, 10**9])
def test_small_batches_and_blocks(spark, monkeypatch, least):
    for name, value in {"PAIRS": 40, "BLOCK": 8, "LEAST": least, "MOST_EDGES": 30}.items():
        monkeypatch.setattr(polygon_cells, name, value)
    monkeypatch.setattr(sj, "MOST_POINTS", 15)
    shapes, places = scene(random.Random(8), 60, 150)
    images, points = frames(spark, shapes, places)
    want = sorted((i, j, str(j % 3)) for i, parts in enumerate(shapes) for j, p in enumerate(places) if any(holds(rings, *p) for rings in parts))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for share, pairs in ((1000, 10**6), (5, 10)):
                got = sj.polygon_hits(images, points, ["id"], ["spot", "kind"], box=None, share=share, min_pairs=pairs)
                assert got.columns == ["id", "spot", "kind"] and sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_counts_of_hits(spark):
    shapes, places = scene(random.Random(9), 60, 150)
    images, points = frames(spark, shapes, places)
    counts = sj.polygon_hits(images, points, ["id"], ["spot"], box=None, counted=True)
    want = {j: sum(any(holds(rings, *p) for rings in parts) for parts in shapes) for j, p in enumerate(places)}
    assert sorted(map(tuple, counts.collect())) == sorted((j, n) for j, n in want.items() if n)


def test_odd_values_hit_as_pairs_one_by_one(spark):
    nan, inf = float("nan"), float("inf")
    square = closed([(0, 0), (4, 0), (4, 4), (0, 4)])
    line = struct.pack("<BII4d", 1, 2, 2, -9, -9, 9, 9)
    drawn = [
        polygon([square]), polygon([[(0, 0), (nan, 0), (4, 4), (0, 4)]]), polygon([[(0, 0), (inf, 0), (4, 4), (0, 4)]]), polygon([]), line, b"", b"x", None,
        several(7, [line, polygon([[(0, 0), (4, nan), (4, 4), (0, 4)]])]), polygon([[(2, 2)]]), polygon([[(1, 1), (1, 1)]]), polygon([square, []]), polygon([[], square]),
    ]
    boxes = [None, (0.0, 0.0, 4.0, 4.0), (4.0, 0.0, 0.0, 4.0), (0.0, 0.0, nan, 4.0), (nan, 0.0, 4.0, 4.0), (-inf, -inf, inf, inf), (0.0, None, 4.0, 4.0)]
    rows = [(f"{g}-{b}" if g % 2 else None, d, box) for g, d in enumerate(drawn) for b, box in enumerate(boxes)]
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    images = spark.createDataFrame(rows, f"id string, geometry binary, bbox {box}")
    values = (0.0, -0.0, 1.0, 2.0, 3.5, 4.0, 5.0, nan, inf, -inf, None)
    points = spark.createDataFrame([(i % 7 or None, x, y) for i, (x, y) in enumerate((x, y) for x in values for y in values)], "spot int, lon double, lat double")
    for name in ("bbox", None):
        edges = sj.wkb_bounds(F.col("geometry"))
        edges = F.coalesce(F.col(name), edges) if name else edges
        keyed = images.select("id", "geometry", edges.alias("b"))
        pairs = sj.point_hits(keyed, points.selectExpr("spot", "lon", "lat", "lon x", "lat y"), ["id", "geometry"], ["spot", "x", "y"], box="b")
        want = pairs.where(polygon_covers(F.col("geometry"), F.col("x"), F.col("y"))).select("id", "spot")
        got = sj.polygon_hits(images, points, ["id"], ["spot"], box=name)
        assert want.count() > 20
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_pairs_of_a_cell_are_not_rows(spark):
    images, points = frames(spark, *scene(random.Random(10), 20, 20))
    text = plan(sj.polygon_hits(images, points, ["id"], ["spot"], box=None))
    assert "MapInArrow" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("repeated", [False, True])
def test_counts_and_features_without_rows_of_pairs(spark, repeated):
    shapes, places = scene(random.Random(11), 60, 100)
    drawn, spots = frames(spark, shapes, places)
    name = "CASE WHEN id = 7 THEN '' WHEN id = 8 THEN NULL ELSE 'i' || id END" if not repeated else (
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN 'i5' ELSE 'i' || id END"
    )
    images = drawn.selectExpr(f"{name} AS id", "geometry")
    points = spots.selectExpr(("CASE WHEN spot % 9 = 0 THEN NULL WHEN spot % 4 = 0 THEN 4 ELSE spot END" if repeated else "nullif(spot, 3)") + " AS spot", "lon", "lat")
    shown = catalog(spark, *[image(f"i{n}", title=f"t{n}", gsd=n / 2) for n in range(0, 60, 2)]).select("id", "title", "gsd")
    found = sj.polygon_hits(images, points, ["id"], ["spot"], box=None).cache()
    hits = sj.Hits(sj.drawn_images(images, ["id"], box=None), points, ["id"], ["spot"], functools.partial(sj.polygon_hits, drawn=True))
    counts, want = sj.overlap_counts(hits, ["spot"]), sj.overlap_counts(found, ["spot"])
    assert want.count() > 50 and counts.count() == want.count() and counts.exceptAll(want).count() == 0
    columns = ["spot", "id", "title", "gsd", "images"]
    full = sj.hit_features(hits, shown, ["spot"], of_points=counts).select(columns)
    rows = sj.hit_features(found, shown, ["spot"]).join(want, "spot").select(columns)
    assert sj.hit_features(found, shown, ["spot"], of_points=want).select(columns).exceptAll(rows).count() == 0
    assert rows.count() > 100 and full.count() == rows.count() and full.exceptAll(rows).count() == 0


def test_polygon_features_shuffle_no_hits(spark, tmp_path):
    order = ["id AS o_orderkey", "id % 9 AS o_custkey", "timestamp '1996-02-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"]
    spark.range(300).selectExpr(*order).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(500).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    text = plan(queries.run_polygon_features(spark, str(tmp_path)), "simple")
    # Above the function that finds hits nothing is exchanged, neither for the catalog's rows nor for the counts.
    assert "Exchange" not in text[: text.index("MapInArrow")]
    assert not re.search(r"hashpartitioning\(event_id#\d+L, id#", text)
