import math
import random
import struct
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Row, functions as F

from skyledger.functions import dates, geo, numbers, text
from skyledger.functions.wkb import box_wkb, geojson_wkb, wkb_bounds
from skyledger.schema import BBOX_TYPE, make_bbox


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(spark, kind, data, *makers):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *[m(F.col("v")) for m in makers]).orderBy("i").collect()]


def box(w, s, e, n):
    return make_bbox(*[F.lit(float(v)) for v in (w, s, e, n)])


def test_texts(spark):
    sizes = values(spark, "bigint", [None, 0, 1, 524288, 524287, 1073741823, 1073741824, 1610612736], text.file_size_text, text.upload_size_text)
    assert [s[0] for s in sizes] == ["Unknown", "Unknown", "0 MB", "1 MB", "0 MB", "1024 MB", "1.00 GB", "1.50 GB"]
    assert [s[1] for s in sizes][:4] == [None, "0.0 MB", "0.0 MB", "0.5 MB"]
    assert values(spark, "double", [None, 0.0, 0.3, 12.346], text.gsd_text) == [("N/A",), ("N/A",), ("0.30 m",), ("12.35 m",)]
    areas = values(spark, "double", [None, 9999.4, 1e4, 999999.0, 1e6, 1234567.0], text.area_text)
    assert [a[0] for a in areas] == ["Unknown", "9999 m²", "1.0 ha", "100.0 ha", "1.00 km²", "1.23 km²"]
    platforms = values(spark, "string", [None, "", "uav", "DRONE", "hot air BALLOON", "x"], text.platform_label)
    assert [p[0] for p in platforms] == ["Unknown", "Unknown", "Drone", "Drone", "Hot air balloon", "X"]
    counts = values(spark, "bigint", [0, 1, 2], text.count_text, text.overlap_text)
    assert counts == [("No images in view", None), ("1 image in view", None), ("2 images in view", "2 images here")]
    licenses = values(spark, "string", [None, "", "CC-BY-SA-NC", "CC-BY-NC-4.0", "CC0 1.0"], text.license_filter_label)
    assert [x[0] for x in licenses] == ["Any License", "Any License", "CC BY-SA", "CC BY-NC", "CC BY"]
    assert values(spark, "string", ["CC-BY 4.0", "CC-BY-4.0"], text.canonical_license) == [("CC-BY-4.0",)] * 2
    platform_filters = values(spark, "string", ["satellite", "uav", "aircraft", "UAV", None], text.platform_filter_label)
    assert [x[0] for x in platform_filters] == ["Satellite", "Drone", "Other", "All Platforms", "All Platforms"]


def test_fixed_point_text_is_exact(spark):
    rng = random.Random(4)
    doubles = [1.005, 1.115, 8.345, 0.125, 1.45, 0.0, 2.5, 99.995, 1e-9, -1.005, -0.125, 1073741824.125]
    doubles += [rng.randrange(10**6) / 1000 for _ in range(500)] + [rng.uniform(0, 1e5) for _ in range(200)]

    def exact(x, digits):
        text = str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
        return "-" + text if x < 0 else text

    got = values(spark, "double", doubles, lambda c: numbers.to_fixed(c, 2), lambda c: numbers.to_fixed(c, 1))
    assert got == [(exact(x, 2), exact(x, 1)) for x in doubles]
    assert values(spark, "double", [None], lambda c: numbers.to_fixed(c, 2)) == [(None,)]
    doubles += [2.675, 0.5, 1.5, -2.675, 0.00015, 2.5e-05]
    rounds = values(spark, "double", doubles, lambda c: numbers.round_half_even(c, 2), lambda c: numbers.round_half_even(c, 4))
    assert rounds == [(round(x, 2), round(x, 4)) for x in doubles]


def test_dates(spark):
    shown = values(
        spark, "string",
        ["2024-09-07", "2024-09-07T23:59:59Z", "2024-09-07T23:30:00-02:00", "2024-01-31T08:15:30.123456+00:00", "", None, "Unknown Date", "soon"],
        dates.display_date,
    )
    assert [s[0] for s in shown] == [
        "7 Sep 2024", "7 Sep 2024", "8 Sep 2024", "31 Jan 2024", "Unknown Date", "Unknown Date", "Unknown Date", "Invalid Date",
    ]


def test_keys_names_and_links(spark):
    keys = values(spark, "string", ["staging/u1/image.tif", "u1/image.tif", "a/b/c/d", ""], text.upload_id_of_key, text.key_problem)
    assert keys == [("u1", None), (None, "Unexpected key format: u1/image.tif"), ("b", None), (None, "Unexpected key format: ")]
    names = values(spark, "string", ["a.tif", "b.TIFF", "c.tif.zip", "d.tiff.tif", "tif"], text.is_tiff_name, text.title_from_name)
    assert names == [(True, "a"), (True, "b"), (False, "c.tif.zip"), (True, "d.tiff"), (False, "tif")]
    assert values(spark, "string", ["a b&c/é!~*'()-_."], text.encode_uri_component) == [("a%20b%26c%2F%C3%A9!~*'()-_.",)]
    shown = values(spark, "double", [10.0, -0.0, 0.5, 12.345678901234567, 0.0005, -122.25], text.number_text)
    assert [n[0] for n in shown] == ["10", "0", "0.5", "12.345678901234567", "0.0005", "-122.25"]
    link = one(spark, text.id_editor_link(F.lit(2.5), F.lit(-1.0)), text.josm_link(F.lit(""), F.lit("x"), F.lit("http://h/a b"), "Pre - "))
    assert link == (
        "https://www.openstreetmap.org/edit?editor=id#map=16/-1/2.5",
        "http://127.0.0.1:8111/imagery?title=Pre%20-%20x&type=tms&url=http%3A%2F%2Fh%2Fa%20b",
    )
    assert one(spark, text.josm_link(F.lit("t"), F.lit("x"), F.lit(None).cast("string"))) == (None,)
    assert one(spark, text.thumbnail_extension(F.lit("a.png")), text.thumbnail_extension(F.lit("a.jpg"))) == (".png", ".webp")


def test_rings_areas_centroids(spark):
    b = box(10, 20, 11, 22)
    ring = geo.bbox_ring(b)
    got = one(spark, ring, geo.bbox_ring(b, "outline"), geo.ring_area_m2(ring), geo.bbox_area_m2(b), geo.ring_centroid(ring))
    assert got[0] == [[10, 20], [11, 20], [11, 22], [10, 22], [10, 20]]
    assert got[1] == [[10, 22], [11, 22], [11, 20], [10, 20], [10, 22]]
    exact = 6371000.0**2 * math.radians(1) * (math.sin(math.radians(22)) - math.sin(math.radians(20)))
    assert math.isclose(got[2], exact, rel_tol=1e-12) and math.isclose(got[3], exact, rel_tol=1e-12)
    assert tuple(got[4]) == (10.5, 21.0)
    short = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    assert one(spark, geo.ring_area_m2(short), geo.ring_centroid(short)) == (None, None)
    named = F.array(F.lit("1"), F.lit("2"), F.lit("3.5"), F.lit("bad"))
    assert one(spark, geo.reorder_gazetteer_box(named)) == (None,)


def test_geojson_extent_of_every_type(spark):
    shapes = [
        '{"type":"Point","coordinates":[1.5,-2]}',
        '{"type":"LineString","coordinates":[[1,2,99],[3e0,-4.5,99]]}',
        '{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,3],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,7],[5,5]]]]}',
        '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"Point","coordinates":[-3,4]}]}',
        None,
    ]
    got = values(spark, "string", shapes, geo.geojson_extent, lambda c: wkb_bounds(geojson_wkb(c)))
    want = [(1.5, -2, 1.5, -2), (1, -4.5, 3, 2), (0, 0, 4, 3), (0, 0, 6, 7), (-3, 2, 1, 4), None]
    assert [r[0] and tuple(r[0]) for r in got] == want
    assert [r[1] and tuple(r[1]) for r in got] == want


def test_wkb_shapes_and_byte_orders(spark):
    def ring(order, points, dims=2):
        return struct.pack(order + "I", len(points)) + b"".join(struct.pack(f"{order}{dims}d", *p) for p in points)

    little = b"\x01" + struct.pack("<II", 3, 1) + ring("<", [(0, 1), (2, 1), (2, 3), (0, 1)])
    big = b"\x00" + struct.pack(">II", 3, 1) + ring(">", [(0, 1), (2, 1), (2, 3), (0, 1)])
    three_d = b"\x01" + struct.pack("<II", 1003, 1) + ring("<", [(0, 1, 9), (2, 1, 9), (2, 3, 9), (0, 1, 9)], 3)
    with_srid = b"\x01" + struct.pack("<III", 0x20000003, 4326, 1) + ring("<", [(0, 1), (2, 1), (2, 3), (0, 1)])
    several = b"\x01" + struct.pack("<II", 6, 2) + little + big
    line = b"\x01" + struct.pack("<I", 2) + ring("<", [(5, 5), (-5, 6)])
    empty = b"\x01" + struct.pack("<II", 3, 0)
    blobs = [little, big, three_d, with_srid, several, line, empty, None]
    got = values(spark, "binary", [b and bytearray(b) for b in blobs], wkb_bounds)
    assert [r[0] and tuple(r[0]) for r in got] == [(0, 1, 2, 3)] * 5 + [(-5, 5, 5, 6), None, None]
    made = one(spark, box_wkb(*[F.lit(float(v)) for v in (1, 2, 3, 4)]), box_wkb(F.lit(None).cast("double"), *[F.lit(1.0)] * 3))
    assert len(made[0]) == 93 and struct.unpack_from("<BIII", made[0]) == (1, 3, 1, 5) and made[1] is None
    assert struct.unpack_from("<10d", made[0], 13) == (1, 2, 3, 2, 3, 4, 1, 4, 1, 2)


def test_mercator_and_tiles(spark):
    x, y = 6378137.0 * math.radians(12.5), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(48) / 2))
    lon, lat = one(spark, geo.mercator_lon(F.lit(x)), geo.mercator_lat(F.lit(y)))
    assert math.isclose(lon, 12.5, rel_tol=1e-12) and math.isclose(lat, 48, rel_tol=1e-12)
    corners = one(spark, geo.tile_x(F.lit(-180.0), 3), geo.tile_x(F.lit(180.0), 3), geo.tile_y(F.lit(90.0), 3), geo.tile_y(F.lit(-90.0), 3), geo.tile_y(F.lit(0.0), 3))
    assert corners == (0, 7, 0, 7, 4)
    boxes = spark.createDataFrame([(1, Row(-10.0, -10.0, 10.0, 10.0)), (2, None)], f"i int, bbox {BBOX_TYPE.simpleString()}")
    assert {(r.i, r.z, r.x, r.y) for r in geo.explode_tiles(boxes, 1).collect()} == {(1, 1, x, y) for x in (0, 1) for y in (0, 1)}
    world = boxes.limit(1).withColumn("bbox", box(-180, -90, 180, 90))
    assert geo.explode_tiles(world, 3).count() == 64


def hilbert(x, y, bits=16):
    d, side = 0, 1 << bits
    s = side // 2
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_hilbert_equals_the_bitwise_walk(spark):
    rng = random.Random(1)
    cells = [(rng.randrange(65536), rng.randrange(65536)) for _ in range(500)] + [(0, 0), (65535, 65535), (0, 65535), (65535, 0)]
    # With this frame a cell is one unit wide.
    rows = [(i, Row(x + 0.25, y + 0.25, x + 0.75, y + 0.75)) for i, (x, y) in enumerate(cells)]
    df = spark.createDataFrame(rows, f"i int, bbox {BBOX_TYPE.simpleString()}")
    keyed = geo.with_hilbert_key(df, frame=(0, 0, 65536, 65536))
    assert keyed.columns == ["i", "bbox", "hilbert"]
    assert {r.i: r.hilbert for r in keyed.collect()} == {i: hilbert(*c) for i, c in enumerate(cells)}
    outside = spark.createDataFrame([(1, Row(500.0, 500.0, 600.0, 600.0)), (2, None)], f"i int, bbox {BBOX_TYPE.simpleString()}")
    assert {r.i: r.hilbert for r in geo.with_hilbert_key(outside).collect()} == {1: hilbert(65535, 65535), 2: None}


def test_neighbouring_hilbert_keys_are_neighbouring_cells(spark):
    cells = [(x, y) for x in range(32) for y in range(32)]
    rows = [(x, y, Row(x + 0.25, y + 0.25, x + 0.75, y + 0.75)) for x, y in cells]
    df = spark.createDataFrame(rows, f"x int, y int, bbox {BBOX_TYPE.simpleString()}")
    walk = [(r.x, r.y) for r in geo.with_hilbert_key(df, frame=(0, 0, 65536, 65536)).orderBy("hilbert").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))
