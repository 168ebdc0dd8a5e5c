import json

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from skyledger.functions.wkb import wkb_bounds
from skyledger.operators import features, ingest, raster, status
from skyledger.schema import BBOX_TYPE
from skyledger.sources.records import parse_pages

from rows import catalog, image


def test_first_failing_rule_wins(spark):
    rows = [
        (1, 0, 5, 5, 600 * 2**20), (2, 3, 9, 10, 1), (3, 3, 10, 9, 1), (4, 3, 10, 10, 500 * 2**20),
        (5, 3, 10, 10, 500 * 2**20 + 1), (6, 3, 10, 10, 750 * 2**20),
        (7, 3, 10, 10, 1001 * 2**19), (8, 3, 10, 10, 1003 * 2**19),
    ]
    df = spark.createDataFrame(rows, "k int, bands int, width int, height int, file_size bigint")
    checked = ingest.validate(df)
    assert {r.k: r.reason for r in checked.collect()} == {
        1: "Image has no bands", 2: "Image too small: 9x10", 3: "Image too small: 10x9", 4: None,
        5: "File too large: 500MB (max 500MB)", 6: "File too large: 750MB (max 500MB)",
        7: "File too large: 500MB (max 500MB)", 8: "File too large: 502MB (max 500MB)",
    }
    good, bad = ingest.split_valid(checked)
    assert [r.k for r in good.collect()] == [4] and bad.count() == 7 and "reason" not in good.columns


def test_strict_rules(spark):
    boxes = [(1, 1, 2, 2), (-1, -1, 1, 1), (2, 1, 1, 2), (170, 1, 190, 2), (1, 1, 2, 2), None]
    rows = [(i, 3, 10, 10, 1, None if i == 4 else 4326, Row(*map(float, b)) if b else None) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(
        rows, f"k int, bands int, width int, height int, file_size bigint, epsg int, bounds {BBOX_TYPE.simpleString()}"
    )
    assert {r.k: r.reason for r in ingest.validate(df, strict=True).collect()} == {
        0: None, 1: "Bounds at null island", 2: "Invalid bounds", 3: "Invalid bounds", 4: "Image has no CRS", 5: "Invalid bounds",
    }


def test_sidecar_defaults(spark):
    rasters = spark.createDataFrame(
        [("u1", 3, 100, 50, 10, 0.12345, Row(1.0, 2.0, 3.0, 4.0)), ("u2", 1, 20, 20, 9, 1.0, Row(0.0, 0.0, 1.0, 1.0))],
        f"up string, bands int, width int, height int, file_size bigint, res_x double, bounds {BBOX_TYPE.simpleString()}",
    )
    given = spark.createDataFrame([("u1", "", None, "CC0")], "up string, title string, platform string, license string")
    rows = {r.id: r for r in ingest.sidecar_rows(rasters, given, "up", "2024-05-06T07:08:09+00:00", "https://x.example/").collect()}
    a, b = rows["u1"], rows["u2"]
    assert (a.title, a.platform_type, a.license, a.gsd) == ("", "", "CC0", round(0.12345, 4))
    assert (b.title, b.license, b.datetime, b.producer_name) == ("Untitled", "CC-BY 4.0", "2024-05-06", "")
    assert a.cog_href == "https://x.example/imagery/u1.tif" and a.thumbnail_href == "https://x.example/thumbnails/u1.webp"
    assert a.bbox is None and a.epsg == 3857 and a.uploaded_at == "2024-05-06T07:08:09+00:00"


def test_import_edge_cases(spark):
    page = {
        "meta": {"found": 9},
        "results": [
            {"_id": "1", "gsd": 0, "platform": None, "acquisition_start": "2024-01-02", "uploaded_at": "2024-02-01",
             "geojson": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]},
             "properties": {"thumbnail": "http://t/a.png"}, "uuid": "http://i/1.tif"},
            {"_id": "2", "platform": "UAV", "provider": "P", "uploaded_at": "2024-03-01", "gsd": 1e-5, "title": "T",
             "geojson": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 7], [5, 5]]]]},
             "properties": {"thumbnail": ""}},
            {"_id": "3", "uploaded_at": "2024-03-01"},
            {"_id": "4", "uploaded_at": "2019-03-01", "geojson": {"type": "Point", "coordinates": [1, 1]}},
        ],
    }
    pages = spark.createDataFrame([(json.dumps(page),), ("{}",), ("not json",)], "page string")
    records = parse_pages(pages)
    rows = {r.id: r for r in ingest.import_records(records, "https://x.example", acquired_from="2024-01-01").collect()}
    assert set(rows) == {"1", "2"}
    one, two = rows["1"], rows["2"]
    assert (one.title, one.gsd, one.platform_type, one.producer_name, one.datetime) == ("Untitled", None, "unknown", "Unknown", "2024-01-02")
    assert one.thumbnail_href == "https://x.example/thumbnails/1.png" and one.cog_href == "http://i/1.tif"
    assert (two.gsd, two.platform_type, two.producer_name, two.datetime, two.thumbnail_href) == (1.11, "uav", "P", "2024-03-01", None)
    assert tuple(two.bbox) == (5, 5, 6, 7) and (two.file_size, two.bands, two.epsg, two.width) == (0, 3, 4326, None)
    around = ingest.import_records(records, "https://x.example").select("id", wkb_bounds(F.col("geometry")).alias("b"))
    assert {r.id: tuple(r.b) for r in around.collect()} == {"1": (0, 0, 2, 1), "2": (5, 5, 6, 7), "4": (1, 1, 1, 1)}
    assert [r.id for r in ingest.import_records(records, "https://x.example", limit=1).collect()] == ["2"]


def pixel_table(spark, images):
    rows = [
        (name, band + 1, r, c, int(data[band, r, c]))
        for name, data in images.items() for band in range(data.shape[0])
        for r in range(data.shape[1]) for c in range(data.shape[2])
    ]
    return spark.createDataFrame(rows, "image_id string, band int, row int, col int, value bigint")


def stretched_by_numpy(data):
    rgb = data[:3] if data.shape[0] >= 3 else np.stack([data[0]] * 3)
    low, high = np.percentile(rgb[rgb > 0], [2, 98]) if (rgb > 0).any() else (0, 1)
    if high <= low:
        return np.zeros_like(rgb)
    return np.clip((rgb.astype(float) - low) / (high - low) * 255, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("bits", [16, 32])
def test_stretch_equals_numpy(spark, bits):
    rng = np.random.default_rng(3)
    top = 60_000 if bits == 16 else 3_000_000
    images = {
        "rgb": rng.integers(0, top, (4, 6, 7)), "grey": rng.integers(0, 50, (1, 5, 5)), "two": rng.integers(0, top, (2, 4, 4)),
        "flat": np.full((3, 3, 3), 7), "dark": np.zeros((3, 3, 3), int),
    }
    images["grey"][0, 0, 0] = 0
    rgb = raster.unpivot_rgb(raster.compose_rgb(pixel_table(spark, images)))
    got = raster.normalise(rgb, bits).collect()
    want = {name: stretched_by_numpy(data) for name, data in images.items()}
    assert len(got) == sum(w.size for w in want.values())
    assert all(r.value == want[r.image_id]["rgb".index(r.channel), r.row, r.col] for r in got)
    assert raster.normalise(rgb, 8) is rgb


def test_no_data_pixels(spark):
    values = [float(v) for v in range(1, 101)] + [float("nan")] * 20
    table = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "image_id string, row int, value double")
    (found,) = raster.percentile_range(table).collect()
    assert (found.vmin, found.vmax) == tuple(np.percentile(values[:100], [2, 98]))
    shown = {r.row: r.value for r in raster.normalise(table, 16).collect()}
    assert {shown[i] for i in range(100, 120)} == {0} and shown[0] == 0 and shown[99] == 255


def test_render_equals_numpy(spark):
    rng = np.random.default_rng(5)
    images = {
        "rgb": (rng.integers(0, 60_000, (4, 9, 5)).astype(float), 16), "grey": (rng.integers(0, 4000, (1, 3, 11)).astype(float), 16),
        "two": (rng.random((2, 6, 6)), 32), "plain": (rng.integers(0, 256, (3, 4, 4)).astype(float), 8), "dark": (np.zeros((3, 4, 4)), 16),
    }
    images["two"][0][0, ::2, 1] = np.nan
    size, rows, masks = 6, [], []
    for name, (data, bits) in images.items():
        _, h, w = data.shape
        rows += [(name, b + 1, r, c, float(data[b, r, c]), h, w, bits) for b in range(data.shape[0]) for r in range(h) for c in range(w)]
        masks += [(name, r, c, 255 if name == "dark" or (r + c) % 3 else 0, h, w) for r in range(h) for c in range(w) if name != "grey"]
    pixels = spark.createDataFrame(rows, "image_id string, band int, row int, col int, value double, height int, width int, bits int")
    mask = spark.createDataFrame(masks, "image_id string, row int, col int, mask int, height int, width int")
    got = {(r.image_id, r.row, r.col): (r.r, r.g, r.b, r.alpha) for r in raster.render(pixels, mask, size).collect()}
    want = {}
    for name, (data, bits) in images.items():
        _, h, w = data.shape
        at = [[int((i + 0.5) * n / size) for i in range(size)] for n in (h, w)]
        grid = data[:, at[0]][:, :, at[1]]
        rgb = grid[:3] if len(grid) >= 3 else np.stack([grid[0]] * 3)
        with np.errstate(invalid="ignore"):
            low, high = np.percentile(rgb[rgb > 0], [2, 98]) if (rgb > 0).any() else (0, 1)
            byte = rgb if bits == 8 else np.nan_to_num(np.clip((rgb - low) / (high - low) * 255, 0, 255)).astype(np.uint8)
        for i in range(size):
            for j in range(size):
                alpha = None if name in ("grey", "dark") else 255 if (at[0][i] + at[1][j]) % 3 else 0
                want[name, i, j] = (*[int(v) for v in byte[:, i, j]], alpha)
    assert got == want
    assert raster.render(pixels, None, size).where("alpha IS NOT NULL").count() == 0


def test_bad_records_are_listed_and_never_abort(spark):
    shapes = [
        '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,1],[0,0]]]}', "{}", '{"type":"Blob","coordinates":[1,2]}',
        '{"type":"Polygon","coordinates":[[[0,0],[2,', '{"type":"Point"}', '{"type":"Polygon","coordinates":[[["a",0]]]}', "[]", "7", None,
        '{"type":"Polygon","coordinates":[[[0,0],[1-2,0],[2,1],[0,1],[0,0]]]}', ' { "type" : "Polygon", "coordinates" : [ [ [1e0, -2.5], [3,-2.5],[3,4],[1,4],[1,-2.5] ] ] } ',
    ]
    kind = (
        "_id string, uuid string, title string, provider string, platform string, contact string, gsd double, file_size bigint, "
        "acquisition_start string, uploaded_at string, properties struct<thumbnail: string>, geojson string"
    )
    rows = [(str(i), None, None, None, None, None, None, None, "2024", None, None, shape) for i, shape in enumerate(shapes)]
    records = spark.createDataFrame(rows, kind)
    kept = ingest.import_records(records, "https://x.example").select("id", wkb_bounds(F.col("geometry")).alias("b")).collect()
    assert {r.id: tuple(r.b) for r in kept} == {"0": (0, 0, 2, 1), "10": (1, -2.5, 3, 4)}
    rejects = {r.id: r.reason for r in ingest.import_rejects(records).collect()}
    assert rejects.pop("8") == "No geometry" and set(rejects.values()) == {"Geometry cannot be read"} and len(rejects) == 8
    broken = spark.createDataFrame([(bytearray(b"\x01\x03\x00"),), (bytearray(b""),), (bytearray(b"\x01\x63\x00\x00\x00abc"),)], "g binary")
    assert [r.b for r in broken.select(wkb_bounds(F.col("g")).alias("b")).collect()] == [None] * 3


def test_unknown_metadata_is_no_valid_raster(spark):
    df = spark.createDataFrame(
        [(1, None, 20, 20, 1), (2, 3, None, 20, 1), (3, 3, 20, None, 1), (4, 3, 20, 20, None)], "k int, bands int, width int, height int, file_size bigint"
    )
    checked = ingest.validate(df)
    assert {r.reason for r in checked.collect()} == {"Image metadata missing"}
    assert {r.status for r in status.outcomes(checked, "k", "now").collect()} == {"error"}


def test_several_metadata_rows_give_one_sidecar(spark):
    rasters = spark.createDataFrame(
        [("u1", 3, 100, 50, 10, 0.1, Row(1.0, 2.0, 3.0, 4.0))],
        f"up string, bands int, width int, height int, file_size bigint, res_x double, bounds {BBOX_TYPE.simpleString()}",
    )
    for titles in (["b", "a", None], [None, "a", "b"]):
        given = spark.createDataFrame([("u1", t) for t in titles], "up string, title string")
        rows = ingest.sidecar_rows(rasters, given, "up", "2024-05-06T07:08:09+00:00", "https://x.example").collect()
        assert [r.title for r in rows] == ["b"]


def test_final_status_wins_at_equal_times(spark):
    rows = [("a", 1, "complete", "done"), ("a", 1, "processing", "uploading"), ("b", 1, "processing", "downloading"), ("b", 1, "processing", "converting"), ("c", 1, "error", None), ("c", 1, "processing", "done")]
    events = spark.createDataFrame(rows, "upload_id string, ts int, status string, step string")
    for order in (events, events.orderBy(F.desc("status"), F.desc("step")).coalesce(1)):
        assert {r.upload_id: (r.status, r.step) for r in status.latest_status(order).collect()} == {
            "a": ("complete", "done"), "b": ("processing", "converting"), "c": ("error", None),
        }


def test_mask(spark):
    masks = spark.createDataFrame([("a", 0, 0, 255), ("a", 0, 1, 0), ("b", 0, 0, 255)], "image_id string, row int, col int, mask int")
    assert {r.image_id: r.has_mask for r in raster.mask_flags(masks).collect()} == {"a": True, "b": False}
    rgb = masks.drop("mask").withColumn("r", F.lit(1))
    assert {(r.image_id, r.col, r.alpha) for r in raster.with_alpha(rgb, masks).collect()} == {("a", 0, 255), ("a", 1, 0), ("b", 0, None)}


@pytest.mark.parametrize("height,width,size", [(7, 3, 5), (5, 5, 5), (1, 20, 6), (13, 9, 4)])
def test_thumbnail(spark, height, width, size):
    data = np.arange(height * width).reshape(1, height, width)
    table = pixel_table(spark, {"x": data}).withColumns({"height": F.lit(height), "width": F.lit(width)})
    got = {(r.row, r.col): r.value for r in raster.thumbnail(table, size).collect()}
    want = {
        (i, j): int(data[0, int((i + 0.5) * height / size), int((j + 0.5) * width / size)]) for i in range(size) for j in range(size)
    }
    assert got == want


def test_status(spark):
    rows = [
        ("a", 1, "processing", "downloading"), ("a", 5, "complete", "done"), ("b", 3, "processing", "converting"),
        ("c", 2, "error", None), ("d", 400, "processing", "odd"),
    ]
    events = spark.createDataFrame(rows, "upload_id string, s int, status string, step string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    latest = status.latest_status(events)
    assert {r.upload_id: r.status for r in latest.collect()} == {"a": "complete", "b": "processing", "c": "error", "d": "processing"}
    states = {(r.upload_id, r.step): r.state for r in status.step_progress(latest).collect()}
    assert [states["b", s] for s in status.STEPS] == ["done", "done", "active"] + ["pending"] * 4
    assert {states["d", s] for s in status.STEPS} == {"pending"}
    funnel = {r.step: (r.done, r.active, r.pending) for r in status.step_funnel(latest).collect()}
    assert funnel["converting"] == (1, 1, 2) and funnel["done"] == (0, 1, 3)
    as_of = F.timestamp_seconds(F.lit(500))
    assert {r.upload_id for r in status.stale_uploads(events, as_of).collect()} == {"b"}
    assert {r.upload_id for r in status.poll_timeouts(events, as_of).collect()} == {"b"}
    assert status.time_limit() == 363
    texts = {r.upload_id: json.loads(r.value) for r in status.status_record(latest, "https://x.example").collect()}
    assert texts["a"] == {
        "status": "complete", "step": "done", "upload_id": "a", "cog_url": "https://x.example/imagery/a.tif",
        "thumbnail_url": "https://x.example/thumbnails/a.webp", "title": "",
    }
    assert texts["b"] == {"status": "processing", "upload_id": "b", "step": "converting"}
    assert texts["c"] == {"status": "error", "upload_id": "c"}


def test_geojson_and_stac_text(spark):
    from skyledger.operators.search import SearchParams, search

    df = catalog(spark, image("a", (0, 1, 2, 3), title="", file_size=5, platform_type="uav"), image("b"))
    lines = {json.loads(r.value)["properties"]["id"]: json.loads(r.value) for r in features.geojson_lines(search(df, SearchParams())).collect()}
    a = lines["a"]
    assert a["geometry"] == {"type": "Polygon", "coordinates": [[[0, 1], [2, 1], [2, 3], [0, 3], [0, 1]]]}
    assert a["properties"]["title"] == "Untitled Image" and a["properties"]["gsd"] is None and a["properties"]["provider"] == "Unknown"
    assert len(a["properties"]) == 20 and a["properties"]["platform"] == "uav"
    item = {i["id"]: i for i in (json.loads(r.value) for r in features.stac_lines(df, prefix="ext").collect())}
    assert item["a"]["bbox"] == [0, 1, 2, 3] and item["a"]["properties"]["ext:platform_type"] == "uav"
    assert "geometry" not in item["b"] and item["b"]["collection"] == "community"
