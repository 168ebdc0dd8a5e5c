"""Viewports as ranges of quadtree cells."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.functions.geo import with_hilbert_key
from skyledger.operators.search import SearchParams, search
from skyledger.sources import clustered


def boxes(seed, n):
    draw = random.Random(seed)
    out = [(-180, -90, 180, 90), (0, 0, 0, 0), (180, 90, 180, 90), (-400, -200, 400, 200), (5, 5, 4, 4), (170, 0, 190, 1)]
    for _ in range(n):
        size = draw.choice([0, 0.001, 0.02, 0.4, 5, 60, 200])
        x, y = draw.uniform(-185, 185), draw.uniform(-95, 95)
        out.append((x, y, x + size * draw.choice([1, 0.1]), y + size * draw.choice([0.5, 1])))
    return out


def frame(spark, seed, n):
    odd = [image("none"), image("nan", (float("nan"), 0, 1, 1)), image("inf", (float("-inf"), 0, float("inf"), 1))]
    return catalog(spark, *[image(f"i{i:05d}", b) for i, b in enumerate(boxes(seed, n))], *odd)


def test_curve_equals_stored_key(spark):
    draw = random.Random(1)
    spots = [(draw.uniform(-180, 180), draw.uniform(-90, 90)) for _ in range(300)]
    rows = with_hilbert_key(catalog(spark, *[image(str(i), (x, y, x, y)) for i, (x, y) in enumerate(spots)])).select("id", "hilbert").collect()
    for row in rows:
        x, y = spots[int(row.id)]
        assert row.hilbert == clustered.curve_index(16, int((x + 180) / 360 * 65536), int((y + 90) / 180 * 65536))


@pytest.mark.parametrize("most", [1, 3, 8, 1000])
def test_ranges_cover_the_rectangle(most):
    draw = random.Random(most)
    for _ in range(60):
        level = draw.randrange(6)
        x0, x1 = sorted(draw.randrange(1 << level) for _ in range(2))
        y0, y1 = sorted(draw.randrange(1 << level) for _ in range(2))
        found = clustered.curve_ranges(level, x0, x1, y0, y1, most)
        cells = {clustered.curve_index(level, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        covered = {i for a, b in found for i in range(a, b + 1)}
        assert cells <= covered and 0 < len(found) <= most and all(a <= b for a, b in found)
        if most == 1000:
            assert cells == covered


@pytest.mark.parametrize("seed", range(3))
def test_no_hit_is_lost(spark, tmp_path, seed):
    df, path = frame(spark, seed, 1500), str(tmp_path / "places")
    clustered.write_places(df, path, row_group=50, partitions=4)
    assert ids(clustered.read_places(spark, path)) == ids(df)
    views = [((10, 10, 40, 40), False), ((170, -90, -170, 90), True), ((400, 0, 401, 1), False), ((-180, -90, 180, 90), False), ((5, 5, 5, 5), False), ((0, 0, 1e-6, 1e-6), False)]
    views += [((x, y, x + w, y + w), False) for x, y, w in ((-179.99, 89.9, 1), (12.3, 45.6, 0.01), (-60, -60, 119))]
    for view, wrap in views:
        params = SearchParams(bbox=view, wrap=wrap, limit=None)
        for most in (1, 8):
            assert ids(search(clustered.read_places(spark, path, view, wrap, most), params)) == ids(search(df, params))


def row_groups(path, wanted):
    hit = total = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            hit += wanted(stats)
    return hit, total


def test_ranges_reach_parquet_and_skip_row_groups(spark, tmp_path):
    draw = random.Random(7)
    spots = [(draw.uniform(-179, 179), draw.uniform(-89, 89)) for _ in range(20_000)]
    sizes = [draw.choice([0.01, 0.01, 0.3, 2]) for _ in spots]
    df = catalog(spark, *[image(f"i{i:05d}", (x, y, x + s, y + s)) for i, ((x, y), s) in enumerate(zip(spots, sizes))])
    placed, view = str(tmp_path / "placed"), (10.0, 10.0, 40.0, 40.0)
    clustered.write_places(df, placed, row_group=100, partitions=2)
    ranges = clustered.place_ranges(view)

    def meets(s):
        return s["bbox.xmax"].max >= 10 and s["bbox.xmin"].min <= 40 and s["bbox.ymax"].max >= 10 and s["bbox.ymin"].min <= 40

    in_ranges, total = row_groups(placed, lambda s: any(s["place"].max >= a and s["place"].min <= b for a, b in ranges))
    both, _ = row_groups(placed, lambda s: meets(s) and any(s["place"].max >= a and s["place"].min <= b for a, b in ranges))
    assert len(ranges) <= 1 + 2 * clustered.MOST_RANGES and both <= in_ranges < total / 3
    near = clustered.read_places(spark, placed, view)
    pushed = next(line for line in plan(near).splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(place," in pushed
    params = SearchParams(bbox=view, limit=None)
    assert ids(search(near, params)) == ids(search(df, params))


def test_equal_boxes_spread(spark, tmp_path):
    df = spark.range(4000).select(F.format_string("i%05d", "id").alias("id")).crossJoin(catalog(spark, image("x", (1, 1, 2, 2))).drop("id")).select(*catalog(spark).columns)
    path = str(tmp_path / "same")
    clustered.write_places(df, path, partitions=4)
    assert max(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet")) < 2000
