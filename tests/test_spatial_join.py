import random
from functools import partial

import pytest
from pyspark.sql import Row, functions as F

from rows import catalog, image, plan
from skyledger.operators import skew, spatial_join as sj
from skyledger.schema import BBOX_TYPE


def touches(a, b):
    return a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]


def box(rng):
    """Boxes of very different sizes, a third of them at one place, some with swapped edges."""
    size = rng.choice([0, 0.001, 0.3, 0.3, 5, 90, 360])
    if rng.random() < 1 / 3:
        x, y = 13.4, 52.5
    else:
        x, y = rng.uniform(-190, 190), rng.uniform(-90, 90)
    w, h = size * rng.choice([1, 0.1]), size * rng.choice([1, 0.5])
    if rng.random() < 0.1:
        return (x + w, y, x, y + h)
    return (round(x, 3), round(y, 3), round(x + w, 3), round(y + h, 3))


def boxes(spark, values, name):
    rows = [(i, Row(*map(float, b)) if b else None) for i, b in enumerate(values)]
    return spark.createDataFrame(rows, f"{name} int, bbox {BBOX_TYPE.simpleString()}")


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("min_pairs", [skew.MIN_PAIRS, 25])
def test_pairs_equal_nested_loop(spark, seed, min_pairs):
    rng = random.Random(seed)
    left, right = [box(rng) for _ in range(150)] + [None], [box(rng) for _ in range(120)] + [None]
    got = sj.box_pairs(
        boxes(spark, left, "a"), boxes(spark, right, "b"), ["a"], ["b"], share=10, min_pairs=min_pairs
    ).collect()
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and touches(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("min_pairs", [skew.MIN_PAIRS, 25])
def test_points_equal_nested_loop(spark, min_pairs):
    rng = random.Random(9)
    images = [box(rng) for _ in range(200)] + [(10, 10, 20, 20), None]
    spots = [(13.4, 52.5)] * 60 + [(rng.uniform(-190, 190), rng.uniform(-90, 90)) for _ in range(100)]
    spots += [(10.0, 10.0), (20.0, 20.0), (20.0000001, 20.0), (10.0, 15.0), (None, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "p int, lon double, lat double")
    got = sj.point_hits(boxes(spark, images, "a"), points, ["a"], ["p"], share=10, min_pairs=min_pairs).collect()
    want = {
        (i, j) for i, a in enumerate(images) for j, (x, y) in enumerate(spots)
        if a and x is not None and touches(a, (x, y, x, y))
    }
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_endless_boxes(spark):
    inf = float("inf")
    left = [(-inf, -inf, inf, inf), (5, -inf, inf, 7), (-1e9, 0, 1e9, 1), (0, 0, 0.01, 0.01)]
    right = [(0, 0, 1, 1), (6, 6, 6, 6), (1e8, 0.5, 2e8, 0.6), (-inf, 50, -1e5, 60)]
    got = sj.box_pairs(boxes(spark, left, "a"), boxes(spark, right, "b"), ["a"], ["b"]).collect()
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if touches(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nothing_on_one_side(spark):
    some, none = boxes(spark, [(0, 0, 1, 1)], "a"), boxes(spark, [None], "b")
    assert sj.box_pairs(some, none, ["a"], ["b"]).count() == 0
    assert sj.box_pairs(none.withColumnRenamed("b", "a"), some.withColumnRenamed("a", "b"), ["a"], ["b"]).count() == 0


def test_hot_keys_are_split(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(900).select(F.col("id").alias("r"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(left, right, ["k"], share=100, min_pairs=2500).collect()
    assert [(r.k, r._lc, r._rc) for r in hot] == [(0, 15, 7)]  # 1000 x 450 pairs; chunks of at most (450,600 / 100) ** 0.5 rows
    assert skew.hot_keys(left, right, ["k"]) is None
    got = skew.spread_join(left, right, ["k"], ["id"], ["r"], share=100, min_pairs=2500)
    plain = left.join(right, "k")
    assert got.count() == plain.count() == got.select("id", "r").distinct().count()
    assert got.select("id", "r", "k").exceptAll(plain.select("id", "r", "k")).count() == 0


def test_one_cell_goes_to_many_tasks(spark):
    plain = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in plain:
        spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 20_000
        side = lambda name: spark.range(n).select(F.col("id").alias(name), F.lit(1).alias("k"))
        hot = skew.hot_keys(side("a"), side("b"), ["k"]).first()
        assert (hot._lc, hot._rc) == (10, 10)
        pairs = skew.spread_join(side("a"), side("b"), ["k"], ["a"], ["b"])
        per_task = pairs.where("a % 100 = b % 100").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in per_task) == n * n // 100
        # A hundred chunks meet in all of the session's eight partitions.
        assert len(per_task) == 8 and max(r["count"] for r in per_task) < n * n // 300
    finally:
        for name in plain:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_first_hit_does_not_depend_on_row_order(spark):
    rows = [(1, "a", "t2", None), (1, "a", "t1", 5), (1, "a", "t1", 4), (2, "", "x", 1)]
    kind = "p int, id string, title string, n int"
    for order in (rows, rows[::-1]):
        hits = spark.createDataFrame(order, kind).coalesce(1)
        assert [tuple(r) for r in sj.unique_hits(hits, ["p"]).collect()] == [(1, "a", "t1", 4)]
        assert [tuple(r) for r in sj.unique_hits(hits, ["p"], order=("n",)).collect()] == [(1, "a", "t2", None)]


def test_counts_and_features(spark):
    images = catalog(
        spark, image("a", (0, 0, 2, 2), title="A"), image("b", (1, 1, 3, 3), title="B"), image("", (0, 0, 9, 9)), image(None, (0, 0, 9, 9)),
    )
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 50.0, 50.0)], "p int, lon double, lat double")
    hits = sj.point_hits(images, points, ["id"], ["p"]).withColumn("hit_title", F.lit("from hit"))
    unique = sj.unique_hits(hits.unionAll(hits), ["p"])
    assert {(r.p, r.images) for r in sj.overlap_counts(unique, ["p"]).collect()} == {(1, 2), (2, 1)}
    full = sj.hit_features(hits.unionAll(hits), images.where("id = 'a'"), ["p"], {"title": "hit_title"})
    assert {(r.p, r.id, r.title) for r in full.collect()} == {(1, "a", "A"), (1, "b", "from hit"), (2, "a", "A")}
    views = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 1.0), (2, 70.0, 70.0, 80.0, 80.0)], "v int, west double, south double, east double, north double"
    )
    counts = sj.viewport_counts(images.where("id <> ''"), views, ["v"])
    assert {(r.v, r.images) for r in counts.collect()} == {(1, 2), (2, 0)}


@pytest.mark.parametrize("repeats", ["", "images", "points", "images points"])
@pytest.mark.parametrize("min_pairs", [skew.MIN_PAIRS, 25])
def test_features_of_hits_to_find(spark, repeats, min_pairs):
    rng = random.Random(len(repeats))
    ids = lambda n: [f"i{k % 40 if 'images' in repeats else k}" for k in range(n)]
    corners = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(120)]
    size = lambda: rng.choice([0.2, 1, 6])
    rows = [image(i, (x, y, x + size(), y + size()), title=f"t{rng.random()}") for i, (x, y) in zip(ids(117), corners)]
    rows += [image(None, (0, 0, 9, 9)), image("", (0, 0, 9, 9)), image("no box", None)]
    images = catalog(spark, *rows).withColumnRenamed("title", "hit_title")
    spots = [(None if n == 0 else n % 30 if "points" in repeats else n, rng.uniform(0, 9), rng.uniform(0, 9)) for n in range(80)]
    points = spark.createDataFrame(spots + spots[:9] if "points" in repeats else spots, "p int, lon double, lat double")
    shown = catalog(spark, *[image(i, (0, 0, 1, 1), title=f"full {i}", gsd=1.0) for i in ids(117)[1:40:2]], image("i2", (0, 0, 1, 1), gsd=2.0))
    find = partial(sj.point_hits, share=10, min_pairs=min_pairs)
    hits = sj.Hits(images, points, ["id", "hit_title"], ["p"], find)
    made = find(images, points, ["id", "hit_title"], ["p"])
    got, want = (sj.hit_features(h, shown, ["p"], {"title": "hit_title"}) for h in (hits, made))
    assert got.schema.simpleString() == want.schema.simpleString()
    columns = ["id", "p", "title", "gsd", "bbox"]
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert text(got) == text(want) and len(text(got)) > 100


def test_no_nested_loop(spark):
    images, points = catalog(spark, image("a", (0, 0, 2, 2))), spark.createDataFrame([(1, 1.0, 1.0)], "p int, lon double, lat double")
    text = plan(sj.point_hits(images, points, ["id"], ["p"]))
    assert "NestedLoop" not in text and "Cartesian" not in text and "_cell" in text
