import os
import random

import pytest
from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.functions.wkb import box_wkb
from skyledger.operators import merge, status
from skyledger.sources import buckets as store
from skyledger.sources import jobs, pending
from skyledger.sources.records import parse_pages
from skyledger.streaming import merge as merge_stream
from skyledger.streaming import state
from skyledger.streaming import status as status_stream


def sidecars(spark, *images):
    box = [F.lit(float(v)) for v in (0, 0, 1, 1)]
    return catalog(spark, *images).withColumn("geometry", box_wkb(*box))


def run(spark, folder, root, **options):
    query = merge_stream.start_merge(spark, folder, root, f"{root}/checkpoint", **options)
    query.awaitTermination()
    return query


def files(root):
    """Data file -> time of its last change."""
    return {f"{where}/{name}": os.stat(f"{where}/{name}").st_mtime_ns for where, _, names in os.walk(f"{root}/catalog") for name in names if name.endswith(".parquet")}


def rows_of(spark, root):
    return sorted(store.read_buckets(spark, root).collect(), key=str)


def test_merge_stream(spark, tmp_path):
    folder, root, archive = str(tmp_path / "pending"), str(tmp_path / "root"), str(tmp_path / "archive")
    first = sidecars(spark, image("a", uploaded_at="2024-01-01", title="one"), image("b", uploaded_at="2024-01-01"))
    pending.append_sidecars(first.coalesce(1), folder)
    run(spark, folder, root, archive=archive)
    assert ids(store.read_buckets(spark, root)) == ["a", "b"]
    before = {name for _, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}

    # Nothing new: nothing is written.
    held = files(root)
    run(spark, folder, root, archive=archive)
    assert files(root) == held

    second = sidecars(spark, image("a", uploaded_at="2024-02-01", title="two"), image("c", uploaded_at="2024-02-01"))
    pending.append_sidecars(second.coalesce(1), folder)
    run(spark, folder, root, archive=archive)
    rows = {r.id: (r.title, r.bbox is not None) for r in store.read_buckets(spark, root).collect()}
    assert rows == {"a": ("two", True), "b": (None, True), "c": (None, True)}

    third = sidecars(spark, image("a", uploaded_at="2023-01-01", title="late and old"))
    pending.append_sidecars(third.coalesce(1), folder)
    run(spark, folder, root, archive=archive)
    assert {r.id: r.title for r in store.read_buckets(spark, root).collect()}["a"] == "two"
    # Merged sidecars were moved away after their batch had been committed.
    archived = {name for _, _, names in os.walk(archive) for name in names if name.endswith(".parquet")}
    assert before <= archived


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    store.write_buckets(merge.backfill_bbox(sidecars(spark, image("a", uploaded_at="1"))), root, 4)
    batch = sidecars(spark, image("a", uploaded_at="2", title="new"), image("b", uploaded_at="2"), image(None, uploaded_at="2"))
    apply = merge_stream.merge_batch(root)
    apply(batch, 0)
    once = rows_of(spark, root)
    apply(batch, 0)
    assert rows_of(spark, root) == once and len(once) == 3
    held = files(root)
    apply(batch.limit(0), 1)
    assert files(root) == held


def test_rebuild(spark, tmp_path):
    folder, root = str(tmp_path / "pending"), str(tmp_path / "root")
    os.makedirs(folder)
    assert merge_stream.rebuild_catalog(spark, folder, root) == 0
    assert rows_of(spark, root) == [] and store.bucket_count(spark, root) is None
    for name in ("a", "b"):
        pending.append_sidecars(sidecars(spark, image(name, uploaded_at="1")).coalesce(1), folder)
    assert merge_stream.rebuild_catalog(spark, folder, root, buckets=4) == 2
    once = rows_of(spark, root)
    assert merge_stream.rebuild_catalog(spark, folder, root) == 0
    assert rows_of(spark, root) == once and len(once) == 2 and store.bucket_count(spark, root) == 4


@pytest.mark.parametrize("order", ["id", "hilbert", "datetime"])
def test_merge_rewrites_touched_partitions_only(spark, tmp_path, order):
    root = str(tmp_path / "root")
    rows = [image(f"i{i:04d}", bbox=(i % 90, 0, i % 90 + 1, 1), uploaded_at="1") for i in range(400)]
    store.write_buckets(catalog(spark, *rows), root, 16, order)
    first = files(root)
    bucket = {r.id: r.b for r in catalog(spark, *rows, image("zz")).select("id", store.bucket_of(F.col("id"), 16).alias("b")).collect()}
    late = catalog(spark, image("i0005", uploaded_at="2", title="new"), image("i0006", uploaded_at="0", title="old"), image("zz", uploaded_at="2"))
    changed = {bucket[name] for name in ("i0005", "i0006", "zz")}
    assert store.merge_buckets(late, root, order) == sorted(changed) and len(changed) < 16
    second = files(root)
    touched = lambda name: any(f"/bucket={b}/" in name for b in changed)
    assert {f: t for f, t in first.items() if not touched(f)} == {f: t for f, t in second.items() if not touched(f)}
    assert not {f for f in first if touched(f)} & second.keys()
    merged = {r.id: r.title for r in store.read_buckets(spark, root).collect()}
    assert len(merged) == 401 and merged["i0005"] == "new" and merged["i0006"] is None and "zz" in merged
    once = rows_of(spark, root)
    store.merge_buckets(late, root, order)
    assert rows_of(spark, root) == once
    assert [r.title for r in store.get_from_buckets(spark, root, "i0005").collect()] == ["new"]
    assert store.get_from_buckets(spark, root, "nobody").collect() == []
    partition = next(line for line in plan(store.get_from_buckets(spark, root, "i0005")).splitlines() if "PartitionFilters" in line)
    assert "bucket" in partition


def test_incremental_merge_equals_full_merge(spark):
    draw = random.Random(3)
    pick = lambda *values: draw.choice([None, *values])

    def some(n, unique):
        names = [f"i{i}" for i in range(n)] if unique else [f"i{draw.randrange(40)}" for _ in range(n)]
        return [image(name, uploaded_at=pick("1", "2"), title=pick("s", "t"), gsd=pick(1.0, 2.0), datetime=pick("2020")) for name in [*names, None]]

    base, late = some(30, True), some(60, False)
    merged = [merge.merge_catalog(catalog(spark, *base), catalog(spark, *late), base_unique=u) for u in (True, False)]
    full = [sorted(map(str, (r.asDict() for r in m.select("id", "uploaded_at", "title", "gsd", "datetime").collect()))) for m in merged]
    assert full[0] == full[1] and len(full[0]) == len({r[0] for r in [*base, *late]})
    extra = catalog(spark, *late).withColumn("source_file", F.lit("f"))
    assert merge.merge_catalog(catalog(spark, *base), extra, base_unique=True).where("source_file = 'f'").count() > 0


def test_duplicates_of_an_import_go(spark, tmp_path):
    root = str(tmp_path / "root")
    store.write_buckets(sidecars(spark, image("x", uploaded_at="1"), image("x", uploaded_at="2")), root)
    assert [(r.id, r.uploaded_at) for r in store.read_buckets(spark, root).collect()] == [("x", "2")]
    merge_stream.merge_batch(root)(sidecars(spark, image("y", uploaded_at="1")), 3)
    assert ids(store.read_buckets(spark, root)) == ["x", "y"]


def test_import_and_conversion(spark, tmp_path):
    shape = '{"type":"Polygon","coordinates":[[[%d,0],[%d,0],[%d,1],[%d,1],[%d,0]]]}'
    lines = [
        '{"_id":"%d","uuid":"http://legacy/%d.tif","uploaded_at":"2024","geojson":%s}' % (i, i, shape % (i, i + 1, i + 1, i, i)) for i in range(40)
    ]
    page = '{"results":[' + ",".join([*lines, '{"_id":"99","geojson":{}}']) + "]}"
    root = str(tmp_path / "root")
    assert store.convert_buckets(spark, root, "legacy", F.lit("x")) == 0
    jobs.import_catalog(parse_pages(spark.createDataFrame([(page,)], "page string")), root, "https://x.example", row_group=10, buckets=8)
    assert store.read_buckets(spark, root).count() == 40
    changed = store.convert_buckets(spark, root, "legacy", F.when(F.col("id") != "7", F.concat(F.lit("new/"), "id")))
    rows = {r.id: r.cog_href for r in store.read_buckets(spark, root).collect()}
    assert changed == 39 and rows["7"] == "http://legacy/7.tif" and rows["8"] == "new/8" and len(rows) == 40
    held = files(root)
    assert store.convert_buckets(spark, root, "legacy", F.when(F.col("id") == "7", F.lit("seven"))) == 1
    assert len(held.keys() - files(root).keys()) == 1
    assert store.convert_buckets(spark, root, "nowhere", F.lit("x")) == 0


def status_files(spark, path, batches):
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "upload_id string, s bigint, step string, status string")
        df.select("upload_id", F.timestamp_seconds("s").alias("ts"), "step", "status").coalesce(1).write.parquet(f"{path}/{number}")


def feed(spark, path):
    schema = "upload_id string, ts timestamp, step string, status string"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [
    [("a", 1000, "downloading", "processing"), ("b", 1000, "downloading", "processing"), ("d", 1010, "done", "complete")],
    [("a", 1100, "done", "complete"), ("c", 1300, "validating", "processing"), ("b", 1050, "converting", "processing")],
    [("b", 1500, "done", "complete"), ("e", 2000, "downloading", "processing")],
]


def test_latest_status_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    status_files(spark, source, BATCHES)
    stream = feed(spark, source)
    assert status_stream.read_latest_status(spark, out, stream.schema).count() == 0
    status_stream.start_latest_status(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted(status_stream.read_latest_status(spark, out, stream.schema).collect())
    batch = spark.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(source)
    assert got == sorted(status.latest_status(batch).collect()) and len(got) == 5


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.set("spark.sql.session.timeZone", old)


def test_timeouts_equal_batch(spark, tmp_path, zone):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    status_files(spark, source, BATCHES)
    late = state.poll_timeout_stream(feed(spark, source), delay="10 minutes", retention_seconds=10**6)
    status_stream.start_append(late, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.schema(late.schema).parquet(out).selectExpr("upload_id", "unix_seconds(started) AS s").collect()
    got = sorted(r.upload_id for r in rows)
    assert {r.s for r in rows} == {1000}
    batch = spark.read.option("recursiveFileLookup", True).schema("upload_id string, ts timestamp, step string, status string").parquet(source)
    # b ended after its limit; c's limit (1663) is beyond the last watermark (1400).
    assert got == ["b"]
    assert sorted(r.upload_id for r in status.poll_timeouts(batch, F.timestamp_seconds(F.lit(1400))).collect()) == ["b"]


@pytest.mark.parametrize("retention, told", [(None, []), (86400, [("a", "error")])])
def test_write_after_the_outcome(spark, tmp_path, retention, told):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = 86400
    status_files(spark, source, [
        [("a", 1000, "done", "complete")],
        [("x", 1000 + 2 * day, "done", "complete")],  # moves the watermark beyond a's retention
        [("y", 1001 + 2 * day, "done", "complete")],
        [("a", 1002 + 2 * day, "downloading", "processing"), ("b", 1002 + 2 * day, "done", "complete")],
        [("z", 2000 + 3 * day, "done", "complete")],
        [("w", 2001 + 3 * day, "done", "complete")],
    ])
    late = state.poll_timeout_stream(feed(spark, source), retention_seconds=retention)
    status_stream.start_append(late, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.schema(late.schema).parquet(out).collect()
    assert [(r.upload_id, r.status) for r in rows] == told


def test_compacted_log_has_the_same_state(spark, tmp_path):
    source, out, small = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "small")
    status_files(spark, source, BATCHES)
    stream = feed(spark, source)
    status_stream.start_latest_status(stream, out, str(tmp_path / "cp")).awaitTermination()
    status_stream.compact_latest_status(spark, out, small, stream.schema)
    whole, compact = (status_stream.read_latest_status(spark, p, stream.schema) for p in (out, small))
    assert sorted(whole.collect()) == sorted(compact.collect()) and spark.read.parquet(small).count() == whole.count()


def test_funnel_takes_back_old_steps(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    draw = random.Random(6)
    steps = [*status.STEPS, "unknown", None]
    batches = [
        [(f"u{draw.randrange(30)}", draw.randrange(40), draw.choice(steps), draw.choice(["processing", "complete", "error"])) for _ in range(60)]
        for _ in range(5)
    ]
    status_files(spark, source, batches)
    moves = state.step_funnel_stream(feed(spark, source))
    assert {(r.done, r.active, r.pending) for r in state.read_funnel(spark, out).collect()} == {(0, 0, 0)}
    for _ in range(2):  # the second run finds nothing new
        status_stream.start_append(moves, out, str(tmp_path / "cp")).awaitTermination()
        batch = spark.read.option("recursiveFileLookup", True).schema(feed(spark, source).schema).parquet(source)
        want = status.step_funnel(status.latest_status(batch))
        assert sorted(map(tuple, state.read_funnel(spark, out).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # Every batch changed the numbers, so that steps were left again.
    assert max(r.version for r in spark.read.parquet(out).collect()) >= 5


def test_sidecars_of_two_streams(spark, tmp_path):
    from skyledger.streaming.sidecars import stream_sidecar_rows

    def landed(name, kind, batches):
        for number, rows in enumerate(batches):
            made = spark.createDataFrame(rows, kind.replace("bounds double", "west double"))
            if "west" in made.columns:
                box = "named_struct('xmin', west, 'ymin', 0D, 'xmax', west + 1, 'ymax', 1D)"
                made = made.selectExpr("k", "timestamp_seconds(s) AS staged_at", f"{box} AS bounds", "0.5D AS res_x", "3 AS bands", "9 AS width", "9 AS height", "7L AS file_size")
            else:
                made = made.selectExpr("k", "timestamp_seconds(s) AS written_at", "title")
            made.coalesce(1).write.parquet(f"{tmp_path}/{name}/{number}")
        return spark.readStream.schema(made.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    hour = 3600
    rasters = landed("rasters", "k long, s long, bounds double", [
        [(1, 100, 1.0), (2, 200, 2.0), (3, 300, 3.0), (4, 400, 4.0)], [(5, 500, 5.0)], [(6, 600, 6.0)], [(99, 50 * hour, 0.0)],
    ])
    uploads = landed("uploads", "k long, s long, title string", [
        [(1, 90, "early"), (3, 300 + 2 * hour, "too late"), (5, 400, "before its raster")], [(2, 900, "after")], [(6, 700, None), (2, 901, "again")], [(98, 50 * hour, "x")],
    ])
    made = stream_sidecar_rows(rasters, uploads, "k", "2024-03-01T00:00:00+00:00", "https://x.example", delay="30 minutes")
    status_stream.start_append(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r.id: r.title for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()}
    # 3 and 4 have no metadata in time and are told without, once the time is over; 99 still waits for its own.
    assert rows == {"1": "early", "2": "after", "3": "Untitled", "4": "Untitled", "5": "before its raster", "6": "Untitled"}


def test_merge_and_write_shuffle_the_base_once(spark, tmp_path, monkeypatch):
    root, plans = str(tmp_path / "once"), []
    monkeypatch.setattr(store, "_write", lambda rows, *args, write=store._write: (plans.append(plan(rows, "simple")), write(rows, *args)))
    made = [image(f"i{k % 90}" if k else None, (0, 0, 1, 1), uploaded_at=str(k), title=f"t{k}") for k in range(120)]
    late = catalog(spark, image("i1", (0, 0, 1, 1), uploaded_at="999", title="new"), image("i2", uploaded_at="0"), image("n", uploaded_at=None), image(None, uploaded_at=None))
    store.write_buckets(catalog(spark, *made), root, 3)
    merged = rows_of(spark, root)
    store.merge_buckets(late, root)
    want = merge.merge_catalog(catalog(spark, *made), late)
    assert len(merged) == 91 and rows_of(spark, root) == sorted(want.collect(), key=str) and len(rows_of(spark, root)) == 92
    assert "Join" not in plans[1] and "hashpartitioning(bucket" in plans[0] and "hashpartitioning(id" not in plans[0]
    # An id with very many copies sends one row per task.
    monkeypatch.setattr(store, "MOST_COPIES", 1)
    store.write_buckets(catalog(spark, *made), str(tmp_path / "hot"), 3)
    assert rows_of(spark, str(tmp_path / "hot")) == merged and plans[2].count("WindowGroupLimit") > plans[0].count("WindowGroupLimit")
