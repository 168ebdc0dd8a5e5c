import datetime as dt
import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.operators.search import SearchParams, search
from skyledger.operators.stats import catalog_stats
from skyledger.schema import CATALOG_SCHEMA
from skyledger.session import scratch_path, scratch_root
from skyledger.sources import catalog as store
from skyledger.sources import pending, records
from skyledger.sources.sample import sample_catalog


def scattered(spark, n):
    k = F.col("id")
    x, y = (k * 37 % 350).cast("double") - 175, (k * 91 % 160).cast("double") - 80
    box = F.struct(x.alias("xmin"), y.alias("ymin"), (x + 0.5).alias("xmax"), (y + 0.5).alias("ymax"))
    rows = spark.range(n).select(
        F.format_string("i%06d", k).alias("id"), box.alias("bbox"), F.format_string("20%02d-01-01", k % 25).alias("datetime"),
        F.lit("2024").alias("uploaded_at"),
    )
    return store.to_catalog_schema(rows)


def parts(path):
    return [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path}/*.parquet"))]


def test_missing_catalog_is_empty(spark, tmp_path):
    none = store.read_catalog_or_empty(spark, str(tmp_path / "nowhere"))
    assert none.schema == CATALOG_SCHEMA and none.count() == 0
    assert tuple(catalog_stats(none).first()) == (0, None, None, 0, 0)
    with pytest.raises(Exception):
        store.read_catalog_or_empty(spark, "nosuchscheme://x/y")


def test_id_layout(spark, tmp_path):
    path = str(tmp_path / "by-id")
    store.write_catalog(scattered(spark, 25_000), path, partitions=1)
    (file,) = parts(path)
    meta = file.metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [10_000, 10_000, 5_000]
    assert meta.row_group(0).column(0).compression == "ZSTD"
    written = file.read(["id"]).column(0).to_pylist()
    assert written == sorted(written)


def test_order_is_global_over_files(spark, tmp_path):
    for order, key in [("id", lambda r: r["id"]), ("datetime", lambda r: ([-ord(c) for c in r["datetime"]], r["id"]))]:
        path = str(tmp_path / order)
        store.write_catalog(scattered(spark, 3000), path, order, partitions=4)
        files = parts(path)
        rows = [r for f in files for r in f.read(["id", "datetime"]).to_pylist()]
        assert len(files) == 4 and rows == sorted(rows, key=key)


def test_clustered_layout_reads_fewer_row_groups(spark, tmp_path):
    view = (10.0, 10.0, 40.0, 40.0)

    def touched(path):
        hit = total = 0
        for file in parts(path):
            names = [file.metadata.row_group(0).column(c).path_in_schema for c in range(file.metadata.num_columns)]
            for g in range(file.metadata.num_row_groups):
                stat = {n: file.metadata.row_group(g).column(names.index(f"bbox.{n}")).statistics for n in ("xmin", "ymin", "xmax", "ymax")}
                total += 1
                hit += (
                    stat["xmax"].max >= view[0] and stat["xmin"].min <= view[2]
                    and stat["ymax"].max >= view[1] and stat["ymin"].min <= view[3]
                )
        return hit, total

    by_id, clustered = str(tmp_path / "id"), str(tmp_path / "hilbert")
    df = scattered(spark, 20_000)
    store.write_catalog(df, by_id, "id", row_group=100, partitions=2)
    store.write_catalog(df, clustered, "hilbert", row_group=100, partitions=2)
    hit, total = touched(by_id)
    assert hit > 0.9 * total
    hit, total = touched(clustered)
    assert hit < total / 5
    found = [search(store.read_catalog(spark, p), SearchParams(bbox=view, limit=None)) for p in (by_id, clustered)]
    assert ids(found[0]) == ids(found[1]) and found[0].count() > 0


def test_equal_hilbert_keys_spread_over_files(spark, tmp_path):
    same = scattered(spark, 4000).withColumn(
        "bbox", F.when(F.col("id") < "i003000", F.expr("named_struct('xmin', 1d, 'ymin', 1d, 'xmax', 2d, 'ymax', 2d)")).otherwise(F.col("bbox"))
    )
    path = str(tmp_path / "same")
    store.write_catalog(same, path, "hilbert", partitions=4)
    assert max(f.metadata.num_rows for f in parts(path)) < 2000


def test_search_plan(spark, tmp_path):
    path = str(tmp_path / "plan")
    store.write_catalog(scattered(spark, 100), path)
    df = store.read_catalog(spark, path)
    text = plan(search(df, SearchParams(bbox=(0, 0, 9, 9), date_start="2001", date_end="2002", max_gsd=3)))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThanOrEqual(bbox.xmax,0.0)", "LessThanOrEqual(bbox.xmin,9.0)", "LessThanOrEqual(bbox.ymin,9.0)"):
        assert part in pushed
    stats_text = plan(catalog_stats(df))
    schema = next(line for line in stats_text.splitlines() if "ReadSchema" in line)
    assert schema.strip() == "ReadSchema: struct<datetime:string,platform_type:string,file_size:bigint>"
    narrow = plan(df.select("bbox.xmin"))
    assert "ReadSchema: struct<bbox:struct<xmin:double>>" in narrow


def test_pending_files_of_different_shape(spark, tmp_path):
    folder = tmp_path / "pending"
    (folder / "deep").mkdir(parents=True)
    assert pending.read_pending(spark, str(folder)).count() == 0
    assert pending.read_pending(spark, str(tmp_path / "none")).count() == 0
    pq.write_table(pa.table({"id": ["a"], "width": pa.array([5], pa.int64()), "title": ["A"]}), folder / "a.parquet")
    pq.write_table(pa.table({"title": ["B"], "width": pa.array([6], pa.int32()), "id": ["b"], "gsd": [0.5]}), folder / "deep" / "b.parquet")
    (folder / "notes.txt").write_text("not a sidecar")
    rows = {r.id: r for r in pending.read_pending(spark, str(folder)).collect()}
    assert {k: (r.title, r.width, r.gsd) for k, r in rows.items()} == {"a": ("A", 5, None), "b": ("B", 6, 0.5)}
    assert rows["a"].source_file.endswith("/a.parquet") and rows["a"].bbox is None


def test_upload_metadata(spark, tmp_path):
    for key, body in {"u1": {"title": "T", "license": "L"}, "u 2": None}.items():
        (tmp_path / "staging" / key).mkdir(parents=True)
        (tmp_path / "staging" / key / "meta.json").write_text(json.dumps(body) if body else "{broken")
    rows = {r.upload_id: r for r in records.read_upload_metadata(spark, str(tmp_path / "staging")).collect()}
    assert set(rows) == {"u1", "u 2"}
    assert (rows["u1"].title, rows["u1"].license, rows["u1"].platform) == ("T", "L", None)
    assert (rows["u 2"].title, rows["u 2"].license) == (None, None)


def test_staged_objects(spark, tmp_path):
    (tmp_path / "staging" / "u1").mkdir(parents=True)
    (tmp_path / "staging" / "u1" / "image.tif").write_bytes(b"12345")
    (tmp_path / "staging" / "loose.tif").write_bytes(b"1")
    df = records.read_objects(spark, str(tmp_path / "staging"), str(tmp_path), "*.tif")
    rows = {r.object_key: (r.file_size, r.upload_id) for r in df.collect()}
    assert rows == {"staging/u1/image.tif": (5, "u1"), "staging/loose.tif": (1, None)}
    assert "content" not in plan(df)


def test_pages_per_file(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"_id": "1", "geojson": {"type": "Point", "coordinates": [1.25, 2]}}]}, indent=2))
    row = records.read_pages(spark, str(tmp_path), one_per_file=True).first()
    assert row["_id"] == "1" and json.loads(row.geojson) == {"type": "Point", "coordinates": [1.25, 2]}


def test_sample_is_reproducible(spark):
    keys = spark.range(300)
    make = lambda seed: sample_catalog(keys.repartition(3), "id", dt.date(2024, 5, 1), "https://x.example", seed)
    rows = sorted(make(0).collect(), key=str)
    assert rows == sorted(make(0).collect(), key=str) and rows != sorted(make(1).collect(), key=str)
    assert len({r.id for r in rows}) == 300 and {r.platform_type for r in rows} == {"satellite", "uav", "aircraft"}
    for r in rows:
        limit = {"satellite": 0.4, "uav": 0.04, "aircraft": 0.16}[r.platform_type]
        assert 0 < r.bbox.xmax - r.bbox.xmin <= limit + 1e-9 and "2022-05-01" <= r.datetime[:10] <= "2024-04-30"
        assert r.datetime < r.uploaded_at and r.geometry is not None


def test_scratch_is_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert os.path.isabs(scratch_root(spark))


def test_lost_values_are_counted(spark):
    from skyledger.schema import lost_values

    df = spark.createDataFrame([(99999999999, "1"), (5, "x"), (None, None)], "width bigint, height string")
    assert lost_values(df).first().asDict() == {"width": 1, "height": 1}
