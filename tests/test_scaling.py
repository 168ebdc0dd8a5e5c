"""Plans that hold at larger sizes."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from skyledger.functions import utm
from skyledger.operators import ingest, skew
from skyledger.plans import queries
from skyledger.schema import make_bbox, to_catalog_schema
from skyledger.sources import clustered, records


def plan_of(frame):
    told = io.StringIO()
    with redirect_stdout(told):
        frame.explain()
    return told.getvalue()


def test_cells_are_never_broadcast(spark):
    def side(name):
        return spark.range(40).select(F.col("id").alias(name), (F.col("id") % 7).alias("k"))

    for limits in ({}, {"share": 100, "min_pairs": 3}):
        pairs = skew.spread_join(side("a"), side("b"), ["k"], ["a"], ["b"], **limits)
        assert "SortMergeJoin" in plan_of(pairs)
        assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a in range(40) for b in range(40) if a % 7 == b % 7}


def test_utm_bounds_computes_shared_parts_once(spark):
    row = spark.range(1).select(F.lit(32633).alias("e"), *[F.lit(float(x)).alias(n) for n, x in (("a", 4e5), ("b", 5e6), ("c", 5e5), ("d", 6e6))])
    box = utm.utm_bounds(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))
    plan = row.select(box.alias("box"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("COSH(") == len(utm.BETA) + 1


def test_tasks_of_the_order_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "TASK_ROWS", 20)
    box = make_bbox(F.col("id") * 3.0 - 170, F.lit(1.0), F.col("id") * 3.0 - 169, F.lit(2.0))
    rows = to_catalog_schema(spark.range(100).select(F.col("id").cast("string").alias("id"), box.alias("bbox")))
    clustered.write_places(rows, str(tmp_path / "places"))
    assert len(list((tmp_path / "places").glob("part-*"))) == 5
    assert clustered.read_places(spark, str(tmp_path / "places")).count() == 100


def test_imported_geometries_are_read_once(spark):
    text = '{"results":[{"_id":"a","geojson":{"type":"Point","coordinates":[1,2]}},{"_id":"b"}]}'
    landed = records.parse_pages(spark.createDataFrame([(text,)], "page string"))
    made = ingest.import_records(landed, "https://x.example")
    assert plan_of(made.select("id", "geometry")).count("ArrowEvalPython") == 1
    assert [r.id for r in made.collect()] == ["a"]


def test_upload_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"part {k}") for k in range(10, 2_000, 10)], "p_partkey bigint, p_name string").write.parquet(
        str(tmp_path / "part.parquet")
    )
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    made = queries.run_upload_metadata(spark, str(tmp_path))
    tasks = {path.name[:10] for path in (tmp_path / "staging").glob("upload=*/part-*.txt")}
    assert len(tasks) > 1
    assert made.count() == len([k for k in range(10, 2_000, 10) if k % 3])


def test_lone_hits_are_not_shuffled_for_their_features(spark, tmp_path):
    order = ["id AS o_orderkey", "id % 9 AS o_custkey", "timestamp '1996-02-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"]
    spark.range(300).selectExpr(*order).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(500).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    text = plan_of(queries.run_hit_features(spark, str(tmp_path)))
    assert not re.search(r"hashpartitioning\(event_id#\d+L, id#", text)
