import random

from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.functions.wkb import box_wkb
from skyledger.operators import merge
from skyledger.schema import CATALOG_SCHEMA


def flat(df):
    return sorted(df.select("id", "title", "uploaded_at", "bbox").collect(), key=str)


def with_box(df, w, s, e, n):
    return df.withColumn("geometry", box_wkb(*[F.lit(float(v)) for v in (w, s, e, n)]))


def test_union_casts_by_name(spark):
    base = catalog(spark, image("a", (0, 0, 1, 1), width=5, title="x"))
    other = spark.createDataFrame([("y", 7, "b", "note", 1)], "title string, width bigint, id string, extra string, rn int")
    both = merge.union_by_name(base, other)
    assert both.columns == CATALOG_SCHEMA.names + ["extra"]
    assert both.schema["width"].dataType.simpleString() == "int"
    assert {(r.id, r.title, r.width, r.extra) for r in both.collect()} == {("a", "x", 5, None), ("b", "y", 7, "note")}


def test_bbox_fields_are_matched_by_name(spark):
    other = spark.sql("SELECT 'a' AS id, named_struct('xmin', 1f, 'xmax', 3f, 'ymin', 2f, 'ymax', 4f) AS bbox")
    box = merge.union_by_name(other).first().bbox
    assert (box.xmin, box.ymin, box.xmax, box.ymax) == (1.0, 2.0, 3.0, 4.0)


def test_latest_wins_nulls_last_and_ties_are_decided(spark):
    rows = catalog(
        spark,
        image("a", uploaded_at="2024-01-01", title="old"), image("a", uploaded_at="2024-02-01", title="new"),
        image("a", uploaded_at=None, title="none"),
        image("t", uploaded_at="2024-01-01", title="p"), image("t", uploaded_at="2024-01-01", title="q"),
        image(None, uploaded_at="1"), image(None, uploaded_at="2", title="null id"),
    )
    got = {r.id: r.title for r in merge.latest_per_id(rows.repartition(5)).collect()}
    assert got == {"a": "new", "t": "q", None: "null id"}


def test_merge_is_idempotent_and_order_free(spark):
    rng = random.Random(5)

    def some(n, label):
        # A third of the rows are copies of one id.
        return catalog(
            spark,
            *[
                image("hot" if rng.random() < 1 / 3 else f"i{rng.randrange(40)}", title=f"{label}{i}",
                      uploaded_at=f"2024-01-{rng.randrange(1, 29):02}")
                for i in range(n)
            ],
            image(None, title=label, uploaded_at=rng.choice(["2023", "2025"])),
        )

    base, late = with_box(some(120, "b"), 0, 1, 2, 3), with_box(some(60, "p"), 4, 5, 6, 7)
    merged = merge.merge_catalog(base, late)
    once = flat(merged)
    assert flat(merge.merge_catalog(merged, late)) == once
    assert flat(merge.merge_catalog(late, base)) == once
    unique = merge.merge_catalog(base, base.limit(0))
    assert flat(merge.merge_catalog(unique, late, base_unique=True)) == once
    assert flat(merge.merge_catalog(merged, late, base_unique=True)) == once


def test_backfill_only_where_missing(spark):
    df = with_box(catalog(spark, image("a", (9, 9, 10, 10)), image("b")), 0, 1, 2, 3)
    df = df.unionByName(catalog(spark, image("c")))
    boxes = {r.id: r.bbox and (r.bbox.xmin, r.bbox.ymin, r.bbox.xmax, r.bbox.ymax) for r in merge.backfill_bbox(df).collect()}
    assert boxes == {"a": (9, 9, 10, 10), "b": (0, 1, 2, 3), "c": None}


def test_update(spark):
    df = catalog(spark, image("a", cog_href="x"), image("b", cog_href="y"))
    updates = spark.createDataFrame([("a", "new"), ("zz", "none")], "id string, new_href string")
    out = merge.update_hrefs(df, updates)
    assert out.columns == df.columns
    assert {r.id: r.cog_href for r in out.collect()} == {"a": "new", "b": "y"}


def test_report(spark):
    base, late = catalog(spark, image("a"), image("b")), catalog(spark, image("a"), image("c", (0, 0, 1, 1)))
    late = late.withColumn("source_file", F.concat(F.lit("f"), "id"))
    row = merge.merge_report(base, late, merge.merge_catalog(base, late.drop("source_file"))).first()
    assert (row.rows_before, row.merged, row.rows_after, row.rows_with_bbox) == (4, 2, 3, 1)


def test_plans(spark):
    df = catalog(spark, image("a"))
    text = plan(merge.latest_per_id(df))
    # The limit per id is applied on both sides of the shuffle.
    assert text.count("WindowGroupLimit") >= 2
    assert ids(df) == ["a"]


def test_ties_never_depend_on_row_order(spark):
    rows = [image("a", (0, 0, 1, 1), uploaded_at="1", license=name) for name in ("CC0", "CC-BY 4.0", "CC-BY-SA")]
    found = {merge.latest_per_id(catalog(spark, *order).coalesce(1)).first().license for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(found) == 1


def test_several_updates_of_one_id(spark):
    base = catalog(spark, image("a", (0, 0, 1, 1), cog_href="old"), image("b", (0, 0, 1, 1), cog_href="kept"))
    for hrefs in (["n1", "n2", None], [None, "n2", "n1"]):
        updates = spark.createDataFrame([("a", h) for h in hrefs], "id string, new_href string")
        assert {(r.id, r.cog_href) for r in merge.update_hrefs(base, updates).collect()} == {("a", "n2"), ("b", "kept")}
        assert merge.update_hrefs(base, updates).count() == 2
