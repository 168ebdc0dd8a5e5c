import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.functions import dates
from skyledger.operators.search import (
    SearchParams, get_item, newest_first, next_page, number_pages, page_of, search, visible_count, visible_rows,
)


@pytest.fixture(scope="module")
def images(spark):
    return catalog(
        spark,
        image("a", (0, 0, 1, 1), title="Delta 100% done", datetime="2024-01-05", gsd=0.1, platform_type="UAV", license="CC-BY-4.0"),
        image("b", (1, 1, 2, 2), title="delta_1000 done", datetime="2024-01-31T23:59:59Z", gsd=3.0, platform_type="drone", license="CC-BY 4.0"),
        image("c", (5, 5, 6, 6), title="", datetime="2024-01-31T23:59:59+00:00", platform_type="Satellite", license="CC-BY-SA-4.0"),
        image("d", None, title=None, datetime="2024-02-01T00:00:00Z", gsd=0.0, platform_type=""),
        image("e", (178, 0, 179, 1), title="back\\slash", datetime=None, platform_type=None),
        image("f", (-179, 0, -178, 1), title="x", datetime="2024-01-31", gsd=9.0),
    )


def found(images, **params):
    return ids(search(images, SearchParams(**params)))


def test_viewport_edges_touch_and_null_box_never_matches(images):
    assert found(images, bbox=(1, 1, 1, 1)) == ["a", "b"]
    assert found(images, bbox=(-180, -90, 180, 90)) == ["a", "b", "c", "e", "f"]
    assert found(images, bbox=(0.5, 0.5, 2, 2), bbox_mode="within") == ["b"]


def test_antimeridian(images):
    assert found(images, bbox=(170, -10, -170, 10)) == []
    assert found(images, bbox=(170, -10, -170, 10), wrap=True) == ["e", "f"]


def test_end_day_as_text_and_as_time(images):
    assert found(images, date_start="2024-01-31", date_end="2024-01-31") == ["c", "f"]
    assert found(images, date_start="2024-01-31", date_end="2024-01-31", date_mode="timestamp") == ["b", "c", "f"]


def test_platform_alias_only_for_exact_argument(images):
    assert found(images, platform="uav") == ["a", "b"]
    assert found(images, platform="UAV") == ["a"]
    assert found(images, platform="SATELLITE") == ["c"]


def test_license_spellings_differ(images):
    assert found(images, license="cc-by-4.0") == ["a"]
    assert found(images, license="CC-BY") == ["a", "b", "c"]


def test_zero_and_empty_mean_no_filter(images):
    assert found(images, max_gsd=0, query="", platform="", license="", date_start="") == list("abcdef")
    assert found(images, max_gsd=3) == ["a", "b", "d"]


def test_wildcards_live_unless_literal(images):
    assert found(images, query="100% done") == ["a", "b"]
    assert found(images, query="100% done", literal=True) == ["a"]
    assert found(images, query="A_1") == ["a", "b"]
    assert found(images, query="A_1", literal=True) == ["b"]
    assert found(images, query="k\\s") == ["e"]


def test_newest_first_with_id_ties_and_nulls_last(images, spark):
    same = images.withColumn("datetime", F.when(F.col("id") != "c", F.lit("2024")))
    assert [r.id for r in search(same, SearchParams(limit=3)).collect()] == ["a", "b", "d"]
    assert [r.id for r in search(same, SearchParams(limit=10)).collect()][-1] == "c"


def test_lookup(images):
    assert ids(get_item(images, "b")) == ["b"]
    assert ids(get_item(images, "' OR '1'='1")) == []


def test_pages(spark):
    many = catalog(spark, *[image(f"i{n:02}", datetime=f"2024-01-{31 - n:02}") for n in range(23)])
    rows = {r.id: r for r in number_pages(search(many)).collect()}
    assert (rows["i00"].page, rows["i00"].remaining) == (1, 13)
    assert (rows["i22"].rank, rows["i22"].page, rows["i22"].remaining) == (23, 3, 0)
    assert ids(page_of(search(many, SearchParams(limit=None)), 3)) == ["i20", "i21", "i22"]
    assert visible_count(23) == 10 and visible_count(23, loads=2) == 23
    assert visible_count(23, selected_index=15) == 20 and visible_count(23, selected_index=3) == 10
    assert len(ids(visible_rows(search(many)))) == 10
    assert len(ids(visible_rows(search(many), loads=1))) == 20
    assert len(ids(visible_rows(search(many), selected_id="i15"))) == 20
    assert len(ids(visible_rows(search(many), selected_id="i03"))) == 10


def test_pages_of_any_result(spark):
    draw = random.Random(8)
    rows = [image(None if n % 50 == 0 else f"i{n:04}", (n % 9, 0, 1, 1), datetime=draw.choice([None, "2024-01-01", "2024-01-02", f"20{n % 90:02}"])) for n in range(700)]
    rows += [image("same", datetime="2024")] * 30
    results = search(catalog(spark, *rows), SearchParams(limit=None))
    got = sorted(number_pages(results, 7).select("rank", "datetime", "id", "total", "page", "remaining").collect())
    want = sorted(((r.datetime, r.id) for r in results.collect()), key=lambda r: ([-ord(c) for c in r[0]] + [1] if r[0] is not None else [9], r[1] is None, r[1] or ""))
    assert [(r.datetime, r.id) for r in got] == want and [r.rank for r in got] == list(range(1, 731))
    assert all(r.total == 730 and r.page == (r.rank - 1) // 7 + 1 and r.remaining == 730 - min(r.page * 7, 730) for r in got)
    text = plan(number_pages(results))
    assert "Window" not in text and "SinglePartition" not in text
    assert number_pages(results.limit(0)).collect() == [] == visible_rows(results.limit(0)).collect()


def test_next_page_reads_on_from_the_last_row(spark, tmp_path):
    rows = [image(None if n == 7 else f"i{n:03}", datetime=[None, "2024-01-01", f"2023-{n:03}"][n % 3]) for n in range(60)]
    results = search(catalog(spark, *rows), SearchParams(limit=None))
    whole = [(r.datetime, r.id) for r in results.orderBy(*newest_first()).collect()]
    seen, last = [], None
    while page := [(r.datetime, r.id) for r in next_page(results, last, 7).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == whole
    catalog(spark, *rows).write.parquet(str(tmp_path / "c"))
    text = plan(next_page(search(spark.read.parquet(str(tmp_path / "c")), SearchParams(limit=None)), ("2024-01-01", "i004")))
    assert "TakeOrderedAndProject" in text and "LessThan(datetime,2024-01-01)" in text


def test_presets_and_their_labels(spark):
    as_of = dt.date(2024, 3, 1)
    assert dates.date_preset("week", as_of) == ("2024-02-23", "2024-03-01")
    assert dates.date_preset("month", as_of) == ("2024-01-31", "2024-03-01")
    assert dates.date_preset("year", as_of) == ("2024-01-01", "2024-03-01")
    assert dates.date_preset("any", as_of) == ("", "")
    saved = [dates.date_preset(n, as_of) for n in ("week", "month", "year", "any")] + [
        ("2024-01-01", "2024-02-01"), ("2024-02-23", "2024-02-29"), ("", "2024-03-01"),
    ]
    df = spark.createDataFrame(saved, "s string, e string")
    labels = [r.l for r in df.select(dates.date_range_label(F.col("s"), F.col("e"), as_of).alias("l")).collect()]
    assert labels == ["Past Week", "Past Month", "This Year", "Any Date", "This Year", "Custom Date", "Custom Date"]
