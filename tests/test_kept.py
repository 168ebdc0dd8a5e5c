"""Postings and partial statistics beside a catalog in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from rows import catalog, ids, image, plan
from skyledger.operators.search import SearchParams, search
from skyledger.operators.stats import catalog_stats
from skyledger.sources import buckets, kept

PARTS = ["Survey", " of the", "100%", "_a", "straße", "É", "ab", "\\", "x", " ", "MOSAIC"]
TEXTS = ["survey", "of the", "0%", "y_of", "a%b", "%", "_", "ab", "e mos", "STRASSE", "straße", "é", "\\", "100%_a", "vey%mosaic", "nothing here"]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    draw, path = random.Random(2), str(tmp_path_factory.mktemp("kept"))
    made = lambda n: [
        image(f"i{draw.randrange(900)}" if k else None, uploaded_at=str(n), title=draw.choice([None, "", "".join(draw.choice(PARTS) for _ in range(6))]),
              platform_type=draw.choice([None, "uav", "UAV", f"p{n}"]), file_size=draw.choice([None, 5, 10**12]), datetime=draw.choice([None, f"20{n}0"]), license=draw.choice(["CC-BY-4.0", None]))
        for k in range(300)
    ]
    buckets.write_buckets(catalog(spark, *made(1)), path, 8)
    kept.renew(spark, path)
    buckets_of_first = {r.file for r in spark.read.parquet(f"{path}/postings").select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    touched = buckets.merge_buckets(catalog(spark, *made(2)[1:20]), path)
    kept.renew(spark, path, touched)
    later = {r.file for r in spark.read.parquet(f"{path}/postings").select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    untouched = [f for f in buckets_of_first if not any(f"bucket={n}/" in f for n in touched)]
    assert set(untouched) <= later
    return path


@pytest.mark.parametrize("literal", [False, True])
def test_found_as_by_search(spark, root, literal):
    rows = buckets.read_buckets(spark, root)
    for text in TEXTS:
        want = ids(search(rows.na.fill("-", ["id"]), SearchParams(query=text, literal=literal, limit=None)))
        assert ids(kept.search_kept(spark, root, text, literal=literal).na.fill("-", ["id"])) == want, text
    licensed = kept.search_kept(spark, root, "cc-by", "license")
    assert licensed.count() == rows.where("license IS NOT NULL").count() > 0


def test_postings_are_used_and_read_by_gram(spark, root):
    assert kept.needed_grams("a%bcd_efgh") == ["bcd", "efg", "fgh"] and kept.needed_grams("a%bc") == []
    assert kept.needed_grams("a%bc", literal=True) == ["%bc", "a%b"]
    text = plan(kept.search_kept(spark, root, "survey"))
    assert "In(gram, [" in text and "postings" in text and "LeftSemi" in text
    assert "postings" not in plan(kept.search_kept(spark, root, "ab"))
    with pytest.raises(ValueError, match="no postings"):
        kept.search_kept(spark, root, "survey", "producer_name")


def test_statistics_need_no_catalog(spark, root):
    got = kept.kept_stats(spark, root)
    assert got.collect() == catalog_stats(buckets.read_buckets(spark, root)).collect()
    assert "/catalog" not in plan(got)


def test_empty_catalog(spark, tmp_path):
    root = str(tmp_path / "none")
    buckets.write_buckets(catalog(spark, image("a", title="abc")), root, 2)
    kept.renew(spark, root)
    kept.renew(spark, root, [])
    assert ids(kept.search_kept(spark, root, "abc")) == ["a"] and ids(kept.search_kept(spark, root, "abcd")) == []


def test_postings_are_lists_and_shuffle_no_gram(spark, tmp_path, monkeypatch):
    root, made = str(tmp_path / "lists"), [("a", "aaaa😀b"), ("b", "AAAA"), ("c", None), (None, "xaaa"), ("d", "ab"), ("e", "")]
    buckets.write_buckets(catalog(spark, *[image(i, title=t) for i, t in made]), root, 1)
    plans = []
    monkeypatch.setattr(kept, "_store", lambda rows, path, mode, store=kept._store: (plans.append(plan(rows)), store(rows, path, mode)))
    kept.renew(spark, root)
    held = spark.read.parquet(f"{root}/postings")
    assert {(r.field, r.gram, tuple(sorted(r.ids, key=str))) for r in held.collect()} == {
        ("title", "aaa", (None, "a", "b")), ("title", "aa😀", ("a",)), ("title", "a😀b", ("a",)), ("title", "xaa", (None,)),
    }
    # What is dealt out is a row for each image; its grams never cross the network.
    assert "MapInArrow" in plans[0] and "Generate" not in plans[0] and plans[0].index("Exchange") > plans[0].index("MapInArrow")


def test_chunks_of_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "IMAGES", 40)
    root, batch = str(tmp_path / "small"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    buckets.write_buckets(catalog(spark, *[image(f"i{k}", title=f"no {k % 30} of {k}") for k in range(200)]), root, 3)
    spark.conf.set(batch, 7)
    try:
        kept.renew(spark, root)
    finally:
        spark.conf.unset(batch)
    held = spark.read.parquet(f"{root}/postings")
    assert held.agg(F.max(F.size("ids"))).first()[0] <= 7
    # A bucket's postings come from several tasks.
    assert held.select("bucket", F.shiftright("chunk", 32)).distinct().count() > 5
    for text in ("no 12 of", "o 1%of 1", " of "):
        assert ids(kept.search_kept(spark, root, text)) == ids(search(buckets.read_buckets(spark, root), SearchParams(query=text, limit=None)))
