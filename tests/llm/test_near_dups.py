import random

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import near_dups


def check(spark, rows, similarity=85):
    docs = corpus.frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = near_dups.near_duplicates(docs, similarity=similarity).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert corpus.bag(got) == corpus.bag(corpus.near_duplicates(rows, similarity))
    return docs


def copies(draw, vocabulary, n, groups):
    """Texts in groups whose members differ by a few words, around the limit."""
    texts = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 6, 20, 60, 120]))]
        for _ in range(n):
            text = list(base)
            for _ in range(draw.randrange(3)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            texts.append(draw.choice([" ", "\n", "\t "]).join(text).upper() if draw.random() < 0.3 else " ".join(text))
    return texts


def test_equals_brute_force(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "é", "ß", "\x85", "\xa0x"]
    texts = [None, "", " \n\t", "one", "ONE", "one two", *copies(draw, vocabulary, 12, 12)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    docs = check(spark, list(zip(order, texts, strict=True)))
    kept = near_dups.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in corpus.near_duplicates(list(zip(order, texts, strict=True))) if k}


def test_large_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    draw = random.Random(9)
    check(spark, list(enumerate(copies(draw, [f"v{i}" for i in range(500)], 60, 2))))


def test_chains_are_followed(spark):
    base = [f"c{i}" for i in range(150)]
    # Neighbours are alike, the ends of the chain are not.
    rows = [(40 - k, " ".join([*[f"x{k}y{j}" for j in range(3 * k)][:0], *base[3 * k :], *[f"n{j}" for j in range(3 * k)]])) for k in range(12)]
    check(spark, rows)


def test_many_equal_texts_and_null_ids(spark):
    rows = [(i, "the same text again and again") for i in range(300)]
    docs = corpus.frame(spark, [t for _, t in rows] + ["the same text again and again", None], [i for i, _ in rows] + [None, None])
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == 302 and sum(r.kept for r in got) == 3
    assert {r.component_id for r in got} == {0, None}


def test_repeated_ids(spark):
    odd = corpus.frame(spark, ["a b c d e f", None, "", "a b c d e f", "a b c d e f g"], [1, 1, 1, 3, 2])
    assert sorted((r.doc_id, r.component_id) for r in near_dups.near_duplicates(odd).collect()) == [(1, 1), (1, 1), (1, 1), (2, 2), (3, 1)]
    docs = corpus.frame(spark, ["a b c d e f"] * 2 + ["g h i j k l"], [1, 1, 2])
    got = near_dups.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 2, True)]


def test_empty_table(spark):
    docs = corpus.frame(spark, ["x"]).limit(0)
    assert near_dups.near_duplicates(docs).collect() == [] == near_dups.without_near_duplicates(docs).collect()


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        a = np.unique(draw.integers(0, 1 << 63, 900).astype(np.uint64))
        b = np.unique(np.r_[a[: int(share * len(a))], draw.integers(0, 1 << 63, 60).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(near_dups.signature(a) == near_dups.signature(b)) - true) < 0.1


def test_long_text(spark):
    text = " ".join(f"w{i % 7001}" for i in range(60_000))
    check(spark, [(2, text), (1, text + " end"), (3, "short")])


def test_texts_that_fill_the_ring_share_no_bands():
    draw = np.random.default_rng(4)
    a, b = (np.unique(draw.integers(0, 1 << 63, 3_000_000).astype(np.uint64)) for _ in range(2))
    x, y = near_dups.signature(a), near_dups.signature(b)
    assert (x == y).sum() == 0 and not set(near_dups.band_hashes(x)) & set(near_dups.band_hashes(y))
    near = np.unique(np.r_[a[60_000:], b[:60_000]])
    assert np.mean(x == near_dups.signature(near)) > 0.9


@pytest.fixture
def without_help(spark):
    """No broadcast by size, no adaptive split of skewed partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of_tasks(df):
    counts = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())
    return counts[len(counts) // 2], counts[-1]


def test_one_hot_key_is_spread(spark, without_help):
    rows = spark.range(300_000).select(F.when(F.col("id") < 250_000, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("row")).repartition(16, "row")
    found = rows.groupBy("key").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = near_dups.looked_up(rows, found, ["key"], 300_000)
    median, most = rows_of_tasks(joined)
    assert joined.count() == 300_000 and joined.columns == ["key", "row", "least"]
    assert most <= 4 * max(median, 300_000 // 16)
    assert joined.where("least <> IF(row < 250000, 0, row)").count() == 0


def test_one_hub_keeps_its_component(spark, without_help):
    links = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionAll(spark.range(1).select((F.col("id") + 70_000).alias("a"), (F.col("id") + 70_001).alias("b")))
    found = near_dups.components(links)
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 60_000), (70_000, 2)}


def test_a_hot_pivots_pairs_go_to_many_groups(spark, without_help, monkeypatch):
    monkeypatch.setattr(near_dups, "SHARE", 20)
    texts = spark.range(2_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 4, "q r s t u v").otherwise("a b c d e f").alias("text"))
    pairs = spark.range(1, 2_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    linked = near_dups.confirmed(pairs, texts, 5, 85)
    assert sorted(r.b for r in linked.collect()) == [i for i in range(1, 2_001) if i % 5 != 4]
