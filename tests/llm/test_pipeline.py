"""Every stage against what the operator's brute force keeps, and the whole job."""

import os

import corpus
import corpus_pipeline
import pytest

import __spark_entry__ as entry_point
from skyledger.llm import quality
from skyledger.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages_and_run(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "packing":
            assert kept.columns == columns
        have = {r.doc_id: r.text for r in kept.collect()} if name != "packing" else {}
        if name == "quality":
            scores = quality.quality_scores(docs, table(spark, SF_DIR, "labels")).collect()
            assert set(have) == {r.doc_id for r in scores if r.predicted}
        elif name == "line_dedup":
            assert have == {i: text for i, _, _, text in corpus.dedup_lines(rows)}
        elif name == "near_dedup":
            assert set(have) == {i for i, _, _, stays in corpus.near_duplicates(rows) if stays}
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
            assert set(have) == {i for i, *_, bad in corpus.contamination(rows, items) if not bad}
        docs = kept
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    stepwise = docs.collect()
    digest = lambda rows: corpus.bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(whole) == digest(stepwise)


def test_registered():
    names = set(entry_point.queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) >= 10
