"""What is kept beside a catalog in buckets: postings for text search and partial statistics.

Both are partitioned by bucket like the catalog, so after a merge only the buckets it touched are made anew (``renew``).
``root/postings`` has a row for each three-letter gram of a chunk of texts, with the ids in that chunk that hold it, sorted by gram,
so that a search reads the row groups of its own grams. A chunk is a batch of rows of one bucket, so no list outgrows a batch. ``root/partials`` has numbers for each bucket and platform, whose sums, minima and maxima are those of the catalog.
A merge that ends before ``renew`` leaves them as they were; the same ``renew`` again completes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.operators.search import text_predicate
from skyledger.operators.stats import merge_partials, stats_partials
from skyledger.schema import to_catalog_schema
from skyledger.session import ship_package
from skyledger.sources.catalog import ROW_GROUP

GRAM = 3
#: Images whose postings a task makes and sorts. The tasks grow in number with the catalog, so none has to spill. Ids of up to
#: 16 bytes or so fit Parquet's dictionary then, and a posting takes two bytes.
IMAGES = 50_000
POSTINGS = "bucket int, field string, gram string, chunk bigint, ids array<string>"
#: Texts that can be searched through postings.
TEXTS = ("title", "license")


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each place of a gram in the texts: the gram as three code points of 21 bits, and the text's number."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    inside = np.flatnonzero(text[: -(GRAM - 1)] == text[GRAM - 1 :])
    return points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2], text[inside]


def _spelled(grams: np.ndarray) -> list[str]:
    mask = (1 << 21) - 1
    points = np.stack([grams >> 42, grams >> 21 & mask, grams & mask], axis=1).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)]


def _batch_postings(batch: pa.RecordBatch, field: str, chunk: int) -> pa.RecordBatch:
    """A row for each bucket and gram of a batch of rows, with the different ids that hold it."""
    gram, row = _grams(batch.column(field).to_pylist())
    known, number = np.unique(gram, return_inverse=True)
    buckets, bucket = np.unique(batch.column("bucket").to_numpy(), return_inverse=True)
    # One number for bucket, gram and row: equal ones are a gram that stands several times in a text.
    held = np.unique((bucket[row] * len(known) + number) * batch.num_rows + row)
    group, row = held // max(batch.num_rows, 1), held % max(batch.num_rows, 1)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    first = group[starts]
    made = {
        "bucket": pa.array(buckets[first // max(len(known), 1)], pa.int32()),
        "field": pa.array([field] * len(first), pa.string()),
        "gram": pa.array(_spelled(known[first % max(len(known), 1)]), pa.string()),
        "chunk": pa.array(np.full(len(first), chunk), pa.int64()),
        "ids": pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), batch.column("id").take(pa.array(row))),
    }
    return pa.RecordBatch.from_pydict(made)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        for field in TEXTS:
            yield _batch_postings(batch, field, task << 32 | n)


def needed_grams(text: str, literal: bool = False) -> list[str]:
    """Grams that every match of ``search``'s text predicate holds: those of the pieces between its wildcards."""
    wanted = text.lower()
    pieces = [wanted] if literal else re.split("[%_]", wanted)
    return sorted({piece[i : i + GRAM] for piece in pieces for i in range(len(piece) - GRAM + 1)})


def _store(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", mode)
        .option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    )


def renew(spark: SparkSession, root: str, buckets: Iterable[int] | None = None) -> None:
    """Make postings and partial statistics of these buckets anew, or of all."""
    rows, mode = spark.read.parquet(f"{root}/catalog"), "static"
    if buckets is not None:
        numbers = sorted(buckets)
        if not numbers:
            return
        rows, mode = rows.where(F.col("bucket").isin(numbers)), "dynamic"
    ship_package(spark)
    # Only ids and texts are dealt, before they become some thirty postings each, and in tasks whose number follows their own.
    texts = rows.select("bucket", "id", *[F.lower(name).alias(name) for name in TEXTS])
    dealt = texts.repartitionByRange(-(-max(rows.count(), 1) // IMAGES), "bucket", "id")
    postings = dealt.mapInArrow(_postings, POSTINGS).sortWithinPartitions("bucket", "field", "gram")
    _store(postings, f"{root}/postings", mode)
    partials = stats_partials(rows, ["bucket"]).hint("rebalance", "bucket").sortWithinPartitions("bucket", "platform_type")
    _store(partials, f"{root}/partials", mode)


def kept_stats(spark: SparkSession, root: str) -> DataFrame:
    """``stats.catalog_stats`` from the partial statistics, without a look at the catalog."""
    return merge_partials(spark.read.parquet(f"{root}/partials"))


def ids_with_grams(spark: SparkSession, root: str, field: str, grams: list[str]) -> DataFrame:
    """Bucket and id of the images whose text holds all ``grams``."""
    if field not in TEXTS:
        raise ValueError(f"no postings for {field!r}")
    held = spark.read.parquet(f"{root}/postings").where((F.col("field") == field) & F.col("gram").isin(grams))
    # All postings of an image are in one chunk, so chunks are intersected each for itself.
    lists = held.groupBy("bucket", "chunk").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
    common = F.reduce(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), F.array_intersect)
    return lists.select("bucket", F.explode(common).alias("id"))


def search_kept(spark: SparkSession, root: str, text: str, field: str = "title", literal: bool = False) -> DataFrame:
    """Catalog rows whose ``field`` matches ``text``, as ``search`` has it.

    Postings give the candidates, the predicate decides. A text without a whole gram between its wildcards scans the catalog.
    """
    rows = spark.read.parquet(f"{root}/catalog")
    grams = needed_grams(text, literal)
    if grams:
        found = ids_with_grams(spark, root, field, grams).withColumnsRenamed({"bucket": "_bucket", "id": "_id"})
        same = (F.col("bucket") == F.col("_bucket")) & F.col("id").eqNullSafe(F.col("_id"))
        rows = rows.join(found, same, "left_semi")
    return to_catalog_schema(rows.where(text_predicate(field, text, literal)).drop("bucket"))
