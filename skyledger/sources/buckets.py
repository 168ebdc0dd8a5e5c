"""The catalog as Parquet partitioned by a hash of the id: a merge rewrites the partitions that it touches.

``root/catalog/bucket=…`` has the rows and ``root/layout`` the number of buckets. Spark lists, prunes, stages and replaces the
partitions (dynamic overwrite). Every id stands once, so a bucket can be merged for itself. A write that ends halfway leaves some buckets
with the old rows and others with the new ones; the same write again, or the next merge of the same rows, completes it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.geo import WORLD, with_hilbert_key
from skyledger.operators.merge import latest_per_id, merge_catalog, update_hrefs
from skyledger.operators.search import legacy_hrefs
from skyledger.schema import to_catalog_schema
from skyledger.session import scratch_path
from skyledger.sources.catalog import ROW_GROUP, empty_catalog, missing_path

#: Enough for catalogs of some ten million images; a bucket should fit a task.
BUCKETS = 64
#: The number of buckets is a bound for what a merge collects: the numbers of those it touches.
MOST_BUCKETS = 100_000
#: An id with more copies than this is limited before the shuffle.
MOST_COPIES = 1000
#: Parts of the buckets for each shuffle partition; so many that the partitions come out alike.
SPREAD = 4


def bucket_of(image_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(image_id), F.lit(buckets).cast("bigint")).cast("int")


def bucket_count(spark: SparkSession, root: str) -> int | None:
    """The catalog's number of buckets; ``None`` if there is no catalog."""
    try:
        return spark.read.schema("buckets int").json(f"{root}/layout").first().buckets
    except AnalysisException as error:
        if missing_path(error):
            return None
        raise


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """All rows, or none when there is no catalog yet."""
    try:
        rows = spark.read.parquet(f"{root}/catalog")
    except AnalysisException as error:
        if missing_path(error):
            return empty_catalog(spark)
        raise
    return to_catalog_schema(rows.drop("bucket"))


def get_from_buckets(spark: SparkSession, root: str, image_id: str) -> DataFrame:
    """The row with this id, or no row: one partition is listed and read."""
    buckets = bucket_count(spark, root)
    if buckets is None:
        return empty_catalog(spark)
    rows = spark.read.parquet(f"{root}/catalog").where(F.col("bucket") == bucket_of(F.lit(image_id), buckets))
    return to_catalog_schema(rows.where(F.col("id") == F.lit(image_id)).drop("bucket"))


def _dealt(spark: SparkSession, buckets: int) -> dict[str, Column]:
    """The bucket and a part of it: what rows are dealt by, so that a bucket is written by several tasks."""
    parts = -(-SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    return {"bucket": bucket_of(F.col("id"), buckets), "_part": F.pmod(F.hash("id"), F.lit(parts))}


def _write(dealt: DataFrame, root: str, mode: str, order: str, row_group: int, frame: tuple) -> None:
    """Write rows that are dealt by their ``bucket``; a large bucket comes from several tasks, in a file each."""
    if order == "hilbert":
        dealt = with_hilbert_key(dealt, frame=frame)
    elif order not in ("id", "datetime"):
        raise ValueError(f"unknown order {order!r}")
    sort = {"id": [F.asc_nulls_last("id")], "datetime": [F.desc_nulls_last("datetime"), F.asc_nulls_last("id")]}.get(
        order, [F.asc_nulls_last("hilbert"), F.asc_nulls_last("id")]
    )
    (
        dealt.sortWithinPartitions("bucket", *sort).drop("hilbert", "_part").write.mode("overwrite").partitionBy("bucket")
        .option("partitionOverwriteMode", mode).option("compression", "zstd").option("parquet.block.row.count.limit", row_group)
        .parquet(f"{root}/catalog")
    )


def write_buckets(
    rows: DataFrame, root: str, buckets: int = BUCKETS, order: str = "id", row_group: int = ROW_GROUP, frame: tuple = WORLD,
    unique: bool = False,
) -> None:
    """Write a new catalog of the latest row of every id, or replace the one in ``root``.

    Inside a bucket rows go by ``id``, ``hilbert`` or ``datetime`` (newest first). ``rows`` must not come from ``root``.
    The ids' copies are counted first, unless ``unique`` tells that ``rows`` have been merged already.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    spark = rows.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{root}/layout")
    rows = to_catalog_schema(rows)
    copies = None if unique else rows.groupBy("id").count().agg(F.max("count")).first()[0]
    if copies and copies > MOST_COPIES:
        rows = latest_per_id(rows)
    _write(latest_per_id(rows, _dealt(spark, buckets)), root, "static", order, row_group, frame)


def _touched(rows: DataFrame, root: str, buckets: int) -> tuple[list[int], DataFrame]:
    """The buckets of the ids in ``rows`` (as many numbers as there are buckets at most), and the catalog's rows in them."""
    spark = rows.sparkSession
    numbers = sorted(r.bucket for r in rows.select(bucket_of(F.col("id"), buckets).alias("bucket")).distinct().collect())
    try:
        held = spark.read.parquet(f"{root}/catalog").where(F.col("bucket").isin(numbers)).drop("bucket")
    except AnalysisException as error:
        if not missing_path(error):
            raise
        held = empty_catalog(spark)
    return numbers, to_catalog_schema(held)


def merge_buckets(
    rows: DataFrame, root: str, order: str = "id", buckets: int = BUCKETS, row_group: int = ROW_GROUP
) -> list[int]:
    """Merge pending ``rows`` into the catalog; gives the buckets written, a number each.

    The pending rows are landed once, as they are read for their buckets and for the merge. Only partitions that hold
    one of their ids' buckets are listed, read and replaced; the files of all others stay. Merging the same rows again
    changes nothing. Without a catalog the rows become one with ``buckets`` buckets.
    """
    spark = rows.sparkSession
    landed = scratch_path(spark, "pending")
    rows.write.parquet(landed)
    late = spark.read.schema(rows.schema).parquet(landed)
    if late.isEmpty():
        return []
    known = bucket_count(spark, root)
    if known is None:
        write_buckets(merge_catalog(empty_catalog(spark), late), root, buckets, order, row_group, unique=True)
        return list(range(buckets))
    numbers, held = _touched(late, root, known)
    merged = merge_catalog(held, late, base_unique=True, dealt=_dealt(spark, known))
    _write(merged, root, "dynamic", order, row_group, WORLD)
    return numbers


def convert_buckets(spark: SparkSession, root: str, pattern: str, new_href: Column, order: str = "id") -> int:
    """Give every address that contains ``pattern`` a new one; gives the number of changed addresses.

    ``new_href`` makes the new address, a column, from the columns ``id`` and ``cog_href``; rows for
    which it is NULL stay as they are. Buckets without a change stay as they are, too.
    """
    buckets = bucket_count(spark, root)
    if buckets is None:
        return 0
    found = legacy_hrefs(read_buckets(spark, root), pattern).select("id", "cog_href")
    landed = scratch_path(spark, "addresses")
    found.withColumn("new_href", new_href).where("new_href IS NOT NULL").select("id", "new_href").write.parquet(landed)
    updates = spark.read.parquet(landed)
    changed = updates.count()
    if changed:
        _, held = _touched(updates, root, buckets)
        updated = update_hrefs(held, updates).withColumn("bucket", bucket_of(F.col("id"), buckets)).hint("rebalance", "bucket")
        _write(updated, root, "dynamic", order, ROW_GROUP, WORLD)
    return changed
