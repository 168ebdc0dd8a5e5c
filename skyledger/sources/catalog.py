"""Reading and writing the catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.geo import WORLD, with_hilbert_key
from skyledger.schema import CATALOG_SCHEMA, to_catalog_schema

# Rows per row group. The small size suits catalogs of some thousand
# images; on a large one footers would outgrow the data they describe.
ROW_GROUP = 10_000
SMALL_ROW_GROUP = 100


def missing_path(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows in the declared schema, whatever integer widths the file has."""
    return to_catalog_schema(spark.read.parquet(path))


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def read_catalog_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows, or none when the path does not exist yet."""
    try:
        return read_catalog(spark, path)
    except AnalysisException as error:
        if missing_path(error):
            return empty_catalog(spark)
        raise


def _write(df: DataFrame, path: str, row_group: int) -> None:
    (
        df.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", row_group)
        .parquet(path)
    )


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_catalog(
    df: DataFrame,
    path: str,
    order: str = "id",
    row_group: int = ROW_GROUP,
    partitions: int | None = None,
    frame: tuple[float, float, float, float] = WORLD,
) -> None:
    """Write the catalog sorted by ``id``, ``hilbert`` (clustered) or ``datetime`` (newest first).

    The order is global over the files. Every order ends in ``id``, so equal Hilbert
    keys or dates can still be divided over partitions. Never write to the path the
    rows are read from; ``sources/buckets.py`` replaces parts of a catalog.
    """
    if order == "id":
        ranged = _ranged(df, [F.asc_nulls_last("id"), F.desc_nulls_last("uploaded_at")], partitions)
        _write(ranged, path, row_group)
    elif order == "hilbert":
        keyed = with_hilbert_key(df, frame=frame)
        ranged = _ranged(keyed, [F.asc_nulls_last("hilbert"), F.asc_nulls_last("id")], partitions)
        _write(ranged.drop("hilbert"), path, row_group)
    elif order == "datetime":
        ranged = _ranged(df, [F.desc_nulls_last("datetime"), F.asc_nulls_last("id")], partitions)
        _write(ranged, path, row_group)
    else:
        raise ValueError(f"unknown order {order!r}")
