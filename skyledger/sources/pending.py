"""Pending sidecars: batch and streaming reads, and the append sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.schema import SIDECAR_SCHEMA, to_catalog_schema
from skyledger.sources.catalog import missing_path


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every ``*.parquet`` below ``path`` with their ``source_file``; none when nothing is pending.

    One read with the declared schema covers all files: columns a sidecar lacks are NULL.
    """
    reader = (
        spark.read.schema(SIDECAR_SCHEMA)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
    )
    try:
        rows = reader.parquet(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    except AnalysisException as error:
        if not missing_path(error):
            raise
        rows = spark.createDataFrame([], SIDECAR_SCHEMA).withColumn("source_file", F.lit(None).cast("string"))
    return to_catalog_schema(rows)


def stream_pending(
    spark: SparkSession, path: str, max_files: int | None = None, archive: str | None = None
) -> DataFrame:
    """Sidecars as they arrive.

    The checkpoint of the query remembers which files were merged. With ``archive``
    Spark also moves a file there, but only after the batch that read it has committed.
    """
    reader = (
        spark.readStream.schema(SIDECAR_SCHEMA)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return to_catalog_schema(reader.parquet(path))


def append_sidecars(rows: DataFrame, path: str) -> None:
    """Add the rows of one batch of processed uploads."""
    rows.drop("bbox").write.mode("append").parquet(path)
