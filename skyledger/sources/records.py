"""JSON and binary sources: import pages, upload metadata, staged objects; text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.functions.text import key_problem, upload_id_of_key

# A JSON column declared as string keeps the nested object as text, so geometries of
# every nesting depth fit one schema.
PAGE_SCHEMA = (
    "results array<struct<_id: string, title: string, provider: string, platform: string, contact: string, "
    "uuid: string, gsd: double, file_size: bigint, acquisition_start: string, uploaded_at: string, "
    "properties: struct<thumbnail: string>, geojson: string>>"
)
METADATA_FIELDS = ("upload_id", "title", "platform", "license", "acquired", "provider")
METADATA_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in METADATA_FIELDS])


def read_pages(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Image records of landed pages ``{"results": [...]}``, one page per line or per file."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", one_per_file).json(path)
    return pages.select(F.inline("results"))


def parse_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """Image records of pages held as text in a column."""
    return pages.select(F.from_json(column, PAGE_SCHEMA).alias("_page")).select(F.inline("_page.results"))


def read_upload_metadata(spark: SparkSession, path: str, names: str = "meta.json") -> DataFrame:
    """User metadata from ``staging/<id>/meta.json`` files, or files of other ``names``.

    The upload id comes from the path. An unreadable file counts as empty metadata.
    """
    rows = (
        spark.read.schema(METADATA_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", names)
        .json(path)
    )
    folder = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    return rows.select(F.url_decode(folder).alias("upload_id"), *METADATA_FIELDS[1:])


def read_objects(spark: SparkSession, path: str, root: str, glob: str = "*") -> DataFrame:
    """Objects below ``path`` with key relative to ``root``, size, upload id or key problem.

    Only the listing is used; file contents are pruned from the scan.
    """
    objects = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    key = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^/*" + root.strip("/") + "/", "")
    return objects.select(
        key.alias("object_key"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")
    ).withColumns({"upload_id": upload_id_of_key(F.col("object_key")), "reason": key_problem(F.col("object_key"))})


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a one-column text DataFrame, one line per row."""
    lines.write.mode("overwrite").text(path)
