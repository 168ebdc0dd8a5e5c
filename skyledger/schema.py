"""The catalog schema and the casts that bring any source to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

BBOX_TYPE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("xmin", "ymin", "xmax", "ymax")]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("gsd", T.DoubleType()),
        T.StructField("platform_type", T.StringType()),
        T.StructField("producer_name", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("cog_href", T.StringType()),
        T.StructField("thumbnail_href", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("bands", T.IntegerType()),
        T.StructField("epsg", T.IntegerType()),
        T.StructField("uploaded_by", T.StringType()),
        T.StructField("uploaded_at", T.StringType()),
        T.StructField("geometry", T.BinaryType()),
        T.StructField("bbox", BBOX_TYPE),
    ]
)

# Sidecars come from writers that store 64-bit integers. Parquet widens INT32 to
# BIGINT on read but never narrows, so they are read wide and cast afterwards.
SIDECAR_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType)
        for f in CATALOG_SCHEMA
    ]
)

# Columns that writers or intermediate steps leave behind.
ARTIFACT_COLUMNS = ("rn", "__index_level_0__")


def quoted(name: str) -> str:
    """A column name for use in expression text."""
    return "`" + name.replace("`", "``") + "`"


def make_bbox(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A bbox struct, NULL when any edge is NULL."""
    parts = [xmin, ymin, xmax, ymax]
    known = xmin.isNotNull() & ymin.isNotNull() & xmax.isNotNull() & ymax.isNotNull()
    named = [p.cast("double").alias(n) for p, n in zip(parts, BBOX_TYPE.names)]
    return F.when(known, F.struct(*named))


def _same_type(left: T.DataType, right: T.DataType) -> bool:
    return left.simpleString() == right.simpleString()


def to_catalog_schema(df: DataFrame) -> DataFrame:
    """Cast ``df`` to the declared columns by name; unknown columns stay at the end.

    Columns that already have the declared type are passed through untouched, so
    filters on them still reach the Parquet scan. The bbox struct is rebuilt by
    field name, because a struct cast goes by position.
    """
    present = {f.name: f.dataType for f in df.schema}
    columns = []
    for field in CATALOG_SCHEMA:
        name = field.name
        if name not in present:
            columns.append(F.lit(None).cast(field.dataType).alias(name))
        elif _same_type(present[name], field.dataType):
            columns.append(F.col(name))
        elif name == "bbox":
            columns.append(make_bbox(*[F.col(f"bbox.{n}") for n in BBOX_TYPE.names]).alias(name))
        else:
            columns.append(F.col(name).try_cast(field.dataType).alias(name))
    known = set(CATALOG_SCHEMA.names)
    extra = [F.col(n) for n in df.columns if n not in known and n not in ARTIFACT_COLUMNS]
    return df.select(*columns, *extra)


def lost_values(df: DataFrame) -> DataFrame:
    """One row: per cast column, how many values ``to_catalog_schema`` turns into NULL because they don't fit."""
    cast = {f.name: f.dataType for f in CATALOG_SCHEMA if f.name in df.columns and f.name != "bbox"}
    lost = lambda name: F.col(name).isNotNull() & F.col(name).try_cast(cast[name]).isNull()
    return df.agg(*[F.count_if(lost(name)).alias(name) for name in cast])
