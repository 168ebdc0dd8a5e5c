"""Hand-written catalog rows and small helpers."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, Row, SparkSession

from skyledger.schema import CATALOG_SCHEMA


def image(id, bbox=None, **fields):
    values = dict.fromkeys(CATALOG_SCHEMA.names)
    values.update(id=id, **fields)
    if bbox is not None:
        values["bbox"] = Row(xmin=float(bbox[0]), ymin=float(bbox[1]), xmax=float(bbox[2]), ymax=float(bbox[3]))
    return tuple(values[name] for name in CATALOG_SCHEMA.names)


def catalog(spark: SparkSession, *images) -> DataFrame:
    return spark.createDataFrame(list(images), CATALOG_SCHEMA)


def ids(df: DataFrame) -> list:
    return sorted(row.id for row in df.select("id").collect())


def plan(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
