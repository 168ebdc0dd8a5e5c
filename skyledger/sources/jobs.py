"""Jobs that fill a catalog from an import."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyledger.functions.geo import WORLD
from skyledger.operators.ingest import import_records
from skyledger.operators.stats import catalog_extent
from skyledger.session import scratch_path
from skyledger.sources.buckets import BUCKETS, write_buckets
from skyledger.sources.catalog import SMALL_ROW_GROUP


def import_catalog(
    records: DataFrame, root: str, base_url: str, acquired_from: str = "", row_group: int = SMALL_ROW_GROUP, buckets: int = BUCKETS
) -> None:
    """Import records as a new catalog, its buckets clustered on a Hilbert curve over the extent of the data itself.

    The mapped rows are landed once, because the extent is needed before they can be ordered.
    """
    spark = records.sparkSession
    landed = scratch_path(spark, "imported")
    import_records(records, base_url, acquired_from).write.parquet(landed)
    rows = spark.read.parquet(landed)
    box = catalog_extent(rows).first()
    known = box.xmin is not None and box.xmin < box.xmax and box.ymin < box.ymax
    write_buckets(rows, root, buckets, "hilbert", row_group, tuple(box) if known else WORLD)
