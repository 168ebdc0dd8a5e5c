"""Merging sidecars into the catalog, keyed updates and the merge report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.wkb import wkb_bounds
from skyledger.schema import ARTIFACT_COLUMNS, to_catalog_schema


TIE_BREAKERS = ("datetime", "title", "cog_href", "file_size", "gsd")


def union_by_name(*sources: DataFrame) -> DataFrame:
    """All rows of all sources by column name, in the declared types; duplicates stay."""
    cast = [to_catalog_schema(df) for df in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def drop_artifacts(df: DataFrame) -> DataFrame:
    return df.drop(*ARTIFACT_COLUMNS)


def latest_order(columns: list[str]) -> list[Column]:
    """Newest upload first, by string; the rest only breaks ties the same way every time.

    Rows that still tie differ in no ordered column; a hash of all ``columns`` decides then,
    so the outcome never depends on the order of rows.
    """
    return [*[F.desc_nulls_last(name) for name in ("uploaded_at", *TIE_BREAKERS)], F.xxhash64(*sorted(columns))]


def _later(late: list[str], base: list[str]) -> Column:
    """Does ``_late`` come before the row itself in ``latest_order``?"""
    names = [n for n in ("uploaded_at", *TIE_BREAKERS) if n in base]
    shared = sorted(c for c in base if c in late and c not in ARTIFACT_COLUMNS)
    new, old = F.struct(*[F.col("_late").getField(n) for n in names]), F.struct(*names)
    tied = F.xxhash64(*[F.col("_late").getField(c) for c in shared]) < F.xxhash64(*shared)
    return (new > old) | ((new == old) & tied)


def latest_per_id(df: DataFrame, dealt: dict[str, Column] | None = None) -> DataFrame:
    """One row per id, the one uploaded last.

    Catalyst turns the rank filter into a group limit that every task applies before
    the shuffle, so an id with many copies sends one row per task.

    ``dealt`` names columns made from the id. The rows get them and are shuffled by them alone, so that what is written by them
    needs no second shuffle. Copies of an id then travel to one task: for rows with few of them.
    """
    order = latest_order([c for c in df.columns if c not in ARTIFACT_COLUMNS])
    if dealt:
        df = df.withColumns(dealt).repartition(*dealt)
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*(dealt or ()), "id").orderBy(*order)))
    return drop_artifacts(ranked.where(F.col("rn") == 1))


def backfill_bbox(df: DataFrame, split: bool = True) -> DataFrame:
    """Fill a NULL bbox from the geometry; other geometries are not decoded.

    By default only the rows in question go through Python. That reads the source twice,
    but on Parquet the second read skips row groups whose statistics show no missing
    ``bbox.xmin``. ``split=False`` sends every row through Python in one pass, which
    suits small results of costly plans.
    """
    if not split:
        wanted = F.when(F.col("bbox").isNull(), F.col("geometry"))
        return df.withColumn("bbox", F.coalesce(F.col("bbox"), wkb_bounds(wanted)))
    missing = "bbox.xmin IS NULL AND bbox IS NULL AND geometry IS NOT NULL"
    filled = df.where(missing).withColumn("bbox", wkb_bounds(F.col("geometry")))
    return df.where("bbox IS NOT NULL OR geometry IS NULL").unionAll(filled.select(*df.columns))


def merge_catalog(
    base: DataFrame, pending: DataFrame, base_unique: bool = False, dealt: dict[str, Column] | None = None
) -> DataFrame:
    """Catalog after adding the pending rows: latest per id, bbox filled in.

    A bbox depends on nothing but its row, so it is filled in where that is cheapest: at
    the sources for a full merge. With ``base_unique`` (the base is itself the result of
    a merge) each base row meets at most one candidate, the latest pending row of its id, and the
    later of the two stays: one pass over the base, and one over its ids for the new ones. Whether the
    candidates are broadcast, so that no base row is shuffled, is Catalyst's choice from their size.

    ``dealt`` is for a result that is written by columns made from the id, which it gets: base rows and candidates
    are shuffled by these once, for the merge and the writing. An id has two rows at most then.
    """
    base, pending = to_catalog_schema(base), to_catalog_schema(pending)
    if not base_unique:
        return latest_per_id(union_by_name(backfill_bbox(base), backfill_bbox(pending)))
    base = backfill_bbox(base)
    late = latest_per_id(backfill_bbox(pending, split=False))
    if dealt:
        return latest_per_id(union_by_name(base, late), dealt)
    columns = [*base.columns, *[c for c in late.columns if c not in base.columns]]
    # One candidate an id: each base row meets at most one, and one of the two stays.
    candidate = late.select(F.struct(*late.columns).alias("_late"))
    met = base.join(candidate, F.col("id").eqNullSafe(F.col("_late.id")), "left")
    wins = F.col("_late").isNotNull() & _later(late.columns, base.columns)
    kept = met.select(
        *[
            F.when(wins, F.col("_late").getField(c) if c in late.columns else F.lit(None)).otherwise(
                F.col(c) if c in base.columns else F.lit(None)
            ).alias(c)
            for c in columns
        ]
    )
    held = base.select(F.col("id").alias("_held"))
    added = late.join(held, F.col("id").eqNullSafe(F.col("_held")), "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def merge_report(base: DataFrame, pending: DataFrame, merged: DataFrame, source: str = "source_file") -> DataFrame:
    """One row: rows before and after, rows with a bbox, sidecar files merged."""
    none = F.lit(None).cast("string")
    before = base.select(none.alias(source)).unionByName(pending.select(source)).agg(
        F.count("*").alias("rows_before"), F.count_distinct(source).alias("merged")
    )
    after = merged.agg(F.count("*").alias("rows_after"), F.count("bbox").alias("rows_with_bbox"))
    # Each one-row part leaves the other's columns empty.
    both = before.unionByName(after, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("rows_before", "merged", "rows_after", "rows_with_bbox")])


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the largest by its columns in turn. Combined in each task before the shuffle."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_top"))
    return top.select(*[F.col(key) if c == key else F.col("_top").getField(c).alias(c) for c in df.columns])


def update_hrefs(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Set ``cog_href`` to ``new_href`` for the ids in ``updates``; of several updates the largest text.

    No join hint: a small update set is broadcast from its size, a large one is
    joined by shuffle with the adaptive skew split.
    """
    joined = catalog.join(one_per_key(updates.select("id", "new_href"), "id"), "id", "left")
    return joined.withColumn("cog_href", F.coalesce("new_href", "cog_href")).select(*catalog.columns)
