"""Catalog search: optional predicates, projection, newest-first top-k, paging, lookup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.dates import end_of_day, parse_timestamp
from skyledger.schema import quoted
from skyledger.session import scratch_path

DEFAULT_LIMIT = 200
PAGE_SIZE = 10

RESULT_COLUMNS = (
    "id", "title", "datetime", "gsd", "platform_type", "producer_name", "license", "cog_href",
    "thumbnail_href", "file_size", "width", "height", "bands", "epsg", "uploaded_by", "uploaded_at",
)


@dataclass(frozen=True)
class SearchParams:
    """Search arguments; an empty, ``None`` or zero value means no filter.

    ``bbox`` is (west, south, east, north). ``bbox_mode`` is ``intersects`` (closed,
    touching counts) or ``within``. ``date_mode`` is ``string`` (lexicographic) or
    ``timestamp`` (whole end day). ``wrap`` splits a viewport with west > east at the
    antimeridian. ``literal`` takes ``%`` and ``_`` in texts as plain characters.
    ``limit=None`` returns every match.
    """

    bbox: tuple[float, float, float, float] | None = None
    date_start: str = ""
    date_end: str = ""
    platform: str = ""
    license: str = ""
    max_gsd: float | None = None
    query: str = ""
    limit: int | None = DEFAULT_LIMIT
    bbox_mode: str = "intersects"
    date_mode: str = "string"
    wrap: bool = False
    literal: bool = False


def bbox_predicate(
    bbox: tuple[float, float, float, float], mode: str = "intersects", wrap: bool = False
) -> Column:
    west, south, east, north = (float(v) for v in bbox)
    xmin, ymin, xmax, ymax = (F.col(f"bbox.{n}") for n in ("xmin", "ymin", "xmax", "ymax"))
    if mode == "within":
        if wrap and west > east:
            lon = ((xmin >= west) & (xmax <= 180.0)) | ((xmin >= -180.0) & (xmax <= east))
        else:
            lon = (xmin >= west) & (xmax <= east)
        return lon & (ymin >= south) & (ymax <= north)
    if wrap and west > east:
        lon = (xmax >= west) | (xmin <= east)
    else:
        lon = (xmax >= west) & (xmin <= east)
    return lon & (ymax >= south) & (ymin <= north)


def date_predicates(start: str, end: str, mode: str = "string") -> list[Column]:
    when = F.col("datetime")
    if mode == "string":
        found = [when >= start] if start else []
        return found + ([when <= end_of_day(end)] if end else [])
    instant = parse_timestamp(when)

    def midnight(day: dt.date) -> Column:
        return F.lit(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc))

    found = [instant >= midnight(dt.date.fromisoformat(start))] if start else []
    if end:
        found.append(instant < midnight(dt.date.fromisoformat(end) + dt.timedelta(days=1)))
    return found


def platform_predicate(platform: str) -> Column:
    lowered = F.lower(F.col("platform_type"))
    # Only the exact argument 'uav' takes in drones.
    return lowered.isin("uav", "drone") if platform == "uav" else lowered == platform.lower()


def text_predicate(column: str, text: str, literal: bool = False) -> Column:
    lowered, wanted = F.lower(F.col(column)), text.lower()
    if literal:
        return lowered.contains(wanted)
    return lowered.like("%" + wanted.replace("\\", "\\\\") + "%")


def predicates(p: SearchParams) -> list[Column]:
    found: list[Column] = []
    if p.bbox:
        found.append(bbox_predicate(p.bbox, p.bbox_mode, p.wrap))
    found += date_predicates(p.date_start, p.date_end, p.date_mode)
    if p.platform:
        found.append(platform_predicate(p.platform))
    if p.license:
        found.append(text_predicate("license", p.license, p.literal))
    if p.max_gsd:
        found.append(F.col("gsd") <= float(p.max_gsd))
    if p.query:
        found.append(text_predicate("title", p.query, p.literal))
    return found


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("datetime"), F.asc_nulls_last("id")]


def search(catalog: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Matching images, newest first, in the 20-column result shape.

    The filters on ``bbox``, ``datetime`` and ``gsd`` reach the Parquet scan, and
    sort plus limit become a per-task top-k, so nothing is fully sorted or shuffled.
    """
    conditions = predicates(params)
    if conditions:
        catalog = catalog.where(reduce(and_, conditions))
    found = catalog.selectExpr(
        *RESULT_COLUMNS,
        "bbox.xmin AS bbox_west", "bbox.ymin AS bbox_south", "bbox.xmax AS bbox_east", "bbox.ymax AS bbox_north",
    )
    if params.limit is None:
        return found
    return found.orderBy(*newest_first()).limit(params.limit)


def get_item(catalog: DataFrame, image_id: str) -> DataFrame:
    """The row with this id, or no row. The id is a bound literal."""
    return catalog.where(F.col("id") == F.lit(image_id)).limit(1)


def legacy_hrefs(catalog: DataFrame, host: str) -> DataFrame:
    """Ids and addresses of images still stored under ``host``."""
    return catalog.where(F.col("cog_href").contains(host)).select("id", "cog_href")


def ranked(results: DataFrame, order: Sequence[Column] | None = None) -> tuple[DataFrame, int]:
    """``results`` with their ``rank`` (from 1) in ``order``, newest first by default, and their number.

    Rows are range-sorted and landed once with their place in their partition. The number of rows in each partition
    comes to the driver, one for each partition, and gives the rank its partition starts behind. No task sees more than its range.
    """
    spark = results.sparkSession
    keys = list(order or newest_first())
    landed = scratch_path(spark, "ranked")
    # The whole row decides among equal keys, as far as it can be compared, so that equal keys spread as well.
    rest = [F.col(quoted(f.name)) for f in results.schema if f.dataType.typeName() not in ("map", "variant")]
    ordered = results.repartitionByRange(*keys, *rest).sortWithinPartitions(*keys, *rest)
    ordered.withColumn("_row", F.monotonically_increasing_id()).write.parquet(landed)
    rows = spark.read.parquet(landed)
    part = F.shiftright("_row", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for count in counts:
        starts.append((count.part, total))
        total += count.n
    offsets = spark.createDataFrame(starts, "_part bigint, _start bigint")
    # As many rows as the sort had partitions.
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rank = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*[F.col(quoted(c)) for c in results.columns], rank.alias("rank")), total


def number_pages(results: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rank, page and remaining count of a result of any size, newest first."""
    rows, total = ranked(results)
    page = F.floor((F.col("rank") - 1) / page_size).cast("int") + 1
    shown = F.least(page * page_size, F.lit(total))
    return rows.select(
        *[F.col(quoted(c)) for c in results.columns], F.col("rank").cast("int").alias("rank"), F.lit(total).cast("bigint").alias("total"),
        page.alias("page"), (F.lit(total) - shown).cast("bigint").alias("remaining"),
    )


def after_row(datetime: str | None, image_id: str | None) -> Column:
    """Rows that come behind this one, newest first: the last row of a page gives the predicate of the next.

    Plain comparisons, which reach the Parquet scan; ids stand once in a catalog.
    """
    when, image = F.col("datetime"), F.col("id")
    behind = ((image > image_id) | image.isNull()) if image_id is not None else F.lit(False)
    if datetime is None:
        return when.isNull() & behind
    return (when < datetime) | when.isNull() | ((when == datetime) & behind)


def next_page(results: DataFrame, last: tuple[str | None, str | None] | None, page_size: int = PAGE_SIZE) -> DataFrame:
    """The page behind the row ``last`` (datetime, id), or the first: a top-k of one page however deep it lies."""
    rows = results if last is None else results.where(after_row(*last))
    return rows.orderBy(*newest_first()).limit(page_size)


def page_of(results: DataFrame, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page, by distributed top-k with offset."""
    return results.orderBy(*newest_first()).offset((page - 1) * page_size).limit(page_size)


def visible_count(total: int, loads: int = 0, selected_index: int | None = None, page_size: int = PAGE_SIZE) -> int:
    """Rows shown after ``loads`` load-more steps; a selection further down expands the list."""
    shown = page_size
    for _ in range(loads):
        shown = min(shown + page_size, total)
    if selected_index is not None and selected_index >= shown:
        shown = selected_index + 5
    return shown


def visible_rows(
    results: DataFrame, loads: int = 0, selected_id: str | None = None, page_size: int = PAGE_SIZE
) -> DataFrame:
    """The rows shown, as ``visible_count``; the selected id's rank is looked up first."""
    rows = number_pages(results, page_size)
    index = None
    if selected_id is not None:
        index = rows.where(F.col("id") == selected_id).agg(F.min("rank") - 1).first()[0]
    return rows.where(F.col("rank") <= _shown(rows, loads, index, page_size))


def _shown(rows: DataFrame, loads: int, index: int | None, page_size: int) -> Column:
    shown = F.lit(page_size)
    if loads:
        shown = F.when(F.col("total") > 0, F.least(F.lit(page_size * (loads + 1)), F.col("total")))
    return shown if index is None else F.when(F.lit(index) >= shown, F.lit(index + 5)).otherwise(shown)
