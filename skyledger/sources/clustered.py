"""The catalog ordered along a Hilbert curve by classes of size, and viewports as ranges of that order.

A box belongs to the finest grid of ``CLASSES`` (2^level cells each way) whose cells are as large as the box. ``place`` has the class in its
upper bits and the Hilbert key of the box's middle in the lower ones, so images of a class lie together along the curve. What meets a viewport
has its middle at most half a cell of its class outside it. So for each class the viewport, grown by that, becomes a few
intervals of the curve, by descending the quadrants; quadrants that lie inside are taken whole. The intervals are plain
comparisons on one stored column, which Parquet's statistics answer for row groups and files; ``search`` then compares the boxes themselves.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.geo import with_hilbert_key
from skyledger.schema import to_catalog_schema
from skyledger.sources.catalog import ROW_GROUP

#: Bits of the Hilbert key along an axis.
LEVELS = 16
#: Levels of the grids: cells of 360, 22.5 and 1.4 degrees from west to east.
CLASSES = (0, 4, 8)
#: Rows for a task that writes the order, so that tasks become more with the catalog and not larger.
TASK_ROWS = 250_000
#: Intervals for one class; more of them read less beside the viewport.
MOST_RANGES = 8

Box = tuple[float, float, float, float]


def with_place(df: DataFrame, bbox: str = "bbox", out: str = "place") -> DataFrame:
    """Add the place in the order; a row without a box has none. Infinite and NaN edges belong to the coarsest class."""
    wide = f"greatest(abs({bbox}.xmax - {bbox}.xmin) / 360D, abs({bbox}.ymax - {bbox}.ymin) / 180D)"
    fits = " ".join(f"WHEN {wide} <= {0.5**level!r}D THEN {n}" for n, level in reversed([*enumerate(CLASSES)]))
    keyed = with_hilbert_key(df, bbox, "_key")
    return keyed.withColumn(out, F.expr(f"shiftleft(CAST(CASE {fits} ELSE 0 END AS BIGINT), {2 * LEVELS}) | _key")).drop("_key")


def curve_index(level: int, column: int, row: int) -> int:
    """The cell's distance along the Hilbert curve of its grid."""
    index, swap, flip = 0, 0, 0
    for bit in range(level - 1, -1, -1):
        x, y = column >> bit & 1, row >> bit & 1
        differ = x ^ y
        index = index << 2 | (x ^ (swap & differ) ^ flip) << 1 | differ
        swap, flip = (flip ^ x, swap ^ x) if differ else (swap ^ flip ^ x ^ 1, flip)
    return index


def _cells(low: float, high: float, start: float, size: float, margin: float) -> tuple[int, int]:
    """First and last cell of an axis for middles in ``[low - margin, high + margin]``."""
    cells = 1 << LEVELS

    def cell(value: float) -> int:
        return min(cells - 1, max(0, math.floor(max(-1e9, min(1e9, (value - start) / size * cells)))))

    # A cell more on both sides, for the rounding of middles.
    return max(0, cell(low - margin) - 1), min(cells - 1, cell(high + margin) + 1)


def curve_ranges(level: int, x0: int, x1: int, y0: int, y1: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` intervals of the curve that cover the cells of the rectangle, and perhaps others."""
    whole: list[tuple[int, int]] = []
    open_ = [(0, 0)]
    for depth in range(level + 1):
        span = level - depth
        partly = []
        for cx, cy in open_:
            left, right, low, high = cx << span, ((cx + 1) << span) - 1, cy << span, ((cy + 1) << span) - 1
            if right < x0 or left > x1 or high < y0 or low > y1:
                continue
            if x0 <= left and right <= x1 and y0 <= low and high <= y1:
                index = curve_index(depth, cx, cy)
                whole.append((index << 2 * span, ((index + 1) << 2 * span) - 1))
            else:
                partly.append((cx, cy))
        open_ = [(2 * cx + i, 2 * cy + j) for cx, cy in partly for i in (0, 1) for j in (0, 1)]
        # Four cells for each interval are enough to find the widest gaps between them.
        if len(partly) > 4 * most:
            for cx, cy in partly:
                index = curve_index(depth, cx, cy)
                whole.append((index << 2 * span, ((index + 1) << 2 * span) - 1))
            break
    whole.sort()
    joined: list[list[int]] = []
    for first, last in whole:
        if joined and first <= joined[-1][1] + 1:
            joined[-1][1] = max(last, joined[-1][1])
        else:
            joined.append([first, last])
    gaps = sorted(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1], reverse=True)
    cuts = sorted(gaps[: most - 1])
    bounds = zip([0, *cuts], [*cuts, len(joined)])
    return [(joined[a][0], joined[b - 1][1]) for a, b in bounds if a < b]


def place_ranges(bbox: Box, wrap: bool = False, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Intervals of ``place`` that hold everything that can meet the viewport."""
    west, south, east, north = (float(v) for v in bbox)
    views = [(west, 180.0), (-180.0, east)] if wrap and west > east else [(west, east)]
    found: list[tuple[int, int]] = []
    whole = 4**LEVELS
    for n, level in enumerate(CLASSES):
        if level == 0:
            found.append((0, whole - 1))  # of any size, so they may meet any viewport
            continue
        rows = _cells(south, north, -90.0, 180.0, 90.0 / 2**level)
        for low, high in views:
            columns = _cells(low, high, -180.0, 360.0, 180.0 / 2**level)
            if columns[0] <= columns[1] and rows[0] <= rows[1]:
                found += [(n * whole + a, n * whole + b) for a, b in curve_ranges(LEVELS, *columns, *rows, most)]
    merged: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def place_predicate(bbox: Box, wrap: bool = False, most: int = MOST_RANGES, column: str = "place") -> Column:
    place = F.col(column)
    parts = [(place >= a) & (place <= b) if a < b else place == a for a, b in place_ranges(bbox, wrap, most)]
    return reduce(or_, parts) if parts else F.lit(False)


def write_places(df: DataFrame, path: str, row_group: int = ROW_GROUP, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write the catalog in the order of its cells, with ``place`` as a column; equal places spread by ``id``."""
    order = [F.asc_nulls_last("place"), F.asc_nulls_last("id")]
    placed = with_place(df)
    ranged = placed.repartitionByRange(partitions or math.ceil(df.count() / TASK_ROWS) or 1, *order)
    (
        ranged.sortWithinPartitions(*order).write.mode(mode)
        .option("compression", "zstd").option("parquet.block.row.count.limit", row_group).parquet(path)
    )


def read_places(spark: SparkSession, path: str, bbox: Box | None = None, wrap: bool = False, most: int = MOST_RANGES) -> DataFrame:
    """Rows that can meet the viewport (all without one), for ``search`` to compare."""
    rows = spark.read.parquet(path)
    return to_catalog_schema((rows if bbox is None else rows.where(place_predicate(bbox, wrap, most))).drop("place"))
