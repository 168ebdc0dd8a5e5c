"""Map tiles of footprints over many zooms as a quadtree: large boxes take coarse tiles, small ones fine tiles.

A box has rows from zoom 0 on. A tile that lies wholly in the box (``whole``) stands for all tiles below it; the others that
the box touches are divided further, down to ``detail`` zooms below the one where the box is about a tile wide, or ``LAST_ZOOM``. So
the rows follow the box's outline, not its area, and are bounded for a box of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.geo import MERCATOR_MAX_LAT
from skyledger.schema import quoted

LAST_ZOOM = 14
DETAIL = 4


def most_rows(detail: int = DETAIL, last: int = LAST_ZOOM) -> int:
    """A bound for the rows of a box: up to three tiles across where it is a tile wide, twice as many at each zoom below."""
    return 9 * (last + 1) + sum(4 * (3 << d) + 8 for d in range(detail + 1))


def _edges(bbox: str) -> dict[str, Column]:
    """The box in parts of the square map, growing to the east and south."""
    box = {n: F.col(f"{bbox}.{n}") for n in ("xmin", "ymin", "xmax", "ymax")}

    def down(lat: Column) -> Column:
        phi = F.radians(lat)
        between = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2
        return F.when(lat >= MERCATOR_MAX_LAT, 0.0).when(lat <= -MERCATOR_MAX_LAT, 1.0).otherwise(between)

    def inside(value: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))

    return {
        "_w": inside((box["xmin"] + 180) / 360), "_e": inside((box["xmax"] + 180) / 360),
        "_n": inside(down(box["ymax"])), "_s": inside(down(box["ymin"])),
    }


def tile_pyramid(df: DataFrame, bbox: str = "bbox", detail: int = DETAIL, last: int = LAST_ZOOM) -> DataFrame:
    """One row for each tile (``z, x, y``) of each box, with ``whole``, and ``leaf`` where the tile is not divided further.

    Rows without a box, or with NaN edges or edges in the wrong order, vanish.
    """
    keep = [F.col(quoted(c)) for c in df.columns]
    total = " + ".join(f"{bbox}.{n}" for n in ("xmin", "ymin", "xmax", "ymax"))
    known = df.where(f"{total} IS NOT NULL AND NOT isnan({total}) AND {bbox}.xmin <= {bbox}.xmax AND {bbox}.ymin <= {bbox}.ymax")
    rows = known.select(*keep, *[e.alias(n) for n, e in _edges(bbox).items()])
    width = "greatest(_e - _w, _s - _n)"
    deepest = f"CAST(least({last}, {detail} + CASE WHEN {width} > 0 THEN least({last}, floor(-log2({width}))) ELSE {last} END) AS INT)"
    rows = rows.withColumn("_last", F.expr(deepest)).withColumn("z", F.expr("explode(sequence(0, _last))"))
    size = "shiftleft(1, z)"

    def touched(value: str) -> str:
        return f"CAST(least({size} - 1, floor({value} * {size})) AS INT)"

    rows = rows.selectExpr(
        *[quoted(c) for c in df.columns], "z", "_last", f"{touched('_w')} AS _x0", f"{touched('_e')} AS _x1", f"{touched('_n')} AS _y0", f"{touched('_s')} AS _y1",
        # Tiles of this zoom, and of the one above, that lie wholly in the box: from ... to.
        *[
            f"CAST({'ceil' if first else 'floor'}({edge} * {grid}) - {0 if first else 1} AS INT) AS {name}{axis}{0 if first else 1}"
            for name, grid in (("_in", size), ("_up", f"shiftleft(1, z) / 2"))
            for axis, first, edge in (("x", True, "_w"), ("x", False, "_e"), ("y", True, "_n"), ("y", False, "_s"))
        ],
    )
    # Where the row of tiles above is whole from ... to, only the tiles beside it are new.
    hidden = "z > 0 AND _upx0 <= _upx1 AND shiftright(y, 1) BETWEEN _upy0 AND _upy1"
    side = lambda a, b: f"CASE WHEN {a} <= {b} THEN sequence({a}, {b}) ELSE CAST(array() AS ARRAY<INT>) END"
    columns = f"CASE WHEN {hidden} THEN concat({side('_x0', '2 * _upx0 - 1')}, {side('2 * _upx1 + 2', '_x1')}) ELSE sequence(_x0, _x1) END"
    placed = rows.withColumn("y", F.expr("explode(sequence(_y0, _y1))")).withColumn("x", F.expr(f"explode({columns})"))
    whole = "x BETWEEN _inx0 AND _inx1 AND y BETWEEN _iny0 AND _iny1"
    return placed.selectExpr(*[quoted(c) for c in df.columns], "z", "x", "y", f"{whole} AS whole", f"({whole}) OR z = _last AS leaf")


def in_tile(z: int, x: int, y: int) -> Column:
    """Rows of a pyramid whose boxes touch the tile, or may: its own rows and those of tiles above it that are not divided.

    At most one row of a box. Of rows above that aren't ``whole`` the box decides; at zooms below the last one all leaves are such.
    """
    own = (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)
    for up in range(1, z + 1):
        own |= F.col("leaf") & (F.col("z") == z - up) & (F.col("x") == x >> up) & (F.col("y") == y >> up)
    return own
