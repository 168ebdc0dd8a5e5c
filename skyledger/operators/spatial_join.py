"""Rectangle and point joins by grid cells, exact and without nested loops.

Every rectangle has a home level: the finest grid whose cells are at least as large
as the rectangle, where it touches at most a few cells. Two rectangles meet in a cell
of the coarser of their two home levels. So one side is placed in its home cells and
the other in the cells it touches at the levels the first side uses, and the join is
on the cell number. Sizes may differ by any factor, with no separate path for
large footprints. A pair that shares several cells is kept only in the cell holding
the lower-left corner of the overlap, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from skyledger.functions.polygon_cells import cell_hits
from skyledger.functions.polygons import outline_parts
from skyledger.functions.wkb import wkb_bounds
from skyledger.operators.skew import MIN_PAIRS, SHARE, deal, key_loads, spread_join
from skyledger.schema import quoted
from skyledger.session import scratch_path

MAX_LEVEL = 20

# Points of a cell that a task holds at a time, pairs of rows of a cell that a task should get, and tasks for them at most.
MOST_POINTS = 250_000
TASK_PAIRS = 100_000_000
MOST_TASKS = 2000


# Expression text instead of column objects: these are long and built for every join.


def _cell(x: str, y: str) -> str:
    """Level, column and row of the cell at ``_level`` packed into one BIGINT join key.

    Five bits for the level and 29 for each axis; ``_step`` stays within 24 bits.
    """
    return f"(shiftleft(CAST(_level AS BIGINT), 58) | shiftleft({x} + 268435456, 29) | ({y} + 268435456))"


def _step(value: str) -> str:
    """Cell number of a coordinate along its axis at ``_level``; never decreases in ``value``.

    Coordinates beyond ten turns, infinite ones too, count as ten turns, which bounds the
    cells of any box.
    """
    return f"floor((least(3600D, greatest(-3600D, {value})) + 180D) * (pow(2D, _level) / 360D))"


def _boxes(df: DataFrame, box: str, prefix: str, keep: list[str]) -> DataFrame:
    """Key columns and edges of rows with a box, with ordered edges and the home level."""
    p = {n: f"{prefix}{n}" for n in ("xmin", "ymin", "xmax", "ymax")}
    size = f"greatest(abs({p['xmax']} - {p['xmin']}), abs({p['ymax']} - {p['ymin']}), 1e-9D)"
    return (
        df.selectExpr(*[quoted(k) for k in keep], *[f"{box}.{n} AS {alias}" for n, alias in p.items()])
        .where(" AND ".join(f"{alias} IS NOT NULL" for alias in p.values()))
        .selectExpr(
            "*",
            f"least({p['xmin']}, {p['xmax']}) AS {prefix}x0",
            f"greatest({p['xmin']}, {p['xmax']}) AS {prefix}x1",
            f"least({p['ymin']}, {p['ymax']}) AS {prefix}y0",
            f"greatest({p['ymin']}, {p['ymax']}) AS {prefix}y1",
            f"CAST(least({MAX_LEVEL}, greatest(0, floor(log2(360D / {size})))) AS INT) AS {prefix}home",
        )
    )


def _place(boxes: DataFrame, prefix: str, points: bool = False) -> DataFrame:
    """One row with ``_cell`` per cell touched at ``_level``; a point touches one."""
    if points:
        return boxes.selectExpr("*", f"{_cell(_step(prefix + 'x0'), _step(prefix + 'y0'))} AS _cell")
    across = f"sequence({_step(prefix + 'x0')}, {_step(prefix + 'x1')})"
    up = f"sequence({_step(prefix + 'y0')}, {_step(prefix + 'y1')})"
    exploded = boxes.selectExpr("*", f"explode({across}) AS _cx").selectExpr("*", f"explode({up}) AS _cy")
    return exploded.selectExpr("*", f"{_cell('_cx', '_cy')} AS _cell").drop("_cx", "_cy")


def _at_home(boxes: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
    """Rows whose own level is one of ``levels``, placed there."""
    own = boxes.where(F.col(prefix + "home").isin(levels))
    return _place(own.selectExpr("*", f"{prefix}home AS _level"), prefix)


def _at_levels(boxes: DataFrame, prefix: str, levels: list[int], strict: bool, points: bool = False) -> DataFrame:
    """Rows placed at those of ``levels`` that are coarser than their own (or equal)."""
    listed = ", ".join(map(str, levels))
    leveled = boxes.selectExpr("*", f"explode(CAST(array({listed}) AS ARRAY<INT>)) AS _level")
    return _place(leveled.where(f"_level {'<' if strict else '<='} {prefix}home"), prefix, points)


def _levels(a: DataFrame, b: DataFrame) -> tuple[set[int], set[int]]:
    """Home levels in use on both sides: one job, at most 2 * (MAX_LEVEL + 1) rows."""
    homes = a.selectExpr("0 AS side", "a_home AS level").unionAll(b.selectExpr("1 AS side", "b_home AS level"))
    rows = homes.distinct().collect()
    return {r.level for r in rows if r.side == 0}, {r.level for r in rows if r.side == 1}


def _meet(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str],
    share: int,
    min_pairs: int,
    points: bool = False,
    counted: DataFrame | None = None,
    more: list[str] | None = None,
) -> DataFrame:
    pairs = spread_join(left, right.drop("_level"), ["_cell"], left_keys, right_keys, share, min_pairs, counted)
    if points:
        # A point is in one cell of a level, so it meets a box once; two of its columns tell all four edges.
        met = "a_xmax >= b_xmin AND a_xmin <= b_xmin AND a_ymax >= b_ymin AND a_ymin <= b_ymin"
    else:
        touch = "a_xmax >= b_xmin AND a_xmin <= b_xmax AND a_ymax >= b_ymin AND a_ymin <= b_ymax"
        met = f"{touch} AND _cell = {_cell(_step('greatest(a_x0, b_x0)'), _step('greatest(a_y0, b_y0)'))}"
    return pairs.where(met).select(*left_keys, *(more or []), *right_keys)


def _pairs(
    a: DataFrame, b: DataFrame, left_keys: list[str], right_keys: list[str], share: int, min_pairs: int,
    points: bool = False, widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One job finds which levels are in use; the pairs themselves stay lazy.

    ``widen`` gives more columns to the rows of ``a``. What is counted beforehand is counted without them.
    """
    a_levels, b_levels = _levels(a, b)
    wide = widen(a) if widen else a
    more = [c for c in wide.columns if c not in a.columns]
    limits = (share, min_pairs, points)
    a_home = sorted(level for level in a_levels if level <= max(b_levels, default=-1))
    b_home = sorted(level for level in b_levels if level < max(a_levels, default=-1))
    parts = []
    if a_home or not b_home:
        at_a = _at_levels(b, "b_", a_home, False, points)
        counted = _at_home(a, "a_", a_home)
        parts.append(_meet(_at_home(wide, "a_", a_home), at_a, left_keys, right_keys, *limits, counted, more))
    if b_home:
        at_b, counted = (_at_levels(rows, "a_", b_home, True) for rows in (wide, a))
        parts.append(_meet(at_b, _at_home(b, "b_", b_home), left_keys, right_keys, *limits, counted, more))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str],
    left_box: str = "bbox",
    right_box: str = "bbox",
    share: int = SHARE,
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """Key columns of all pairs whose closed boxes touch, each pair of rows once.

    Rows with a NULL box match nothing. Key names of the two sides must differ.
    """
    a = _boxes(left, left_box, "a_", left_keys)
    b = _boxes(right, right_box, "b_", right_keys)
    return _pairs(a, b, left_keys, right_keys, share, min_pairs)


def point_hits(
    catalog: DataFrame,
    points: DataFrame,
    image_keys: list[str],
    point_keys: list[str],
    lon: str = "lon",
    lat: str = "lat",
    box: str = "bbox",
    share: int = SHARE,
    min_pairs: int = MIN_PAIRS,
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Key columns of every footprint under every point; edges count.

    ``widen`` adds columns, not rows, to the images' key columns. Hits have them too, and need no join to get them.
    """
    spots = points.select(
        *point_keys,
        F.struct(
            F.col(lon).alias("xmin"), F.col(lat).alias("ymin"), F.col(lon).alias("xmax"), F.col(lat).alias("ymax")
        ).alias("_spot"),
    )
    # A point is a box of no size at the finest level, so the footprint is the coarser side.
    a = _boxes(catalog, box, "a_", image_keys)
    b = _boxes(spots, "_spot", "b_", point_keys)
    return _pairs(a, b, image_keys, point_keys, share, min_pairs, points=True, widen=widen)


def drawn_images(
    catalog: DataFrame, image_keys: list[str], geometry: str = "geometry", box: str | None = "bbox"
) -> DataFrame:
    """Key columns, outline and box of the images that have a geometry, computed once and written to the scratch folder.

    A NULL box is computed from the geometry, with ``box=None`` every box is.
    """
    outline = F.col(geometry)
    edges = wkb_bounds(outline) if box is None else F.coalesce(F.col(box), wkb_bounds(F.when(F.col(box).isNull(), outline)))
    images = catalog.where(outline.isNotNull()).select(*image_keys, outline.alias("_outline"), edges.alias("_box"))
    path = scratch_path(catalog.sparkSession, "outlines")
    images.write.parquet(path)
    return catalog.sparkSession.read.schema(images.schema).parquet(path)


def polygon_hits(
    catalog: DataFrame,
    points: DataFrame,
    image_keys: list[str],
    point_keys: list[str],
    lon: str = "lon",
    lat: str = "lat",
    geometry: str = "geometry",
    box: str | None = "bbox",
    share: int = SHARE,
    min_pairs: int = MIN_PAIRS,
    widen: Callable[[DataFrame], DataFrame] | None = None,
    counted: bool = False,
    drawn: bool = False,
) -> DataFrame:
    """Key columns of every footprint that holds a point, by its drawn polygons and not by its box; borders count.

    Images and points of a cell come together as in ``point_hits``, but in one sorted stream, and one Arrow function finds
    a cell's hits without a row for each pair of them. A NULL box is computed from the geometry, with ``box=None`` every
    box is. Images without a polygon are hit by nothing.

    ``widen`` as in ``point_hits``. With ``counted`` the key columns of points that are hit, and the number of rows of images that
    hold them as ``images``, added up over points of equal keys. ``drawn`` says that ``catalog`` is from ``drawn_images``.
    """
    images = catalog if drawn else drawn_images(catalog, image_keys, geometry, box)
    a = _boxes(images, "_box", "a_", [*image_keys, "_outline"])
    where = F.struct(F.col(lon).alias("xmin"), F.col(lat).alias("ymin"), F.col(lon).alias("xmax"), F.col(lat).alias("ymax"))
    b = _boxes(points.select(*point_keys, where.alias("_spot")), "_spot", "b_", point_keys)
    b = b.where("NOT isnan(b_xmin) AND NOT isnan(b_ymin)")
    # A point is a box of no size at the finest level, so the footprint is the coarser side.
    levels = sorted(r[0] for r in a.select("a_home").distinct().collect())
    right, on = _at_levels(b, "b_", levels, False, True), ["_cell"]
    hot, pairs = key_loads(_at_home(a, "a_", levels), right, on, share, min_pairs, MOST_POINTS)
    wide = widen(a) if widen else a
    shown = [] if counted else [*image_keys, *[c for c in wide.columns if c not in a.columns]]
    left = _at_home(wide.withColumn("_parts", outline_parts(F.col("_outline"))), "a_", levels)
    if hot is not None:
        left, right = deal(left, right, on, image_keys, point_keys, hot)
        on = ["_cell", "_li", "_ri"]
    kinds = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}

    def none(columns: list[str]) -> list[Column]:
        return [F.lit(None).cast(kinds[c]).alias(c) for c in columns]

    def stream(side: int, box: list[str], parts: list[Column], of_images: list, of_points: list) -> list:
        edges = [F.col(c) if c else F.lit(None).cast("double") for c in box]
        named = [edge.alias(name) for edge, name in zip(edges, ("_x0", "_y0", "_x1", "_y1"))]
        return [*on, F.lit(side).alias("_side"), *named, *parts, *of_images, *of_points]

    nothing = F.lit(None).cast("binary")
    parts = [F.col("_parts.xy").alias("_xy"), F.col("_parts.rings").alias("_rings")]
    corners = ["a_xmin", "a_ymin", "a_xmax", "a_ymax"]
    rows = left.select(*stream(1, corners, parts, shown, none(point_keys))).unionAll(
        right.select(*stream(0, ["b_xmin", "b_ymin", "", ""], [nothing.alias("_xy"), nothing.alias("_rings")], none(shown), point_keys))
    )
    # Tasks by what they have to compare, not by what they read.
    tasks = min(MOST_TASKS, int(pairs // TASK_PAIRS))
    default = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *on) if tasks > default else rows.repartition(*on)
    keys = StructType([StructField(c, kinds[c]) for c in point_keys])
    if counted:
        made = StructType([*keys.fields, StructField("_images", LongType())])
    else:
        made = StructType([*[StructField(c, kinds[c]) for c in shown], StructField("_points", ArrayType(keys))])
    found = dealt.sortWithinPartitions(*on, "_side").mapInArrow(cell_hits(on, shown, point_keys, counted), made)
    if counted:
        return found.groupBy(*point_keys).agg(F.sum("_images").alias("images"))
    return found.select(*shown, F.inline("_points")).select(*image_keys, *shown[len(image_keys) :], *point_keys)


def viewport_counts(
    catalog: DataFrame, viewports: DataFrame, view_keys: list[str], share: int = SHARE, min_pairs: int = MIN_PAIRS
) -> DataFrame:
    """Images per saved rectangle (columns west, south, east, north), zero included."""
    areas = viewports.select(
        *view_keys,
        F.struct(
            F.col("west").alias("xmin"), F.col("south").alias("ymin"),
            F.col("east").alias("xmax"), F.col("north").alias("ymax"),
        ).alias("area"),
    )
    pairs = box_pairs(catalog, areas, ["id"], view_keys, "bbox", "area", share, min_pairs)
    counts = pairs.groupBy(*view_keys).agg(F.count("*").alias("images"))
    return viewports.join(counts, view_keys, "left").withColumn("images", F.coalesce("images", F.lit(0)))


@dataclass(frozen=True)
class Hits:
    """Images and points whose hits are still to be found by ``find``, which takes what ``point_hits`` takes."""

    images: DataFrame
    points: DataFrame
    image_keys: list[str]
    point_keys: list[str]
    find: Callable[..., DataFrame] = point_hits


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys that several rows have, NULL like any value; ``None`` if there are none. One job finds that out."""
    counts = df.groupBy(*[F.col(k).alias(f"_again_{k}") for k in keys]).agg(F.count("*").alias("_rows"))
    again = counts.where("_rows > 1").drop("_rows")
    return again if again.count() else None


def _split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys no other row has, and all others, if there are any."""
    again = _repeated(df, keys)
    if again is None:
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in keys])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def _named(rows: DataFrame, image_key: str = "id") -> DataFrame:
    return rows.where(F.col(image_key).isNotNull() & (F.col(image_key) != ""))


def unique_hits(
    hits: DataFrame, point_keys: list[str], image_key: str = "id", order: tuple[str, ...] = ()
) -> DataFrame:
    """First hit per image and point by the columns in ``order``, then by all others in turn.

    The choice never depends on the order of rows. Hits without an image id are dropped.
    """
    named = _named(hits, image_key)
    keys = [*point_keys, image_key]
    rest = [*order, *[c for c in hits.columns if c not in keys and c not in order]]
    if not rest:
        return named.distinct()
    first = named.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in hits.columns])


def _parted(hits: Hits, image_key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Images whose id no other image has, points whose keys no other point has, and all hits of others, if there may be any."""
    once, again = _split(hits.images, [image_key])
    alone, together = _split(hits.points, hits.point_keys)
    others = [(again, hits.points), (once, together)]
    found = [hits.find(i, p, hits.image_keys, hits.point_keys) for i, p in others if i is not None and p is not None]
    return once, alone, reduce(DataFrame.unionByName, found) if found else None


def overlap_counts(hits: DataFrame | Hits, point_keys: list[str], image_key: str = "id") -> DataFrame:
    """Number of different images per point.

    Hits still to be found, by a ``find`` that counts them as ``polygon_hits`` does, are counted where they are found; only those of
    ids or points that several rows have become rows. Their counts are computed once and written to the scratch folder.
    """
    if not isinstance(hits, Hits):
        return hits.groupBy(*point_keys).agg(F.count_distinct(image_key).alias("images"))
    missing = F.col(image_key).isNull()
    once, alone, others = _parted(replace(hits, images=hits.images.where(~missing)), image_key)
    parts = [hits.find(once, alone, hits.image_keys, hits.point_keys, counted=True)]
    nameless = hits.images.where(missing)
    if not nameless.isEmpty():
        found = hits.find(nameless, hits.points, hits.image_keys, hits.point_keys)
        others = found if others is None else others.unionByName(found)
    if others is not None:
        # A point that is alone has images of two kinds, and no id is of both; another one has none of the first.
        parts.append(overlap_counts(others, point_keys, image_key))
    counts = reduce(DataFrame.unionByName, parts).groupBy(*point_keys).agg(F.sum("images").alias("images"))
    path = scratch_path(hits.images.sparkSession, "counts")
    counts.write.parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def _lone_hit_features(
    hits: Hits, catalog: DataFrame, point_keys: list[str], fallback: dict[str, str]
) -> tuple[DataFrame, DataFrame | None]:
    """Features of the hits that are the only ones of their image and point, and all other hits, if there may be any.

    Where no other image has the id and no other point the keys, each hit is such a one. These images take
    their catalog row with them into the search, and a hit is complete where it is found.
    """
    names = [c for c in catalog.columns if c != "id"]
    rows = catalog.select("id", *[F.col(c).alias(f"_full_{c}") for c in names])
    filled = {f"_full_{n}": F.coalesce(F.col(f"_full_{n}"), F.col(c)) for n, c in fallback.items()}

    def widen(images: DataFrame) -> DataFrame:
        joined = images.join(rows, "id", "left")
        return joined.withColumns(filled) if filled else joined

    once, alone, others = _parted(replace(hits, images=_named(hits.images)))
    full = hits.find(once, alone, hits.image_keys, hits.point_keys, widen=widen).select(
        "id", *point_keys, *[F.col(f"_full_{c}").alias(c) for c in names]
    )
    return full, others


def hit_features(
    hits: DataFrame | Hits,
    catalog: DataFrame,
    point_keys: list[str],
    fallback: dict[str, str] | None = None,
    order: tuple[str, ...] = (),
    of_points: DataFrame | None = None,
) -> DataFrame:
    """Full catalog row for every unique hit; what the hit itself carries fills the gaps.

    ``fallback`` maps a catalog column to the column of ``hits`` used when the id is
    not in the catalog. ``catalog`` is unique by id. An image hit very often makes a
    skewed left side, which the adaptive join splits without touching the right side.

    Hits still to be found (``Hits``) give the same rows, but only those of ids or points that
    several rows have are shuffled; there may be far more hits than images and points.

    ``of_points`` has a row of more columns for each of some ``point_keys``; the result has these columns, and only those points.
    """
    fallback = fallback or {}
    if of_points is not None:
        if not isinstance(hits, Hits):
            return hit_features(hits, catalog, point_keys, fallback, order).join(of_points, point_keys)
        more = [c for c in of_points.columns if c not in point_keys]
        hits = replace(hits, points=hits.points.join(of_points, point_keys), point_keys=[*hits.point_keys, *more])
        point_keys = [*point_keys, *more]
    if isinstance(hits, Hits):
        full, others = _lone_hit_features(hits, catalog, point_keys, fallback)
        return full if others is None else full.unionByName(hit_features(others, catalog, point_keys, fallback, order))
    unique = unique_hits(hits, point_keys, order=order)
    carried = unique.select(*point_keys, "id", *[F.col(c).alias(f"_hit_{n}") for n, c in fallback.items()])
    joined = carried.join(catalog, "id", "left")
    filled = {n: F.coalesce(F.col(n), F.col(f"_hit_{n}")) for n in fallback}
    return joined.withColumns(filled).drop(*[f"_hit_{n}" for n in fallback]) if filled else joined
