"""Points in the polygons of WKB geometries, one Arrow function over whole batches of pairs."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StructType

# Ship these functions by value: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Edges that are compared with points at once; a longer polygon is compared with one point at a time.
MOST_EDGES = 500_000

# What broken bytes raise while they are walked.
_BROKEN = (struct.error, ValueError, IndexError)


def _polygons(data: bytes) -> Iterator[list[np.ndarray]]:
    """The rings (n x 2) of every polygon in a geometry of any kind and byte order; the first ring is the outer one."""
    at, pending = 0, 1

    def numbers(kind: str, count: int = 1) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, order + kind, count, at)
        at += found.nbytes
        return found

    while pending:
        pending -= 1
        order = "<" if data[at] == 1 else ">"
        at += 1
        code = int(numbers("u4")[0])
        # Two ways to say that positions have a height or a measure; one of them may add a reference system.
        high = code >> 29
        dims = 2 + (high >> 2 & 1) + (high >> 1 & 1) + (0, 1, 1, 2)[(code & 0x1FFFFFFF) // 1000]
        if high & 1:
            numbers("u4")
        kind = (code & 0x1FFFFFFF) % 1000
        if kind == 1:
            numbers("f8", dims)
        elif kind == 2:
            numbers("f8", dims * int(numbers("u4")[0]))
        elif kind == 3:
            rings = [numbers("f8", dims * int(numbers("u4")[0])).reshape(-1, dims)[:, :2] for _ in range(int(numbers("u4")[0]))]
            yield [np.ascontiguousarray(ring, "f8") for ring in rings]
        elif kind in (4, 5, 6, 7):
            pending += int(numbers("u4")[0])
        else:
            raise ValueError(f"geometry of kind {kind}")


def _edges(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Edges (x1, y1, x2, y2), the number of edges of each ring, and for each ring whether it is an outer one.

    ``None`` if there is no polygon or the bytes are broken.
    """
    try:
        found = list(_polygons(data))
    except _BROKEN:
        return None
    edges, counts, outer = [], [], []
    for rings in found:
        if not rings or not len(rings[0]):
            continue  # holes of nothing
        for n, ring in enumerate(rings):
            if len(ring):
                edges.append(np.hstack([ring, np.roll(ring, -1, axis=0)]))
                counts.append(len(ring))
                outer.append(n == 0)
    if not edges:
        return None
    return np.concatenate(edges), np.array(counts), np.array(outer)


def _covered(shapes: list[tuple], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Is point i in shape i? Winding numbers of all edges of all pairs in one pass."""
    sizes = np.array([len(s[0]) for s in shapes])
    edges = np.concatenate([s[0] for s in shapes])
    px, py = np.repeat(x, sizes), np.repeat(y, sizes)
    x1, y1, x2, y2 = edges.T
    side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
    up, down = (y1 <= py) & (y2 > py) & (side > 0), (y1 > py) & (y2 <= py) & (side < 0)
    touch = (side == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    counts, outer = np.concatenate([s[1] for s in shapes]), np.concatenate([s[2] for s in shapes])
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    turns = np.add.reduceat(up.astype(np.int64) - down, starts)
    on_ring = np.logical_or.reduceat(touch, starts)
    # A polygon's first ring must hold the point, its border included; a hole must not, but for its border.
    good = np.where(outer, on_ring | (turns != 0), on_ring | (turns == 0))
    polygons = np.flatnonzero(outer)
    in_polygon = np.logical_and.reduceat(good, polygons)
    first_polygon = np.r_[0, np.cumsum([s[2].sum() for s in shapes])[:-1]]
    return np.logical_or.reduceat(in_polygon, first_polygon)


def _batch_covers(blobs: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
    x, y = (np.asarray(v.to_numpy(dtype="f8", na_value=np.nan)) for v in (xs, ys))
    out = np.zeros(len(blobs), bool)
    known: dict[bytes, tuple | None] = {}
    shapes: list[tuple] = []
    where: list[int] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if where:
            out[where] = _covered(shapes, x[where], y[where])
        shapes.clear()
        where.clear()
        held = 0

    for i, blob in enumerate(blobs):
        if blob is None or np.isnan(x[i]) or np.isnan(y[i]):
            continue
        if blob not in known:
            known[blob] = _edges(blob)
        shape = known[blob]
        if shape is None:
            continue
        if held and held + len(shape[0]) > MOST_EDGES:
            settle()
        shapes.append(shape)
        where.append(i)
        held += len(shape[0])
    settle()
    return pd.Series(out)


_covers_udf = F.pandas_udf(_batch_covers, BooleanType())


def polygon_covers(geometry: Column, lon: Column, lat: Column) -> Column:
    """Is the position in one of the polygons of a WKB geometry? Borders count, also those of holes.

    Inside is what a ring winds around at least once. A multipolygon or a collection holds what one of its polygons holds.
    Points and lines hold nothing, and so do NULL, empty and broken geometries; a NULL or NaN position is in nothing. Rings may be left
    open. Heights and measures are passed over.
    """
    return _covers_udf(geometry, lon, lat)


def _parts(data: bytes | None) -> tuple[bytes, bytes]:
    """Corners (x, y) of all rings, and the number of corners of each ring, negative for holes."""
    try:
        found = [] if data is None else list(_polygons(data))
    except _BROKEN:
        found = []
    corners, counts = [], []
    for rings in found:
        if not rings or not len(rings[0]):
            continue  # holes of nothing
        for n, ring in enumerate(rings):
            # The last corner repeats the first one of a closed ring; next to infinite ones it stays, as they make no border.
            if len(ring) > 1 and ring[0, 0] == ring[-1, 0] and ring[0, 1] == ring[-1, 1] and np.isfinite(ring).all():
                ring = ring[:-1]
            if len(ring):
                corners.append(ring.astype("<f8").tobytes())
                counts.append(-len(ring) if n else len(ring))
    return b"".join(corners), struct.pack(f"<{len(counts)}i", *counts)


def _batch_parts(blobs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parts(blob) for blob in blobs], columns=["xy", "rings"], dtype=object)


PARTS_TYPE = StructType().add("xy", "binary").add("rings", "binary")
_parts_udf = F.pandas_udf(_batch_parts, PARTS_TYPE)


def outline_parts(geometry: Column) -> Column:
    """The polygons of a WKB geometry, packed: ``xy`` has corners, ``rings`` numbers of corners. Both are empty without a polygon."""
    return _parts_udf(geometry)
