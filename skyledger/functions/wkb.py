"""Arrow functions for WKB, the only Python code that touches geometry bytes.

NumPy works on whole Arrow batches of equal box polygons; other shapes are walked
one at a time.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType

from skyledger.schema import BBOX_TYPE

# Ship these functions by value: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BOX_HEADER = struct.pack("<BIII", 1, 3, 1, 5)
_BOX_DTYPE = [("head", "V13"), ("xy", "<f8", (5, 2))]
_BOX_SIZE = 93
_SPACED = str.maketrans("[],", "   ")

# GeoJSON type name to WKB type number.
_TYPES = {
    "Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4,
    "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7,
}


def _coordinate_runs(data: bytes) -> Iterator[np.ndarray]:
    """Every coordinate run of one WKB geometry as an ``(n, dims)`` array."""
    at = 0

    def word() -> int:
        nonlocal at
        value = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        return value

    pending = 1
    while pending:
        pending -= 1
        order = "<" if data[at] == 1 else ">"
        at += 1
        code = word()
        dims = 2
        if code & 0xE0000000:
            dims += bool(code & 0x80000000) + bool(code & 0x40000000)
            if code & 0x20000000:
                at += 4
            code &= 0x0FFFFFFF
        else:
            dims += (0, 1, 1, 2)[code // 1000]
            code %= 1000
        if code >= 4:
            pending += word()
            continue
        runs = word() if code == 3 else 1
        for _ in range(runs):
            count = 1 if code == 1 else word()
            yield np.frombuffer(data, order + "f8", count * dims, at).reshape(count, dims)
            at += 8 * count * dims


# What broken bytes or texts raise while they are walked.
_BROKEN = (struct.error, ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError)


def _extent(data: bytes) -> tuple[float, float, float, float] | None:
    try:
        runs = [run[:, :2] for run in _coordinate_runs(data) if len(run)]
    except _BROKEN:
        return None
    points = np.concatenate(runs) if runs else np.empty((0, 2))
    points = points[~np.isnan(points).any(axis=1)]
    if not len(points):
        return None
    return (*points.min(axis=0), *points.max(axis=0))


def _batch_extents(blobs: pd.Series) -> pd.DataFrame:
    out = np.full((len(blobs), 4), np.nan)
    known = blobs.notna().to_numpy()
    is_box = np.array(
        [ok and len(b) == _BOX_SIZE and b[:13] == _BOX_HEADER for ok, b in zip(known, blobs)], dtype=bool
    )
    if is_box.any():
        xy = np.frombuffer(b"".join(blobs[is_box]), _BOX_DTYPE)["xy"]
        out[is_box] = np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)
    for i in np.flatnonzero(known & ~is_box):
        extent = _extent(bytes(blobs.iloc[i]))
        if extent:
            out[i] = extent
    return pd.DataFrame(out, columns=["xmin", "ymin", "xmax", "ymax"]).astype(object).where(~np.isnan(out), None)


def _batch_boxes(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
    edges = pd.concat([w, s, e, n], axis=1).to_numpy(dtype="f8", na_value=np.nan)
    rows = np.zeros(len(edges), _BOX_DTYPE)
    rows["head"] = np.void(_BOX_HEADER)
    rows["xy"] = edges[:, [[0, 1], [2, 1], [2, 3], [0, 3], [0, 1]]]
    missing = np.isnan(edges).any(axis=1)
    return pd.Series([None if gone else row.tobytes() for gone, row in zip(missing, rows)], dtype=object)


def _encode(geometry: dict) -> bytes:
    kind = geometry["type"]
    head = struct.pack("<BI", 1, _TYPES[kind])

    def run(points: list) -> bytes:
        flat = [float(v) for point in points for v in point[:2]]
        return struct.pack(f"<I{len(flat)}d", len(points), *flat)

    if kind == "GeometryCollection":
        parts = geometry["geometries"]
        return head + struct.pack("<I", len(parts)) + b"".join(map(_encode, parts))
    coordinates = geometry["coordinates"]
    if kind == "Point":
        return head + struct.pack("<2d", *coordinates[:2])
    if kind == "LineString":
        return head + run(coordinates)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(run, coordinates))
    parts = [{"type": kind[5:], "coordinates": part} for part in coordinates]
    return head + struct.pack("<I", len(parts)) + b"".join(map(_encode, parts))


def _encoded(text: str | None) -> bytes | None:
    try:
        return None if text is None else _encode(json.loads(text))
    except _BROKEN:
        return None


# The start and the separators of a closed ring of five positions.
_RING_TEXT = re.compile(
    r'\s*\{\s*"type"\s*:\s*"Polygon"\s*,\s*"coordinates"\s*:\s*\[\s*\[((?:\s*\[\s*[-+.0-9eE]+\s*,\s*[-+.0-9eE]+\s*\]\s*,?){5})\s*\]\s*\]\s*\}\s*'
)


def _batch_geojson(texts: pd.Series) -> pd.Series:
    """Rings of five positions, the usual footprints, are packed together; other texts one at a time."""
    out = np.full(len(texts), None, object)
    rings, where = [], []
    for i, text in enumerate(texts):
        match = None if text is None else _RING_TEXT.fullmatch(text)
        if match:
            rings.append(match[1])
            where.append(i)
        else:
            out[i] = _encoded(text)
    if rings:
        flat = " ".join(rings).translate(_SPACED).split()
        if len(flat) == 10 * len(rings):
            try:
                rows = np.zeros(len(rings), _BOX_DTYPE)
                rows["head"] = np.void(_BOX_HEADER)
                rows["xy"] = np.array(flat, "f8").reshape(-1, 5, 2)
            except ValueError:
                rows = None
        else:
            rows = None
        for n, i in enumerate(where):
            out[i] = _encoded(texts.iloc[i]) if rows is None else rows[n].tobytes()
    return pd.Series(out, dtype=object)


_extents_udf = F.pandas_udf(_batch_extents, BBOX_TYPE)
_boxes_udf = F.pandas_udf(_batch_boxes, BinaryType())
_geojson_udf = F.pandas_udf(_batch_geojson, BinaryType())
_geojson_once_udf = F.pandas_udf(_batch_geojson, BinaryType()).asNondeterministic()


def wkb_bounds(geometry: Column) -> Column:
    """Extent of a WKB geometry of any type and byte order as a bbox struct.

    NULL, empty and broken geometries give NULL. Pass NULL for rows that need no bounds:
    Python functions are evaluated for every row they are given.
    """
    extent = _extents_udf(geometry)
    return F.when(extent["xmin"].isNotNull(), extent)


def box_wkb(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Box polygon as little-endian WKB; NULL when an edge is NULL."""
    return _boxes_udf(w, s, e, n)


def geojson_wkb(geojson: Column, once: bool = False) -> Column:
    """GeoJSON geometry text as two-dimensional WKB; NULL for texts that are no geometry.

    With ``once`` a filter on the result doesn't make Catalyst compute it a second time below the projection.
    """
    return (_geojson_once_udf if once else _geojson_udf)(geojson)
