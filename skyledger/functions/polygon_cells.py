"""Which points of a grid cell lie in which outlines of that cell, one Arrow function over a sorted stream of both.

A row is a point (``_side`` 0: position in ``_x0``, ``_y0``) or an outline (``_side`` 1: box in ``_x0`` to ``_y1``, corners in
``_xy``, rings in ``_rings`` as ``outline_parts`` gives them). The rows of a cell come together, its points first. The points of the
cell that is open are held and outlines stream past them, so what is found leaves as one list of points for each outline.
Pairs of points and outlines exist only here, a bounded number at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship these functions by value: workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs that are made at once, and pairs that are compared with an edge at once (they stay in the processor's cache).
PAIRS = 1 << 20
BLOCK = 1 << 14

#: So many pairs with outlines of the same rings are compared edge by edge; fewer ones together with those of other rings.
LEAST = 2000

#: Edges of such mixed pairs that are compared at once; a longer outline is compared with one point at a time.
MOST_EDGES = 500_000

BOX = ("_x0", "_y0", "_x1", "_y1")


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of runs of ``counts`` numbers each from ``starts``, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of at most ``most`` in the sum of their counts, or of one element."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield slice(at, end)
        at = end


class Points:
    """Points of several cells, found by rectangles: cells are cut into strips of as many points each by y, strips go by x.

    ``group`` is the number of a point's cell and never decreases.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, group: np.ndarray, groups: int) -> None:
        # Places among all x and all y take their places, so that a cell or strip and a place make one number.
        self.base = len(x) + 1
        self.xs, self.ys = np.sort(x), np.sort(y)
        by_y = np.argsort(self._code(group, self.ys, y, "left"), kind="stable")
        self.y_codes = self._code(group, self.ys, y[by_y], "left")
        self.first = np.searchsorted(group, np.arange(groups + 1))
        self.size = np.diff(self.first)
        self.strips = np.maximum(1, (np.sqrt(self.size) / 4).astype(np.int64))
        self.strip0 = np.cumsum(self.strips) - self.strips
        strip = self._strip(group, np.arange(len(x)))
        codes = self._code(strip, self.xs, x[by_y], "left")
        by_x = np.argsort(codes, kind="stable")
        self.x_codes = codes[by_x]
        self.order = by_y[by_x]
        self.x, self.y = x[self.order], y[self.order]

    def _code(self, part: np.ndarray, values: np.ndarray, value: np.ndarray, side: str) -> np.ndarray:
        return part * self.base + np.searchsorted(values, value, side)

    def _strip(self, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.strip0[group] + (place - self.first[group]) * self.strips[group] // np.maximum(1, self.size[group])

    def pairs(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
        """Numbers of boxes and of the points in them, edges included. Numbers of boxes never decrease."""
        low = np.searchsorted(self.y_codes, self._code(group, self.ys, y0, "left"))
        high = np.searchsorted(self.y_codes, self._code(group, self.ys, y1, "right"))
        some = np.flatnonzero(high > low)
        g = group[some]
        s0, s1 = self._strip(g, low[some]), self._strip(g, high[some] - 1)
        box, strip = np.repeat(some, s1 - s0 + 1), _runs(s0, s1 - s0 + 1)
        start = np.searchsorted(self.x_codes, self._code(strip, self.xs, x0[box], "left"))
        count = np.searchsorted(self.x_codes, self._code(strip, self.xs, x1[box], "right")) - start
        some = np.flatnonzero(count > 0)
        box, start, count = box[some], start[some], count[some]
        for part in _slices(count, PAIRS):
            b, p = np.repeat(box[part], count[part]), _runs(start[part], count[part])
            y = self.y[p]
            keep = np.flatnonzero((y >= y0[b]) & (y <= y1[b]))
            if len(keep):
                yield b[keep], p[keep]


def _binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, and where each row's begin and end."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    width = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) // width
    data = column.buffers()[2]
    return np.frombuffer(b"" if data is None else data, kind, ends[-1]), ends


class Outlines:
    """Outlines of a batch, those with the same rings beside each other."""

    def __init__(self, batch: pa.RecordBatch, group: np.ndarray) -> None:
        self.corners, at = _binary(batch.column("_xy"), "<f8")
        self.corners = self.corners.reshape(-1, 2)
        self.rings, ring_at = _binary(batch.column("_rings"), "<i4")
        layouts = batch.column("_rings").dictionary_encode()
        layout = layouts.indices.to_numpy(zero_copy_only=False)
        # Not those without a polygon.
        rows = np.flatnonzero(np.diff(ring_at))
        self.rows = rows[np.argsort(layout[rows], kind="stable")]
        self.layout = layout[self.rows]
        self.kinds = [np.frombuffer(kind.as_py(), "<i4") for kind in layouts.dictionary]
        self.start, self.edges = at[:-1][self.rows] // 2, np.diff(at)[self.rows] // 2
        self.box = [batch.column(name).to_numpy(zero_copy_only=False)[self.rows] for name in BOX]
        self.group = group[self.rows]

    def hold(self, outline: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Is point i in outline i? Numbers of outlines never decrease."""
        out = np.zeros(len(outline), bool)
        used = self.layout[outline]
        bounds = np.r_[0, np.flatnonzero(np.diff(used)) + 1, len(used)]
        mixed = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < LEAST:
                mixed.append(np.arange(lo, hi))
                continue
            kind = self.kinds[used[lo]]
            first, last = outline[lo], outline[hi - 1] + 1
            corners = self.corners[self.start[first:last, None] + np.arange(self.edges[first])]
            xs, ys = (np.ascontiguousarray(corners[:, :, axis].T) for axis in (0, 1))
            for at in range(lo, hi, BLOCK):
                part = slice(at, min(at + BLOCK, hi))
                out[part] = _hold_alike(kind, xs, ys, outline[part] - first, x[part], y[part])
        if mixed:
            pairs = np.concatenate(mixed)
            for part in _slices(self.edges[outline[pairs]], MOST_EDGES):
                some = pairs[part]
                out[some] = self._hold_mixed(outline[some], x[some], y[some])
        return out

    def _hold_mixed(self, outline: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Winding numbers of all edges of all pairs in one pass."""
        if not hasattr(self, "after"):
            counts = np.abs(self.rings)
            ends = np.cumsum(counts)
            self.after = np.arange(1, len(self.corners) + 1)
            self.after[ends - 1] = ends - counts
            self.outer = np.zeros(len(self.corners), np.int8)
            self.outer[ends - counts] = np.sign(self.rings)
        sizes = self.edges[outline]
        at = _runs(self.start[outline], sizes)
        x1, y1 = self.corners[at].T
        x2, y2 = self.corners[self.after[at]].T
        px, py = np.repeat(x, sizes), np.repeat(y, sizes)
        side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
        up, down = (y1 <= py) & (y2 > py) & (side > 0), (y1 > py) & (y2 <= py) & (side < 0)
        touch = (side == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
        begins = self.outer[at]
        starts = np.flatnonzero(begins)
        outer = begins[starts] > 0
        turns = np.add.reduceat(up.astype(np.int64) - down, starts)
        on_ring = np.logical_or.reduceat(touch, starts)
        good = np.where(outer, on_ring | (turns != 0), on_ring | (turns == 0))
        polygons = np.flatnonzero(outer)
        in_polygon = np.logical_and.reduceat(good, polygons)
        return np.logical_or.reduceat(in_polygon, np.searchsorted(starts[polygons], np.cumsum(sizes) - sizes))


def _hold_alike(kind: np.ndarray, xs: np.ndarray, ys: np.ndarray, outline: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``hold`` for outlines of the same rings: corner by corner, all pairs at once.

    A polygon's first ring must hold the point, its border included; a hole must not, but for its border.
    """
    held, in_polygon, at = np.zeros(len(x), bool), None, 0
    for ring in kind:
        corners = abs(int(ring))
        turns = np.zeros(len(x), np.int8 if corners < 128 else np.int64)
        border = np.zeros(len(x), bool)
        x1, y1 = xs[at + corners - 1].take(outline), ys[at + corners - 1].take(outline)
        dx, dy, below = x - x1, y - y1, y1 <= y
        for n in range(at, at + corners):
            x2, y2 = xs[n].take(outline), ys[n].take(outline)
            below2 = y2 <= y
            side = (x2 - x1) * dy - dx * (y2 - y1)
            turns += (below & ~below2 & (side > 0)).view(np.int8)
            turns -= (below2 & ~below & (side < 0)).view(np.int8)
            flat = side == 0
            if flat.any():
                i = np.flatnonzero(flat)
                border[i] |= (
                    (np.minimum(x1[i], x2[i]) <= x[i]) & (x[i] <= np.maximum(x1[i], x2[i]))
                    & (np.minimum(y1[i], y2[i]) <= y[i]) & (y[i] <= np.maximum(y1[i], y2[i]))
                )
            x1, y1, below, dx, dy = x2, y2, below2, x - x2, y - y2
        at += corners
        if ring > 0:
            if in_polygon is not None:
                held |= in_polygon
            in_polygon = border | (turns != 0)
        else:
            in_polygon &= border | (turns == 0)
    return held | in_polygon


def _found(points: Points, outlines: Outlines) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    with np.errstate(all="ignore"):
        for outline, point in points.pairs(*outlines.box, outlines.group):
            held = np.flatnonzero(outlines.hold(outline, points.x[point], points.y[point]))
            if len(held):
                yield outline[held], point[held]


def _listed(points: Points, rows: pa.RecordBatch, outlines: Outlines, batch: pa.RecordBatch, images: list[str]) -> Iterator[pa.RecordBatch]:
    """Outlines' columns with the list of their points' columns, lists being parts of what an outline has."""
    for outline, point in _found(points, outlines):
        starts = np.r_[0, np.flatnonzero(np.diff(outline)) + 1]
        kept = rows.take(pa.array(points.order[point]))
        made = pa.StructArray.from_arrays(kept.columns, names=kept.schema.names)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(point)], pa.int32()), made)
        shown = batch.select(images).take(pa.array(outlines.rows[outline[starts]]))
        yield pa.RecordBatch.from_arrays([*shown.columns, lists], names=[*images, "_points"])


def _counted(points: Points, rows: pa.RecordBatch, outlines: Outlines) -> Iterator[pa.RecordBatch]:
    """Points' columns with the number of outlines that hold them."""
    counts = np.zeros(len(points.x), np.int64)
    for _, point in _found(points, outlines):
        counts += np.bincount(point, minlength=len(counts))
    some = np.flatnonzero(counts)
    if len(some):
        shown = rows.take(pa.array(points.order[some]))
        yield pa.RecordBatch.from_arrays([*shown.columns, pa.array(counts[some])], names=[*shown.schema.names, "_images"])


def cell_hits(on: list[str], images: list[str], points: list[str], counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``. Rows go by ``on`` and ``_side``; ``images`` and ``points`` are the columns that are handed on.

    With ``counted`` points leave with ``_images``, the number of outlines that hold them, in parts to be added up.
    """

    def meet(found: Points, rows: pa.RecordBatch, batch: pa.RecordBatch, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        outlines = Outlines(batch, group)
        shown = rows.select(points)
        yield from _counted(found, shown, outlines) if counted else _listed(found, shown, outlines, batch, images)

    def spots(rows: pa.RecordBatch, group: np.ndarray, groups: int) -> Points:
        return Points(*(rows.column(n).to_numpy(zero_copy_only=False) for n in BOX[:2]), group, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [*points, *BOX[:2]]
        key: tuple | None = None
        # Points of the cell that is open, those of several batches until they are asked for.
        held: list[pa.RecordBatch] = []
        found: Points | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in on]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = key != tuple(k[0] for k in keys)
            group = np.cumsum(new)
            is_point = batch.column("_side").to_numpy(zero_copy_only=False) == 0
            more = int(np.searchsorted(group, 1))
            if more:
                begins = int(is_point[:more].sum())
                if begins:
                    held.append(pa.concat_batches([batch.select(kept).slice(0, begins)]))
                    found = None
                if held and more > begins:
                    if found is None:
                        held = [pa.concat_batches(held)]
                        found = spots(held[0], np.zeros(held[0].num_rows, np.int64), 1)
                    yield from meet(found, held[0], batch.slice(begins, more - begins), np.zeros(more - begins, np.int64))
            if more < batch.num_rows:
                groups = int(group[-1]) + 1
                at, out = (np.flatnonzero(side[more:]) + more for side in (is_point, ~is_point))
                rows = batch.select(kept).take(pa.array(at))
                if len(at) and len(out):
                    yield from meet(spots(rows, group[at], groups), rows, batch.take(pa.array(out)), group[out])
                key, found = tuple(k[-1] for k in keys), None
                last = int(np.searchsorted(group[at], groups - 1))
                held = [pa.concat_batches([rows.slice(last)])] if last < len(at) else []

    return run
