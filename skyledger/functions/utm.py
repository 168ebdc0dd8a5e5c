"""Transverse Mercator metres (UTM zones) to longitude and latitude, as expressions evaluated in the JVM.

The inverse projection is Krüger's series to the fourth order of the ellipsoid's third flattening, good to a micrometre within a
zone's usual reach. A box is not a box in degrees: its sides bend. So its bounds are taken over points along all four sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from skyledger.functions.geo import mercator_bounds
from skyledger.schema import make_bbox

# The WGS 84 ellipsoid, and the scale and offsets of the zones.
SEMI_MAJOR_M, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, FALSE_EAST_M, FALSE_NORTH_M = 0.9996, 500_000.0, 10_000_000.0
#: First EPSG code before zone 1, north and south.
NORTH, SOUTH = 32600, 32700
#: Points along each side of a box, beside its first corner.
POINTS = 21

_N = FLATTENING / (2 - FLATTENING)
#: Metres for each radian of rectifying latitude.
RADIUS_M = SCALE * SEMI_MAJOR_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The series' coefficients, from the ellipsoid's third flattening.
BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
)
DELTA = (
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4,
    56 / 15 * _N**3 - 136 / 35 * _N**4,
    4279 / 630 * _N**4,
)


def _stages(epsg: Column) -> list[Callable[[Column], Column]]:
    """The steps from a ``struct<x,y>`` to ``struct<lon,lat>``, a struct each: what a later step reads again is computed once."""
    south = epsg > SOUTH
    zone = epsg - F.when(south, SOUTH).otherwise(NORTH)

    def scaled(p: Column) -> Column:
        xi = (p["y"] - F.when(south, FALSE_NORTH_M).otherwise(0.0)) / RADIUS_M
        return F.struct(xi.alias("xi"), ((p["x"] - FALSE_EAST_M) / RADIUS_M).alias("eta"))

    def unbent(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        xi1, eta1 = xi, eta
        for j, beta in enumerate(BETA, 1):
            xi1 = xi1 - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct(xi1.alias("xi"), eta1.alias("eta"))

    def on_sphere(p: Column) -> Column:
        chi = F.asin(F.sin(p["xi"]) / F.cosh(p["eta"]))
        lon = (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])))
        return F.struct(lon.cast("double").alias("lon"), chi.alias("chi"))

    def on_ellipsoid(p: Column) -> Column:
        chi = p["chi"]
        lat = chi
        for j, delta in enumerate(DELTA, 1):
            lat = lat + delta * F.sin(2 * j * chi)
        return F.struct(p["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    return [scaled, unbent, on_sphere, on_ellipsoid]


def _projected(spots: Column, epsg: Column) -> Column:
    """Positions of an array of ``struct<x,y>``, an array for each step."""
    for stage in _stages(epsg):
        spots = F.transform(spots, stage)
    return spots


def utm_point(east: Column, north: Column, epsg: Column) -> Column:
    """``struct<lon,lat>`` of a position in the zone that ``epsg`` names; NULL for other systems. Longitudes are not wrapped at ±180°."""
    spot = F.struct(east.cast("double").alias("x"), north.cast("double").alias("y"))
    return F.when(is_utm(epsg), _projected(F.array(spot), epsg)[0])


def is_utm(epsg: Column) -> Column:
    return epsg.between(NORTH + 1, NORTH + 60) | epsg.between(SOUTH + 1, SOUTH + 60)


def utm_bounds(x0: Column, y0: Column, x1: Column, y1: Column, epsg: Column, points: int = POINTS) -> Column:
    """Longitude/latitude bbox around a box in a UTM zone, over ``points`` steps along each side."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: i / points)

    def side(point_at) -> Column:
        return F.transform(steps, point_at)

    across, up = (lambda t: x0 + (x1 - x0) * t), (lambda t: y0 + (y1 - y0) * t)
    around = F.concat(
        side(lambda t: F.struct(across(t).alias("x"), y0.alias("y"))), side(lambda t: F.struct(across(t).alias("x"), y1.alias("y"))),
        side(lambda t: F.struct(x0.alias("x"), up(t).alias("y"))), side(lambda t: F.struct(x1.alias("x"), up(t).alias("y"))),
    )
    spots = _projected(around, epsg)
    # The array is made once and read for its four edges.
    box = F.transform(
        F.array(spots),
        lambda s: make_bbox(
            F.array_min(F.transform(s, lambda p: p["lon"])), F.array_min(F.transform(s, lambda p: p["lat"])),
            F.array_max(F.transform(s, lambda p: p["lon"])), F.array_max(F.transform(s, lambda p: p["lat"])),
        ),
    )[0]
    return F.when(is_utm(epsg), box)


def projected_bounds(x0: Column, y0: Column, x1: Column, y1: Column, epsg: Column) -> Column:
    """Longitude/latitude bbox of a box in degrees (4326), Web Mercator (3857) or a UTM zone; NULL for other systems."""
    return (
        F.when(epsg == 4326, make_bbox(x0, y0, x1, y1))
        .when(epsg == 3857, mercator_bounds(x0, y0, x1, y1))
        .when(is_utm(epsg), utm_bounds(x0, y0, x1, y1, epsg))
    )
