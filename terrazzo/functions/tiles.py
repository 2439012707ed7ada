"""Web map tiles as expressions: scheme arithmetic and vector-tile quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrazzo.functions import crs
from terrazzo.model import PlanError

MAX_ZOOM = 30


def _zoom(z: int) -> int:
    if not 0 <= z <= MAX_ZOOM:
        raise PlanError(f"zoom {z} is outside 0..{MAX_ZOOM}")
    return 1 << z


def tile_of(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Column and row (top-left origin) of the tile a position falls in."""
    n = _zoom(z)
    lat = F.greatest(F.least(lat, F.lit(crs.MAX_LATITUDE)), F.lit(-crs.MAX_LATITUDE))
    x, y = crs._mercator(lon, lat)
    span = 2 * math.pi * crs.RADIUS
    clamp = lambda v: F.greatest(F.least(F.floor(v), F.lit(n - 1)), F.lit(0)).cast("int")
    return clamp((x / span + 0.5) * n), clamp((F.lit(0.5) - y / span) * n)


def tiles_of(bounds: Column, z: int) -> Column:
    """The tiles (x, y) whose closed boxes a Mercator envelope [minx, miny, maxx, maxy] meets, inside the scheme."""
    n, span = _zoom(z), 2 * math.pi * crs.RADIUS
    first = lambda v: F.greatest(F.ceil(v * n) - 1, F.lit(0)).cast("int")
    last = lambda v: F.least(F.floor(v * n), F.lit(n - 1)).cast("int")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    xs = run(first(bounds[0] / span + 0.5), last(bounds[2] / span + 0.5))
    ys = run(first(F.lit(0.5) - bounds[3] / span), last(F.lit(0.5) - bounds[1] / span))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """Mercator bounds of a tile."""
    n, span = _zoom(z), 2 * math.pi * crs.RADIUS
    if not (0 <= x < n and 0 <= y < n):
        raise PlanError(f"tile {z}/{x}/{y} is outside the scheme")
    return (x / n - 0.5) * span, (0.5 - (y + 1) / n) * span, ((x + 1) / n - 0.5) * span, (0.5 - y / n) * span


def resolution(z: int, size: int = 256) -> float:
    """Metres a pixel at the equator."""
    return 2 * math.pi * crs.RADIUS / size / _zoom(z)


def scale(z: int, size: int = 256) -> float:
    return resolution(z, size) * 96 / 0.0254


def quantized(x: Column, y: Column, bounds: tuple[float, float, float, float], extent: int = 4096) -> tuple[Column, Column]:
    """Tile coordinates, y downwards, half away from zero."""
    minx, miny, maxx, maxy = bounds
    return (
        F.round((x - minx) * (extent / (maxx - minx))).cast("int"),
        F.round((F.lit(maxy) - y) * (extent / (maxy - miny))).cast("int"),
    )
