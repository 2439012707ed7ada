"""Identify: features near a position, over several layers; and the map arithmetic around it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.geometry import encode, wkb_point
from terrazzo.functions.tiles import MAX_ZOOM
from terrazzo.model import PlanError, Predicate
from terrazzo.operators import shapes
from terrazzo.operators.spatial import QueryGeometry, within_distance
from terrazzo.plans.compile import predicate
from terrazzo.plans.dataset import Dataset, quoted


def tolerance(extent: tuple[float, float, float, float], width: int, height: int, pixels: float) -> float:
    """Map units of a pixel tolerance, by the coarser axis."""
    if width <= 0 or height <= 0:
        raise PlanError("the image has no size")
    return pixels * max((extent[2] - extent[0]) / width, (extent[3] - extent[1]) / height)


def identify(layers: dict[str, tuple[Dataset, str]], query: QueryGeometry, distance: float, definitions: dict[str, Predicate] | None = None) -> DataFrame:
    """Features at most ``distance`` away, with their layer's name; layer definitions restrict first."""
    found = {}
    for name, (ds, geometry) in layers.items():
        where = (definitions or {}).get(name)
        rows = ds.df.where(predicate(ds, where)) if where is not None else ds.df
        near = within_distance(rows, geometry, query, distance)
        found[name] = near.select(ds.feature_id().alias("feature_id"), *[F.col(c) for c in ds.fields if c != geometry])
    return shapes.layers(found)


def zoom(width_metres: float, pixels: int, tile: int = 256) -> int:
    """The zoom whose resolution is nearest a view's, within the scheme."""
    if width_metres <= 0 or pixels <= 0:
        raise PlanError("the view has no size")
    world = 2 * math.pi * 6378137.0
    return max(0, min(MAX_ZOOM, round(math.log2(world / tile / (width_metres / pixels)))))


def clip(wkb: Column, env: Column, frame: bytes, bounds: tuple[float, float, float, float]) -> Column:
    """The geometry inside a frame; one that the frame holds whole is left as it is."""
    inside = (env["minx"] >= bounds[0]) & (env["miny"] >= bounds[1]) & (env["maxx"] <= bounds[2]) & (env["maxy"] <= bounds[3])
    return F.when(inside, wkb).otherwise(F.call_function("st_intersection", wkb, F.lit(frame)))


def simplified(df: DataFrame, geometry: str, bounds: tuple[float, float, float, float], pixels: int, tolerance_pixels: float = 1.0) -> DataFrame:
    """What a view shows: features whose envelope meets it, generalised to some pixels; what has nothing left is dropped."""
    env = F.col(quoted(geometry))["env"]
    near = df.where((env["minx"] <= bounds[2]) & (env["maxx"] >= bounds[0]) & (env["miny"] <= bounds[3]) & (env["maxy"] >= bounds[1]))
    shape = encode(F.call_function("st_generalize", F.col(quoted(geometry))["wkb"], F.lit(tolerance(bounds, pixels, pixels, tolerance_pixels))))
    return near.withColumn(geometry, shape).where(F.col(quoted(geometry))["env"].isNotNull())


def feature_info(layers: dict, box: tuple[float, float, float, float], width: int, height: int, i: int, j: int, pixels: float = 3, definitions: dict | None = None, most: int | None = None) -> DataFrame:
    """What a map image of ``box`` shows at pixel (i, j), counted from the top left: features within some pixels of its centre, ``most`` at most, by layer and id."""
    if not (0 <= i < width and 0 <= j < height):
        raise PlanError(f"pixel {i}, {j} is outside the image")
    x, y = box[0] + (i + 0.5) * (box[2] - box[0]) / width, box[3] - (j + 0.5) * (box[3] - box[1]) / height
    found = identify(layers, QueryGeometry(wkb_point(x, y), (x, y, x, y), 0), tolerance(box, width, height, pixels), definitions)
    if most is None:
        return found
    place = F.element_at(F.create_map(*[F.lit(v) for k, n in enumerate(layers) for v in (n, k)]), F.col("layer"))
    return found.orderBy(place, "feature_id").limit(most)
