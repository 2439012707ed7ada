"""Rasters as long tables (raster_id, band, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.geometry import wkb_point
from terrazzo.operators import served, shapes, spatial
from terrazzo.plans.dataset import Dataset

BINS = 256


def band_statistics(cells: DataFrame) -> DataFrame:
    """min, max, mean and (sample) deviation of every band."""
    v = F.col("value").cast("double")
    return cells.groupBy("raster_id", "band").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"))


def histogram(cells: DataFrame, eight_bit: bool = False, bins: int = BINS) -> DataFrame:
    """(raster_id, band, bin, n): 8-bit bands by edges -0.5 to 255.5, others over their own range; a flat band falls in the middle bin."""
    v = F.col("value").cast("double")
    rows = cells.where(F.col("value").isNotNull())
    if eight_bit:
        at = F.floor(v + 0.5)
        rows = rows.withColumn("bin", F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int"))
    else:
        ends = rows.groupBy("raster_id", "band").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        rows = rows.join(ends, ["raster_id", "band"])
        at = F.floor(F.try_divide((v - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
        rows = rows.withColumn("bin", F.when(F.col("_lo") == F.col("_hi"), bins // 2).otherwise(F.least(at, F.lit(bins - 1))).cast("int"))
    return rows.groupBy("raster_id", "band", "bin").agg(F.count("*").alias("n"))


def identify(cells: DataFrame, raster_id, row: int, col: int) -> DataFrame:
    """Every band's value at a cell."""
    return cells.where((F.col("raster_id") == raster_id) & (F.col("row") == row) & (F.col("col") == col)).select("raster_id", "band", "value")


def pixel(x: Column, y: Column, minx: Column, maxy: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(row, col) of a position in a raster whose upper left corner and pixel size are known; rows run downwards."""
    return F.floor((maxy - y) / height).cast("long"), F.floor((x - minx) / width).cast("long")


def identify_at(cells: DataFrame, rasters: DataFrame, x: float, y: float, items: Dataset | None = None) -> DataFrame:
    """Every band's value at a location, of every raster that covers it; and, with ``items``, the catalogue items whose footprint meets it.

    ``rasters`` is (raster_id, minx, maxy, pixel_width, pixel_height, rows, cols).  The result is (raster_id, band, value, row, col), and where items are
    asked for a list of their ids, the same in every row.
    """
    row, col = pixel(F.lit(float(x)), F.lit(float(y)), F.col("minx"), F.col("maxy"), F.col("pixel_width"), F.col("pixel_height"))
    at = rasters.select("raster_id", row.alias("row"), col.alias("col"), "rows", "cols").where("row >= 0 and col >= 0 and row < rows and col < cols").drop("rows", "cols")
    found = cells.join(at, ["raster_id", "row", "col"]).select("raster_id", "band", "value", "row", "col")
    if items is None:
        return found
    query = spatial.QueryGeometry(wkb_point(float(x), float(y)), (float(x), float(y), float(x), float(y)), 0)
    near = items.with_df(spatial.filter_by(items.df, items.geometries[0], query, "intersects"))
    named = near.df.agg(F.array_sort(F.collect_list(near.feature_id())).alias("items"))
    return found.crossJoin(F.broadcast(named))  # one row


def catalog_query(items: Dataset, params: dict[str, str], native: int = 4326) -> DataFrame:
    """The catalogue's items by the same requests as any layer: where, geometry, time, order, page, statistics."""
    return served.serve(items, params, native)


def find(items: Dataset, text: str, fields: tuple[str, ...] | None = None, contains: bool = True) -> DataFrame:
    """Items with a literal text in a string field."""
    return shapes.find_text(items, text, fields, contains)


def classified(cells: DataFrame, attributes: DataFrame) -> DataFrame:
    """Cells with their category from an attribute table (value, category); unknown values stay, without one."""
    return cells.join(attributes, "value", "left")
