"""Vector-tile sink: MVT 2.1 bytes of point, line and polygon features, a row a tile.

A feature goes whole into every tile that its envelope meets, and is encoded where it is read, in the JVM, as a
layer of its own.  Layers merge by renumbering their keys and values: in the tasks first, then in rounds, so what
meets in the end are a few encoded parts of a tile and never its features.  The bytes do not depend on how the rows
were dealt: features stand in the order of their geometry and properties.

A tile of ``encode`` is one value.  One of more than ``most`` features is flagged (``over``).  ``pieces`` is the way to
have the same features in layers of a bounded number, ``pieced`` in tiles of a bounded size; both merge to the tile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions import crs, tiles
from terrazzo.functions.crs import transform_geometry
from terrazzo.functions.geometry import call, register, wkb_box
from terrazzo.model import Box, FeatureQuery, Predicate
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset, quoted
from terrazzo.session import written

EXTENT = 4096
MOST_FEATURES = 5_000_000
#: Parts of a tile that are merged before the last round.
FAN = 32
#: Features of a layer that are read at once.
SLICE = 10_000
#: Bytes of a piece's features, as ``_weight`` has them.
PIECE = 4 << 20
_LAYER = 3  # the number of a tile's layers in its message
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _property(df: DataFrame, name: str) -> Column:
    """Numbers and truth values as they are, all else as text."""
    c = F.col(quoted(name))
    return (c if isinstance(df.schema[name].dataType, _PLAIN) else c.cast("string")).alias(name)


def _bounds(x: Column, y: Column, z: int) -> Column:
    """Mercator bounds of a tile, as ``tiles.tile_bounds`` has them."""
    n, span = 1 << z, 2 * math.pi * crs.RADIUS
    return F.array((x / n - 0.5) * span, (F.lit(0.5) - (y + 1) / n) * span, ((x + 1) / n - 0.5) * span, (F.lit(0.5) - y / n) * span)


def _plain(df: DataFrame, wkb_mercator: str, properties: list[str]) -> DataFrame:
    """(wkb, properties) of every feature."""
    register(df.sparkSession)
    return df.select(F.col(quoted(wkb_mercator)).alias("wkb"), F.struct(*[_property(df, p) for p in properties]).alias("properties"))


def _where(plain: DataFrame, z: int, only: DataFrame | None) -> DataFrame:
    """(wkb, properties, x, y) of every feature and every tile, of ``only`` if given, that it meets."""
    rows = plain.select("wkb", "properties", F.explode(call("st_tilesmet", F.col("wkb"), F.lit(z))).alias("tile")).select("wkb", "properties", "tile.x", "tile.y")
    return rows if only is None else rows.join(only.select("x", "y"), ["x", "y"], "left_semi")


def _one(z: int, layer: str, extent: int) -> Column:
    """A feature as a layer of its own."""
    return call("st_tilefeature", F.col("wkb"), F.col("properties"), _bounds(F.col("x"), F.col("y"), z), F.lit(layer), F.lit(extent)).alias("one")


def meeting(df: DataFrame, z: int, wkb_mercator: str, properties: list[str], layer: str = "features", extent: int = EXTENT, only: DataFrame | None = None) -> DataFrame:
    """(x, y, one, at) of every feature and every tile that it meets: a layer of its own, and the row's place.

    Of tiles ``only`` (x, y), if given: others are left out before anything is encoded.
    """
    rows = _where(_plain(df, wkb_mercator, properties), z, only)
    return rows.select("x", "y", _one(z, layer, extent), F.monotonically_increasing_id().alias("at"))


def _merged(c: str) -> Column:
    return call("st_mergelayers", F.col(c))


def message(layer: Column) -> Column:
    """A tile of one layer."""
    return F.concat(F.lit(bytes([_LAYER << 3 | 2])), _varint(F.length(layer)), layer)


def _varint(n: Column) -> Column:
    """A length as its seven-bit groups, low ones first; all but the last have the high bit set."""
    group = lambda k: F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.when(F.shiftright(n, 7 * (k + 1)) > 0, 128).otherwise(0))), 2, "0"))
    return F.concat(*[group(k) if k == 0 else F.when(F.shiftright(n, 7 * k) > 0, group(k)).otherwise(F.lit(b"")) for k in range(5)])


def merged(features: DataFrame, z: int, most: int = MOST_FEATURES) -> DataFrame:
    """(z, x, y, n, over, tile) from the features of ``meeting``."""
    part = F.pmod(F.shiftright("at", 33), F.lit(FAN)).cast("int")  # by task: what a task merges is one part
    parts = features.withColumn("part", part).groupBy("x", "y", "part").agg(F.count(F.lit(1)).alias("n"), call("st_layerparts", F.col("one")).alias("layer"))
    whole = parts.groupBy("x", "y").agg(F.sum("n").alias("n"), _merged("layer").alias("layer"))
    return whole.select(F.lit(z).alias("z"), "x", "y", "n", (F.col("n") > most).alias("over"), message(F.col("layer")).alias("tile"))


def encode(df: DataFrame, z: int, wkb_mercator: str, properties: list[str], layer: str = "features", most: int = MOST_FEATURES, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, n, over, tile) of every tile that a feature meets; ``wkb_mercator`` holds the geometry in Mercator metres."""
    return merged(meeting(df, z, wkb_mercator, properties, layer, extent), z, most)


def pieces(df: DataFrame, z: int, wkb_mercator: str, properties: list[str], layer: str = "features", most: int = MOST_FEATURES, extent: int = EXTENT) -> DataFrame:
    """(z, x, y, piece, n, layer): the features of ``encode`` in encoded layers of at most ``most`` features each, which merge to its tiles."""
    cut = F.expr(f"at div {int(most)}")  # places in a task are consecutive, and tasks far apart
    cuts = meeting(df, z, wkb_mercator, properties, layer, extent).withColumn("cut", cut).groupBy("x", "y", "cut").agg(F.count(F.lit(1)).alias("n"), _merged("one").alias("layer"))
    return cuts.select(F.lit(z).alias("z"), "x", "y", F.col("cut").alias("piece"), "n", "layer")


def met(wkb: Column, zooms: list[int]) -> Column:
    """The tiles (z, x, y) that a Mercator geometry meets."""
    at = lambda z: F.transform(call("st_tilesmet", wkb, F.lit(z)), lambda t: F.struct(F.lit(z).alias("z"), t["x"].alias("x"), t["y"].alias("y")))
    return F.flatten(F.array(*map(at, zooms)))


def _weight(plain: DataFrame) -> Column:
    """Bytes that a feature takes in a layer, about: its geometry and properties, and its share of the arrays beside them."""
    long = [F.coalesce(F.octet_length(F.col("properties")[f.name]), F.lit(0)) for f in plain.schema["properties"].dataType if isinstance(f.dataType, T.StringType)]
    return sum(long, F.length("wkb") + 16 + 8 * len(plain.schema["properties"].dataType)).cast("long")


def _number(pieces: Column) -> Column:
    """The piece of a feature by what it is, so that pieces do not depend on how rows are dealt."""
    return F.pmod(F.xxhash64("wkb", "properties"), pieces)


def dealing(df: DataFrame, zooms: list[int], wkb_mercator: str, properties: list[str], only: DataFrame | None = None) -> tuple[DataFrame | None, dict[int, int]]:
    """How tiles, of ``only`` (z, x, y) if given, are cut into pieces of about ``PIECE`` bytes.

    (z, x, y, whole, pieces, crowded) of the tiles of more than one piece, None if there are none, and the pieces that each zoom's features fill.
    ``crowded`` has the pieces that equal features swell, and in how many parts these are dealt by their places.
    """
    plain = _plain(df, wkb_mercator, properties)
    rows = plain.select("wkb", "properties", _weight(plain).alias("w"), F.inline(met(F.col("wkb"), zooms)))
    rows = rows if only is None else rows.join(only.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    at = ["z", "x", "y"]
    weights = written(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("whole"), F.sum("w").alias("w")), "tile-weights")
    filled = {r["z"]: (math.ceil(r["w"] / PIECE), r["most"]) for r in weights.groupBy("z").agg(F.sum("w").alias("w"), F.max("w").alias("most")).collect()}
    if all(most <= PIECE for _, most in filled.values()):
        return None, {z: n for z, (n, _) in filled.items()}
    large = weights.where(F.col("w") > PIECE).select(*at, "whole", F.ceil(F.col("w") / PIECE).alias("pieces"))
    fill = rows.join(F.broadcast(large), at).groupBy(*at, _number(F.col("pieces")).alias("piece")).agg(F.sum("w").alias("w"))
    swollen = fill.where(F.col("w") > 2 * PIECE).groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("piece", F.ceil(F.col("w") / PIECE)))).alias("crowded"))
    return written(large.join(swollen, at, "left"), "tile-dealing"), {z: n for z, (n, _) in filled.items()}


def pieced(df: DataFrame, z: int, wkb_mercator: str, properties: list[str], dealt: tuple[DataFrame | None, dict[int, int]], layer: str = "features", most: int = MOST_FEATURES, extent: int = EXTENT, only: DataFrame | None = None) -> DataFrame:
    """(z, x, y, piece, n, over, tile): the tiles of ``encode``, large ones in pieces as ``dealing`` has them.

    Every piece is a tile by itself; ``n`` is the number of features of all pieces, and ``whole`` merges them.  A piece's features meet in one task, and no task
    has many pieces.
    """
    rows, (large, filled) = _where(_plain(df, wkb_mercator, properties), z, only), dealt
    if large is None:
        rows = rows.withColumns({"whole": F.lit(None).cast("long"), "piece": F.lit(0).cast("long")})
    else:  # at most a row for each PIECE of all features, so broadcast
        rows = rows.join(F.broadcast(large.where(F.col("z") == z).drop("z")), ["x", "y"], "left").withColumn("piece", F.coalesce(_number(F.col("pieces")), F.lit(0)))
        parts = F.col("crowded")[F.col("piece")]
        rows = rows.withColumn("piece", F.when(parts.isNull(), F.col("piece")).otherwise(F.col("piece") + F.col("pieces") * F.pmod(F.monotonically_increasing_id(), parts)))
    ones = rows.select("x", "y", "piece", "whole", _one(z, layer, extent))
    tasks = filled.get(z, 1)
    ones = ones.repartition(tasks, "x", "y", "piece") if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ones.repartition("x", "y", "piece")
    n = F.coalesce(F.max("whole"), F.count(F.lit(1))).alias("n")
    return ones.groupBy("x", "y", "piece").agg(n, _merged("one").alias("layer")).select(F.lit(z).alias("z"), "x", "y", "piece", "n", (F.col("n") > most).alias("over"), message(F.col("layer")).alias("tile"))


def whole(cut: DataFrame) -> DataFrame:
    """(z, x, y, n, over, tile) as ``encode`` has them from the pieces of tiles; a tile is one value, made in one task."""
    parts = cut.withColumn("part", layer_of(F.col("tile")))
    merged = parts.groupBy("z", "x", "y").agg(F.max("n").alias("n"), F.max("over").alias("over"), _merged("part").alias("layer"))
    return merged.select("z", "x", "y", "n", "over", message(F.col("layer")).alias("tile"))


def features(layer: Column) -> Column:
    """The features of an encoded layer: kind, xs, ys, properties."""
    return call("st_tilefeatures", layer)


def slices(layer: Column, most: int = SLICE) -> Column:
    """An encoded layer as layers of at most ``most`` features each, in order: the way to read a large one by many tasks, a slice at a time."""
    return call("st_layerslices", layer, F.lit(most))


def layer_of(tile: Column) -> Column:
    """The one layer of a tile that ``encode`` made."""
    length = F.expr("0")
    for k in range(4, -1, -1):  # the bytes of the length before the first without its high bit
        byte = F.conv(F.hex(F.substring(tile, 2 + k, 1)), 16, 10).cast("int")
        length = F.when(byte < 128, F.lit(k + 1)).otherwise(length)
    return F.substr(tile, length + 2)


def tile(ds: Dataset, z: int, x: int, y: int, native: int, where: Predicate | None = None, properties: tuple[str, ...] | None = None, layer: str = "features") -> DataFrame:
    """One tile of a dataset whose geometry is in the system ``native``: only features whose envelope meets the tile's box there are read."""
    spark = register(ds.df.sparkSession)
    bounds = tiles.tile_bounds(z, x, y)
    box = spark.range(1).select(call("st_bounds", transform_geometry(F.lit(wkb_box(*bounds)), 3857, native))).first()[0]
    near = execute.select(ds, FeatureQuery(where=where, box=Box(*box))).df
    g = ds.geometries[0]
    names = list(properties or [c for c in ds.fields if c not in ds.geometries])
    rows = near.select(*[F.col(quoted(c)) for c in names], transform_geometry(F.col(quoted(g))["wkb"], native, 3857).alias("__wkb"))
    return encode(rows, z, "__wkb", names, layer).where((F.col("x") == x) & (F.col("y") == y))
