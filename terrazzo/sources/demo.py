"""Demo datasets, made by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.geometry import point, register
from terrazzo.plans.dataset import Dataset


def points(spark: SparkSession) -> Dataset:
    """110 points in 10 rows and 11 columns; value is x + y."""
    register(spark)
    k = F.col("id")
    row, column = F.floor(k / 11), k % 11
    x, y = (column - 5).cast("double"), (row - 4).cast("double")
    rows = spark.range(110).select(F.format_string("point-%03d", k).alias("name"), (x + y).alias("value"), point(x, y).alias("geometry"))
    return Dataset(rows, ids=("name",), ordinal=("name",), name="demo.points")


# The capitals of the demo set.
CITIES = (
    ("Amsterdam", 900_000, 4.9041, 52.3676),
    ("Berlin", 3_664_000, 13.4050, 52.5200),
    ("London", 8_900_000, -0.1276, 51.5072),
    ("Madrid", 3_300_000, -3.7038, 40.4168),
    ("Oslo", 700_000, 10.7522, 59.9139),
    ("Paris", 2_150_000, 2.3522, 48.8566),
    ("Rome", 2_870_000, 12.4964, 41.9028),
    ("Vienna", 1_900_000, 16.3738, 48.2082),
)


def cities(spark: SparkSession) -> Dataset:
    """Eight capitals; a city is known by its name in lower case."""
    register(spark)
    rows = spark.createDataFrame(CITIES, "name string, population long, x double, y double")
    rows = rows.select(F.lower("name").alias("id"), "name", "population", point(F.col("x"), F.col("y")).alias("geometry"))
    return Dataset(rows, ids=("id",), ordinal=("id",), name="demo.cities")


def world(spark: SparkSession, n: int = 34135) -> DataFrame:
    """A stand-in for a table of places: name, country, population, geometry, by integer arithmetic."""
    register(spark)
    k = F.col("id")
    x = (k * 7919 % 36000) / 100.0 - 180
    y = (k * 104729 % 17000) / 100.0 - 85
    population = F.floor(F.pow(F.lit(1.6), (k * 31 % 29).cast("double"))) + k % 1000
    return spark.range(n).select(
        F.concat(F.lit("place-"), k.cast("string")).alias("name"),
        F.concat(F.lit("C"), (k * 13 % 171).cast("string")).alias("country"),
        population.cast("long").alias("population"),
        point(x, y).alias("geometry"),
    )
