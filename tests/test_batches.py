"""Framed batches: round trips of all kinds, columns alone, counts without decoding, damage refused."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions import geometry as geo
from terrazzo.model import PlanError
from terrazzo.sources import batches


@pytest.fixture
def rows(spark):
    made = [(k, k / 3 if k % 4 else None, f"t\tab\n{k}" if k % 5 else None, k % 2 == 0, datetime.date(2020, 1, 1 + k % 28), datetime.datetime(2021, 1, 1, 0, k % 60), decimal.Decimal(k) / 4, [k, None], bytes([k % 256])) for k in range(1300)]
    df = spark.createDataFrame(made, "id long, v double, s string, b boolean, d date, at timestamp, dec decimal(10,2), list array<int>, raw binary")
    return df.withColumn("shape", geo.point(F.col("id"), F.lit(1.0))).repartition(3)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_round_trip(spark, rows, tmp_path):
    path = f"file://{tmp_path}/f"
    batches.write(rows, path)
    assert same(batches.read(spark, path), rows) and batches.count(spark, path) == 1300 and batches.header(spark, path)["rows"] == 1300
    assert max(r["rows"] for r in batches._heads(spark, path).collect()) <= 512
    batches.verify(spark, path)
    few = batches.read(spark, path, ["s", "id"])
    assert few.columns == ["s", "id"] and same(few, rows.select("s", "id"))


def test_only_wanted_columns_are_decoded(spark, rows, tmp_path):
    """Fields that are not wanted may be anything: nobody looks at them."""
    path = tmp_path / "f"
    batches.write(rows.select("id", "s", "v"), f"file://{path}")
    for file in path.glob("part-*"):
        lines = [line.split("\t") for line in file.read_text().splitlines()]
        file.write_text("".join("\t".join([*fields[:4], "nonsense", *fields[5:]]) + "\n" for fields in lines))
        for crc in path.glob(".*.crc"):
            crc.unlink(missing_ok=True)
    assert same(batches.read(spark, f"file://{path}", ["v", "id"]), rows.select("v", "id"))
    assert batches.count(spark, f"file://{path}") == 1300
    with pytest.raises(Exception, match="cannot be read"):
        batches.read(spark, f"file://{path}").collect()


@pytest.mark.parametrize("damage", ["mark", "cut", "bit", "schema", "rows"])
def test_damage_is_refused(spark, tmp_path, damage):
    path = tmp_path / "f"
    batches.write(spark.range(600).coalesce(1).withColumn("s", F.col("id").cast("string")), f"file://{path}")
    (file,) = path.glob("part-*")
    for crc in path.glob(".*.crc"):
        crc.unlink()
    lines = file.read_text().splitlines()
    fields = lines[0].split("\t")
    if damage == "mark":
        fields[0] = "TZB9"
    elif damage == "cut":
        fields = fields[:-1]
    elif damage == "bit":
        fields[3] = fields[3][:40] + ("A" if fields[3][40] != "A" else "B") + fields[3][41:]
    elif damage == "schema":
        fields[2] = "0" * 16
    else:
        fields[1] = "17"
    file.write_text("\n".join(["\t".join(fields), *lines[1:]]) + "\n")
    with pytest.raises(Exception, match="frame"):
        batches.read(spark, f"file://{path}").collect()
    file.write_text("\n".join(lines[1:]) + "\n")
    with pytest.raises(PlanError):
        batches.verify(spark, f"file://{path}")


def test_wider_schema(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    batches.write(spark.range(5), path)
    wider = T.StructType([T.StructField("id", T.LongType()), T.StructField("more", T.StringType())])
    assert [tuple(r) for r in batches.read(spark, path, schema=wider).orderBy("id").collect()] == [(k, None) for k in range(5)]
    assert batches.read(spark, path, ["more"], wider).count() == 5
    for bad in (T.StructType([T.StructField("other", T.LongType())]), T.StructType([*wider.fields[:1], T.StructField("more", T.StringType(), False)])):
        with pytest.raises(PlanError):
            batches.read(spark, path, schema=bad)
    with pytest.raises(PlanError):
        batches.read(spark, path, ["nothing"])


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    batches.write(spark.range(0), path)
    assert batches.read(spark, path).count() == 0 == batches.count(spark, path)
    batches.verify(spark, path)
