"""Features as framed batches: a line a frame, a column a field, so that a reader decodes only what it wants.

A folder holds lines of text, which Spark writes, splits and reads wherever its files are.  A frame is a mark with the
format's version, the number of its rows, the digest of its schema, and for every column a checksum and the column's
values (Arrow's own form, compressed).  The schema stands once in a header beside the frames, with the numbers of frames and rows.
Lines are cut into fields in the JVM: columns that are not wanted never reach a decoder, and rows are counted from the
frames' heads alone.  A frame whose mark, length, schema or checksum is not right is refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.model import PlanError
from terrazzo.plans.dataset import quoted
from terrazzo.session import get_text, put_text

#: Fixed value: what a frame begins with, the version of the format last.
MARK = "TZB1"
#: Rows of a frame, as a page of features has them.
ROWS = 512
_HEADER = "_header.json"


def _digest(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()[:16]


def _said(column: pa.Array) -> str:
    """A column's checksum and values."""
    plain = pa.RecordBatch.from_arrays([column], names=["c"]).serialize()
    data = pa.Codec("zstd").compress(plain, asbytes=True)
    return f"{zlib.crc32(data):08x}:{plain.size}:{base64.b64encode(data).decode()}"


def _column(said: str, kind: pa.DataType) -> pa.Array:
    try:
        crc, size, text = said.split(":")
        data = base64.b64decode(text, validate=True)
        if zlib.crc32(data) != int(crc, 16):
            raise ValueError("its checksum is wrong")
        schema = pa.schema([("c", kind)])
        return pa.ipc.read_record_batch(pa.py_buffer(pa.Codec("zstd").decompress(data, decompressed_size=int(size), asbytes=True)), schema).column(0)
    except (ValueError, pa.ArrowException) as e:
        raise ValueError(f"a frame's column cannot be read: {e}") from e


def write(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """``df`` as frames of at most ``rows`` rows, in a new folder."""
    spark, path, digest = df.sparkSession, path.rstrip("/"), _digest(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                line = "\t".join([MARK, str(part.num_rows), digest, *map(_said, part.columns)])
                yield pa.RecordBatch.from_arrays([pa.array([line])], names=["value"])

    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names may differ in case alone
    plain.mapInArrow(run, "value string").write.text(path)
    heads = _heads(spark, path).agg(F.count("*").alias("frames"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    put_text(spark, f"{path}/{_HEADER}", json.dumps({"schema": df.schema.jsonValue(), "frames": heads["frames"], "rows": heads["rows"]}))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("fields"))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows of every frame, from its first fields."""
    head = F.split(F.substring_index(F.col("value"), "\t", 3), "\t")
    right = (F.get(head, F.lit(0)) == MARK) & F.get(head, F.lit(1)).rlike("^[0-9]+$")
    return spark.read.text(path).select(F.when(right, F.get(head, F.lit(1)).cast("long")).otherwise(F.raise_error(F.lit("a line is no frame")).cast("long")).alias("rows"))


def header(spark: SparkSession, path: str) -> dict:
    """schema, frames and rows of a folder of frames."""
    held = json.loads(get_text(spark, f"{path.rstrip('/')}/{_HEADER}"))
    return {**held, "schema": T.StructType.fromJson(held["schema"])}


def count(spark: SparkSession, path: str) -> int:
    """The rows of all frames, without decoding one."""
    return _heads(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def verify(spark: SparkSession, path: str) -> None:
    """Refuses a folder that lacks frames which its header counts, or holds others."""
    held = header(spark, path)
    found = _heads(spark, path).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if tuple(found) != (held["frames"], held["rows"]):
        raise PlanError(f"{path} holds {found[0]} frames of {found[1]} rows, its header says {held['frames']} of {held['rows']}")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a folder of frames; ``columns`` alone where they are named.

    ``schema`` is a wider one that the rows are wanted in: it begins with the frames' own columns, and those that they lack are null.
    """
    own = header(spark, path)["schema"]
    wanted = schema or own
    if [(f.name, f.dataType) for f in wanted.fields[: len(own)]] != [(f.name, f.dataType) for f in own.fields] or any(not f.nullable for f in wanted.fields[len(own) :]):
        raise PlanError("the schema does not begin with the frames' own, or what it adds may not be null")
    names = [f.name for f in wanted.fields]
    if unknown := [c for c in columns or () if c not in names]:
        raise PlanError(f"there is no column {unknown[0]!r}")
    held = [k for k, f in enumerate(own.fields) if columns is None or f.name in columns]
    kept = T.StructType([T.StructField(f"c{k}", own.fields[k].dataType) for k in held])
    width, digest = 3 + len(own), _digest(own)
    fields = F.col("fields")
    right = (F.size(fields) == width) & (F.get(fields, F.lit(0)) == MARK) & (F.get(fields, F.lit(2)) == digest)
    checked = _lines(spark, path).where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("a line is no frame of this schema")).cast("boolean")))
    frames = checked.select(F.get(fields, F.lit(1)).cast("int").alias("rows"), *[F.get(fields, F.lit(3 + k)).alias(f"c{k}") for k in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(kept)
        for batch in batches:
            for r in batch.to_pylist():
                arrays = [_column(r[f.name], f.type) for f in kinds]
                if any(len(a) != r["rows"] for a in arrays):
                    raise ValueError("a frame's columns and rows are not as many")
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds) if arrays else pa.RecordBatch.from_arrays([pa.nulls(r["rows"])], names=["none"])

    if held:
        decoded = frames.mapInArrow(run, kept)
    else:
        decoded = frames.select(F.explode(F.sequence(F.lit(1), F.col("rows"))))  # only columns that the frames lack: as many rows
    said = {own.fields[k].name: F.col(f"c{k}") for k in held}
    out = [f for f in wanted.fields if columns is None or f.name in columns]
    return decoded.select(*[said.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in out]).select(*[F.col(quoted(c)) for c in (columns or names)])
