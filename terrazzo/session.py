"""Session helpers: the package on the executors, bounded batches, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "terrazzo.shipped"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Puts this package on the executors' path, once a context, through Spark's own file server.

    Rows go to Python workers in batches of BATCH, unless the session says otherwise: what a worker holds, and the JVM beside it.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64MB"):  # Spark's default
        spark.conf.set(_BATCH, BATCH)
    if getattr(context, _SHIPPED, None):
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="terrazzo-code-"), "terrazzo_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in root.rglob("*"):
            if file.suffix in {".py", ".json"}:
                z.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, as in tests, one of our own, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="terrazzo-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, whatever reads it.

    It lies there as long as a result may be read from it; ``drop`` takes away those of rounds that have ended.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, after its last reader has ended."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there with its whole text or not at all."""
    jvm = spark._jvm
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not files.rename(draft, at):
        raise OSError(f"cannot make {path}")


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text; also one that Spark's readers leave out for its name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
