"""WARC archives as a Spark data source (``format("terrazzo_warc")``).

Writing: a file a task, each record a gzip member of its own whose extra field
``sl`` holds its compressed and plain length, so a reader can step over it.  The
commit writes a manifest with the files of successful tasks and with offsets
every CHUNK_BYTES; a lost task's leftovers are never read.

Reading: partitions are planned from the manifest (chunks of files) or, for
other archives, one a file (.warc or .warc.gz).  Filters on record type and
header columns are pushed down: of each record the headers are read, inflated and
parsed first; a payload is decoded only if they pass and payloads are wanted, and one that
reaches beyond the read buffer is not even read where the record states its length.

Defined results: null html is an empty payload; empty tables give an archive
without records; repeated rows give repeated records, and of equal payloads all rows with
the largest page_id are responses; a null page_id is smaller than any other, and such
rows are responses where all copies are like them; pages of any length are one record
each; only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from terrazzo.llm.storage import Segments, shared_path, written

MANIFEST = "_manifest.json"
CHUNK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
#: Payloads under this many bytes are never replaced by a revisit.
REVISIT_BYTES = 1000
#: Payloads with copies up to which all pages meet their table.
MOST_PLAIN = 100_000

SCHEMA = "record_id string, warc_type string, uri string, warc_date string, content_type string, content_length long, headers map<string,string>, payload binary"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("warc_type", pa.string()),
        ("uri", pa.string()),
        ("warc_date", pa.string()),
        ("content_type", pa.string()),
        ("content_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)
#: Columns that are headers: what filters may be pushed on.
_HEADER = {"record_id": "warc-record-id", "warc_type": "warc-type", "uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(headers: Iterable[tuple[str, str]], payload: bytes) -> bytes:
    """A record in plain form; line breaks inside header values become spaces."""
    lines = [b"WARC/1.1"] + [f"{k}: {' '.join(v.split()) if v else ''}".encode() for k, v in headers]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", payload, b"", b""])


def member(plain: bytes) -> bytes:
    """A gzip member; ``sl`` is left out where a length needs over 32 bits."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = body.compress(plain) + body.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"" if max(size, len(plain)) >= 1 << 32 else b"sl" + struct.pack("<HII", 8, size, len(plain))
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + b"\0\0\0\0\x00\xff"
    return head + (struct.pack("<H", len(extra)) + extra if extra else b"") + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class _Commit(WriterCommitMessage):
    def __init__(self, file: str, offsets: list[int], size: int):
        self.file, self.offsets, self.size = file, offsets, size


class WarcWriter(DataSourceArrowWriter):
    """Rows with uri, warc_type, headers (map) and payload become records."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        name, at, offsets = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                columns = {n: batch.column(n) for n in batch.schema.names}
                for k in range(batch.num_rows):
                    headers = [
                        ("WARC-Type", columns["warc_type"][k].as_py()),
                        ("WARC-Record-ID", columns["record_id"][k].as_py()),
                        ("WARC-Target-URI", columns["uri"][k].as_py() or ""),
                        ("WARC-Date", columns["warc_date"][k].as_py()),
                        ("Content-Type", columns["content_type"][k].as_py()),
                        *((a, b) for a, b in columns["headers"][k].as_py() if b is not None),
                    ]
                    at += out.write(member(record_bytes(headers, columns["payload"][k].as_py() or b""))) or 0
                    if at - offsets[-1] >= CHUNK_BYTES:
                        offsets.append(at)
        return _Commit(name, [x for x in offsets if x < at], at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        files = [{"file": m.file, "offsets": m.offsets, "size": m.size} for m in messages if m is not None]
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{m.file}")


class _Chunk(InputPartition):
    def __init__(self, file: str, start: int, end: int | None):
        self.file, self.start, self.end = file, start, end


class _Source:
    """Bytes of a stream with a look-ahead buffer."""

    def __init__(self, stream, left: int | None):
        self.stream, self.left, self.held = stream, left, b""

    def fill(self, n: int) -> bool:
        while len(self.held) < n:
            want = 1 << 16 if self.left is None else min(1 << 16, self.left)
            got = self.stream.read(max(want, min(n - len(self.held), self.left if self.left is not None else n))) if want else b""
            if not got:
                return False
            if self.left is not None:
                self.left -= len(got)
            self.held += got
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        """Steps over ``n`` bytes; what is not in the buffer is not read."""
        held = min(n, len(self.held))
        self.held = self.held[held:]
        n -= held
        if n > 0:
            n = n if self.left is None else min(n, self.left)
            self.stream.seek(n, 1)
            if self.left is not None:
                self.left -= n


def parse_headers(head: bytes) -> dict[str, str]:
    """Header names in lower case; folded lines are joined."""
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _plain_records(src: _Source, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while src.fill(1):
        n = 4096
        while (cut := src.held.find(b"\r\n\r\n")) < 0 and src.fill(n):
            n *= 2
        if cut < 0:
            if src.held.strip():
                raise ValueError("a WARC record ends inside its headers")
            return
        headers = parse_headers(src.take(cut + 4)[:-4])
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            yield headers, src.take(size)
        else:
            yield headers, None
            src.skip(size)
        src.skip(4)


def _members(src: _Source, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while src.fill(18):
        if src.held[:3] != b"\x1f\x8b\x08":
            raise ValueError("a gzip member is expected")
        flags, at, length = src.held[3], 10, None
        if flags & 4:
            (n,) = struct.unpack_from("<H", src.held, 10)
            src.fill(12 + n)
            if src.held[12:14] == b"sl":
                length, _ = struct.unpack_from("<II", src.held, 16)
            at = 12 + n
        for bit in (8, 16):  # a name, a comment
            if flags & bit:
                while src.held.find(b"\0", at) < 0:
                    if not src.fill(len(src.held) + 1):
                        raise ValueError("a gzip member ends inside its header")
                at = src.held.index(b"\0", at) + 1
        at += 2 * bool(flags & 2)
        yield from _sized(src, at, length, wanted) if length is not None else _unsized(src, at, wanted)


def _sized(src: _Source, at: int, length: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """A member that states its length: its head alone is read and inflated until the record is wanted."""
    d, plain, near = zlib.decompressobj(-15), b"", at
    while (cut := plain.find(b"\r\n\r\n")) < 0:
        if near >= length - 8:
            raise ValueError("a WARC record ends inside its headers")
        src.fill(min(length, near + 2048))
        upto = min(length - 8, len(src.held), near + 2048)
        if upto == near:
            raise ValueError("a gzip member is cut short")
        plain += d.decompress(src.held[near:upto])
        near = upto
    headers = parse_headers(plain[:cut])
    if not wanted(headers):
        src.skip(length)
        yield headers, None
        return
    whole = src.take(length)
    if len(whole) < length:
        raise ValueError("a gzip member is cut short")
    plain += d.decompress(whole[near:-8]) + d.flush()
    yield headers, plain[cut + 4 : cut + 4 + int(headers.get("content-length", 0))]


def _unsized(src: _Source, at: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """A member of unknown length is inflated to its end, but kept only if the record is wanted."""
    src.take(at)
    d, head, rest, headers = zlib.decompressobj(-15), b"", [], None
    keep = False
    while not d.eof:
        if not src.fill(1):
            raise ValueError("a gzip member is cut short")
        piece = d.decompress(src.held)
        src.held = d.unused_data if d.eof else b""
        if headers is None:
            head += piece
            if (cut := head.find(b"\r\n\r\n")) >= 0:
                headers = parse_headers(head[:cut])
                keep = wanted(headers)
                rest.append(head[cut + 4 :] if keep else b"")
        elif keep:
            rest.append(piece)
    src.take(8)
    if headers is None:
        raise ValueError("a WARC record ends inside its headers")
    yield headers, b"".join(rest)[: int(headers.get("content-length", 0))] if keep else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterable:
        """Takes equality, membership and prefix tests on header columns; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADER and isinstance(f, EqualTo):
                self.tests.append((_HEADER[name], "in", {f.value}))
            elif name in _HEADER and isinstance(f, In):
                self.tests.append((_HEADER[name], "in", set(f.value)))
            elif name in _HEADER and isinstance(f, StringStartsWith):
                self.tests.append((_HEADER[name], "prefix", f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = _fs(self.path)
        names = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(base, recursive=False))}
        if MANIFEST in names:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
            chunks = [_Chunk(f"{base}/{x['file']}", a, b) for x in files if x["size"] for a, b in zip(x["offsets"], [*x["offsets"][1:], x["size"]], strict=True)]
        else:
            chunks = [_Chunk(f"{base}/{n}", 0, None) for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]
        return chunks or [_Chunk("", 0, 0)]

    def passes(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = headers.get(name)
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _fs(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.file) as stream:
            stream.seek(partition.start)
            src = _Source(stream, None if partition.end is None else partition.end - partition.start)
            records = _members if partition.file.endswith(".gz") else _plain_records
            for headers, payload in records(src, lambda h: self.payloads and self.passes(h)):
                if not self.passes(headers):
                    continue
                rows.append((headers, payload))
                held += len(payload or b"") + 500
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        columns = [[h.get(_HEADER[n]) for h, _ in rows] for n in _ARROW.names[:5]]
        columns += [[int(h.get("content-length", 0)) for h, _ in rows], [list(h.items()) for h, _ in rows], [p for _, p in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """Options: path (a folder), payload (false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "terrazzo_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive; filters on type and headers reach the reader."""
    register(spark)
    return spark.read.format("terrazzo_warc").option("payload", str(payload).lower()).load(_qualified(spark, path))


def _qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme is on the file system that Spark takes for such paths, not on a worker's own."""
    if "://" in path or path.startswith("file:"):
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def records(pages: DataFrame, most_plain: int = MOST_PLAIN) -> DataFrame:
    """Records of pages (page_id, url, html): responses, and revisits of equal payloads.

    Of equal payloads of at least REVISIT_BYTES bytes the largest page_id responds.  Digests are
    summed up by payload, so a payload that a third of the pages share needs one row a task.  Only
    payloads with copies are joined back: by broadcast where Spark finds their table small, else
    pages that a bitmap tells to have none go past the join.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    shared = written(shared.where("copies > 1").select("digest", "keeper"), "warc-copies")
    if shared.count() <= most_plain:
        joined = rows.join(shared, "digest", "left")
    else:
        marked = Segments(shared, "digest").marked(rows, F.col("digest"), "maybe")
        alone = marked.where("not maybe").withColumn("keeper", F.lit(None).cast("long"))
        joined = marked.where("maybe").join(shared, "digest", "left").unionByName(alone)
    visit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    record = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        F.when(visit, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(record(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"),
        F.col("url").alias("uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.create_map(
            F.lit("X-Page-Id"),
            F.col("page_id").cast("string"),
            F.lit("WARC-Payload-Digest"),
            F.concat(F.lit("sha1:"), "digest"),
            F.lit("X-Payload-Length"),
            F.col("n").cast("string"),
            F.lit("WARC-Profile"),
            F.when(visit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit("WARC-Refers-To"),
            F.when(visit, record(F.col("keeper"))),
        ).alias("headers"),
        F.when(~visit, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str | None = None) -> str:
    """Writes an archive of pages to a folder (a new one in the shared folder if not named); returns its path."""
    spark = pages.sparkSession
    register(spark)
    path = _qualified(spark, path) if path else shared_path(spark, "warc")
    records(pages).write.format("terrazzo_warc").mode("append").option("path", path).save()
    return path
