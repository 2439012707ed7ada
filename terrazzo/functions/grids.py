"""Datum shifts tabulated on grids: readers of the two published file formats, and their way to the executors.

A reader accounts for every byte that it uses and refuses what it cannot: a shift that is half read would move
every position of the gap by some other datum's error.  Both readers yield the same ``Grid``: rows from the south,
columns from the west, shifts in seconds of arc, north and east positive.

``deploy`` sends the grids of an operation through Spark's own file server, so an executor reads them once; of
nested grids the finest one that holds a position counts (``st_gridshift``, and routes of ``crs.transform``).
Shifts jump at the edges of nested grids, so some positions beside them have two origins or none: the way back
takes the finest grid's, ``st_gridorigins`` has them all.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
import tempfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from terrazzo.functions.datums import Operation
from terrazzo.model import PlanError

#: Bytes of a grid file at most; every executor holds it.
MOST_BYTES = 512 << 20
#: The record names of an NTv2 sub-grid header, and seconds in the units that a file may state.
_EDGES = ("S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC")
_SECONDS = {"SECONDS": 1.0, "MINUTES": 60.0, "DEGREES": 3600.0}
#: Bytes of an NTv2 record's name and value: binary values, or all text.
_BINARY, _TEXT = (8, 8), (16, 56)


@dataclass(frozen=True, eq=False)
class Grid:
    """``lat`` and ``lon`` are (rows, columns) of shifts in seconds; edges and steps in degrees; ``accuracy`` in metres, 0 where the file states none."""

    name: str
    parent: str
    south: float
    west: float
    step_lat: float
    step_lon: float
    lat: np.ndarray
    lon: np.ndarray
    accuracy: float = 0.0

    @property
    def box(self) -> tuple[float, float, float, float]:
        rows, columns = self.lat.shape
        return self.west, self.south, self.west + (columns - 1) * self.step_lon, self.south + (rows - 1) * self.step_lat


def _count(low: float, high: float, step: float, name: str) -> int:
    """Nodes from edge to edge."""
    if not (step > 0 and high > low and math.isfinite(high - low)):
        raise PlanError(f"grid {name}: its edges and steps describe no nodes")
    steps = (high - low) / step
    if abs(steps - round(steps)) > 1e-3:
        raise PlanError(f"grid {name}: its steps do not divide its edges")
    return round(steps) + 1


class _Records:
    """The records of an NTv2 file, in either form and byte order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        if data[:8] != b"NUM_OREC":
            raise PlanError("not a grid file: no NUM_OREC at its begin")
        self.order = next((o for o in "<>" if len(data) >= 12 and 11 <= struct.unpack_from(f"{o}i", data, 8)[0] <= 64), None)
        self.text = self.order is None
        self.size = _TEXT if self.text else _BINARY
        self.order = self.order or "<"

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise PlanError("the grid file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def record(self) -> tuple[str, bytes]:
        name, value = self.take(self.size[0]), self.take(self.size[1])
        return name.decode("latin-1").strip(" \0"), value

    def words(self, value: bytes) -> str:
        return value.decode("latin-1").strip(" \0")

    def number(self, header: dict, key: str, kind: str) -> float:
        if key not in header:
            raise PlanError(f"the grid file has no {key}")
        if not self.text:
            return struct.unpack_from(self.order + kind, header[key])[0]
        try:
            return float(self.words(header[key]))
        except ValueError:
            raise PlanError(f"the grid file's {key} is no number") from None


def read_ntv2(data: bytes) -> list[Grid]:
    """The sub-grids of an NTv2 file, in its order.

    Binary headers state longitudes and their shifts positive west, in the unit of GS_TYPE, and list nodes from the south-east;
    text headers state them positive east, in degrees with shifts in seconds, and list nodes from their first edges.
    """
    r = _Records(data)
    overview = dict(r.record() for _ in range(11))
    for _ in range(int(r.number(overview, "NUM_OREC", "i")) - 11):
        r.record()
    size, files = int(r.number(overview, "NUM_SREC", "i")), int(r.number(overview, "NUM_FILE", "i"))
    if size < 11 or files < 1:
        raise PlanError("the grid file's counts make no sense")
    unit = _SECONDS.get(r.words(overview.get("GS_TYPE", b"")).upper(), 1.0) if not r.text else 1.0
    out = []
    while True:
        begun = r.at
        name, _ = r.record() if not r.data[r.at : r.at + 3] == b"END" else ("END", b"")
        if name == "END":
            break
        r.at = begun
        out.append(_sub_grid(r, dict(r.record() for _ in range(size)), unit))
    if len(out) != files:
        raise PlanError(f"the grid file states {files} grids and holds {len(out)}")
    return out


def _sub_grid(r: _Records, header: dict, unit: float) -> Grid:
    name = r.words(header.get("SUB_NAME", b"")) or "?"
    south, north, east, west, step_lat, step_lon = (r.number(header, k, "d") for k in _EDGES)
    if not r.text:
        south, north, east, west, step_lat, step_lon = (v * unit / 3600 for v in (south, north, -east, -west, step_lat, step_lon))
    from_north, from_east = north < south, east < west
    south, north, west, east = min(south, north), max(south, north), min(west, east), max(west, east)
    rows, columns = _count(south, north, abs(step_lat), name), _count(west, east, abs(step_lon), name)
    if rows * columns != int(r.number(header, "GS_COUNT", "i")):
        raise PlanError(f"grid {name}: its edges describe {rows * columns} nodes, GS_COUNT states otherwise")
    nodes = np.frombuffer(r.take(16 * rows * columns), dtype=f"{r.order}f4").reshape(rows, columns, 4).astype(np.float32)
    if not r.text:
        from_east = not from_east  # nodes run from the eastern edge, whose longitude is the smaller one counted westwards
    nodes = nodes[:: -1 if from_north else 1, :: -1 if from_east else 1]
    if not np.isfinite(nodes[:, :, :2]).all():
        raise PlanError(f"grid {name}: a shift is no number")
    sign = np.float32(unit)
    return Grid(name, r.words(header.get("PARENT", b"")), south, west, abs(step_lat), abs(step_lon), nodes[:, :, 0] * sign, nodes[:, :, 1] * (sign if r.text else -sign), max(0.0, float(nodes[:, :, 2:].max())))


def _nadcon_half(data: bytes) -> tuple[str, tuple, np.ndarray]:
    if len(data) < 96:
        raise PlanError("the grid file ends too early")
    order = next((o for o in "<>" if 0 < struct.unpack_from(f"{o}i", data, 64)[0] < 1 << 16 and 0 < struct.unpack_from(f"{o}i", data, 68)[0] < 1 << 16), None)
    if order is None:
        raise PlanError("not a grid file: its counts make no sense")
    columns, rows, _ = struct.unpack_from(f"{order}3i", data, 64)
    west, step_lon, south, step_lat, _ = struct.unpack_from(f"{order}5f", data, 76)
    size = 4 * (columns + 1)  # a record: four bytes of its own, then a row of nodes; the header takes the first record
    if size < 96:
        raise PlanError("not a grid file: its header is longer than its records")
    if len(data) != size * (rows + 1):
        raise PlanError("the grid file's length is not that of its rows")
    nodes = np.frombuffer(data, dtype=f"{order}f4").reshape(rows + 1, columns + 1)[1:, 1:].astype(np.float32)
    return data[:56].decode("latin-1").strip(" \0"), (south, west, step_lat, step_lon), nodes


def read_nadcon(las: bytes, los: bytes, accuracy: float = 0.15) -> list[Grid]:
    """One grid from the pair of NADCON files: latitude shifts, and longitude shifts, which the format counts positive west."""
    name, edges, lat = _nadcon_half(las)
    _, other, lon = _nadcon_half(los)
    if edges != other or lat.shape != lon.shape:
        raise PlanError("the two grid files describe different nodes")
    if min(lat.shape) < 2 or not (edges[2] > 0 and edges[3] > 0) or not (np.isfinite(lat).all() and np.isfinite(lon).all()):
        raise PlanError(f"grid {name}: its edges and steps describe no nodes")
    return [Grid(name, "NONE", *map(float, edges), lat, -lon, accuracy)]


def packed(grids: list[Grid]) -> bytes:
    """The grids as the JVM reads them."""
    out = [struct.pack(">i", len(grids))]
    for g in grids:
        out += [struct.pack(">4d2i", g.south, g.west, g.step_lat, g.step_lon, *g.lat.shape), g.lat.astype(">f4").tobytes(), g.lon.astype(">f4").tobytes()]
    return b"".join(out)


def to_ntv2(grids: list[Grid], system_from: str = "", system_to: str = "") -> bytes:
    """The grids as an NTv2 file with binary headers, in seconds."""
    word = lambda v: v.encode("latin-1")[:8].ljust(8)
    number = lambda v: struct.pack("<i4x", v) if isinstance(v, int) else struct.pack("<d", v)
    record = lambda name, v: word(name) + (word(v) if isinstance(v, str) else number(v))
    head = (("NUM_OREC", 11), ("NUM_SREC", 11), ("NUM_FILE", len(grids)), ("GS_TYPE", "SECONDS"), ("VERSION", ""), ("SYSTEM_F", system_from), ("SYSTEM_T", system_to), ("MAJOR_F", 0.0), ("MINOR_F", 0.0), ("MAJOR_T", 0.0), ("MINOR_T", 0.0))
    out = [record(*r) for r in head]
    for g in grids:
        west, south, east, north = (v * 3600 for v in g.box)
        out += [record("SUB_NAME", g.name), record("PARENT", g.parent or "NONE"), record("CREATED", ""), record("UPDATED", "")]
        out += [record(k, float(v)) for k, v in zip(_EDGES, (south, north, -east, -west, g.step_lat * 3600, g.step_lon * 3600), strict=True)]
        nodes = np.zeros((*g.lat.shape, 4), dtype="<f4")
        nodes[:, :, 0], nodes[:, :, 1], nodes[:, :, 2:] = g.lat, -g.lon, g.accuracy
        out += [record("GS_COUNT", g.lat.size), nodes[:, ::-1].tobytes()]
    return b"".join([*out, record("END", "")])


def read_file(spark: SparkSession, path: str) -> bytes:
    """A file's bytes, through Spark's own readers; a larger one than MOST_BYTES is refused."""
    found = spark.read.format("binaryFile").load(path).select("length").collect()
    if len(found) != 1:
        raise PlanError(f"{path} names {len(found)} files")
    if found[0]["length"] > MOST_BYTES:
        raise PlanError(f"{path} is larger than {MOST_BYTES} bytes")
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def deploy(spark: SparkSession, source: str, target: str, grids: list[Grid], name: str | None = None, accuracy: float | None = None) -> Operation:
    """Sends the grids to the executors, and returns the operation between the two datums that they stand for."""
    if not grids:
        raise PlanError("an operation needs a grid")
    data = packed(grids)
    if len(data) > MOST_BYTES:
        raise PlanError(f"grids of more than {MOST_BYTES} bytes")
    file = f"grid-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sent = spark.sparkContext.__dict__.setdefault("_terrazzo_grids", set())
    if file not in sent:
        path = os.path.join(tempfile.mkdtemp(prefix="terrazzo-grid-"), file)
        with open(path, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        sent.add(file)
    roots = [g for g in grids if g.parent.upper() in ("", "NONE")] or grids
    stated = max(g.accuracy for g in grids) if accuracy is None else accuracy
    return Operation(name or f"{source} to {target} by {roots[0].name}", source, target, stated, tuple(g.box for g in roots), grid=file)
