"""Grid shifts and the datum graph: files written here, plain interpolation, all ways by enumeration."""

import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import crs, datums, grids
from terrazzo.model import PlanError


def grid(name="ROOT", parent="NONE", south=40.0, west=-100.0, step=0.5, rows=9, columns=11, seed=1, accuracy=0.25):
    rng = np.random.default_rng(seed)
    lat, lon = (rng.uniform(-8, 8, (rows, columns)).astype(np.float32) for _ in range(2))
    return grids.Grid(name, parent, south, west, step, step, lat, lon, accuracy)


def nested():
    return [grid(), grid("FINE", "ROOT", 41.0, -98.0, 0.125, 9, 9, seed=2, accuracy=0.1)]


def plain_shift(found, x, y):
    """The position moved by the finest grid that holds it."""
    for g in sorted(found, key=lambda g: g.step_lat * g.step_lon):
        r, c = (y - g.south) / g.step_lat, (x - g.west) / g.step_lon
        if 0 <= r < g.lat.shape[0] - 1 and 0 <= c < g.lat.shape[1] - 1:
            i, j = int(r), int(c)
            mix = lambda s: sum(float(s[i + a, j + b]) * (r - i if a else 1 - r + i) * (c - j if b else 1 - c + j) for a in (0, 1) for b in (0, 1))  # noqa: B023, E731
            return x + mix(g.lon) / 3600, y + mix(g.lat) / 3600
    return None


def same(a, b):
    return [(g.name, g.parent, g.lat.tolist(), g.lon.tolist()) for g in a] == [(g.name, g.parent, g.lat.tolist(), g.lon.tolist()) for g in b] and np.allclose([g.box for g in a], [g.box for g in b])


def text_file(found, from_north=False, from_east=False):
    """The same grids with text headers, nodes in the order of the stated edges."""
    record = lambda k, v: str(k).encode().ljust(16) + str(v).encode().ljust(56)
    out = [record("NUM_OREC", 11), record("NUM_SREC", 12), record("NUM_FILE", len(found)), *[record(f"R{k}", "") for k in range(8)]]
    for g in found:
        west, south, east, north = g.box
        if from_north:
            south, north = north, south
        if from_east:
            west, east = east, west
        said = {"SUB_NAME": g.name, "PARENT": g.parent, "CREATED": "", "UPDATED": "", "S_LAT": south, "N_LAT": north, "E_LONG": east, "W_LONG": west, "LAT_INC": g.step_lat, "LONG_INC": g.step_lon, "GS_COUNT": g.lat.size, "MORE": ""}
        out += [record(k, v) for k, v in said.items()]
        nodes = np.stack([g.lat, g.lon, np.full_like(g.lat, g.accuracy), np.zeros_like(g.lat)], axis=2)[:: -1 if from_north else 1, :: -1 if from_east else 1]
        out.append(nodes.astype("<f4").tobytes())
    return b"".join([*out, record("END", "")])


def test_ntv2_round_trip():
    found = nested()
    data = grids.to_ntv2(found, "A", "B")
    assert same(grids.read_ntv2(data), found) and [g.accuracy for g in grids.read_ntv2(data)] == pytest.approx([0.25, 0.1])
    swapped = b"".join(_swapped(data))
    assert same(grids.read_ntv2(swapped), found)
    for north, east in itertools.product((False, True), repeat=2):
        assert same(grids.read_ntv2(text_file(found, north, east)), found)


def _swapped(data):
    """The same file in the other byte order."""
    words = ("GS_TYPE", "VERSION", "SYSTEM_F", "SYSTEM_T", "SUB_NAME", "PARENT", "CREATED", "UPDATED", "END")
    at = 0
    while at < len(data):
        name, value = data[at : at + 8], data[at + 8 : at + 16]
        at += 16
        key = name.decode().strip()
        if key in words:
            yield name + value
        elif key in ("NUM_OREC", "NUM_SREC", "NUM_FILE", "GS_COUNT"):
            n = struct.unpack("<i4x", value)[0]
            yield name + struct.pack(">i4x", n)
            if key == "GS_COUNT":
                yield np.frombuffer(data, "<f4", 4 * n, at).astype(">f4").tobytes()
                at += 16 * n
        else:
            yield name + value[::-1]


def test_nadcon_pair():
    g = grid(rows=5, columns=30)
    rows, columns = g.lat.shape
    head = b"NADCON EXTRACTED REGION".ljust(56) + b"NADGRD".ljust(8) + struct.pack("<3i5f", columns, rows, 1, g.west, g.step_lon, g.south, g.step_lat, 0.0)
    half = lambda s: head.ljust(4 * (columns + 1), b"\0") + np.concatenate([np.zeros((rows, 1)), s], axis=1).astype("<f4").tobytes()
    (read,) = grids.read_nadcon(half(g.lat), half(-g.lon))
    assert read.lat.tolist() == g.lat.tolist() and read.lon.tolist() == g.lon.tolist() and read.box == pytest.approx(g.box)
    other = half(g.lat)[:92] + struct.pack("<f", 1.0) + half(g.lat)[96:]
    for bad in ((half(g.lat), half(g.lon)[:-4]), (half(g.lat)[:50], half(g.lon)), (b"\xff" * 2000, half(g.lon)), (half(g.lat), struct.pack("<f", 0) * 0 + half(grid(rows=5, columns=30, west=-90.0).lon)[:76] + struct.pack("<f", -90.0) + half(g.lon)[80:])):
        with pytest.raises(PlanError):
            grids.read_nadcon(*bad)
    assert grids.read_nadcon(other, half(g.lon))


@pytest.mark.parametrize("damage", ["short", "no end", "count", "no header", "step", "nan", "files"])
def test_damaged_files_are_refused(damage):
    data = bytearray(grids.to_ntv2([grid()]))
    at = lambda name: data.index(name.ljust(8)) + 8
    if damage == "short":
        data = data[:-300]
    elif damage == "no end":
        data = data[:-16]
    elif damage == "count":
        data[at(b"GS_COUNT") : at(b"GS_COUNT") + 4] = struct.pack("<i", 7)
    elif damage == "no header":
        data = b"something else" + bytes(data)
    elif damage == "step":
        data[at(b"LAT_INC") : at(b"LAT_INC") + 8] = struct.pack("<d", 0.0)
    elif damage == "nan":
        data[at(b"GS_COUNT") + 8 : at(b"GS_COUNT") + 12] = struct.pack("<f", math.nan)
    else:
        data[at(b"NUM_FILE") : at(b"NUM_FILE") + 4] = struct.pack("<i", 2)
    with pytest.raises(PlanError):
        grids.read_ntv2(bytes(data))


def test_shift_and_inverse(spark, tmp_path):
    found = nested()
    (tmp_path / "a.gsb").write_bytes(grids.to_ntv2(found))
    operation = grids.deploy(spark, "NAD27", "NAD83", grids.read_ntv2(grids.read_file(spark, f"file://{tmp_path}/a.gsb")))
    assert operation.accuracy == pytest.approx(0.25) and operation.area == (found[0].box,)
    rng = np.random.default_rng(5)
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(-101, -94, 400), rng.uniform(39, 45, 400), strict=True)] + [(-100.0, 40.0), (-95.0, 41.0), (-98.0, 41.0), (-97.0, 42.0), (-96.0, 44.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, x double, y double").repartition(3)
    moved = F.call_function("st_gridshift", F.col("x"), F.col("y"), F.lit(operation.grid), F.lit(True))
    back = F.call_function("st_gridshift", moved[0], moved[1], F.lit(operation.grid), F.lit(False))
    rows = {r["k"]: r for r in df.select("k", moved.alias("m"), back.alias("b")).collect()}
    inside = 0
    for k, (x, y) in enumerate(points):
        want = plain_shift(found, x, y)
        assert (rows[k]["m"] is None) == (want is None)
        if want:
            inside += 1
            assert rows[k]["m"] == pytest.approx(want, abs=1e-11)
            if rows[k]["b"] and plain_shift(found, *rows[k]["b"]):  # a position near an inner edge may have two sources
                assert plain_shift(found, *rows[k]["b"]) == pytest.approx(want, abs=1e-9)
    assert 100 < inside < 400
    smooth = rows[0]
    assert smooth is not None and grids.deploy(spark, "NAD27", "NAD83", found).grid == operation.grid


def test_transform_takes_the_grid_where_it_reaches(spark):
    found = nested()
    operation = grids.deploy(spark, "NAD27", "NAD83", found, accuracy=0.15)
    inside, outside = (-97.3, 41.7), (-80.0, 30.0)
    df = spark.createDataFrame([inside, outside], "x double, y double")
    at = lambda *xy: [tuple(r) for r in df.select(*xy).collect()]
    by_grid, plain = at(*crs.transform(F.col("x"), F.col("y"), 4267, 4269, grids=[operation])), at(*crs.transform(F.col("x"), F.col("y"), 4267, 4269))
    assert by_grid[0] == pytest.approx(plain_shift(found, *inside), abs=1e-11) and by_grid[1] == pytest.approx(plain[1], abs=1e-10) and by_grid[0] != plain[0]
    best = crs.find_transformations(4267, 4269, grids=[operation])
    assert best[0]["gridded"] and best[0]["path"] == ((operation.name, True),) and not best[0]["approximate"]
    back = crs.find_transformations(4269, 4267, grids=[operation])
    assert back[0]["path"] == ((operation.name, False),)
    alone = at(*crs.transform(F.col("x"), F.col("y"), 4267, 4269, by=best[0]))
    assert alone[0] == by_grid[0] and alone[1] == (None, None)
    projected = at(*crs.transform(F.col("x"), F.col("y"), 4267, 26914, grids=[operation]))
    assert projected[0] == pytest.approx(at(*crs.transform(F.lit(by_grid[0][0]), F.lit(by_grid[0][1]), 4269, 26914))[0], abs=1e-6)
    with pytest.raises(PlanError):
        crs.transform(F.col("x"), F.col("y"), 4326, 4269, by=best[0])
    wkb = F.call_function("st_pointzm", F.col("x"), F.col("y"), F.lit(5.0), F.lit(None).cast("double"))
    moved = df.select(F.call_function("st_zs", crs.transform_geometry(wkb, 4267, 4269, grids=[operation]))[0].alias("z"), crs.transform_geometry(wkb, 4267, 4269, by=best[0]).alias("w")).collect()
    assert [r["z"] for r in moved] == [5.0, 5.0] and moved[0]["w"] is not None and moved[1]["w"] is None


def test_composition_and_inversion():
    shifts = {n: datums.affine(d.shift) for n, d in crs.DATUMS.items()}
    p = np.array([3.9e6, -1.2e5, 5.0e6])
    for a in shifts.values():
        m, t = np.array(a.m), np.array(a.t)
        both = datums.compose(a, datums.invert(a))
        assert np.allclose(np.array(both.m) @ p + both.t, p, atol=1e-6)
        for b in shifts.values():
            c = datums.compose(a, b)
            assert np.allclose(np.array(c.m) @ p + c.t, np.array(b.m) @ (m @ p + t) + b.t, atol=1e-6)
    assert datums.parameters(shifts["OSGB36"]) == pytest.approx(crs.DATUMS["OSGB36"].shift, abs=1e-5)
    assert datums.residual(shifts["NAD27"]) == pytest.approx(0, abs=1e-6) and 100 < datums.residual(shifts["OSGB36"]) < 200


def enumerated(source, target, operations):
    """Every simple way, by trying all orders of all datums in between."""
    names = [n for n in crs.DATUMS if n not in (source, target)]
    out = set()
    for size in range(len(names) + 1):
        for between in itertools.permutations(names, size):
            stops = (source, *between, target)
            choices = [[(o.name, True) for o in operations if (o.source, o.target) == leg] + [(o.name, False) for o in operations if (o.target, o.source) == leg] for leg in itertools.pairwise(stops)]
            out |= set(itertools.product(*choices))
    return out


def test_ways_are_all_ways(spark):
    deployed = [grids.deploy(spark, "NAD27", "NAD83", [grid()]), grids.deploy(spark, "OSGB36", "ETRS89", [grid(west=-5.0, south=50.0)])]
    every = [*crs.operations(), *deployed]
    for a, b in itertools.permutations(crs.DATUMS, 2):
        found = [tuple((o.name, f) for o, f in w.steps) for w in datums.ways(a, b, every)]
        assert len(found) == len(set(found)) and set(found) == enumerated(a, b, every)
    codes = {d: c for c, d in crs.GEOGRAPHIC.items()}
    for a, b in itertools.permutations(codes, 2):
        got = crs.find_transformations(codes[a], codes[b], grids=deployed)
        assert {c["path"] for c in got} <= enumerated(a, b, every) and [c["accuracy"] for c in got] == sorted(c["accuracy"] for c in got)


def test_chosen_operation_is_the_one_applied(spark):
    """The composed candidate equals the default transform; the translation differs by no more than it says."""
    codes = {d: c for c, d in crs.GEOGRAPHIC.items()}
    places = {"NAD27": (-100.0, 40.0), "OSGB36": (-2.0, 53.0)}
    for a, b in itertools.permutations(crs.DATUMS, 2):
        found = [c for c in crs.find_transformations(codes[a], codes[b]) if c["method"] == "position vector"]
        place = places.get(a) or places.get(b)
        if found and place:
            (plain, chosen) = (spark.range(1).select(*crs.transform(F.lit(place[0]), F.lit(place[1]), codes[a], codes[b], by=by)).first() for by in (None, found[0]))
            assert tuple(chosen) == pytest.approx(tuple(plain), abs=1e-10)
    reduced = next(c for c in crs.find_transformations(4277, 4326) if c["method"] == "geocentric translation")
    exact, moved = (spark.range(1).select(*crs.transform(F.lit(-2.0), F.lit(53.0), 4277, 4326, by=by)).first() for by in (None, reduced))
    assert 0 < math.hypot(moved[0] - exact[0], moved[1] - exact[1]) * 111_320 < reduced["accuracy"]


def test_areas():
    assert datums.split((170.0, -10.0, -170.0, 10.0)) == ((170.0, -10.0, 180.0, 10.0), (-180.0, -10.0, -170.0, 10.0))
    assert datums.intersect([(0, 0, 10, 10)], [(5, 5, 20, 20), (6, 6, 7, 7), (30, 0, 40, 1)]) == ((5, 5, 10, 10),)
    assert datums.covers([(160.0, -50.0, 180.0, 0.0), (-180.0, -50.0, -170.0, 0.0)], (175.0, -20.0, -175.0, -10.0)) and not datums.covers([], None)


def test_positions_on_inner_edges_go_back(spark, tmp_path):
    """All residues of the query's positions, edges and ties of rounding among them: as its SQL, and every start is an origin of its end."""
    import duckdb

    from terrazzo.plans import catalog

    duckdb.sql("SELECT range AS p_partkey FROM range(0, 120000)").write_parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["transform_grid"](spark, str(tmp_path)).toPandas().set_index("p_partkey").sort_index()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
        want = c.execute(catalog.oracle_sql()["transform_grid"]).df().set_index("p_partkey").sort_index()
    assert got.equals(want) and 10_000 < want["lon"].notna().sum() < 110_000


def test_a_position_with_two_origins(spark):
    """North of the fine grid's edge the wide one moves positions back into the fine one: both ways are known, the finest first."""
    from terrazzo.plans import catalog

    operation = grids.deploy(spark, "NAD27", "NAD83", catalog._planes())
    df = spark.createDataFrame([(-95.93, 45.0), (-96.0, 43.25), (-95.4, 45.0)], "x double, y double")
    moved = F.call_function("st_gridshift", F.col("x"), F.col("y"), F.lit(operation.grid), F.lit(True))
    rows = df.select("x", "y", F.call_function("st_gridorigins", moved[0], moved[1], F.lit(operation.grid)).alias("o"), F.call_function("st_gridshift", moved[0], moved[1], F.lit(operation.grid), F.lit(False)).alias("b")).collect()
    assert [len(r["o"]) for r in rows] == [2, 1, 1] and all(tuple(r["b"]) == tuple(r["o"][0]) for r in rows)
    assert all(min(abs(o["x"] - r["x"]) + abs(o["y"] - r["y"]) for o in r["o"]) < 1e-11 for r in rows)
