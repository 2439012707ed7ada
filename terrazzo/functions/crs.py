"""Coordinate systems: a catalogue, datums with their shifts, and transforms.

Formulas are the published ones (spherical Mercator; transverse Mercator by the
third-order Krueger series, good to a millimetre inside a zone; ellipsoidal Mercator,
Albers, Lambert and polar stereographic in closed form or by iteration; datum shifts by
the seven-parameter position-vector method).  Web Mercator and UTM are plain column
expressions; the others run in the JVM functions of ``geometry.register``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrazzo.functions import datums
from terrazzo.functions.datums import Operation
from terrazzo.model import PlanError

# Ellipsoids (semi-major axis, inverse flattening) and the sphere of web maps.
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
CLARKE_1866 = (6378206.4, 294.978698213898)
AIRY_1830 = (6377563.396, 299.3249646)
RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798066


@dataclass(frozen=True)
class Datum:
    """``shift`` takes geocentric coordinates to WGS 84: metres, arc seconds, parts per million; ``accuracy`` in metres; ``area`` in degrees."""

    name: str
    ellipsoid: tuple[float, float]
    shift: tuple[float, ...]
    accuracy: float
    area: tuple[float, float, float, float]


_NULL = (0.0,) * 7
# Published datum operations to WGS 84 and their areas.
DATUMS = {
    d.name: d
    for d in (
        Datum("WGS 84", WGS84, _NULL, 0.0, (-180, -90, 180, 90)),
        Datum("ETRS89", GRS80, _NULL, 1.0, (-16.1, 32.88, 40.18, 84.73)),
        Datum("NAD83", GRS80, _NULL, 4.0, (-172.54, 23.81, -47.74, 86.46)),
        Datum("NAD27", CLARKE_1866, (-8.0, 160.0, 176.0, 0.0, 0.0, 0.0, 0.0), 10.0, (-124.79, 24.41, -66.91, 49.38)),
        Datum("OSGB36", AIRY_1830, (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489), 2.0, (-9.01, 49.75, 2.01, 61.01)),
        Datum("RGF93 v1", GRS80, _NULL, 1.0, (-9.86, 41.15, 10.38, 51.56)),
        Datum("NZGD2000", GRS80, _NULL, 1.0, (160.6, -55.95, -171.2, -25.88)),
    )
}
# Geographic systems; projected systems with method, central meridian, latitude of origin, scale, false easting and northing, two parallels.
GEOGRAPHIC = {4326: "WGS 84", 4258: "ETRS89", 4269: "NAD83", 4267: "NAD27", 4277: "OSGB36", 4171: "RGF93 v1", 4167: "NZGD2000"}
PROJECTED = {
    3857: ("WGS 84 / Pseudo-Mercator", "WGS 84", "web", (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)),
    3395: ("WGS 84 / World Mercator", "WGS 84", "mercator", (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)),
    5070: ("NAD83 / Conus Albers", "NAD83", "albers", (-96.0, 23.0, 1.0, 0.0, 0.0, 29.5, 45.5)),
    27700: ("OSGB36 / British National Grid", "OSGB36", "tm", (-2.0, 49.0, 0.9996012717, 400000.0, -100000.0, 0.0, 0.0)),
    2154: ("RGF93 v1 / Lambert-93", "RGF93 v1", "lambert", (3.0, 46.5, 1.0, 700000.0, 6600000.0, 49.0, 44.0)),
    2193: ("NZGD2000 / New Zealand Transverse Mercator 2000", "NZGD2000", "tm", (173.0, 0.0, 0.9996, 1600000.0, 10000000.0, 0.0, 0.0)),
    3031: ("WGS 84 / Antarctic Polar Stereographic", "WGS 84", "polar", (0.0, -90.0, 1.0, 0.0, 0.0, -71.0, 0.0)),
    3032: ("WGS 84 / Australian Antarctic Polar Stereographic", "WGS 84", "polar", (70.0, -90.0, 1.0, 6000000.0, 6000000.0, -71.0, 0.0)),
    3413: ("WGS 84 / NSIDC Sea Ice Polar Stereographic North", "WGS 84", "polar", (-45.0, 90.0, 1.0, 0.0, 0.0, 70.0, 0.0)),
    3976: ("WGS 84 / NSIDC Sea Ice Polar Stereographic South", "WGS 84", "polar", (0.0, -90.0, 1.0, 0.0, 0.0, -70.0, 0.0)),
    3995: ("WGS 84 / Arctic Polar Stereographic", "WGS 84", "polar", (0.0, 90.0, 1.0, 0.0, 0.0, 71.0, 0.0)),
    3996: ("WGS 84 / IBCAO Polar Stereographic", "WGS 84", "polar", (0.0, 90.0, 1.0, 0.0, 0.0, 75.0, 0.0)),
}
#: UTM families: first code less one, zones, datum, southern.
UTM = ((32600, range(1, 61), "WGS 84", False), (32700, range(1, 61), "WGS 84", True), (25800, range(28, 39), "ETRS89", False), (26900, range(1, 24), "NAD83", False))
# Codes that other catalogues use for a system of this one.
ALIASES = {102100: 3857, 102113: 3857, 900913: 3857}


@dataclass(frozen=True)
class Crs:
    code: int
    name: str
    kind: str
    datum: Datum
    unit: str
    method: str
    parameters: tuple[float, ...] = (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    zone: int | None = None
    south: bool = False

    @property
    def ellipsoid(self) -> tuple[float, float]:
        return self.datum.ellipsoid

    @property
    def axes(self) -> tuple[tuple[str, str, str], ...]:
        """(name, orientation, unit) in the order of x and y."""
        names = ("Longitude", "Latitude") if self.kind == "geographic" else ("Easting", "Northing")
        return (names[0], "east", self.unit), (names[1], "north", self.unit)


def describe(code: int) -> Crs:
    """A catalogue entry: geographic and projected systems, and the UTM families by rule."""
    code = ALIASES.get(code, code)
    if code in GEOGRAPHIC:
        return Crs(code, GEOGRAPHIC[code], "geographic", DATUMS[GEOGRAPHIC[code]], "degree", "geographic")
    if code in PROJECTED:
        name, datum, method, parameters = PROJECTED[code]
        return Crs(code, name, "projected", DATUMS[datum], "metre", method, parameters)
    for first, zones, base, south in UTM:
        zone = code - first
        if zone in zones:
            parameters = (zone * 6 - 183.0, 0.0, 0.9996, 500000.0, 10000000.0 if south else 0.0, 0.0, 0.0)
            return Crs(code, f"{base} / UTM zone {zone}{'S' if south else 'N'}", "projected", DATUMS[base], "metre", "tm", parameters, zone, south)
    raise PlanError(f"unknown coordinate system {code}")


def catalogue() -> list[Crs]:
    """Every system, geographic ones first, by code."""
    codes = [*sorted(GEOGRAPHIC), *sorted([*PROJECTED, *(first + z for first, zones, _, _ in UTM for z in zones)])]
    return [describe(c) for c in codes]


def _mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def _unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2)


def _series(ellipsoid: tuple[float, float]):
    f = 1 / ellipsoid[1]
    n = f / (2 - f)
    a = ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    return n, a, alpha, beta, delta


def _utm(crs: Crs, lon: Column, lat: Column) -> tuple[Column, Column]:
    n, a, alpha, _, _ = _series(crs.ellipsoid)
    p, dl = F.radians(lat), F.radians(lon - (crs.zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(p)) - F.atanh(F.sin(p) * c) * c)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for k, x in enumerate(alpha, 1):
        east = east + F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * x
        north = north + F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * x
    return east * (0.9996 * a) + 500000.0, north * (0.9996 * a) + (10000000.0 if crs.south else 0.0)


def _unutm(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    _, a, _, beta, delta = _series(crs.ellipsoid)
    xi0, eta0 = (y - (10000000.0 if crs.south else 0.0)) / (0.9996 * a), (x - 500000.0) / (0.9996 * a)
    xi, eta = xi0, eta0
    for k, b in enumerate(beta, 1):
        xi = xi - F.sin(xi0 * 2 * k) * F.cosh(eta0 * 2 * k) * b
        eta = eta - F.cos(xi0 * 2 * k) * F.sinh(eta0 * 2 * k) * b
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + F.sin(chi * 2 * k) * d
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + float(crs.zone * 6 - 183), F.degrees(lat)


def _plain(c: Crs) -> bool:
    """Whether the system's formulas are column expressions."""
    return c.kind == "geographic" or c.method == "web" or c.zone is not None


def transform(x: Column, y: Column, source: int, target: int, grids: Iterable[Operation] = (), by: dict | None = None) -> tuple[Column, Column]:
    """x and y in the target system; through longitude and latitude, and between datums by the best operation.

    Deployed ``grids`` count where they reach a position, the composed shift elsewhere; ``by``, a candidate of
    ``find_transformations``, is applied alone, and positions that it does not reach become null.
    """
    a, b = describe(source), describe(target)
    if a.code == b.code:
        return x, y
    if route := _route(a, b, grids, by):
        moved = F.call_function("st_movedby", x.cast("double"), y.cast("double"), F.lit(_frame(a)), F.lit(_frame(b)), F.lit(route))
        return moved[0], moved[1]
    if not (_plain(a) and _plain(b) and a.datum.shift == b.datum.shift):
        moved = F.call_function("st_moved", x.cast("double"), y.cast("double"), F.lit(_frame(a)), F.lit(_frame(b)))
        return moved[0], moved[1]
    if a.kind == "projected":
        x, y = _unutm(a, x, y) if a.zone else _unmercator(x, y)
    if b.kind == "projected":
        x, y = _utm(b, x, y) if b.zone else _mercator(x, y)
    return x, y


def _route(a: Crs, b: Crs, grids: Iterable[Operation], by: dict | None) -> str | None:
    """The ways to try, for the JVM; none where the systems' own shifts do."""
    if by is not None:
        if (by["source"], by["target"]) != (a.datum.name, b.datum.name):
            raise PlanError(f"{by['name']} does not lead from {a.datum.name} to {b.datum.name}")
        return by["route"]
    grids = tuple(grids)
    exact = [c for c in _candidates(a.datum, b.datum, grids) if not c["approximate"]] if grids else []
    return "|".join(c["route"] for c in exact) if any(c["gridded"] for c in exact) else None


def _frame(c: Crs) -> str:
    return ",".join([c.method, *(repr(float(v)) for v in (*c.ellipsoid, *c.parameters, *c.datum.shift))])


def transform_geometry(wkb: Column, source: int, target: int, grids: Iterable[Operation] = (), by: dict | None = None) -> Column:
    """A whole geometry in the target system, z and m as they are; the stated source must be its own."""
    a, b = describe(source), describe(target)
    if a.code == b.code:
        return wkb
    if route := _route(a, b, grids, by):
        return F.call_function("st_reprojectby", wkb, F.lit(_frame(a)), F.lit(_frame(b)), F.lit(route))
    return F.call_function("st_reproject", wkb, F.lit(_frame(a)), F.lit(_frame(b)))


# --- operations between datums -----------------------------------------------------------------


def operations() -> list[Operation]:
    """The published shifts, each from its datum to WGS 84."""
    return [Operation(f"{d.name} to WGS 84", d.name, "WGS 84", d.accuracy, datums.split(d.area), datums.affine(d.shift)) for d in DATUMS.values() if d.name != "WGS 84"]


def _spelled(steps: list[tuple[datums.Affine | str, str, str]]) -> str:
    """A way for the JVM: grids by name and direction, maps between the ellipsoids of their datums."""
    out = []
    for step, source, target in steps:
        if isinstance(step, str):
            out.append(f"grid,{step}")
        elif not step.null:
            numbers = (*DATUMS[source].ellipsoid, *DATUMS[target].ellipsoid, *[v for row in step.m for v in row], *step.t)
            out.append(",".join(["affine", *(repr(float(v)) for v in numbers)]))
    return ">".join(out)


def _candidates(a: Datum, b: Datum, grids: Iterable[Operation]) -> list[dict]:
    """What can take one datum to the other, in the order of preference."""
    found = []
    for way in datums.ways(a.name, b.name, [*grids, *operations()]):
        legs = [((o.grid + (",+" if forward else ",-")) if o.grid else (o.map if forward else datums.invert(o.map)), p, q) for (o, forward), p, q in zip(way.steps, way.datums, way.datums[1:], strict=False)]
        real = [leg for leg in legs if isinstance(leg[0], str) or not leg[0].null]
        base = {"source": a.name, "target": b.name, "area": way.area, "path": tuple((o.name, forward) for o, forward in way.steps), "gridded": way.gridded}
        name, accuracy = f"{a.name} to {b.name}", way.accuracy
        if way.gridded:
            through = "".join(f" by {o.name}" for o, _ in way.steps if o.grid)
            found.append({**base, "name": name + through, "method": "grid" if len(real) == 1 else "grid, concatenated", "accuracy": accuracy, "steps": len(way.steps), "approximate": False, "route": _spelled(legs), "parameters": None})
            continue
        whole = way.map
        if whole.null:
            if accuracy:
                found.append({**base, "name": name, "method": "null operation", "accuracy": accuracy, "steps": 1, "approximate": False, "route": "", "parameters": datums.parameters(whole)})
            continue
        moved = datums.Affine(((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), whole.t)
        for extra, method, cost, steps, approximate, route, said in (
            ("", "position vector", 0.0, 1, False, [(whole, a.name, b.name)], whole),
            (" by WGS 84", "position vector, concatenated", 0.0, len(real), True, legs, whole),
            (", translation", "geocentric translation", datums.residual(whole), 1, True, [(moved, a.name, b.name)], moved),
        ):
            area = tuple(x for o, _ in way.steps for x in o.area) if steps > 1 else way.area  # a chain is good wherever one of its links is
            found.append({**base, "area": area, "name": name + extra, "method": method, "accuracy": accuracy + cost, "steps": steps, "approximate": approximate, "route": _spelled(route), "parameters": datums.parameters(said)})
    return sorted(found, key=lambda c: (c["accuracy"], not c["gridded"]))


def find_transformations(source: int, target: int, area: datums.Box | None = None, grids: Iterable[Operation] = ()) -> list[dict]:
    """Candidate datum operations between two catalogued systems, most accurate first; none within one datum.

    Every way over the published shifts and the deployed ``grids`` is one, where its operations share an area, and that holds ``area``
    (degrees).  Ways of shifts alone are also offered as one composed shift, which is what ``transform`` applies, and reduced to its
    translation; datums that coincide have the registered null operation.  ``path`` names the operations in order, each with
    its direction; ``parameters`` are the seven of a shift.
    """
    a, b = describe(source).datum, describe(target).datum
    return [] if a is b else [c for c in _candidates(a, b, grids) if datums.covers(c["area"], area)]
