"""Datums as a graph: operations between them, the ways from one to another, and what each way is worth.

An operation is an affine map of geocentric space (from seven published parameters, by the position-vector
method) or a deployed grid; either is used in both directions.  A way is a sequence of operations that visits no
datum twice; its area of use is the intersection of theirs, its accuracy their root of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

Box = tuple[float, float, float, float]
_ARC = math.pi / 648000


@dataclass(frozen=True)
class Affine:
    """x -> m x + t, in metres."""

    m: tuple[tuple[float, float, float], ...]
    t: tuple[float, float, float]

    @property
    def null(self) -> bool:
        return np.allclose(self.m, np.eye(3), rtol=0, atol=1e-15) and max(map(abs, self.t)) < 1e-9


def affine(shift: tuple[float, ...]) -> Affine:
    """From three offsets (metres), three rotations (arc seconds) and a scale (parts per million)."""
    rx, ry, rz, k = shift[3] * _ARC, shift[4] * _ARC, shift[5] * _ARC, 1 + shift[6] * 1e-6
    return Affine(((k, -rz * k, ry * k), (rz * k, k, -rx * k), (-ry * k, rx * k, k)), tuple(shift[:3]))


def compose(first: Affine, then: Affine) -> Affine:
    a, b = np.array(first.m), np.array(then.m)
    return _made(b @ a, b @ np.array(first.t) + np.array(then.t))


def invert(a: Affine) -> Affine:
    m = np.linalg.inv(np.array(a.m))
    return _made(m, -m @ np.array(a.t))


def _made(m: np.ndarray, t: np.ndarray) -> Affine:
    return Affine(tuple(map(tuple, m.tolist())), tuple(t.tolist()))


def parameters(a: Affine) -> tuple[float, ...]:
    """The seven parameters whose map is nearest: exact for one shift, to second order in the rotations for composed ones."""
    m = np.array(a.m)
    k = float(np.cbrt(np.linalg.det(m)))
    turn = [(m[2][1] - m[1][2]) / 2, (m[0][2] - m[2][0]) / 2, (m[1][0] - m[0][1]) / 2]
    return (*a.t, *[float(v) / k / _ARC for v in turn], (k - 1) * 1e6)


def residual(a: Affine, radius: float = 6378137.0) -> float:
    """What leaving out rotation and scale can cost at the earth's surface, in metres."""
    p = parameters(a)
    return radius * math.hypot(math.sqrt(sum((r * _ARC) ** 2 for r in p[3:6])), p[6] * 1e-6)


def split(box: Box) -> tuple[Box, ...]:
    """A box that may cross the date line as boxes that do not."""
    x0, y0, x1, y1 = box
    return (box,) if x0 <= x1 else ((x0, y0, 180.0, y1), (-180.0, y0, x1, y1))


def intersect(a: Iterable[Box], b: Iterable[Box]) -> tuple[Box, ...]:
    """The boxes that both areas cover, each once."""
    b = list(b)
    met = {(max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])) for p in a for q in b}
    real = sorted(x for x in met if x[0] <= x[2] and x[1] <= x[3])
    return tuple(x for x in real if not any(_inside(x, y) for y in real if y != x))


def _inside(inner: Box, outer: Box) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and inner[2] <= outer[2] and inner[3] <= outer[3]


def covers(area: Iterable[Box], box: Box | None) -> bool:
    """Whether an area holds every part of a box; no area holds none."""
    area = list(area)
    return bool(area) and (box is None or all(any(_inside(b, a) for a in area) for b in split(box)))


@dataclass(frozen=True)
class Operation:
    """From one datum to another: ``map`` (geocentric) or ``grid`` (a deployed file); ``area`` in degrees, ``accuracy`` in metres."""

    name: str
    source: str
    target: str
    accuracy: float
    area: tuple[Box, ...]
    map: Affine | None = None
    grid: str | None = None


@dataclass(frozen=True)
class Way:
    """Operations in order, each with its direction, and the datums that they visit; ``area`` is what all of them cover."""

    steps: tuple[tuple[Operation, bool], ...]
    datums: tuple[str, ...]
    area: tuple[Box, ...] = field(compare=False)

    @property
    def accuracy(self) -> float:
        return math.sqrt(sum(o.accuracy**2 for o, _ in self.steps))

    @property
    def gridded(self) -> bool:
        return any(o.grid for o, _ in self.steps)

    @property
    def map(self) -> Affine | None:
        """All steps in one, where all are maps."""
        out = None
        for o, forward in self.steps:
            if o.map is None:
                return None
            step = o.map if forward else invert(o.map)
            out = step if out is None else compose(out, step)
        return out


def ways(source: str, target: str, operations: Iterable[Operation]) -> Iterator[Way]:
    """Every way from one datum to another, in the order of the operations, shared area or not; none to itself."""
    edges: dict[str, list[tuple[str, Operation, bool]]] = {}
    for o in operations:
        edges.setdefault(o.source, []).append((o.target, o, True))
        edges.setdefault(o.target, []).append((o.source, o, False))

    def walk(at: str, steps: tuple, seen: tuple[str, ...], area: tuple[Box, ...]) -> Iterator[Way]:
        if at == target:
            yield Way(steps, seen, area)
            return
        for to, o, forward in edges.get(at, ()):
            if to not in seen:
                yield from walk(to, (*steps, (o, forward)), (*seen, to), intersect(area, o.area))

    if source != target:
        yield from walk(source, (), (source,), ((-180.0, -90.0, 180.0, 90.0),))
