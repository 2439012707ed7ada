"""The style expression dialect: JSON arrays such as ``["case", [">", ["get", "n"], 3], "a", "b"]`` as columns.

Missing values stay missing (null) through arithmetic; comparisons with a missing
side are false; division by zero follows IEEE.  ``!=`` on numbers is a true
inequality.  Exponential interpolation is ``progress ** base``.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.model import PlanError
from terrazzo.plans.dataset import quoted

# Colour names.
COLOURS = {
    "white": (255, 255, 255),
    "black": (0, 0, 0),
    "red": (255, 0, 0),
    "green": (0, 128, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "orange": (255, 165, 0),
    "gray": (128, 128, 128),
    "grey": (128, 128, 128),
    "lightgray": (211, 211, 211),
    "lightgrey": (211, 211, 211),
    "darkgray": (169, 169, 169),
    "darkgrey": (169, 169, 169),
}
CHANNELS = ("r", "g", "b", "a")


def colour(channels: list[Column]) -> Column:
    """A colour value: struct<r,g,b,a:int>, 0 to 255."""
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(CHANNELS, channels, strict=True)])


def parse_colour(text: Column) -> Column:
    """A colour from text: a name, ``#`` with 3, 4, 6 or 8 digits, ``rgb()`` or ``rgba()``; null for other text."""
    t = F.lower(F.trim(text))
    digits = F.substring(t, 2, 8)
    short = F.length(t).isin(4, 5)
    pair = lambda k: F.when(short, F.repeat(F.substring(digits, k + 1, 1), 2)).otherwise(F.substring(digits, 2 * k + 1, 2))
    byte = lambda k: F.conv(pair(k), 16, 10).cast("int")
    out = F.lit(None).cast("struct<r:int,g:int,b:int,a:int>")
    parts = F.split(F.regexp_extract(t, r"^rgba?\(([0-9., ]+)\)$", 1), r"\s*,\s*")
    number = lambda k: F.try_element_at(parts, F.lit(k + 1)).try_cast("double")
    alpha = F.when(F.size(parts) == 4, F.bround(number(3) * 255)).otherwise(F.lit(255))
    proper = F.size(parts).isin(3, 4) & number(0).between(0, 255) & number(1).between(0, 255) & number(2).between(0, 255) & alpha.between(0, 255)
    out = F.when(t.startswith("rgb") & proper, colour([number(0), number(1), number(2), alpha])).otherwise(out)
    hexed = colour([byte(0), byte(1), byte(2), F.when(F.length(t).isin(5, 9), byte(3)).otherwise(F.lit(255))])
    out = F.when(t.rlike("^#([0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})$"), hexed).otherwise(out)
    out = F.when(t == "transparent", colour([F.lit(0)] * 4)).otherwise(out)
    for name, rgb in COLOURS.items():
        out = F.when(t == name, colour([F.lit(v) for v in (*rgb, 255)])).otherwise(out)
    return out


_ORDER = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Compiler:
    """Compiles expressions over a DataFrame's columns; ``context`` gives zoom, id and geometry-type."""

    def __init__(self, df: DataFrame, context: dict | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.context = context or {}

    def kind(self, e, scope: dict) -> str:
        """number, text, boolean or unknown, as far as the expression shows it."""
        if isinstance(e, bool):
            return "boolean"
        if isinstance(e, (int, float)):
            return "number"
        if isinstance(e, str):
            return "text"
        if not isinstance(e, list) or not e:
            return "unknown"
        op = e[0]
        if op == "literal":
            return self.kind(e[1], scope)
        if op == "get":
            t = self.types.get(e[1])
            return "number" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "unknown"
        if op == "var":
            return self.kind(*scope[e[1]])
        if op == "let":
            return self.kind(e[-1], self._bind(e, scope))
        if op in ("==", "!=", "<", "<=", ">", ">=", "all", "any", "!", "has", "in"):
            return "boolean"
        if op == "+":
            return "text" if any(self.kind(x, scope) == "text" for x in e[1:]) else "number"
        if op in ("-", "*", "/", "%", "interpolate", "zoom"):
            return "number"
        if op in ("concat", "geometry-type", "id"):
            return "text"
        if op in ("case", "match", "coalesce", "step"):
            return self.kind({"case": e[-1], "match": e[-1], "coalesce": e[1], "step": e[2]}[op], scope)
        return "unknown"

    def _bind(self, e: list, scope: dict) -> dict:
        scope = dict(scope)
        for name, value in zip(e[1:-1:2], e[2:-1:2], strict=True):
            scope[name] = (value, dict(scope))
        return scope

    def compile(self, e, scope: dict | None = None) -> Column:
        scope = scope or {}
        if e is None:
            return F.lit(None)
        if isinstance(e, (bool, str)):
            return F.lit(e)
        if isinstance(e, (int, float)):
            return F.lit(float(e))
        if not isinstance(e, list) or not e or not isinstance(e[0], str):
            raise PlanError(f"not an expression: {e!r}")
        method = getattr(self, "_" + {"==": "eq", "!=": "ne", "+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod", "!": "not", "in": "is_in", "geometry-type": "gtype", "at-interpolate": "at", "to-color": "to_color"}.get(e[0], e[0] if e[0] not in _ORDER else "order"), None)
        if method is None:
            raise PlanError(f"unknown operator {e[0]!r}")
        return method(e, scope)

    def _many(self, items, scope) -> list[Column]:
        return [self.compile(x, scope) for x in items]

    def _truth(self, e, scope) -> Column:
        return F.coalesce(self.compile(e, scope).cast("boolean"), F.lit(False))

    def _number(self, e, scope) -> Column:
        c = self.compile(e, scope)
        return c.cast("double") if self.kind(e, scope) in ("number", "unknown") else F.lit(None).cast("double")

    def _literal(self, e, scope):
        return self.compile(e[1], scope) if not isinstance(e[1], list) else F.array(*self._many(e[1], scope))

    def _get(self, e, scope):
        if e[1] not in self.types:
            return F.lit(None)
        c = F.col(quoted(e[1]))
        return c.cast("double") if isinstance(self.types[e[1]], T.NumericType) else c

    def _has(self, e, scope):
        return F.col(quoted(e[1])).isNotNull() if e[1] in self.types else F.lit(False)

    def _var(self, e, scope):
        if e[1] not in scope:
            raise PlanError(f"unbound variable {e[1]!r}")
        return self.compile(*scope[e[1]])

    def _let(self, e, scope):
        return self.compile(e[-1], self._bind(e, scope))

    def _zoom(self, e, scope):
        return F.lit(float(self.context.get("zoom", 0)))

    def _id(self, e, scope):
        return self.context.get("id", F.lit(None))

    def _gtype(self, e, scope):
        return self.context.get("geometry-type", F.lit(None))

    def _same(self, e, scope) -> Column:
        a, b = self.kind(e[1], scope), self.kind(e[2], scope)
        if "unknown" not in (a, b) and a != b:
            return F.lit(False)
        return self.compile(e[1], scope) == self.compile(e[2], scope)

    def _eq(self, e, scope):
        return F.coalesce(self._same(e, scope), F.lit(False))

    def _ne(self, e, scope):
        both = self.compile(e[1], scope).isNotNull() & self.compile(e[2], scope).isNotNull()
        return both & ~F.coalesce(self._same(e, scope), F.lit(False))

    def _order(self, e, scope):
        if {self.kind(e[1], scope), self.kind(e[2], scope)} & {"text", "boolean"}:
            return F.lit(False)
        return F.coalesce(_ORDER[e[0]](self._number(e[1], scope), self._number(e[2], scope)), F.lit(False))

    def _all(self, e, scope):
        return reduce(operator.and_, [self._truth(x, scope) for x in e[1:]], F.lit(True))

    def _any(self, e, scope):
        return reduce(operator.or_, [self._truth(x, scope) for x in e[1:]], F.lit(False))

    def _not(self, e, scope):
        return ~self._truth(e[1], scope)

    def _is_in(self, e, scope):
        inside = e[2][1] if isinstance(e[2], list) and e[2] and e[2][0] == "literal" else e[2]
        if isinstance(inside, list) and not (inside and isinstance(inside[0], str) and hasattr(self, "_" + inside[0])):
            return F.coalesce(reduce(operator.or_, [self._eq(["==", e[1], x], scope) for x in inside], F.lit(False)), F.lit(False))
        return F.coalesce(self.compile(e[2], scope).contains(self.compile(e[1], scope)), F.lit(False))

    def _add(self, e, scope):
        if self.kind(e, scope) == "text":
            return F.concat(*[c.cast("string") for c in self._many(e[1:], scope)])
        return reduce(operator.add, [self._number(x, scope) for x in e[1:]])

    def _sub(self, e, scope):
        numbers = [self._number(x, scope) for x in e[1:]]
        return -numbers[0] if len(numbers) == 1 else reduce(operator.sub, numbers)

    def _mul(self, e, scope):
        return reduce(operator.mul, [self._number(x, scope) for x in e[1:]])

    def _div(self, e, scope):
        a, b = self._number(e[1], scope), self._number(e[2], scope)
        zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))

    def _mod(self, e, scope):
        a, b = self._number(e[1], scope), self._number(e[2], scope)
        return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(a, b))

    def _concat(self, e, scope):
        return F.concat_ws("", *[c.cast("string") for c in self._many(e[1:], scope)])

    def _case(self, e, scope):
        out = self.compile(e[-1], scope)
        for test, value in reversed(list(zip(e[1:-1:2], e[2:-1:2], strict=True))):
            out = F.when(self._truth(test, scope), self.compile(value, scope)).otherwise(out)
        return out

    def _match(self, e, scope):
        out = self.compile(e[-1], scope)
        for labels, value in reversed(list(zip(e[2:-1:2], e[3:-1:2], strict=True))):
            hit = self._any(["any", *[["==", e[1], x] for x in (labels if isinstance(labels, list) else [labels])]], scope)
            out = F.when(hit, self.compile(value, scope)).otherwise(out)
        return out

    def _coalesce(self, e, scope):
        return F.coalesce(*self._many(e[1:], scope))

    def _step(self, e, scope):
        x, out = self._number(e[1], scope), self.compile(e[2], scope)
        for stop, value in zip(e[3::2], e[4::2], strict=True):
            out = F.when(x >= F.lit(float(stop)), self.compile(value, scope)).otherwise(out)
        return out

    def _progress(self, mode: list, p: Column) -> Column:
        if mode[0] == "linear":
            return p
        if mode[0] == "exponential":
            return F.pow(p, F.lit(float(mode[1])))
        if mode[0] == "cubic-bezier":
            x1, y1, x2, y2 = map(float, mode[1:5])
            at = lambda t, a, b: 3 * (1 - t) * (1 - t) * t * a + 3 * (1 - t) * t * t * b + t * t * t
            # the parameter of p by bisection, as an aggregate over 30 halvings
            start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

            def halve(s: Column, _: Column) -> Column:
                mid = (s["lo"] + s["hi"]) / 2
                low = at(mid, x1, x2) < p
                return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

            found = F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, halve)
            return at((found["lo"] + found["hi"]) / 2, y1, y2)
        raise PlanError(f"unknown interpolation {mode[0]!r}")

    def _to_color(self, e, scope):
        kind, c = self.kind(e[1], scope), self.compile(e[1], scope)
        if kind == "number":
            grey = F.bround(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * 255)
            return F.when(c.isNotNull(), colour([grey, grey, grey, F.lit(255)]))
        if kind == "boolean":
            raise PlanError("to-color reads a number or a colour name")
        parsed = parse_colour(c.cast("string"))
        return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a colour: "), c.cast("string")))).otherwise(parsed)

    def _interpolate(self, e, scope):
        if all(isinstance(v, list) and v and v[0] == "to-color" or self.kind(v, scope) == "text" for v in e[4::2]):
            return self._interpolate_colours(e, scope)
        x, stops = self._number(e[2], scope), [float(s) for s in e[3::2]]
        values = [self._number(v, scope) for v in e[4::2]]
        out = values[-1]
        for k in range(len(stops) - 2, -1, -1):
            p = (x - stops[k]) / (stops[k + 1] - stops[k])
            out = F.when(x < F.lit(stops[k + 1]), values[k] + (values[k + 1] - values[k]) * self._progress(e[1], p)).otherwise(out)
        return F.when(x.isNotNull(), F.when(x <= F.lit(stops[0]), values[0]).otherwise(out))

    def _interpolate_colours(self, e, scope):
        """Each channel along the ramp, rounded half to even."""
        x, stops = self._number(e[2], scope), [float(s) for s in e[3::2]]
        values = [self.compile(v if isinstance(v, list) and v[0] == "to-color" else ["to-color", v], scope) for v in e[4::2]]
        out = values[-1]
        for k in range(len(stops) - 2, -1, -1):
            p = self._progress(e[1], (x - stops[k]) / (stops[k + 1] - stops[k]))
            mixed = colour([F.bround(values[k][n] + (values[k + 1][n] - values[k][n]) * p) for n in CHANNELS])
            out = F.when(x < F.lit(stops[k + 1]), mixed).otherwise(out)
        return F.when(x.isNotNull(), F.when(x <= F.lit(stops[0]), values[0]).otherwise(out))

    def _at(self, e, scope):
        inner = e[2]
        return self._interpolate(["interpolate", inner[1], e[1], *inner[3:]], scope)


def compile_expression(df: DataFrame, e, context: dict | None = None) -> Column:
    return Compiler(df, context).compile(e)


def legacy_filter(f: list) -> list:
    """A legacy filter as an expression; its ``!=`` is true for missing values."""
    op = f[0]
    if op in ("all", "any"):
        return [op, *map(legacy_filter, f[1:])]
    if op == "none":
        return ["!", ["any", *map(legacy_filter, f[1:])]]
    if op == "!":
        return ["!", legacy_filter(f[1])]
    if op == "has":
        return ["has", f[1]]
    if op == "!has":
        return ["!", ["has", f[1]]]
    if op == "==" or op in _ORDER:
        return [op, ["get", f[1]], f[2]]
    if op == "!=":
        return ["!", ["==", ["get", f[1]], f[2]]]
    if op == "in":
        return ["in", ["get", f[1]], ["literal", f[2:]]]
    raise PlanError(f"unknown filter {op!r}")
