"""A dataset: a DataFrame with identity, kinds and an optional geometry column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.model import Kind, PlanError

#: A key whose type has no exact literal here.
_TEXT = object()
#: The feature id column, carried through every projection.
ID = "__feature_id"


def kind_of(field: T.StructField) -> Kind | None:
    """The kind of a column; None for types outside the model."""
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return Kind.BOOLEAN
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT64
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Kind.DOUBLE
    if isinstance(t, T.StringType):
        return Kind.GUID if (field.metadata or {}).get("kind") == "guid" else Kind.STRING
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Kind.DATETIME
    if isinstance(t, T.StructType) and {"wkb", "env"} <= set(t.names):
        return Kind.GEOMETRY
    return None


@dataclass(frozen=True)
class Dataset:
    """``ids`` identify a feature (none: a keyless set); ``ordinal`` columns give the store order."""

    df: DataFrame
    ids: tuple[str, ...] = ()
    ordinal: tuple[str, ...] = ()
    name: str = "dataset"
    start_field: str | None = None
    end_field: str | None = None

    @property
    def kinds(self) -> dict[str, Kind]:
        return {f.name: k for f in self.df.schema.fields if (k := kind_of(f))}

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def kind(self, name: str) -> Kind:
        """Case-sensitive lookup; an unknown field is a typed failure."""
        try:
            return self.kinds[name]
        except KeyError:
            raise PlanError(f"{self.name} has no field {name!r}") from None

    @property
    def geometries(self) -> list[str]:
        return [n for n, k in self.kinds.items() if k is Kind.GEOMETRY]

    def feature_id(self) -> Column:
        """Identity as text; a keyless set has none.

        Parts of a composite identity are joined by ``|``; in a part ``\\`` and ``|`` are escaped by ``\\``, and null is ``\\N``,
        so different keys never share an id.
        """
        if not self.ids:
            return F.lit(None).cast("string")
        if len(self.ids) == 1:
            return F.col(quoted(self.ids[0])).cast("string")
        return F.concat_ws("|", *[self._part(c) for c in self.ids])

    def _part(self, name: str) -> Column:
        text = F.col(quoted(name)).cast("string")
        if isinstance(self.df.schema[name].dataType, T.StringType):
            text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\N"))

    def keys(self, feature_id: str) -> tuple | None:
        """The values of the identity columns that an id names; None where it can name no row."""
        parts = [feature_id] if len(self.ids) == 1 else _split(feature_id)
        if len(parts) != len(self.ids):
            return None
        out = []
        for name, part in zip(self.ids, parts, strict=True):
            kind = self.df.schema[name].dataType
            if part is None or isinstance(kind, T.StringType):
                out.append(part)
            elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
                if not re.fullmatch(r"0|-?[1-9][0-9]{0,18}", part) or not -(1 << bits - 1) <= int(part) < 1 << bits - 1:
                    return None
                out.append(int(part))
            else:
                out.append(_TEXT)  # told apart by the id's text
        return tuple(out)

    def lookup(self, ids: list[str]) -> Column:
        """Rows with one of some ids: typed tests of the key columns, which reach the scan, then the id itself where those do not decide."""
        keys = [k for k in map(self.keys, ids) if k is not None]
        if not keys:
            return F.lit(False)
        test = None
        for at, name in enumerate(self.ids):
            values = {k[at] for k in keys}
            if _TEXT not in values:
                c = F.col(quoted(name))
                known = sorted(v for v in values if v is not None)
                one = c.isin(known) if known else F.lit(False)
                one = one | c.isNull() if None in values else one
                test = one if test is None else test & one
        if len(self.ids) == 1 and test is not None:
            return test
        exact = self.feature_id().isin(ids)
        return exact if test is None else test & exact

    def ordinals(self) -> list[Column]:
        return [F.col(quoted(c)) for c in (self.ordinal or self.ids)]

    def with_df(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.ids, self.ordinal, self.name, self.start_field, self.end_field)


def _split(feature_id: str) -> list[str | None]:
    """The parts of a composite id."""
    parts = re.findall(r"((?:[^|\\]|\\.)*)(?:\||$)", feature_id, re.S)
    parts = parts[: -1 if len(parts) > 1 and not feature_id.endswith("|") else None]
    return [None if p == "\\N" else re.sub(r"\\(.)", r"\1", p, flags=re.S) for p in parts]


def quoted(name: str) -> str:
    """A column name that Spark reads as one name."""
    return "`" + name.replace("`", "``") + "`"


def schema_extends(writer: T.StructType, reader: Sequence[T.StructField]) -> bool:
    """Append-only evolution: the reader's columns are a prefix of the writer's, and nullability does not narrow."""
    if len(reader) > len(writer.fields):
        return False
    return all(r.name == w.name and r.dataType == w.dataType and (r.nullable or not w.nullable) for r, w in zip(reader, writer.fields, strict=False))
