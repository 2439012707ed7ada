"""Datasets in a relational database: a plan's where, box, order and page become one SQL statement, read over JDBC.

What the dialect cannot say exactly (case-folded LIKE) stays out of the statement and is
decided by Spark; a page is then cut by Spark as well, so the rows are the same either way.
A whole read is split by ranges of a numeric key.  The driver jar is the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions.geometry import encode, register
from terrazzo.model import Box, Compare, Constant, Every, FeatureQuery, IsIn, IsNull, Kind, Literal, PlanError, Predicate, Some
from terrazzo.plans import execute, validate
from terrazzo.plans.compile import can_match
from terrazzo.plans.dataset import Dataset, kind_of


@dataclass(frozen=True)
class Dialect:
    """How a database says names, truth, text order, well-known binary and boxes.

    ``classes``: LIKE knows character classes in brackets.  ``pads``: comparisons of texts ignore blanks at their end.
    """

    quote: tuple[str, str] = ('"', '"')
    true: str = "TRUE"
    false: str = "FALSE"
    text_order: str = "{}"
    wkb: str = "{}"
    box: str | None = None
    instant: str = "CAST('{}' AS TIMESTAMP)"
    nulls: bool = True
    classes: bool = False
    pads: bool = False

    def name(self, n: str) -> str:
        return ".".join(self.quote[0] + part.replace(self.quote[1], self.quote[1] * 2) + self.quote[1] for part in n.split("."))


DIALECTS = {
    "plain": Dialect(),
    "postgis": Dialect(text_order='{} COLLATE "C"', wkb="ST_AsBinary({})", box="{0} && ST_MakeEnvelope({1}, {2}, {3}, {4}, {5})"),
    "sqlserver": Dialect(
        quote=("[", "]"), true="1", false="0", text_order="{} COLLATE Latin1_General_BIN2", wkb="{}.STAsBinary()", instant="CAST('{}' AS datetime2)", nulls=False, classes=True, pads=True,
        box="{0}.Filter(geometry::STGeomFromText('POLYGON(({1} {2}, {3} {2}, {3} {4}, {1} {4}, {1} {2}))', {5})) = 1",
    ),
}


@dataclass(frozen=True)
class Table:
    """A table as a dataset: identity columns, and a geometry column with its system."""

    name: str
    ids: tuple[str, ...] = ()
    geometry: str | None = None
    srid: int = 4326


class Statement:
    """A plan as SQL over a table whose columns are known."""

    def __init__(self, dialect: Dialect, table: Table, schema: T.StructType):
        self.dialect, self.table = dialect, table
        self.kinds = {f.name: Kind.GEOMETRY if f.name == table.geometry else kind_of(f) for f in schema.fields}
        self.columns = [f.name for f in schema.fields]
        self.exact = True

    def literal(self, v: Literal) -> str:
        if v.kind == "string":
            return "'" + v.value.replace("'", "''") + "'"
        if v.kind == "boolean":
            return self.dialect.true if v.value else self.dialect.false
        return repr(v.value)

    def instant(self, ms: float) -> str:
        return self.dialect.instant.format((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S.%f"))

    def compare(self, p: Compare) -> str:
        kind, name = self.kinds[p.field], self.dialect.name(p.field)
        if kind is None or not can_match(kind, p.op, p.value):
            return "1=0"
        if kind is Kind.DATETIME:
            if p.value.value != int(p.value.value):
                self.exact = False
                return "1=1"
            at, after = self.instant(p.value.value), self.instant(p.value.value + 1)  # a column counts in whole milliseconds
            sides = {"=": f"{name} >= {at} AND {name} < {after}", "!=": f"({name} < {at} OR {name} >= {after})", "<": f"{name} < {at}", "<=": f"{name} < {after}", ">": f"{name} >= {after}", ">=": f"{name} >= {at}"}
            return f"({sides[p.op]})"
        if kind is Kind.STRING and self.dialect.pads and p.op not in ("LIKE", "ILIKE"):
            self.exact = False  # equal texts are found, and some others; no other comparison keeps every row
            return f"{self.dialect.text_order.format(name)} = {self.literal(p.value)}" if p.op == "=" else f"{name} IS NOT NULL"
        if kind is Kind.STRING and p.op in ("<", "<=", ">", ">="):
            return f"{self.dialect.text_order.format(name)} {p.op} {self.literal(p.value)}"
        if p.op == "ILIKE" or kind is Kind.GUID:
            self.exact = False
            return f"{name} IS NOT NULL"
        if p.op == "LIKE":
            self.exact = False  # collations may fold case: the database narrows, Spark decides
            pattern = p.value.value.replace("~", "~~")
            pattern = pattern.replace("[", "~[") if self.dialect.classes else pattern
            return f"{name} LIKE {self.literal(Literal('string', pattern))} ESCAPE '~'"
        op = "<>" if p.op == "!=" else p.op
        if kind is Kind.STRING:
            return f"{self.dialect.text_order.format(name)} {op} {self.literal(p.value)}"
        return f"{name} {op} {self.literal(p.value)}"

    def predicate(self, p: Predicate) -> str:
        """A condition that holds for every row that the predicate admits, and for those alone while ``exact``."""
        if isinstance(p, Constant):
            return "1=1" if p.truth else "1=0"
        if isinstance(p, (Every, Some)):
            if not p.terms:
                return "1=1" if isinstance(p, Every) else "1=0"
            return "(" + (" AND " if isinstance(p, Every) else " OR ").join(self.predicate(t) for t in p.terms) + ")"
        if isinstance(p, IsNull):
            return f"{self.dialect.name(p.field)} IS {'NOT ' * p.negated}NULL"
        if isinstance(p, IsIn):
            values = [self.compare(Compare(p.field, "=", v)) for v in p.values]
            found = "(" + (" OR ".join(values) or "1=0") + ")"
            if not p.negated:
                return found
            return f"({self.dialect.name(p.field)} IS NOT NULL AND NOT {found})" if self.exact else f"{self.dialect.name(p.field)} IS NOT NULL"
        if isinstance(p, Compare):
            return self.compare(p)
        raise PlanError(f"not a predicate: {p!r}")

    def where(self, q: FeatureQuery) -> str:
        terms = []
        if q.where is not None:
            terms.append(self.predicate(q.where))
        if q.box is not None:
            b: Box = q.box
            if self.table.geometry and self.dialect.box:
                terms.append(self.dialect.box.format(self.dialect.name(self.table.geometry), *(repr(float(v)) for v in (b.minx, b.miny, b.maxx, b.maxy)), self.table.srid))
            self.exact = False  # an index test: Spark looks at the envelopes again
        if q.ids is not None:
            terms.append(self.ids(q.ids))
        return " AND ".join(terms)

    def ids(self, ids: tuple[str, ...]) -> str:
        """Only single integer or text keys have a statement; others are Spark's."""
        key = self.table.ids[0] if len(self.table.ids) == 1 else None
        kind = self.kinds.get(key)
        if kind is Kind.INT64:
            wanted = sorted({int(i) for i in ids if i.lstrip("-").isdecimal() and str(int(i)) == i})
            return f"{self.dialect.name(key)} IN ({', '.join(map(str, wanted))})" if wanted else "1=0"
        if kind is Kind.STRING:
            self.exact = self.exact and not self.dialect.pads
            said = ", ".join(self.literal(Literal("string", i)) for i in sorted(set(ids)))
            return f"{self.dialect.text_order.format(self.dialect.name(key))} IN ({said})" if ids else "1=0"
        self.exact = False
        return "1=1"

    def order(self, q: FeatureQuery) -> str:
        terms = []
        for t in q.order:
            name = self.dialect.name(t.field)
            said = self.dialect.text_order.format(name) if self.kinds[t.field] is Kind.STRING else name
            way = "DESC" if t.descending else "ASC"
            if self.dialect.nulls:
                terms.append(f"{said} {way} NULLS {'FIRST' if t.descending else 'LAST'}")
            else:
                terms += [f"CASE WHEN {name} IS NULL THEN 1 ELSE 0 END {way}", f"{said} {way}"]
        return ", ".join(terms)

    def pages(self, q: FeatureQuery) -> bool:
        """Whether the database may cut the page: it has an order of all rows, and the same one."""
        if not self.exact or q.limit is None or q.box is not None or not (q.order or self.table.ids):
            return False
        texts = [t.field for t in q.order if self.kinds[t.field] is Kind.STRING] + [c for c in self.table.ids if self.kinds[c] is Kind.STRING]
        if texts and self.dialect.pads:  # texts that differ in blanks alone would tie
            return False
        return not q.order or len(self.table.ids) == 1 and self.kinds.get(self.table.ids[0]) is Kind.STRING  # ties go by the id's text

    def select(self, q: FeatureQuery, page: bool) -> str:
        """The statement; ``page`` puts order, offset and limit into it."""
        columns = [f"{self.dialect.wkb.format(self.dialect.name(c))} AS {self.dialect.name(c)}" if c == self.table.geometry else self.dialect.name(c) for c in self.columns]
        text = f"SELECT {', '.join(columns)} FROM {self.dialect.name(self.table.name)}"
        where = self.where(q)
        text += f" WHERE {where}" if where else ""
        if page and q.limit is not None:
            own = [self.dialect.text_order.format(self.dialect.name(c)) if self.kinds[c] is Kind.STRING else self.dialect.name(c) for c in self.table.ids]
            keys = ", ".join(filter(None, [self.order(q), *own]))
            if not keys:
                raise PlanError(f"{self.table.name} has no order to cut a page by")
            text += f" ORDER BY {keys} OFFSET {execute.start_of(q)} ROWS FETCH NEXT {q.limit} ROWS ONLY"
        return text


class Database:
    """Tables of one database; ``dialect`` is plain, postgis or sqlserver."""

    def __init__(self, spark: SparkSession, url: str, dialect: str = "plain", **options: str):
        if dialect not in DIALECTS:
            raise PlanError(f"unknown dialect {dialect!r}")
        self.spark, self.url, self.dialect, self.options = spark, url, DIALECTS[dialect], options

    def _read(self, query: str, **more) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({query}) t", **self.options, **{k: str(v) for k, v in more.items()}).load()

    def schema(self, table: Table) -> T.StructType:
        """The columns as Spark reads them; the geometry is binary."""
        columns = self._read(f"SELECT * FROM {self.dialect.name(table.name)} WHERE 1=0") if not table.geometry or self.dialect.wkb == "{}" else None
        if columns is None:
            named = self._read(f"SELECT column_name AS n FROM information_schema.columns WHERE table_name = '{table.name.rpartition('.')[2]}'")
            names = [r[0] for r in named.collect()]
            said = [f"{self.dialect.wkb.format(self.dialect.name(c))} AS {self.dialect.name(c)}" if c == table.geometry else self.dialect.name(c) for c in names]
            columns = self._read(f"SELECT {', '.join(said)} FROM {self.dialect.name(table.name)} WHERE 1=0")
        return columns.schema

    def _dataset(self, table: Table, df: DataFrame) -> Dataset:
        if table.geometry:
            register(self.spark)
            df = df.withColumn(table.geometry, encode(F.col(table.geometry)))
        return Dataset(df, table.ids, table.ids, table.name)

    def scan(self, table: Table, split: str | None = None, parts: int = 8) -> Dataset:
        """The whole table; ``split`` names a numeric column whose range is read in ``parts`` statements."""
        schema = self.schema(table)
        query = Statement(self.dialect, table, schema).select(FeatureQuery(), False)
        if split is None:
            return self._dataset(table, self._read(query))
        name = self.dialect.name(split)
        low, high = self._read(f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {self.dialect.name(table.name)}").first()
        if low is None:
            return self._dataset(table, self._read(query))
        return self._dataset(table, self._read(query, partitionColumn=split, lowerBound=low, upperBound=int(high) + 1, numPartitions=parts))

    def features(self, table: Table, q: FeatureQuery) -> DataFrame:
        """The plan's rows: what the statement says exactly is read as it comes, the rest is decided again by Spark."""
        schema = self.schema(table)
        asked = Statement(self.dialect, table, schema)
        asked.where(q)
        validate.feature_query(self._dataset(table, self.spark.createDataFrame([], schema)), q)
        page = asked.pages(q)
        found = self._dataset(table, self._read(Statement(self.dialect, table, schema).select(q, page)))
        rest = replace(q, offset=None, cursor=None) if page else q
        return execute.features(found, rest)

    def count(self, table: Table, q: FeatureQuery) -> int:
        schema = self.schema(table)
        asked = Statement(self.dialect, table, schema)
        where = asked.where(q)
        if not asked.exact:
            return self.features(table, replace(q, order=(), limit=None, offset=None, cursor=None)).count()
        return int(self._read(f"SELECT COUNT(*) AS n FROM {self.dialect.name(table.name)}" + (f" WHERE {where}" if where else "")).first()[0])
