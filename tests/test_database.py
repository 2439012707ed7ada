"""Plans over a database: against an embedded one, and the statements of the dialects."""

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.model import Box, FeatureQuery, OrderTerm, PlanError
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset
from terrazzo.plans.parse import parse_filter, parse_where
from terrazzo.sources.database import DIALECTS, Database, Statement, Table

URL = "jdbc:derby:memory:terrazzo;create=true"


@pytest.fixture(scope="module")
def places(spark):
    geo.register(spark)
    df = spark.range(60).select(
        F.col("id").cast("string").alias("code"),
        F.col("id").alias("n"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("O'Name_"), (F.col("id") % 13).cast("string"))).alias("name"),
        (F.col("id") / 4).alias("ratio"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("seen"),
        geo.call("st_point", F.col("id").cast("double"), F.lit(1.0)).alias("shape"),
    )
    connection = spark._jvm.java.sql.DriverManager.getConnection(URL)
    run = connection.createStatement()
    run.execute('CREATE TABLE "places" ("code" VARCHAR(40), "n" BIGINT, "name" VARCHAR(40), "ratio" DOUBLE, "seen" TIMESTAMP, "shape" VARCHAR(100) FOR BIT DATA)')
    for r in df.collect():
        name = "NULL" if r["name"] is None else "'" + r["name"].replace("'", "''") + "'"
        run.execute(f"INSERT INTO \"places\" VALUES ('{r['code']}', {r['n']}, {name}, {r['ratio']}, TIMESTAMP('{r['seen']:%Y-%m-%d %H:%M:%S}'), X'{bytes(r['shape']).hex()}')")
    connection.close()
    return df


@pytest.fixture(scope="module")
def store(spark, places):
    return Database(spark, URL, driver="org.apache.derby.jdbc.EmbeddedDriver")


TABLE = Table("places", ("code",), "shape")


@pytest.mark.parametrize(
    "q",
    [
        FeatureQuery(),
        FeatureQuery(where=parse_filter("n > 10 AND (name = 'O''Name_3' OR ratio <= 4.25)")),
        FeatureQuery(where=parse_filter("name NOT IN ('O''Name_3', 'x') AND name IS NOT NULL")),
        FeatureQuery(where=parse_filter("name LIKE 'O_Name\\_1%' OR name ILIKE 'o''NAME_5'")),
        FeatureQuery(where=parse_filter("name LIKE '%_4' AND n != 4")),
        FeatureQuery(where=parse_where("seen >= DATE '2024-01-05' AND seen < DATE '2024-02-01'")),
        FeatureQuery(where=parse_filter("name = 5 OR n = 'x' OR n IN (1, 2.0, 3)")),
        FeatureQuery(box=Box(5.5, 0, 12, 2), where=parse_filter("n != 8")),
        FeatureQuery(ids=("3", "07", "9", "nothing")),
        FeatureQuery(order=(OrderTerm("name", True), OrderTerm("ratio")), limit=9, offset=4, projection=("n", "name")),
        FeatureQuery(where=parse_filter("n < 40"), limit=5, offset=3),
        FeatureQuery(where=parse_filter("name LIKE 'O%'"), order=(OrderTerm("name"),), limit=6),
    ],
)
def test_the_same_rows_as_in_spark(spark, places, store, q):
    plain = Dataset(places.withColumn("shape", geo.encode(F.col("shape"))), ("code",), ("code",))
    rows = lambda df: [tuple(r) for r in df.drop("shape").collect()]
    got, want = rows(store.features(TABLE, q)), rows(execute.features(plain, q))
    assert (got if q.order or q.limit else sorted(got, key=repr)) == (want if q.order or q.limit else sorted(want, key=repr)) and want
    assert store.count(TABLE, FeatureQuery(where=q.where, box=q.box, ids=q.ids)) == execute.count(plain, FeatureQuery(where=q.where, box=q.box, ids=q.ids))


def test_scan_in_parts(store):
    ds = store.scan(TABLE, "n", 4)
    assert ds.df.count() == 60 and ds.df.rdd.getNumPartitions() == 4 and ds.geometries == ["shape"]
    assert store.scan(TABLE).df.select(F.max("shape.env.maxx")).first()[0] == 59.0


def test_statements_of_dialects(places):
    schema = places.schema
    q = FeatureQuery(where=parse_filter("name < 'b' AND n != 3"), box=Box(0, 1, 2, 3), order=(OrderTerm("name", True),), limit=7, offset=2)
    postgis = Statement(DIALECTS["postgis"], TABLE, schema).select(q, True)
    assert 'ST_AsBinary("shape") AS "shape"' in postgis and '"shape" && ST_MakeEnvelope(0.0, 1.0, 2.0, 3.0, 4326)' in postgis
    assert '"name" COLLATE "C" < \'b\' AND "n" <> 3' in postgis and 'ORDER BY "name" COLLATE "C" DESC NULLS FIRST, "code" COLLATE "C" OFFSET 2 ROWS FETCH NEXT 7 ROWS ONLY' in postgis
    server = Statement(DIALECTS["sqlserver"], TABLE, schema).select(q, True)
    assert "[shape].STAsBinary() AS [shape]" in server and ".Filter(geometry::STGeomFromText('POLYGON((0.0 1.0, 2.0 1.0, 2.0 3.0, 0.0 3.0, 0.0 1.0))', 4326)) = 1" in server
    assert "ORDER BY CASE WHEN [name] IS NULL THEN 1 ELSE 0 END DESC, [name] COLLATE Latin1_General_BIN2 DESC, [code] COLLATE Latin1_General_BIN2 OFFSET" in server
    assert Statement(DIALECTS["plain"], Table('a."b'), schema).select(FeatureQuery(), False).endswith('FROM "a"."""b"')


def said(dialect, text, table=TABLE, schema=None):
    s = Statement(DIALECTS[dialect], table, schema)
    return s.where(FeatureQuery(where=parse_filter(text))), s.exact


def test_texts_in_other_dialects(places):
    """What a dialect reads otherwise is asked for more widely, and left to Spark: no row is lost."""
    schema = places.schema
    assert said("sqlserver", "name LIKE '[a]~%'", schema=schema) == ("[name] LIKE '~[a]~~%' ESCAPE '~'", False)
    assert said("postgis", "name LIKE '[a]~%'", schema=schema) == ("\"name\" LIKE '[a]~~%' ESCAPE '~'", False)
    assert said("sqlserver", "name = 'a'", schema=schema) == ("[name] COLLATE Latin1_General_BIN2 = 'a'", False)  # finds 'a ' too
    for op in ("!=", "<", ">", "<=", ">="):
        assert said("sqlserver", f"name {op} 'a'", schema=schema) == ("[name] IS NOT NULL", False)
        assert said("postgis", f"name {op} 'a'", schema=schema)[1]
    assert said("sqlserver", "name NOT IN ('a', 'b')", schema=schema) == ("[name] IS NOT NULL", False)
    assert said("sqlserver", "n >= 5", schema=schema) == ("[n] >= 5", True)
    s = Statement(DIALECTS["sqlserver"], TABLE, schema)
    assert s.ids(("3", "x")) == "[code] COLLATE Latin1_General_BIN2 IN ('3', 'x')" and not s.exact


def test_pages_need_an_order(places, spark, store):
    schema = places.schema
    keyless, number = Table("places", (), "shape"), Table("places", ("n",), "shape")
    asked = lambda dialect, table, **q: Statement(DIALECTS[dialect], table, schema).pages(FeatureQuery(limit=5, **q))
    assert not asked("plain", keyless) and asked("plain", number) and asked("sqlserver", number)
    assert not asked("sqlserver", TABLE) and asked("plain", TABLE) and not asked("plain", number, order=(OrderTerm("name"),))
    with pytest.raises(PlanError):
        Statement(DIALECTS["sqlserver"], keyless, schema).select(FeatureQuery(limit=5), True)
    assert store.features(keyless, FeatureQuery(limit=5)).count() == 5


def test_unknown(spark, store):
    with pytest.raises(PlanError):
        Database(spark, URL, "dbase")
    with pytest.raises((PlanError, KeyError)):
        store.features(TABLE, FeatureQuery(where=parse_filter("nothing = 1")))
