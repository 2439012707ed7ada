"""The served surface over the demo points."""

import json

import pytest

from terrazzo.model import PlanError
from terrazzo.operators import served
from terrazzo.sources import demo


@pytest.fixture(scope="module")
def ds(spark):
    return demo.points(spark)


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_counts_and_filters(ds):
    serve = lambda **p: served.serve(ds, p)
    assert serve(where="value > 0", returnCountOnly="true").first()[0] == 55
    assert serve(geometry="-1,-1,1,1", returnCountOnly="true").first()[0] == 9
    assert serve(geometry='{"x":0,"y":0}', distance="1.2", units="esriSRUnit_Minute", returnCountOnly="true").first()[0] == 1
    assert serve(geometry=json.dumps({"rings": [[[-1.5, -1.5], [-1.5, 1.5], [1.5, 1.5], [1.5, -1.5], [-1.5, -1.5]], [[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5], [-0.5, -0.5]]]}), returnCountOnly="true").first()[0] == 8
    assert serve(geometry="-1,-1,1,1", spatialRel="esriSpatialRelTouches", returnCountOnly="true").first()[0] == 8
    assert serve(geometry="-1,-1,1,1", spatialRel="esriSpatialRelRelation", relationMask="T*F**F***", returnCountOnly="true").first()[0] == 1
    assert serve(objectIds="point-000,point-001", returnCountOnly="true").first()[0] == 2
    assert tuple(serve(returnExtentOnly="true").first())[:4] == (-5.0, -4.0, 5.0, 5.0)


def test_pages_and_shapes(ds):
    page = served.serve(ds, {"orderByFields": "value DESC, name", "resultRecordCount": "2", "outFields": "name", "returnGeometry": "false"})
    assert [r["name"] for r in page.collect()] == ["point-109", "point-098"]
    assert served.serve(ds, {"outFields": "value", "returnDistinctValues": "true", "returnCountOnly": "true"}).first()[0] == 20
    assert len(names(served.serve(ds, {"where": "name LIKE 'point-00%'"}))) == 10
    assert served.serve(ds, {"returnUniqueIdsOnly": "true"}).count() == 110


def test_statistics(ds):
    stats = json.dumps([{"statisticType": "count", "onStatisticField": "name", "outStatisticFieldName": "n"}, {"statisticType": "PERCENTILE_CONTINUOUS", "onStatisticField": "value", "statisticParameters": {"value": 0.5}, "outStatisticFieldName": "mid"}])
    assert tuple(served.serve(ds, {"outStatistics": stats}).first()) == (110, 0.5)
    grouped = served.serve(ds, {"outStatistics": json.dumps([{"statisticType": "count", "onStatisticField": "name", "outStatisticFieldName": "n"}]), "groupByFieldsForStatistics": "value", "having": "n >= 10", "orderByFields": "n DESC, value"})
    assert [tuple(r) for r in grouped.collect()] == [(0.0, 10), (1.0, 10)]


def test_output_geometry(ds):
    one = {"where": "name = 'point-109'", "outFields": "name"}
    row = served.serve(ds, {**one, "outSR": "3857", "returnCentroid": "true"}).first()
    assert row["geometry"]["env"]["minx"] == pytest.approx(556597.4539663679) and row["centroid"]["y"] == pytest.approx(557305.257274)
    row = served.serve(ds, {**one, "outSR": "3857", "geometryPrecision": "0"}).first()
    assert row["geometry"]["env"]["minx"] == 556597.0
    row = served.serve(ds, {**one, "quantizationParameters": json.dumps({"tolerance": 2, "extent": {"xmin": 0, "ymax": 0}})}).first()
    assert row["geometry"]["env"]["minx"] == 6.0


@pytest.mark.parametrize("p", [{"sqlFormat": "x"}, {"returnIdsOnly": "true", "returnExtentOnly": "true"}, {"having": "n > 1"}, {"geometry": "1,2,3"}, {"geometry": "0,0", "spatialRel": "near"}, {"orderByFields": "name SIDEWAYS"}, {"resultOffset": "x"}, {"where": "name ="}])
def test_refusals(ds, p):
    with pytest.raises(PlanError):
        served.serve(ds, p)
