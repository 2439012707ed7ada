"""One FeatureCollection in many ranges: the same elements whatever the ranges are."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrazzo.sources import documents, ingest

TRICKY = [
    {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"s": 'x}],{"features":[{"', "n": 1}},
    {"type": "Feature", "id": None, "geometry": None, "properties": {"s": "\\\\\"}é{", "features": [{"a": [1, {"b": "}"}]}, 2]}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"s": "\\", "deep": {"features": [[]], "k": "\\u007d"}}},
    {"type": "Feature", "id": "z", "geometry": None, "properties": {}},
]


def document(features=TRICKY, indent=None, before=None, after=None):
    root = {"type": "FeatureCollection", **(before or {}), "features": features, **(after or {})}
    return json.dumps(root, indent=indent, ensure_ascii=False)


@pytest.fixture
def ranged(spark):
    """Sets the size of a range."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def read(spark, path):
    items, rest = documents.elements(spark, f"file://{path}")
    rows = items.orderBy("file", "position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [json.loads(r["text"]) for r in rows], [r["text"] for r in rest.collect()]


def wide():
    return document(before={"name": "n", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "more": [{"a": [{}]}, [[]]]}, after={"features_": [{"q": 1}], "last": {"features": [{"no": 1}]}})


def ranges(text, size):
    """The records of a file as Spark's reader deals them: a range has those that begin in its bytes, or just before them."""
    batches, at = {}, 0
    records = text.encode().split(b"}")
    for record in records if records[-1] else records[:-1]:
        batches.setdefault(at // size * size, []).append(record.decode())
        at += len(record) + 1
    first = min(batches)
    batches[0] = batches.pop(first) if first else batches[first]  # the file's first range has its begin
    for place, values in sorted(batches.items()):
        yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(values)), pa.array([place] * len(values), pa.int64()), pa.array(values)], names=["file", "place", "value"])


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 23, 41, 64, 100, 250, 10_000])
def test_effects_and_pieces_of_all_ranges(indent, size):
    text = json.dumps(json.loads(wide()), indent=indent, ensure_ascii=False) + "\n\n"
    rows = [r for b in documents._effects(ranges(text, size)) for r in b.to_pylist()]
    begins, ends = documents._begins(rows)
    assert ends["f"].depth == -1 and not ends["f"].string
    pieces = [p for b in documents._cut(ranges(text, size), begins) for p in b.to_pylist()]
    found, rest = [], ""
    for p in sorted(pieces, key=lambda p: (p["place"], p["seq"])):
        if p["kind"] == "o":
            rest += p["text"]
        elif p["kind"] == "l":
            found[-1] += p["text"]
        else:
            found.append(p["text"])
    assert [json.loads(f) for f in found] == TRICKY and json.loads(rest[:-1]) == {**json.loads(text), "features": []}
    assert len(rows) > 15 or size > 5


@pytest.mark.parametrize("size", [64, 250, 10_000])
def test_ranges_of_some_sizes(spark, tmp_path, ranged, size):
    (tmp_path / "d.json").write_text(wide() + "\n\n")
    ranged(size)
    got, (rest,) = read(spark, tmp_path / "d.json")
    assert got == TRICKY and json.loads(rest) == {**json.loads(wide()), "features": []}


@pytest.mark.parametrize("cut", range(0, 360, 5))
def test_two_ranges_with_the_border_anywhere(cut):
    """The effect of a range, whatever it begins in, leads to the state that reading from the front has there."""
    text = document(after={"x": [1, {"y": "}"}]}).encode()
    borders = [k + 1 for k, c in enumerate(text) if c == ord("}")]
    at = borders[min(cut * len(borders) // 360, len(borders) - 1)]
    first = documents.Effect(False, first=True)
    first.feed(text[:at])
    middle = first.after(documents.State())
    whole = documents.Cutter(documents.State())
    list(whole.feed(text[:at]))
    assert (middle.string, middle.depth, middle.inside) == (whole.state.string, whole.state.depth, whole.state.inside)
    second = documents.Effect(middle.string)
    second.feed(text[at:])
    end = second.after(middle)
    assert (end.string, end.depth, end.inside) == (False, 0, False)
    pieces = [*documents.Cutter(documents.State()).feed(text[:at])]
    assert b"".join(t for k, t in pieces if k == "o")


def test_elements_that_are_no_objects(spark, tmp_path, ranged):
    (tmp_path / "d.json").write_text('{"features": [1, "a}b,]", null, [2, {"x": 3}], {}, true ], "type": "FeatureCollection"}')
    for size in (20, 1000):
        ranged(size)
        assert read(spark, tmp_path / "d.json")[0] == [1, "a}b,]", None, [2, {"x": 3}], {}, True]


@pytest.mark.parametrize("text", ['{"type":"FeatureCollection","features":[]}', '{"type":"FeatureCollection","features":[ \n ]} ', '{"features":[],"type":"FeatureCollection","x":{}}'])
def test_empty_collections(spark, tmp_path, ranged, text):
    (tmp_path / "d.json").write_text(text)
    for size in (15, 1000):
        ranged(size)
        found, (rest,) = read(spark, tmp_path / "d.json")
        assert found == [] and json.loads(rest) == json.loads(text)


@pytest.mark.parametrize("size", [50, 10_000])
def test_documents_that_do_not_end(spark, tmp_path, ranged, size):
    (tmp_path / "d.json").write_text(document()[:-40])
    ranged(size)
    assert read(spark, tmp_path / "d.json")[0] == []
    decoded = ingest.decode_geojson(spark, f"file://{tmp_path}/d.json", skip_malformed=True)
    assert decoded.features.count() == 0 and [r["reason"] for r in decoded.skipped.collect()] == [ingest.MALFORMED]


def test_ids_follow_the_document(spark, tmp_path, ranged):
    features = [{"type": "Feature", **({"id": f"own{k}"} if k % 10 == 3 else {}), "geometry": {"type": "Point", "coordinates": [k, -k]}, "properties": {"k": k, "pad": "}" * (k % 7)}} for k in range(500)]
    features[17] = "no feature"
    (tmp_path / "d.json").write_text(document(features))
    ranged(4096)
    decoded = ingest.decode_geojson(spark, f"file://{tmp_path}/d.json", skip_malformed=True)
    got = {r["feature_id"]: r["k"] for r in decoded.features.collect()}
    kept = [k for k in range(500) if k != 17]
    assert got == {(f"own{k}" if k % 10 == 3 else str(n)): k for n, k in enumerate(kept, 1)} and decoded.skipped.count() == 1


def test_large_document_is_many_tasks(spark, tmp_path, ranged):
    """Some 40 MB in one line: many ranges, each element once, and nothing of the whole in a task."""
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for k in range(120_000):
            f.write("," * (k > 0) + f'{{"type":"Feature","id":{k},"geometry":{{"type":"Point","coordinates":[{k % 360 - 180},{k % 180 - 90}]}},"properties":{{"k":{k},"text":"{"x{]" * 50}"}}}}')
        f.write("]}")
    ranged(1 << 20)
    items, _ = documents.elements(spark, f"file://{path}")
    assert documents._records(spark, f"file://{path}").rdd.getNumPartitions() >= path.stat().st_size >> 20
    assert items.agg(F.count("*"), F.countDistinct("position"), F.max("position"), F.max(F.length("text"))).first()[:3] == (120_000, 120_000, 119_999)
    features = ingest.read_geojson(spark, f"file://{path}")
    assert tuple(features.agg(F.count("*"), F.sum("k"), F.sum("geometry.env.minx")).first()) == (120_000, sum(range(120_000)), float(sum(k % 360 - 180 for k in range(120_000))))
