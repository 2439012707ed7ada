"""Containment search against a plain version."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from terrazzo.llm import decontam

from .conftest import prose


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w, width=5):
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            w = words(q)
            want = shingles(w, min(5, len(w))) if w else set()
            n = len(want & shingles(words(t), min(5, len(w)))) if want else 0
            if want and n >= math.ceil(0.75 * len(want)):
                out.add((d, i, n, len(want)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randint(5, 50))) for k in range(12)] + [(20, "two words"), (21, ""), (22, None), (23, "Single")]
    docs = [(k, prose(rng, 200)) for k in range(10)]
    docs += [(100 + k, f"{prose(rng, 50)} {q.upper()}! {prose(rng, 3000)}") for k, q in items if q]
    half = items[3][1].split()
    docs += [(200, " ".join(half[: len(half) * 2 // 3])), (201, " ".join(half[: len(half) * 9 // 10])), (202, None), (203, ""), (204, re.sub(" ", "### ", items[4][1]))]
    found = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()}
    assert got == brute(docs, items) and found.count() == len(got)


def test_sketch_size_guarantees_recall(spark):
    items = spark.createDataFrame([(k, prose(random.Random(k), 10 + k)) for k in range(8)], "item_id long, text string")
    shingled = decontam.item_shingles(items)
    sizes = {r["item_id"]: r["n"] for r in shingled.select("item_id", "n").distinct().collect()}
    for r in decontam.sketches(shingled).groupBy("item_id").count().collect():
        n = sizes[r["item_id"]]
        assert r["count"] >= n - math.ceil(0.75 * n) + 1


def sketched(spark, sizes):
    items = spark.createDataFrame([(k, prose(random.Random(k), n)) for k, n in enumerate(sizes)], "item_id long, text string")
    return decontam.sketches(decontam.item_shingles(items)).cache()


def test_classes_admit_every_sketch_hash(spark, monkeypatch):
    sketch = sketched(spark, [1, 2, 5, 6, 30, 300, 300, 90, 91, 95])
    for most in (0, 20, 1000):
        monkeypatch.setattr(decontam, "LISTED", most)
        classes = decontam.classes_of(sketch)
        for w, c in classes.items():
            need = F.ceil(F.col("n") * 0.75)  # the smallest document that can hold the item
            assert sketch.where((F.col("w") == w) & ~c.admits(F.col("hash"), need)).count() == 0
        assert (most == 0) == all(not c.listed for c in classes.values()) and (most == 1000) == all(not c.ceilings for c in classes.values())


def test_tiny_items_leave_the_other_ceilings(spark, monkeypatch):
    """The ceiling of large items is their own, whatever tiny ones there are; short documents are not searched for them."""
    monkeypatch.setattr(decontam, "LISTED", 40)
    alone = decontam.classes_of(sketched(spark, [300] * 6))
    together = decontam.classes_of(sketched(spark, [300] * 6 + [5, 6, 5, 6, 7, 8]))
    assert alone[5].ceilings == together[5].ceilings and not alone[5].listed and len(together[5].listed) >= 6
    (need, ceiling), key = alone[5].ceilings[0], F.lit(-(1 << 63))
    share = (ceiling + 2.0**63) / 2.0**64
    row = spark.range(1).select(alone[5].admits(key, F.lit(need)), alone[5].admits(key, F.lit(need - 1)), together[5].admits(F.lit(together[5].listed[-1]), F.lit(1))).first()
    assert tuple(row) == (True, False, True) and need > 200 and share < 0.4 and max(together[5].listed) > ceiling


@pytest.mark.parametrize("most", [0, 12, 1000])
def test_every_way_of_searching(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "LISTED", most)
    rng = random.Random(11)
    items = [(k, prose(rng, n)) for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 9, 20, 21, 40, 80, 160, 161))]
    docs = [(k, prose(rng, rng.randint(1, 400))) for k in range(30)] + [(100 + k, f"{prose(rng, 9)} {q} {prose(rng, 60)}") for k, q in items] + [(200 + k, q) for k, q in items]
    found = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()} == brute(docs, items)


def test_repeated_and_null_ids(spark):
    item = prose(random.Random(1), 40)
    half, rest = " ".join(item.split()[:20]), " ".join(item.split()[16:])
    rows = [(1, half), (1, rest), (None, item), (None, "clean text of a few words here"), (2, half), (3, item), (3, item)]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long, item_id string")
    items = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs, items).collect()} == {(1, 5), (3, 5)}
    assert sorted(r["key"] for r in decontam.clean(docs, items).collect()) == [3, 4]


def test_clean(spark, docs, empty):
    items = spark.createDataFrame([(1, docs.where("doc_id = 10").first()["text"])], "item_id long, text string")
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1 and kept.where("doc_id = 10").count() == 0
    assert decontam.clean(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, none).count() == docs.count()


def test_no_python_in_the_plan(docs, spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontam.contained(docs.select("doc_id", "text"), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
