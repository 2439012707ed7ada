"""Fill-in-the-middle against a plain version of its rules."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from terrazzo.llm import middle

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain_version(doc_id, text, plain=10, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKED = [(100, "a <P> b"), (101, "<S>"), (102, "x<M"), (103, "<<S<P"), (104, "P><M><"), (105, "<"), (106, "ab"), (107, "é<😀>\n\r\x00z"), (108, "a" * 300_000 + "-" + "b" * 300_000)]


def test_against_plain_version(spark, docs, rows):
    every = docs.unionByName(spark.createDataFrame(MARKED, "doc_id long, text string"), allowMissingColumns=True)
    got = middle.transform(every).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    said = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr)
    assert said == sorted((plain_version(*r) for r in [*rows, *MARKED]), key=repr)
    texts = sorted(((i, t or "") for i, t in [*rows, *MARKED]), key=repr)
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=repr) == texts
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_shares_and_empty(spark, empty):
    assert middle.transform(empty).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two, three; four").alias("text"))
    forms = middle.transform(many, plain_percent=0, suffix_first_percent=100).groupBy("form").count().collect()
    assert [(r["form"], r["count"]) for r in forms] == [("spm", 400)]
    assert middle.transform(many, plain_percent=100).where("form <> 'plain' or output <> 'one two, three; four'").count() == 0


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 64])
def test_segments_cut_between_units(segment):
    split = middle.splitter()
    for text in ("", "a", "abc", "ab cd", " ab", "ab ", "a1b2cc dd\n\né😀ff", "x" * 50 + " " + "y" * 20):
        units, found = middle.Units(text, split, segment), UNITS.findall(text)
        assert len(units) == len(found)
        assert [units.end(k) for k in range(len(found) + 1)] == [len("".join(found[:k])) for k in range(len(found) + 1)]
