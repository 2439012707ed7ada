"""Hard negatives against all pairs, and what the bounds skip."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, id long, part int, centroid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(4)


def plain_version(rows, positives=5, negatives=10, low=30, high=90):
    good = [(i, v, k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in good), default=0)
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v)), k) for i, v, k in good]
    out = []
    for i, a, k in whole:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, m) for j, b, m in whole if j != i)
        for s, j, _ in [x for x in scored if x[2] == k][:positives]:
            fits = [x for x in scored if x[2] != k and low * -s <= -100 * x[0] <= high * -s][:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def said(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def clustered(rng, count, dim=12, tight=0.15, groups=15):
    centres = [[rng.gauss(0, 0.5) for _ in range(dim)] for _ in range(groups)]
    return [(k, [x + rng.gauss(0, tight) for x in rng.choice(centres)], rng.randrange(4)) for k in range(count)]


@pytest.mark.parametrize("tight", [0.0, 0.02, 0.4])
def test_against_all_pairs(spark, tight):
    rows = clustered(random.Random(3), 1500, tight=tight)
    assert said(negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0)) == plain_version(rows)


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = clustered(rng, 300)
    v = rows[5][1]
    rows += [(None, v, 1), (1000, None, 1), (1100, v, None), (1200, [*v[:-1], None], 1), (1300, [*v[:-1], float("nan")], 1), (1400, [*v[:-1], float("inf")], 2)]
    rows += [(1500, [], 1), (1600, v[:3], 2), (1700, [0.0] * 12, 0), (100, rows[7][1], 3), rows[11], rows[11], rows[200], (1800, [-x for x in v], 1)]
    assert said(negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0)) == plain_version(rows)
    assert negatives.mine(table(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0], 1), (None, [1.0], 1)]), F.col("vec_id") % 100 == 0).count() == 0
    assert said(negatives.mine(table(spark, [(0, [1.0], 1), (1, [0.5], 1), (2, [0.25], 2)]), F.col("vec_id") == 0)) == [(0, 1, 1, 2, 32768, 16384)]


def test_one_vector_for_a_third_of_all_rows(spark):
    rows = clustered(random.Random(6), 900)
    rows = [(k, rows[0][1] if k % 3 == 0 else v, label) for k, v, label in rows]
    assert said(negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0)) == plain_version(rows)


def test_lists_are_skipped():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 200
    held = negatives.Lists()
    for c in centres:
        v = np.floor(c + rng.normal(size=(50, 8))).astype(np.int64)
        mean = v.mean(axis=0)
        held.add(np.arange(50), np.zeros(50, np.int64), v, mean, float(np.sqrt(((v - mean) ** 2).sum(1).max())))
    a = np.floor(centres[:1]).astype(np.int64)
    one = negatives.Anchors(np.array([0]), np.array([-1]), np.array([0]), a, np.array([[negatives._NONE]]), np.array([[negatives._MANY]]))
    best = held.search(one, 5, True)
    every = np.sort(np.concatenate([(v @ a[0]) for v in held.vectors]))[::-1]
    assert best.score.tolist() == every[:5].tolist() and held.visited < 6


def test_large_components_are_exact():
    a = np.array([[1 << 24, -(1 << 24), 3]] * 2)
    assert negatives.scores(a, a).tolist() == [[(1 << 49) + 9] * 2] * 2
    wide = np.full((1, 64), 1 << 24)
    assert negatives.scores(wide, wide).tolist() == [[64 << 48]]
    assert all((negatives.unpack(negatives.pack(x)) == x).all() for x in (np.array([1, -128]), np.array([40000]), np.array([1 << 40]), np.zeros(0, np.int64)))
