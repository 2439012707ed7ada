"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import graph, ngramjoin
from terrazzo.llm.storage import Bitmap, Segments

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    known = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((-1 if i is None else i), len(sets[k]), i if not sets[k] else known[root(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def same(a, b):
    return [tuple(map(str, x)) for x in a] == [tuple(map(str, x)) for x in b]


def test_awkward_rows(docs, rows):
    assert same(got(ngramjoin.near_duplicates(docs)), brute(rows))


def family(seed, n=60, length=90):
    """Copies with random edits, so that similarities lie on both sides of the threshold; some passages are common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(length)]
    passage = [word() for _ in range(30)]
    rows = []
    for k in range(n):
        words = list(base) if k % 3 else [word() for _ in range(length)] + passage
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words[: rng.randint(length - 15, len(words))])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    rows = family(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert same(got(ngramjoin.near_duplicates(df, orders=1 + seed)), brute(rows))


def test_keep_one(docs, rows):
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {(i, n, c) for i, n, c in brute(rows)}
    expected = sorted(str(i) for i, n, c in classes if n and i == c) + ["None" for i, t in rows if i is None and shingles(t)]
    shingled = sorted(str(r["doc_id"]) for r in kept.collect() if shingles(r["text"]))
    assert shingled == sorted(expected)
    assert sum(not shingles(r["text"]) for r in kept.collect()) == sum(not shingles(t) for _, t in rows)


def test_empty(empty):
    assert ngramjoin.near_duplicates(empty).count() == 0
    assert ngramjoin.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


def entries(rows):
    return ngramjoin.Entries(**{c: np.array(x, t) for x, (c, t) in zip(zip(*rows, strict=True), ngramjoin.Entries.TYPES.items(), strict=True)})


def listed(e):
    return list(zip(e.token.tolist(), e.sig.tolist(), e.n.tolist(), e.pos.tolist(), strict=True))


def test_packed_entries():
    rng = random.Random(3)
    rows = sorted((rng.choice([rng.getrandbits(64), 7, 2**64 - 1]), rng.getrandbits(63) - 2**62, rng.randint(1, 9000), rng.randint(0, 2000)) for _ in range(500))
    assert listed(ngramjoin.Entries.unpack(entries(rows).pack())) == rows


def test_buckets_keep_every_pair_that_the_order_admits():
    rng = random.Random(4)
    size = {s: rng.randint(1, 60) for s in range(40)}
    rows = list({(t, s): (t, s, size[s], rng.randint(0, size[s] // 4)) for t, s in ((rng.randint(0, 60), rng.randint(0, 39)) for _ in range(600))}.values())
    admits = lambda x, y: x[0] == y[0] and x[1] != y[1] and 7 * min(x[2] - x[3], y[2] - y[3]) >= 3 * (x[2] + y[2])
    pairs = lambda rows: {(x[0], x[1], y[1]) for x in rows for y in rows if admits(x, y)}
    kept = listed(ngramjoin.bucketed(entries(rows + rows[:50])))  # some sets are sent twice
    assert pairs(kept) == pairs(rows) and len(set(kept)) == len(kept) < len(rows)
    assert kept == sorted(kept, key=lambda r: (r[0], r[3], r[2], r[1]))
    assert not listed(ngramjoin.bucketed(entries([(1, 1, 9, 0), (2, 1, 9, 1)]))) and not listed(ngramjoin.bucketed(entries([(1, 1, 9, 0)]).take(slice(0, 0))))


def test_sets_have_two_hashes_and_a_salt():
    data = b"a b c d e f g"
    one, other = (ngramjoin.Sets(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)], dtype=np.int64), salt) for salt in (0, 1))
    assert one.tokens.tolist() == other.tokens.tolist() and len({one.sig[0], one.check[0], other.sig[0], other.check[0]}) == 4


def test_bitmap(spark):
    held = [5, -3, 1 << 40, -(1 << 63), (1 << 63) - 1]
    bitmap = Bitmap(spark.createDataFrame([(x,) for x in [*held, None]], "x long"), "x")
    assert bitmap.may_hold(np.array(held)).all() and not bitmap.may_hold(np.arange(100, 9000)).any()
    assert not Bitmap(spark.createDataFrame([], "x long"), "x").may_hold(np.array(held)).any()


def test_segments(spark):
    keys = spark.range(0, 40_000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    df = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("name"), (F.col("id") % 7 == 0).alias("bits"), F.lit(1).alias("segment"))
    marked = Segments(keys, "key").marked(df, F.col("name"), "maybe")
    assert set(marked.columns) == {"name", "bits", "segment", "maybe"} and marked.count() == 50_000
    held = marked.join(keys, marked["name"] == keys["key"], "left_semi")
    assert held.where("not maybe").count() == 0 and marked.where("maybe").count() < 1.5 * keys.count()
    assert Segments(keys.limit(0), "key").marked(df, F.col("name"), "maybe").where("maybe").count() == 0


def test_repeated_rows_and_null_ids_stay_once(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (1, "other words that stand alone here now", "c"), (None, text, "d"), (None, "so few", "e"), (None, "so few", "e"), (3, None, "f"), (3, None, "f")]
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, sig string"))
    assert sorted((str(r["doc_id"]), r["sig"]) for r in kept.collect()) == [("1", "a"), ("1", "c"), ("3", "f"), ("3", "f"), ("None", "e")]
