"""Substring dedup against a plain table of windows."""

import itertools
import random
import re

import numpy as np
import pytest

from terrazzo.llm import substring

SPACE = re.compile("[\x20\x09-\x0d]+")
WIDE = "doc_id long, text string, block long, part long, answers string, shared string"


def plain_version(rows, width=20):
    words = [(i, [w for w in SPACE.split(t or "") if w]) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    seen = {}
    for i, w in words:
        for s in range(len(w) - width + 1):
            gram = tuple(w[s : s + width])
            seen[gram] = min(seen.get(gram, order(i)), order(i))
    out = []
    for i, w in words:
        gone, mine = set(), set()
        for s in range(len(w) - width + 1):
            gram = tuple(w[s : s + width])
            if gram in mine or seen[gram] < order(i):
                gone.update(range(s, s + width))
            mine.add(gram)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def said(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def passages(rng, count, width):
    """Documents that share passages of all lengths about the width, at all offsets, some inside one document."""
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (*range(width - 2, width + 4), 3 * width, 61, 90)]
    rows = []
    for k in range(count):
        words = []
        for _ in range(rng.randrange(6)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + (rng.choice(shared) if rng.random() < 0.7 else [])
        rows.append((k, rng.choice((" ", "\n", " \t ")).join(words)))
    return rows


def test_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a, b in itertools.product(cover, cover)} == set(range(period))
    assert substring.period_of(20) == 13 and substring.period_of(1) == 1 and substring.period_of(50) == 31


def test_runs_are_equal_where_words_are():
    h = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 20):
        for salt in (0, 1):
            got, want = substring.runs(h, width, salt), [tuple(h[k : k + width].tolist()) for k in range(len(h) - width + 1)]
            assert len(got) == len(want) and len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))
    assert len(substring.runs(h[:5], 6)) == 0


@pytest.mark.parametrize("width", [20, 7, 3])
def test_against_plain_version(spark, width):
    rows = passages(random.Random(width), 120, width)
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], WIDE).repartition(5)
    assert said(substring.dedup(df, width)) == plain_version(rows, width)


def test_awkward_rows(docs, rows, empty):
    assert said(substring.dedup(docs)) == plain_version(rows)
    assert substring.dedup(empty).count() == 0


def test_periodic_texts_and_copies(spark):
    rows = [(k, " ".join(f"p{j % period}" for j in range(70))) for k, period in enumerate((1, 2, 3, 13, 26, 31))]
    rows += [(100 + k, rows[3][1]) for k in range(300)] + [(None, rows[4][1]), (None, rows[4][1]), (7, "a " * 19), (8, "a " * 20), (8, "a " * 21)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert said(substring.dedup(df)) == plain_version(rows)


def test_nothing_shared(spark):
    rows = [(k, " ".join(f"v{k}x{j}" for j in range(25 * k))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert said(substring.dedup(df)) == plain_version(rows)
    assert substring._cut(np.zeros(0, np.uint64), 5) == {}
    cut = substring._cut(np.sort(np.random.default_rng(0).integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2)), 7)
    assert sorted(cut) == list(range(7)) and [(c.start, c.stop) for c in cut.values()] == list(itertools.pairwise([0, *[c.stop for c in cut.values()]]))


def test_many_blocks(spark, monkeypatch):
    """Blocks and parts cut small: the answers of every block and part find their way back."""
    rows = passages(random.Random(9), 80, 20)
    docs = [(k, (t or "") + " ") for k, t in rows]
    made = [substring.Block(pa_texts([t for _, t in docs[a : a + 3]]), 20) for a in range(0, len(docs), 3)]
    assert sum(len(b.words.doc) for b in made) == sum(len(t.split()) for _, t in docs)
    batches = list(cut_blocks(docs, 300, monkeypatch))
    assert len(batches) > 20 and [i for b in batches for i in b.column("doc_ids")[0].as_py()] == [k for k, _ in docs]
    monkeypatch.setattr(substring, "PART_ENTRIES", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert said(substring.dedup(df)) == plain_version(rows)


def pa_texts(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def cut_blocks(docs, size, monkeypatch):
    """The block rows that a task makes of ``docs``, with blocks of ``size`` bytes."""
    import pyarrow as pa

    monkeypatch.setattr(substring, "BLOCK_BYTES", size)
    ids, texts = pa.array([k for k, _ in docs], pa.int64()), pa_texts([t for _, t in docs])
    return substring.block_rows(pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"]), 0)
