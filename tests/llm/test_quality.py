"""Quality rules against a plain version."""

import re
import time
from collections import Counter

import numpy as np

from terrazzo.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(grams)
    covered = {k + s for k, g in enumerate(grams) if count[g] > 1 for s in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, chars, symbols, repeat = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(covered)
    dup = len(lines) - len(set(lines))
    base = n < 50 or 100 * repeat > 50 * n
    bad = base or 10 * symbols > chars or chars < 2 * n or chars > 25 * n or 100 * dup > 50 * max(len(lines), 1)
    return n, chars, symbols, dup, repeat, base, not bad


def test_scores(docs, rows):
    got = sorted(tuple(r) for r in quality.score(docs).na.fill(-1).collect())
    assert got == sorted((-1 if i is None else i, *plain(t)) for i, t in rows)


def test_keep_agrees_and_keeps_columns(docs, rows):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in rows if plain(t)[-1])


def test_order_never_changes_the_verdict(rows):
    data, offsets = text_block(rows)
    rules = quality.default_rules()
    want = [not plain(t)[-1] for _, t in rows]
    for order in (rules, rules[::-1], rules[2:] + rules[:2]):
        cascade = quality.Cascade(order, sample_rows=1)
        assert cascade.rejects(data, offsets).tolist() == want  # the sample
        assert cascade.rejects(data, offsets).tolist() == want  # by the measured order
        made = quality.Features(data, offsets)
        assert made.n_repeat_words is not None and cascade.rejects(data, offsets, made).tolist() == want


def text_block(rows):
    said = [(t or "").encode() for _, t in rows]
    return np.frombuffer(b"".join(said), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in said])]).astype(np.int64)


def test_cascade_orders_by_rejections_for_cost_and_asks_survivors_only(rows):
    seen = {}

    def rule(name, seconds, share):
        def rejects(f):
            seen.setdefault(name, []).append(f.n)
            time.sleep(seconds)
            return np.arange(f.n) < share * f.n

        return quality.Rule(name, rejects)

    cascade = quality.Cascade((rule("dear", 0.02, 0.5), rule("cheap", 0.002, 0.5), rule("idle", 0.002, 0.0)), sample_rows=10)
    data, offsets = text_block(rows)
    cascade.rejects(data, offsets)
    assert [r.name for r in cascade.rules] == ["cheap", "dear", "idle"]
    cascade.rejects(data, offsets)
    half = len(rows) // 2
    assert seen["cheap"] == [len(rows)] * 2 and seen["dear"] == [len(rows), half] and seen["idle"][1] < half


def test_long_and_repeated(spark):
    text = " ".join(f"word{k % 9000}" for k in range(300_000))
    df = spark.createDataFrame([(1, text), (1, text), (2, "a b")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in quality.score(df).collect())
    assert got == [(1, 300_000, False), (1, 300_000, False), (2, 2, False)]


def test_empty(empty):
    assert quality.score(empty).count() == 0 and quality.keep(empty).count() == 0
