"""Quality rules as a short-circuit cascade.

Each rule rejects a document from a few measured features.  Every task takes its own
leading documents, SAMPLE_ROWS of them, as the sample: all rules are run on these, each
on features of its own, which gives a rule's cost (seconds a document) and rejection
rate.  The rules are then ordered by rejections per second and the task evaluates them
in this order on the documents that no earlier rule rejected, so costly features are
computed for survivors alone.  The order changes the work, never the verdict, so tasks
may differ in it; nothing is read twice and nothing crosses the network for the plan.

``keep`` computes only what the cascade asks for.  ``score`` reports every feature of
every document, so there the cascade finds them made and only its verdicts are left.

Defined results: null text is empty (0 words, rejected by ``too_short``); empty
tables give empty results; repeated rows are judged one by one; texts of any length are
read whole; ``score`` reads doc_id and text alone, ``keep`` hands on all columns, whatever
they are called.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm import textvec
from terrazzo.llm.workers import tidy

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Leading rows of a task that cost and selectivity are estimated on (whole blocks, so a little more); no verdict depends on it.
SAMPLE_ROWS = 256

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


class Features:
    """Features of the texts of a block, each computed when first asked for.

    ``alive`` selects rows: after ``narrow`` the costly features are computed for these alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._made: dict[str, np.ndarray] = {}

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        run = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def _get(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def words(self) -> textvec.Words:
        return self._get("words", lambda: textvec.Words(self.data, self.offsets))

    @property
    def n_words(self) -> np.ndarray:
        return self.words.count

    @property
    def word_chars(self) -> np.ndarray:
        """Code points inside words."""
        return self._get("word_chars", lambda: self._sum(self.words.inner & ((self.data & 0xC0) != 0x80)))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._get("n_symbols", lambda: self._sum(_SYMBOL[self.data]))

    @property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        self.n_dup_lines  # noqa: B018
        return self._made["n_lines"]

    @property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""

        def make() -> np.ndarray:
            cut = np.flatnonzero(self.data == 0x0A)
            start = np.unique(np.concatenate([self.offsets[:-1], cut + 1]))
            start = start[start < len(self.data)]
            end = np.append(start[1:], len(self.data))
            # a line ends before its newline; a text's last line ends with the text
            newline = self.data[end - 1] == 0x0A if len(end) else np.zeros(0, bool)
            end = end - newline
            inner = np.zeros(len(self.data) + 1, dtype=np.int64)
            np.cumsum(self.words.inner, out=inner[1:])
            full = inner[end] > inner[start]
            start, end = start[full], end[full]
            doc = np.searchsorted(self.offsets, start, side="right") - 1
            h = textvec.span_hashes(self.data, start, end)
            order = np.lexsort((h, doc))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            self._made["n_lines"] = np.bincount(doc, minlength=self.n)
            return np.bincount(doc[order][same], minlength=self.n)

        return self._get("n_dup_lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 3-word windows that stand twice or more in their text, the first included."""

        def make() -> np.ndarray:
            w = self.words
            h = textvec.windows(textvec.span_hashes(self.data, w.start, w.end), 3)
            if not len(h):
                return np.zeros(self.n, dtype=np.int64)
            doc = w.doc[: len(h)]
            whole = np.flatnonzero(doc == w.doc[2:])
            key = textvec.mix(h[whole] ^ textvec.mix(doc[whole].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(key)
            k = key[order]
            twin = np.zeros(len(k), dtype=bool)
            equal = k[1:] == k[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
            mark = np.zeros(len(w.start), dtype=bool)
            at = whole[order[twin]]
            for step in range(3):
                mark[at + step] = True
            return np.bincount(w.doc[mark], minlength=self.n)

        return self._get("n_repeat_words", make)

    def narrow(self, rows: np.ndarray) -> Features:
        """The same features over some rows; made ones are kept, and bytes are copied together only if another is asked for."""
        return _Narrowed(self, rows)


class _Narrowed(Features):
    def __init__(self, whole: Features, rows: np.ndarray):
        self.n, self._whole, self._rows = len(rows), whole, rows
        self._made = {k: v[rows] for k, v in whole._made.items() if k not in ("words", "texts")}
        if "words" in whole._made:
            self._made["n_words"] = whole.n_words[rows]

    @property
    def n_words(self) -> np.ndarray:
        return self._made["n_words"] if "n_words" in self._made else self.words.count

    def _texts(self) -> tuple[np.ndarray, np.ndarray]:
        def make() -> tuple[np.ndarray, np.ndarray]:
            data, at = self._whole.data, self._whole.offsets
            offsets = np.concatenate([[0], np.cumsum(np.diff(at)[self._rows])]).astype(np.int64)
            return np.concatenate([data[:0], *(data[at[r] : at[r + 1]] for r in self._rows.tolist())]), offsets

        return self._get("texts", make)

    data = property(lambda self: self._texts()[0])
    offsets = property(lambda self: self._texts()[1])


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps features to a boolean array, true where the document goes."""

    name: str
    rejects: Callable[[Features], np.ndarray]


def default_rules() -> tuple[Rule, ...]:
    """The base rules (too short, mostly repeated) and the rules for symbol junk, odd words and repeated lines."""
    return (
        Rule("too_short", lambda f: f.n_words < 50),
        Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
        Rule("symbols", lambda f: 10 * f.n_symbols > f.word_chars),
        Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 25 * f.n_words)),
        Rule("repeated_lines", lambda f: 100 * f.n_dup_lines > 50 * np.maximum(f.n_lines, 1)),
    )


class Cascade:
    """The rules in the order of their worth, as measured on the first documents that it judges."""

    def __init__(self, rules: tuple[Rule, ...] | None = None, sample_rows: int = SAMPLE_ROWS):
        self.rules = rules or default_rules()
        self.spent, self.rejected = np.zeros(len(self.rules)), np.zeros(len(self.rules))
        self.seen, self.sample_rows = 0, sample_rows

    def rejects(self, data: np.ndarray, offsets: np.ndarray, features: Features | None = None) -> np.ndarray:
        """Which texts some rule rejects; ``features`` are those already made."""
        features = features or Features(data, offsets)
        if self.seen >= self.sample_rows:
            return cascade_reject(features, self.rules)
        out = np.zeros(features.n, dtype=bool)
        for k, rule in enumerate(self.rules):
            began = time.perf_counter()
            hit = np.asarray(rule.rejects(Features(data, offsets)), dtype=bool)  # a shared feature counts for every rule that needs it
            self.spent[k] += time.perf_counter() - began
            self.rejected[k] += np.count_nonzero(hit)
            out |= hit
        self.seen += features.n
        if self.seen >= self.sample_rows:
            worth = self.rejected / np.maximum(self.spent, 1e-9)
            self.rules = tuple(self.rules[k] for k in np.argsort(-worth, kind="stable"))
        return out


def cascade_reject(features: Features, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which rows some rule rejects; later rules see only what earlier ones left."""
    rejected = np.zeros(features.n, dtype=bool)
    rows, now = np.arange(features.n), features
    for rule in rules:
        if not len(rows):
            break
        hit = np.asarray(rule.rejects(now), dtype=bool)
        rejected[rows[hit]] = True
        if hit.any():
            left = np.flatnonzero(~hit)
            now, rows = now.narrow(left), rows[left]
    return rejected


def score(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, the measured features, base_failed and kept, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in batches:
            for at, data, offsets in textvec.blocks(batch.column("text")):
                f = Features(data, offsets)
                features = [pa.array(x, pa.int64()) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)]
                base = (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, f.n), *features, pa.array(base), pa.array(~base & ~cascade.rejects(data, offsets, f))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in batches:
            alive = np.zeros(batch.num_rows, dtype=bool)
            for at, data, offsets in textvec.blocks(batch.column("text")):
                alive[at : at + len(offsets) - 1] = ~cascade.rejects(data, offsets)
            yield batch.filter(pa.array(alive))

    return docs.mapInArrow(tidy(run), docs.schema)
