"""Fill-in-the-middle transformation.

The tokenizers library's Split pre-tokenizer, with the matches of UNIT isolated, cuts a
text into units and gives their code-point offsets; nothing is trained.  The number of
offsets is ``n``; two hashes of the doc_id choose two ranks among them, and the offsets at
these ranks are where the text is sliced into prefix, middle and suffix.  The hashes are
Spark expressions, and so is the way back from an output to its text (``restored``).

Texts over SEGMENT characters are cut segment by segment, between units, so that a task
holds the offsets of one segment and not of a whole text; a rank's segment is cut again to
find the rank's offset.

Defined results: null text is empty; the empty text is ``plain`` and has no units; a text
that holds a marker is ``plain``, so outputs can always be read back; a null doc_id is
hashed as no digits; empty tables give no rows; repeated rows get equal outputs; texts of
any length are cut whole; only doc_id and text are read, whatever other columns are called.
There are no ties: two equal ranks leave an empty middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.workers import tidy

#: A unit, and the marks of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents left plain, and percent of the others that begin with the suffix.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Characters whose offsets a task holds at once, and characters of output in a batch.
SEGMENT, HELD = 1 << 17, 4 << 20

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def splitter():
    """The pre-tokenizer: every match of UNIT is a piece of its own."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNIT), "isolated")


class Units:
    """The units of a text: how many there are, and where a number of them ends."""

    _LETTERS = re.compile("[A-Za-z]+")

    def __init__(self, text: str, split, segment: int = SEGMENT):
        self.text, self.split = text, split
        self.cuts = [0]
        while self.cuts[-1] < len(text):
            self.cuts.append(self._cut(self.cuts[-1] + segment))
        self._last = (-1, np.zeros(0, np.int64))
        self.before = np.cumsum([0, *(len(self._ends(k)) for k in range(len(self.cuts) - 1))])

    def _cut(self, at: int) -> int:
        """``at``, or the end of the letters that it would cut through."""
        if at >= len(self.text):
            return len(self.text)
        run = self._LETTERS.match(self.text, at - 1)
        return run.end() if run else at

    def _ends(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            start = self.cuts[k]
            pieces = self.split.pre_tokenize_str(self.text[start : self.cuts[k + 1]])
            self._last = (k, start + np.array([to for _, (_, to) in pieces], dtype=np.int64))
        return self._last[1]

    def __len__(self) -> int:
        return int(self.before[-1])

    def end(self, rank: int) -> int:
        """The code point after the first ``rank`` units."""
        if rank == 0:
            return 0
        k = int(np.searchsorted(self.before, rank, side="left")) - 1
        return int(self._ends(k)[rank - int(self.before[k]) - 1])


def arrange(text: str, h: tuple[int, int, int, int], split, plain_percent: int, suffix_first_percent: int, segment: int = SEGMENT) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text under its four hashes."""
    units = Units(text, split, segment)
    n = len(units)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = units.end(first), units.end(last)
    if h[3] % 100 < suffix_first_percent:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, h in zip(batch.column("doc_id"), batch.column("text"), batch.column("h"), strict=True):
                text = text.as_py() or ""
                rows.append((doc_id.as_py(), *arrange(text, h.as_py(), split, plain_percent, suffix_first_percent)))
                held += len(text)
                if held > HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    hashes = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), hashes.alias("h")).mapInArrow(tidy(run), _SCHEMA)


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def parts(marks: tuple[str, str, str]) -> list[Column]:
        """What stands after each mark; no part holds a mark, so each ends where the next begins."""
        rest, found = F.substr(output, F.lit(len(marks[0]) + 1)), []
        for mark in marks[1:]:
            part = F.substring_index(rest, mark, 1)
            found.append(part)
            rest = F.substr(rest, F.length(part) + len(mark) + 1)
        return [*found, rest]

    prefix, suffix, middle = parts((PREFIX, SUFFIX, MIDDLE))
    suffix2, prefix2, middle2 = parts((SUFFIX, PREFIX, MIDDLE))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
