"""One large FeatureCollection read by many tasks.

Spark's text reader cuts a file into byte ranges wherever records end; with ``}`` as the end of a record it cuts any
document, with line breaks or without.  Two passes follow:

1. Every range says what it does to the state of a reader: whether a string is open, how deep the nesting is, and
   whether that is inside the root's ``features``.  It does not know its own beginning, so it answers for both states of a
   string, and relative to an unknown depth.  One row a range composes, in file order, to every range's beginning.
2. Every range cuts its elements of ``features`` at the commas between them.  What begins in one range and ends in another
   is put together from its pieces, by the range that it begins in.

Text outside of ``features`` is the rest of the document, one record.  Ranges are known by file and place, so a range that
is read again after a loss is the same range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.session import written

_KEY = re.compile(rb'"features"\s*:\s*$')
_ROOT = re.compile(rb"(?:\xef\xbb\xbf)?[ \t\r\n]*\{")
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[ord("["), ord("{")]] = 1
_CLOSE[[ord("]"), ord("}")]] = 1
_BLANK = b" \t\r\n"


@dataclass(frozen=True)
class State:
    """Of a reader between two records: an open string, the depth, and whether that is inside the root's features."""

    string: bool = False
    depth: int = 0
    inside: bool = False


def _strings(data: np.ndarray, open_: bool) -> tuple[np.ndarray, bool]:
    """Which bytes stand in a string (its quotes included), and whether one is open at the end."""
    quote = data == ord('"')
    slash = data == ord("\\")
    if slash.any():  # a quote after an odd run of backslashes is none
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte before that is no backslash
        before = np.concatenate([[-1], last[:-1]])
        quote &= (at - 1 - before) % 2 == 0
    count = np.cumsum(quote) + open_
    return (count % 2 == 1) | quote, bool(len(count) and count[-1] % 2) if len(count) else open_


class Shape:
    """Depth after every byte, from ``start``, of a text that begins in a string or not."""

    def __init__(self, text: bytes, string: bool, start: int):
        self.text, self.data = text, np.frombuffer(text, np.uint8)
        held, self.string = _strings(self.data, string)
        self.free = ~held
        step = np.where(self.free, _OPEN[self.data] - _CLOSE[self.data], 0)
        self.depth = np.cumsum(step, dtype=np.int64) + start
        self.opens = np.flatnonzero(step > 0)

    def named(self, at: int) -> bool:
        """Whether the bracket that opens here is the value of ``features``."""
        return self.data[at] == ord("[") and _KEY.search(self.text, max(0, at - 256), at) is not None


class Effect:
    """What a range does, relative to its beginning: ``lowest`` depth, ``delta`` in the end, and whether the last way up from the lowest is into features.

    A file's first range is counted from inside the root.
    """

    def __init__(self, string: bool, first: bool = False):
        self.string, self.delta, self.lowest, self.named, self.first = string, 0, 0, False, first

    def feed(self, text: bytes) -> None:
        if self.first and (root := _ROOT.match(text)):
            self.first, self.delta, self.lowest, text = False, 1, 1, text[root.end() :]
        shape = Shape(text, self.string, self.delta)
        self.string = shape.string
        if not len(shape.depth):
            return
        least = int(shape.depth.min())
        if least <= self.lowest or self.delta == self.lowest:
            start = -1
            if least <= self.lowest:
                self.lowest, self.named = least, False
                start = int(np.flatnonzero(shape.depth == least)[-1])
            later = shape.opens[shape.opens > start]
            if len(later):
                self.named = shape.named(int(later[0]))
        self.delta = int(shape.depth[-1])

    def after(self, state: State) -> State:
        depth = state.depth + self.delta
        if state.depth + self.lowest > 1:  # the root's own level was never reached
            return State(self.string, depth, state.inside)
        # from the root's level the last way up leads into features or into something else
        return State(self.string, depth, self.named and state.depth + self.lowest == 1 and depth > 1)


class Cutter:
    """Elements of ``features`` in a range that begins in ``state``: (kind, text) with kind l (ends what began before), e, t (begins what ends later), o (outside)."""

    def __init__(self, state: State):
        self.state, self.held, self.begun = state, [], state.inside

    def feed(self, text: bytes) -> Iterator[tuple[str, bytes]]:
        shape = Shape(text, self.state.string, self.state.depth)
        inside, at = self.state.inside, 0
        edges = np.flatnonzero(shape.free & ((shape.data == ord(",")) & (shape.depth == 2) | (_OPEN[shape.data] > 0) & (shape.depth == 2) | (_CLOSE[shape.data] > 0) & (shape.depth == 1)))
        for k in edges.tolist():
            byte = shape.data[k]
            if inside and (byte == ord(",") or _CLOSE[byte]):
                yield from self._element(text[at:k])
                at = k + 1
                if byte != ord(","):
                    inside, at = False, k
            elif not inside and byte != ord(",") and shape.named(k):
                yield "o", text[at : k + 1]
                inside, at, self.begun = True, k + 1, False
        if inside:
            self.held.append(text[at:])
        else:
            yield "o", text[at:]
        self.state = State(shape.string, int(shape.depth[-1]) if len(shape.depth) else self.state.depth, inside)

    def _element(self, text: bytes) -> Iterator[tuple[str, bytes]]:
        whole = b"".join([*self.held, text])
        self.held = []
        if self.begun:
            yield "l", whole
            self.begun = False
        elif whole.strip(_BLANK):
            yield "e", whole

    def end(self) -> Iterator[tuple[str, bytes]]:
        """What is open at the end of the range."""
        rest = b"".join(self.held)
        if self.state.inside and rest.strip(_BLANK):
            yield ("l" if self.begun else "t"), rest


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, place, text) in order; a range comes in several pieces."""
    for batch in batches:
        files, places = batch.column("file").to_pylist(), batch.column("place").to_numpy()
        values = batch.column("value").to_pylist()
        at = 0
        while at < len(values):
            to = at + 1
            while to < len(values) and places[to] == places[at] and files[to] == files[at]:
                to += 1
            yield files[at], int(places[at]), ("}".join(values[at:to]) + "}").encode()
            at = to


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place of the range, value) of the text between closing braces."""
    rows = spark.read.text(path, lineSep="}")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), "value")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, found = None, None

    def row() -> pa.RecordBatch:
        cells = [[now[0]], [now[1]], *[[v] for e in found for v in (e.string, e.delta, e.lowest, e.named)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _EFFECT_TYPES, strict=True)], names=_EFFECT_NAMES)

    for file, place, text in _ranges(batches):
        if (file, place) != now:
            if now:
                yield row()
            now, found = (file, place), (Effect(False, place == 0), Effect(True))
        for effect in found:
            effect.feed(text)
    if now:
        yield row()


_EFFECT = "file string, place long, " + ", ".join(f"string{k} boolean, delta{k} long, lowest{k} long, named{k} boolean" for k in range(2))
_EFFECT_NAMES = [c.split()[0] for c in _EFFECT.split(", ")]
_EFFECT_TYPES = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64(), pa.bool_()] * 2]
_PIECE = "file string, place long, seq int, at long, kind string, text string"
_PIECE_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())


def _begins(rows: list) -> tuple[dict[tuple[str, int], State], dict[str, State]]:
    """The state at every range's beginning, and at every file's end."""
    begins, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r["file"], r["place"])):
        state = begins[r["file"], r["place"]] = ends.get(r["file"], State())
        k = int(state.string)
        effect = Effect(False)
        effect.string, effect.delta, effect.lowest, effect.named = r[f"string{k}"], r[f"delta{k}"], r[f"lowest{k}"], r[f"named{k}"]
        ends[r["file"]] = effect.after(state)
    return begins, ends


def _cut(batches: Iterator[pa.RecordBatch], begins: dict[tuple[str, int], State]) -> Iterator[pa.RecordBatch]:
    """Pieces of every range, each with its place in the range (``seq``) and the number of elements begun before it (``at``)."""
    now, cutter, seq, made = None, None, 0, 0

    def rows(pieces: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        nonlocal seq, made
        out = []
        for kind, text in pieces:
            out.append((*now, seq, made, kind, text.decode("utf-8", "replace")))
            seq, made = seq + 1, made + (kind in "et")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

    for file, place, text in _ranges(batches):
        if (file, place) != now:
            if now:
                yield from rows(cutter.end())
            now, seq, made = (file, place), 0, 0
            cutter = Cutter(begins[now])
        yield from rows(cutter.feed(text))
    if now:
        yield from rows(cutter.end())


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, documents): every element of every document's ``features`` (file, position from 0, text), and what else the documents say (file, text).

    A document that does not end where its root does is malformed as a whole: it has no elements, and its text says so.
    """
    records = _records(spark, path)
    begins, ends = _begins(records.mapInArrow(_effects, _EFFECT).collect())  # one row a range
    states = spark.sparkContext.broadcast(begins)
    pieces = written(records.mapInArrow(lambda batches: _cut(batches, states.value), _PIECE), "document-pieces")

    counts = pieces.groupBy("file", "place").agg(F.sum(F.col("kind").isin("e", "t").cast("long")).alias("made"), F.max(F.when(F.col("kind") == "t", F.col("at"))).alias("open"))
    places, begun, open_at = [], {}, {}
    for r in sorted(counts.collect(), key=lambda r: (r["file"], r["place"])):  # one row a range
        file, base = r["file"], begun.get(r["file"], 0)
        end = ends[file]
        # the last record's brace is one that the file has not, where the root ended before
        places.append((file, r["place"], base, open_at.get(file), end.string or end.depth not in (0, -1), end.depth == -1))
        begun[file] = base + r["made"]
        if r["open"] is not None:
            open_at[file] = base + r["open"]
    known = spark.createDataFrame(places, "file string, place long, base long, origin long, broken boolean, longer boolean")
    held = pieces.join(F.broadcast(known), ["file", "place"])

    sound = held.where("not broken and kind <> 'o'").withColumn("position", F.when(F.col("kind") == "l", F.col("origin")).otherwise(F.col("base") + F.col("at")))
    whole = sound.where("kind = 'e'").select("file", "position", "text")
    over = sound.where("kind <> 'e'").groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("place", "seq", "text"))).alias("parts"))  # two pieces a range at most
    rest = held.where("kind = 'o'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "seq", "text"))).alias("parts"), F.max("broken").alias("broken"), F.max("longer").alias("longer"))
    said = F.array_join(F.col("parts.text"), "")
    text = F.when(F.col("broken"), F.concat(said, F.lit(" (the document does not end)"))).when(F.col("longer"), F.substring(said, F.lit(1), F.length(said) - 1)).otherwise(said)
    return whole.unionByName(over.select("file", "position", F.array_join(F.col("parts.text"), "").alias("text"))), rest.select("file", text.alias("text"))
