"""Substring deduplication by difference-cover anchors.

A window is ``width`` consecutive words of one document; a word goes when a window over it
also starts earlier (in a document with a smaller doc_id, or earlier in its own document).

Two equal windows need not stand at the same place modulo anything, yet a difference cover
of a period holds two members at every distance: so for some step below the period both
windows, moved by it, stand on cover positions.  Runs of ``width - period + 1`` words at
cover positions, the anchors, therefore meet in any two equal windows, and of all positions
only the cover's share is hashed and sent (4 of 13 for windows of 20 words).

1. Texts are written once in blocks of about BLOCK_BYTES, bucketed by block.  Each block
   sends its distinct anchors, dealt by hash; the answer is a bit an anchor: does it stand
   twice or more in the corpus?
2. Around anchors that do, matches are extended to whole windows: each block sends the
   distinct windows over such an anchor, named by 96 bits, with the smallest doc_id that
   has it there.  The answer is a bit a window: has another block a smaller one?
3. Windows inside a block are compared there; with the answers every block knows which of
   its words go.

So a passage that is everywhere costs an entry a block and not one an occurrence, no pairs
are made, texts never cross the network, and answers are bits.  A dealt part holds some
PART_ENTRIES entries, as counted before.  The result is written, and the other tables go.

Defined results: null text and text without words have no words, and none are removed;
texts of fewer words than ``width`` lose nothing; empty tables give no rows; rows with a
null doc_id come after all others; rows that share a doc_id are separate documents, neither
earlier than the other, so repeated rows have equal results; equal windows of one document
are told apart by their starts, so there are no ties; texts of any length are read whole, a
long one is a block of its own; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm import textvec
from terrazzo.llm.bpe import pack, unpack
from terrazzo.llm.storage import drop, written, written_by
from terrazzo.llm.workers import tidy

WIDTH = 20
#: Bytes of text in a block, entries in a dealt part, and words copied together at once.
BLOCK_BYTES, PART_ENTRIES, COPIED_WORDS = (2 << 20) - 64, 1 << 20, 1 << 17
#: By period, the smallest sets that hold two members at every distance.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: A null doc_id is judged as the largest.
_LAST = np.iinfo(np.int64).max
#: Two pairs of odd factors, for two independent hashes of a run.
_FACTORS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def period_of(width: int) -> int:
    """The longest period that leaves anchors of a third of the window."""
    return max(p for p in COVERS if p == 1 or 3 * p <= 2 * width)


def runs(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` word hashes, by joining runs of powers of two."""
    left, right = (np.uint64(x) for x in _FACTORS[salt])
    join = lambda a, b: textvec.mix(a[: len(b)] * left + b * right)
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, size, piece, step = None, 0, h, 1
    while True:
        if width & step:
            out = piece if out is None else join(out, piece[size:])
            size += step
        if size == width:
            return out
        piece = join(piece, piece[step:])
        step *= 2


class Block:
    """The words of a block's texts, its distinct anchors and the windows over shared ones."""

    def __init__(self, texts: pa.Array, width: int):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
        self.words = textvec.Words(self.data, at - at[0])
        self.width, self.period = width, period_of(width)
        self.hashes = textvec.span_hashes(self.data, self.words.start, self.words.end)

    def _inside(self, n: int) -> np.ndarray:
        """Which words begin a run of ``n`` words of one document."""
        doc = self.words.doc
        inside = np.zeros(len(doc), dtype=bool)
        if len(doc) >= n:
            inside[: len(doc) - n + 1] = doc[: len(doc) - n + 1] == doc[n - 1 :]
        return inside

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors in order, how often each stands here, its number for each cover position); sets ``covered``."""
        size = self.width - self.period + 1
        place = np.arange(len(self.words.doc)) - self.words.first[self.words.doc]
        cover = np.zeros(self.period, dtype=bool)
        cover[list(COVERS[self.period])] = True
        self.covered = np.flatnonzero(cover[place % self.period] & self._inside(size))
        found, number, count = np.unique(runs(self.hashes, size)[self.covered], return_inverse=True, return_counts=True)
        return found, count, number

    def windows(self, shared: np.ndarray) -> None:
        """Keeps the windows over a cover position marked in ``shared``: ``at`` (words) in the order of their names, and the names ``name`` and ``check``."""
        marks = np.zeros(len(self.words.doc) + self.period + 1, dtype=np.int32)
        marks[self.covered[shared] + 1] = 1
        np.cumsum(marks, out=marks)
        near = marks[self.period : self.period + len(self.words.doc)] > marks[: len(self.words.doc)]
        at = np.flatnonzero(near & self._inside(self.width))
        name, check = runs(self.hashes, self.width)[at], runs(self.hashes, self.width, 1)[at] >> np.uint64(32)
        ids = self.ids[self.words.doc[at]]
        order = np.lexsort((at, ids, check, name))
        self.at, self.name, self.check, self.of = at[order], name[order], check[order].astype(np.uint32), ids[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.check[1:] != self.check[:-1])
        self.group, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        # of a group's windows the first of each document with the smallest doc_id stay, as far as this block knows
        doc = self.words.doc[self.at]
        again = np.zeros(len(order), dtype=bool)
        again[1:] = ~new[1:] & (doc[1:] == doc[:-1])
        self.repeated = again | (self.of > self.of[self.first][self.group])

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Which words go, where ``earlier`` marks the distinct windows that another block has of a smaller doc_id."""
        edge = np.zeros(len(self.words.doc) + 1, dtype=np.int32)
        gone = self.at[self.repeated | earlier[self.group]]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.width, -1)
        return np.cumsum(edge[:-1]) > 0

    def kept(self, removed: np.ndarray) -> pa.Array:
        """Each text's words that stay, joined by one space."""
        stay = np.flatnonzero(~removed)
        size = self.words.end[stay] - self.words.start[stay] + 1  # with the space after it
        doc = self.words.doc[stay]
        last = np.ones(len(stay), dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        padded, pieces = np.append(self.data, np.uint8(0x20)), []
        for k in range(0, len(stay), COPIED_WORDS):
            of = slice(k, k + COPIED_WORDS)
            to = np.cumsum(size[of])
            said = padded[np.repeat(self.words.start[stay[of]] - (to - size[of]), size[of]) + np.arange(to[-1])]
            said[to - 1] = 0x20
            pieces.append(np.delete(said, to[last[of]] - 1))
        total = np.bincount(doc, weights=size - last, minlength=len(self.words.count)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(total)])
        body = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_string(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def block_rows(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_ids, texts, n_words) of about BLOCK_BYTES of text each, numbered from ``block``."""
    ids, texts = batch.column("doc_id"), batch.column("text")
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
        mine = texts.slice(at, to - at)
        n_words = sum(int(textvec.Words(data, offsets).count.sum()) for _, data, offsets in textvec.blocks(mine))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), _listed(ids.slice(at, to - at)), _listed(mine.cast(pa.string())), pa.array([n_words], pa.int64())],
            names=["block", "doc_ids", "texts", "n_words"],
        )
        block, at = block + 1, to


def _blocks(docs: DataFrame) -> DataFrame:
    """The texts in blocks, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in block_rows(batch, block):
                yield row
                block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "block long, doc_ids array<long>, texts array<string>, n_words long")


def _listed(values: pa.Array) -> pa.Array:
    """One list that holds all of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = Block(batch.column("texts")[k].values, width)
            ids = batch.column("doc_ids")[k].values
            block.doc_ids, block.ids = ids, pc.fill_null(ids, _LAST).to_numpy(zero_copy_only=False)
            yield batch, k, block


def _answers(asked: DataFrame, answer: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> DataFrame:
    """(block, answers): for every block its parts' answers, a bit an entry, from (part, block, payload)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        packed = table.column("payload").to_pylist()
        bits = answer([unpack(x) for x in packed])
        return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})

    told = asked.groupBy("part").applyInArrow(run, "block long, part int, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))


def _bits(answers, sizes: dict[int, int]) -> np.ndarray:
    """A block's answers in the order of its sorted entries; ``sizes``: entries asked by part."""
    told = {a["part"]: a["bits"] for a in answers or ()}
    pieces = [np.unpackbits(np.frombuffer(told[p], np.uint8), count=n).astype(bool) for p, n in sorted(sizes.items())]
    return np.concatenate(pieces) if pieces else np.zeros(0, dtype=bool)


def _cut(hashes: np.ndarray, parts: int) -> dict[int, slice]:
    """Sorted hashes dealt by their upper bits: the parts that have any, with their ranges."""
    part, first = np.unique(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), return_index=True)
    return {int(p): slice(a, b) for p, a, b in zip(part.tolist(), first.tolist(), np.append(first[1:], len(hashes)).tolist())}  # noqa: B905 nothing has no parts


def _asks(block: pa.Scalar, cut: dict[int, slice], columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    rows = [(p, block.as_py(), pack(*[c[of] for c in columns])) for p, of in cut.items()]
    part, number, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(number, pa.int64()), pa.array(payload, pa.binary())], names=["part", "block", "payload"])


_ASKED = "part int, block long, payload binary"


def _twice(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per block: which anchors stand twice, in it or in two blocks."""
    sizes = [len(h) for h, _ in asked]
    hashes, often = np.concatenate([h for h, _ in asked]), np.concatenate([n for _, n in asked]) > 1
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return np.split(often, np.cumsum(sizes)[:-1])


def _smaller(asked: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per block: which windows another block has of a smaller doc_id."""
    sizes = [len(x[0]) for x in asked]
    name, check, ids = (np.concatenate([x[k] for x in asked]) for k in range(3))
    order = np.lexsort((check, name))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = least < ids[order]
    return np.split(out, np.cumsum(sizes)[:-1])


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every document."""
    if width < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    blocks = written_by(_blocks(docs), "block", "substring-blocks")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PART_ENTRIES))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, block in _each(batches, width):
            found, count, _ = block.anchors()
            if len(found):
                yield _asks(batch.column("block")[k], _cut(found, parts), (found, np.minimum(count, 2).astype(np.uint8)))

    def extended(batch: pa.RecordBatch, k: int, block: Block) -> dict[int, slice]:
        """Keeps the block's windows over shared anchors; how its distinct ones are dealt."""
        found, _, number = block.anchors()
        shared = _bits(batch.column("shared")[k].as_py(), {p: of.stop - of.start for p, of in _cut(found, parts).items()})
        block.windows(shared[number])
        return _cut(block.name[block.first], parts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, block in _each(batches, width):
            cut = extended(batch, k, block)
            if cut:
                yield _asks(batch.column("block")[k], cut, tuple(x[block.first] for x in (block.name, block.check, block.of)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, block in _each(batches, width):
            cut = extended(batch, k, block)
            earlier = _bits(batch.column("earlier")[k].as_py(), {p: of.stop - of.start for p, of in cut.items()})
            removed = block.removed(earlier)
            counts = [block.words.count, np.bincount(block.words.doc[removed], minlength=len(block.words.count))]
            yield pa.RecordBatch.from_arrays(
                [block.doc_ids, *[pa.array(c, pa.int64()) for c in counts], block.kept(removed).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    texts = blocks.select("block", "doc_ids", "texts")
    shared = written(_answers(texts.mapInArrow(tidy(anchors), _ASKED), _twice), "substring-shared")
    near = texts.join(shared.withColumnRenamed("answers", "shared"), "block", "left")
    earlier = written(_answers(near.mapInArrow(tidy(windows), _ASKED), _smaller), "substring-earlier")
    both = near.join(earlier.withColumnRenamed("answers", "earlier"), "block", "left")
    result = written(both.mapInArrow(tidy(finish), "doc_id long, n_words long, n_removed long, kept string"), "substring-result")
    drop(blocks, shared, earlier)
    return result
