"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are cut into pre-tokens in blocks of about BLOCK_CHARS characters.  A block
   keeps, for every position, the number of its word in the block's own word list
   (most frequent first, so the numbers compress well), and lists each word once.
2. The word lists are dealt by a hash of the word; a task encodes each distinct word it
   meets once and sends its ids back to the blocks that asked.
3. Ids meet positions by block and texts are reassembled in order.  Decoding joins
   the token-byte table, which has one row a token of the vocabulary and is
   broadcast for that reason.

So words cross the network once a block and not once an occurrence, texts never
do, and a word that is everywhere costs one entry a block.  Step 1 is written
once, bucketed by block: both uses agree on word numbers although executors may
be lost, and positions need no shuffle.  The result is written too; the bucketed
table and the broadcasts go as soon as it stands.

The library encodes a word as one piece: the pattern it is given matches any text whole.

Defined results: null text is empty and has no tokens; the empty text too; empty
tables give no rows; repeated rows are encoded one by one, rows with a null doc_id as
well; a text of any length is encoded whole (a very long one is a block of its own);
only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from terrazzo.llm.storage import drop, written, written_by
from terrazzo.llm.workers import tidy

#: Characters of a block: what one task holds at once, with its distinct words.
BLOCK_CHARS = 8 << 20
#: Encoded words that a task remembers; beyond that it starts anew (more work, same ids).
WORD_CACHE = 200_000
#: A pattern under which any text is one piece.
_WHOLE = r"(?s:.+)"

_TABLE = "block long, part int, doc_ids array<long>, counts array<long>, payload binary, dealt binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned integer columns, compressed by byte planes; empty upper planes cost nothing."""
    head = b"".join(c.dtype.char.encode() + len(c).to_bytes(8, "big") for c in columns)
    body = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(columns).to_bytes(1, "big") + head + len(body).to_bytes(8, "big") + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    heads = [(np.dtype(chr(data[at])), int.from_bytes(data[at + 1 : at + 9], "big")) for at in range(1, 1 + 9 * data[0], 9)]
    at = 1 + 9 * data[0]
    body = np.frombuffer(pa.Codec("zstd").decompress(data[at + 8 :], decompressed_size=int.from_bytes(data[at : at + 8], "big")), dtype=np.uint8)
    out, at = [], 0
    for kind, n in heads:
        out.append(np.ascontiguousarray(body[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def pack_words(words: list[str]) -> bytes:
    said = [w.encode() for w in words]
    return pack(np.fromiter(map(len, said), np.uint32, len(said)), np.frombuffer(b"".join(said), dtype=np.uint8))


def unpack_words(data: bytes) -> list[str]:
    size, said = unpack(data)
    said, to = said.tobytes(), np.cumsum(size, dtype=np.int64)
    return [said[a:b].decode() for a, b in zip((to - size).tolist(), to.tolist(), strict=True)]


def _numbers(text: str, found: Callable, number: dict[str, int]) -> array:
    """The word numbers of a text; unseen words get the next ones."""
    out = array("I")
    if len(text) < 1 << 20:
        out.extend([number.setdefault(w, len(number)) for w in found(text)])
    else:  # a very long text goes word by word
        for m in found.__self__.finditer(text):
            out.append(number.setdefault(m.group(), len(number)))
    return out


def tokenise_blocks(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """Step 1: per block a row of positions (part -1), with the part that each word is dealt to, and a row of words for each part."""

    def block_rows(block: int, ids: list, counts: list, positions: array, number: dict[str, int]) -> Iterator[tuple]:
        at = np.frombuffer(positions, dtype=np.uint32) if len(positions) else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
        rank = np.empty(len(number), dtype=np.uint32)
        rank[order] = np.arange(len(number), dtype=np.uint32)
        words = list(number)
        words = [words[k] for k in order.tolist()]
        part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), dtype=np.uint32, count=len(words))
        yield block, -1, ids, counts, pack(rank[at]), pack(part)
        by = np.argsort(part, kind="stable")
        number, first = np.unique(part[by], return_index=True)
        for r, mine in zip(number.tolist(), np.split(by, first[1:]), strict=True):
            yield block, r, [], [], pack_words([words[k] for k in mine.tolist()]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        found, base, made = regex.compile(pattern).findall, TaskContext.get().partitionId() << 24, 0
        ids, counts, positions, number, held = [], [], array("I"), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = block_rows(base + made, ids, counts, positions, number)
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "part", "doc_ids", "counts", "payload", "dealt"])

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(doc_ids, batch.column("text"), strict=True):
                text = text.as_py() or ""
                got = _numbers(text, found, number)
                ids.append(doc_id)
                counts.append(len(got))
                positions.extend(got)
                held += len(text) + 16
                if held >= BLOCK_CHARS:
                    yield from flush()
                    made += 1
                    ids, counts, positions, number, held = [], [], array("I"), {}, 0
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _TABLE)


def _encode_words(words: DataFrame, ranks) -> DataFrame:
    """Step 2: the ids of each listed word, each distinct word encoded once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=_WHOLE, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, part, payload in zip(batch.column("block"), batch.column("part"), batch.column("payload"), strict=True):
                if len(known) > WORD_CACHE:
                    known.clear()
                ids = []
                for w in unpack_words(payload.as_py()):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                packed = pack(counts, np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([part.as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["block", "part", "ids"])

    return words.select("block", "part", "payload").mapInArrow(tidy(run), "block long, part int, ids binary")


class Block:
    """A block's documents with, for each word number, its ids."""

    def __init__(self, row: dict, table: list[bytes]):
        (self.at,), (dealt,) = unpack(row["payload"]), unpack(row["dealt"])
        self.doc_ids, self.counts, self.table = row["doc_ids"], row["counts"], table
        self.ids: list = [None] * len(dealt)
        by = np.argsort(dealt, kind="stable")
        number, first = np.unique(dealt[by], return_index=True)
        mine = dict(zip(number.tolist(), np.split(by, first[1:]), strict=True))
        for answer in row["ids"] or ():
            counts, ids = unpack(answer["ids"])
            to, ids = np.cumsum(counts, dtype=np.int64), ids.tolist()
            for k, a, b in zip(mine[answer["part"]].tolist(), (to - counts).tolist(), to.tolist(), strict=True):
                self.ids[k] = ids[a:b]

    def documents(self) -> Iterator[tuple[int | None, list[int]]]:
        """(doc_id, word numbers in order)."""
        to = np.cumsum(self.counts)
        for doc_id, a, b in zip(self.doc_ids, (to - self.counts).tolist(), to.tolist(), strict=True):
            yield doc_id, self.at[a:b].tolist()

    def decoded(self) -> list[bytes]:
        """The bytes of each word, from its ids by the token-byte table."""
        table = self.table
        return [b"".join([table[i] for i in ids]) for ids in self.ids]


def _whole(block: Block) -> Iterator[tuple]:
    said = block.decoded()
    for doc_id, words in block.documents():
        ids = [i for w in words for i in block.ids[w]]
        yield doc_id, len(ids), ids, b"".join([said[w] for w in words]).decode()


def _digests(block: Block) -> Iterator[tuple]:
    said = block.decoded()
    listed = [" ".join(map(str, ids)).encode() for ids in block.ids]
    sizes = [len(ids) for ids in block.ids]
    for doc_id, words in block.documents():
        text = b"".join(map(said.__getitem__, words))
        ids = b" ".join(map(listed.__getitem__, words))
        yield doc_id, sum(map(sizes.__getitem__, words)), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


def _run(docs: DataFrame, path: str, pattern: str, finish: Callable[[Block], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the input
    table = written_by(tokenise_blocks(docs, pattern, parts), "block", "bpe", compression="none")
    words = table.where("part >= 0").select("block", "part", "payload").repartitionById(parts, F.col("part"))
    encoded = _encode_words(words, shared).groupBy("block").agg(F.collect_list(F.struct("part", "ids")).alias("ids"))
    positions = table.where("part = -1").select("block", "doc_ids", "counts", "payload", "dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        by_id: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for row in finish(Block({n: batch.column(n)[k].as_py() for n in batch.schema.names}, by_id)):
                    rows.append(row)
                    held += 200 + 4 * row[1]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    joined = positions.join(encoded, "block", "left").select("doc_ids", "counts", "payload", "dealt", "ids")
    result = written(joined.mapInArrow(tidy(run), from_arrow_schema(schema)), "bpe-result")
    drop(table)
    shared.destroy()
    return result


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _run(docs, path, pattern, _whole, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, by spaces) and of the decoded bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _run(docs, path, pattern, _digests, schema)
