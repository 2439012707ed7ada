"""Near duplicates: an exact Jaccard self-join on word shingles, by prefixes under several global orders.

A document's set is its distinct 5-word shingles (64-bit hashes); documents with
equal sets are one node from the start, named by a hash of the set, so a group of
copies costs one entry a task.  A second hash of every set is compared beside the
name: should two different sets ever share a name, all names are drawn anew.  Two
nodes link when 7 |A n B| >= 3 (|A| + |B|), that is Jaccard >= 3/4.

Under any global order of shingles, linked sets share one within their prefixes,
the first ``n - ceil(3n/4) + 1``; and of their first common shingle, at least
``3 (|A| + |B|) / 7`` stand at or after it in both.  That holds for every order at
once.  So pairs are formed from the buckets (shared prefix shingles) of the first
order, where that bound admits them, and every pair must then share a prefix shingle
under each of the other ORDERS - 1 orders too before a text is looked at.  Each order
sorts shingles by how frequent they are among all documents, so boilerplate comes
last, and by a hash of its own among equals.

The first order's prefixes cross the network once, as sorted packed columns dealt by
ranges of shingles; a range holds a bounded number of entries, as counted before.
Rows of one set alone, and rows that no other member of their bucket can be admitted
with, end there.  The other orders' prefixes are made for sets in the remaining rows
only, and travel beside their texts.

Frequencies are counted by task chunks and summed; the table of frequent shingles
has at most HOT_TOKENS rows (it is broadcast), and their buckets are joined apart, with
leads summed before the shuffle.  A shingle missing from it is merely sorted as rare:
any order is a right order, so this bound costs nothing but time.

Large groups never become all pairs.  First every bucket is tied to its most central
member: these pairs are verified and give components.  Then pairs are formed only
between different components of a bucket, of members outside its largest component
with all others: no link between components can be missed, and links inside one would
not change it.

Defined results: null or blank texts have no shingles and link with nothing;
texts with 1 to 4 words have one shingle, the whole sequence; empty tables give no
rows; repeated rows belong to one class, and rows with a null doc_id have the class's
smallest doc_id that is not null; texts of any length are read whole.  Only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from terrazzo.llm import graph, textvec
from terrazzo.llm.storage import Bitmap, drop, unbucketed, unused, written, written_by
from terrazzo.llm.workers import tidy

WIDTH = 5
ORDERS = 2
#: Rows of the frequent-shingle table.
HOT_TOKENS = 1 << 20
#: A shingle is counted as frequent where it is in this many documents of a chunk.
CHUNK_DOCS, CHUNK_TOKENS = 3, 4_000_000
#: Prefix entries of one range of shingles, and those that a task holds before it sends them; more only beyond MOST_RANGES.
RANGE_ENTRIES, MOST_RANGES = 1 << 19, 1 << 15
#: Pairs of one set beyond which its joins are dealt anew and split.
MOST_PAIRS = 1 << 13
#: Sets that a task remembers to have seen (it sends a set again after that), and shingles that a verifying task keeps.
SEEN_SETS, KEPT_TOKENS = 1 << 20, 4 << 20


class Sets:
    """The shingle sets of a block: ``tokens`` sorted inside each document, ``at`` the documents' bounds.

    ``sig`` names a set and ``check`` is a second hash of it, both drawn by ``salt``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salt: int = 0):
        low = textvec.lowered(data)
        w = textvec.Words(low, offsets)
        h = textvec.span_hashes(low, w.start, w.end)
        run = textvec.windows(h, WIDTH) + np.uint64(WIDTH)
        parts = [np.zeros(0, np.uint64)]
        at = np.zeros(len(offsets), dtype=np.int64)
        for d, (a, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=False)):
            if n >= WIDTH:
                x = np.sort(run[a : a + n - WIDTH + 1])
                if len(x) > 1:
                    fresh = np.empty(len(x), dtype=bool)
                    fresh[0] = True
                    np.not_equal(x[1:], x[:-1], out=fresh[1:])
                    x = x[fresh]
            else:  # a text shorter than WIDTH words is one shingle: all its words
                x = textvec.windows(h[a : a + n], n) + np.uint64(n) if n else parts[0]
            parts.append(x)
            at[d + 1] = len(x)
        self.tokens, self.at = np.concatenate(parts), np.cumsum(at)
        self.size = np.diff(self.at)
        self.sig = self._digest(0x51 + 2 * salt)
        self._salt = salt

    def _digest(self, salt: int) -> np.ndarray:
        total = np.zeros(len(self.tokens) + 1, dtype=np.uint64)
        np.cumsum(textvec.mix(self.tokens + np.uint64(salt)), out=total[1:])
        return textvec.mix(total[self.at[1:]] - total[self.at[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    @property
    def check(self) -> np.ndarray:
        return self._digest(0x52 + 2 * self._salt)


def _sets(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[tuple[pa.RecordBatch, int, Sets]]:
    for batch in batches:
        for at, data, offsets in textvec.blocks(batch.column("text")):
            yield batch, at, Sets(data, offsets, salt)


def _fresh(sets: Sets, seen: set[int]) -> np.ndarray:
    """Rows whose set is not empty and new to this task."""
    if len(seen) > SEEN_SETS:
        seen.clear()
    new = np.zeros(len(sets.sig), dtype=bool)
    for k, sig in enumerate(sets.sig.tolist()):
        if sets.size[k] and sig not in seen:
            seen.add(sig)
            new[k] = True
    return new


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def profile(docs: DataFrame, salt: int) -> DataFrame:
    """One pass over all texts: doc_id, sig, n (size of the set) and check of every row; and, where ``counted``, a chunk's frequent shingle as sig with its documents as n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            hot = n >= CHUNK_DOCS
            return made(True, pa.nulls(hot.sum(), pa.int64()), token[hot].view(np.int64), n[hot], None)

        def made(counted: bool, ids: pa.Array, sig: np.ndarray, n: np.ndarray, check: np.ndarray | None) -> pa.RecordBatch:
            check = pa.nulls(len(sig), pa.int64()) if check is None else pa.array(check)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), counted)), ids, pa.array(sig), pa.array(n, pa.int64()), check], names=["counted", "doc_id", "sig", "n", "check"])

        for batch, at, s in _sets(batches, salt):
            yield made(False, batch.column("doc_id").slice(at, len(s.sig)), s.sig, s.size, s.check)
            held.append(s.tokens[np.repeat(_fresh(s, seen), s.size)])
            if sum(map(len, held)) >= CHUNK_TOKENS:
                yield flush()
                held.clear()
                seen.clear()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "counted boolean, doc_id long, sig long, n long, check long")


def profiled(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written profile and its salt: the first under which different sets have different names."""
    salt = 0
    while True:
        table = written(profile(docs, salt), "set-profile")
        names = table.where("not counted").groupBy("sig").agg(F.min("check").alias("least"), F.max("check").alias("most"), F.min("n").alias("few"), F.max("n").alias("many"))
        if not names.where("least <> most or few <> many").limit(1).count():
            return table, salt
        drop(table)
        salt += 1


def frequent(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) with their counted documents, at most HOT_TOKENS."""
    counts = written(table.where("counted").groupBy(F.col("sig").alias("token")).agg(F.sum("n").alias("n")), "shingle-counts")
    # rows by power-of-two count: at most 64 rows
    ladder = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*")).collect()), reverse=True)
    least, rows = 64, 0
    for p, n in ladder:
        if rows + n > HOT_TOKENS:
            break
        least, rows = p, rows + n
    found = counts.where(F.col("n") >= F.lit(2.0) ** F.lit(least)).toArrow() if rows else None
    drop(counts)
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


class Frequencies:
    """A class for each shingle: 0 for those not in the frequent table, else by the logarithm of its count."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        self.token = token
        self.level = np.clip(8 * np.log2(np.maximum(n, 1)) + 1, 1, 255).astype(np.uint64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[token >> np.uint64(42)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.uint64)
        ask = np.flatnonzero(self.maybe[tokens >> np.uint64(42)])
        if len(ask):
            k = np.searchsorted(self.token, tokens[ask])
            k[k == len(self.token)] = 0
            same = self.token[k] == tokens[ask]
            out[ask[same]] = self.level[k[same]]
        return out


class Order:
    """One global order of shingles: frequent ones last, by a hash of its own among equals."""

    def __init__(self, sets: Sets, frequencies: Frequencies, number: int):
        salt = np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
        self.sets, self.level = sets, frequencies.of(sets.tokens) << np.uint64(56)
        self.key = self.level | (textvec.mix(sets.tokens ^ salt) >> np.uint64(8))

    def prefix(self, row: int) -> np.ndarray:
        """Where the row's prefix shingles stand among all tokens, in order."""
        a, m = int(self.sets.at[row]), int(self.sets.size[row])
        return a + np.argsort(self.key[a : a + m])[: m - (3 * m + 3) // 4 + 1]


class Entries:
    """Prefix entries as columns: token, sig, n (size of the set) and pos (place in the order)."""

    TYPES = {"token": np.uint64, "sig": np.int64, "n": np.uint32, "pos": np.uint32}

    def __init__(self, **columns: np.ndarray):
        self.token, self.sig, self.n, self.pos = (columns[c] for c in self.TYPES)

    def take(self, at: np.ndarray) -> Entries:
        return Entries(**{c: getattr(self, c)[at] for c in self.TYPES})

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        return cls(**{c: np.concatenate([np.zeros(0, t), *(getattr(p, c) for p in parts)]) for c, t in cls.TYPES.items()})

    def pack(self) -> bytes:
        """Entries sorted by token, compressed: token steps, n and pos by byte planes."""
        planes = lambda x: x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        body = planes(np.diff(self.token, prepend=np.uint64(0))) + planes(self.n) + planes(self.pos) + self.sig.tobytes()
        return len(self.token).to_bytes(4, "big") + pa.Codec("zstd", 1).compress(body, asbytes=True)

    @classmethod
    def unpack(cls, data: bytes) -> Entries:
        m = int.from_bytes(data[:4], "big")
        body = np.frombuffer(pa.Codec("zstd").decompress(data[4:], decompressed_size=24 * m), dtype=np.uint8)
        plane = lambda a, t: np.ascontiguousarray(body[a * m : (a + np.dtype(t).itemsize) * m].reshape(-1, m).T).view(t).ravel()
        return cls(token=np.cumsum(plane(0, np.uint64)), n=plane(8, np.uint32), pos=plane(12, np.uint32), sig=body[16 * m :].view(np.int64))


def _prefix_entries(batches: Iterator[pa.RecordBatch], hot, salt: int, want_hot: bool) -> Iterator[Entries]:
    """The first order's prefix entries of the sets new to this task: the frequent shingles, or the others."""
    frequencies, seen = Frequencies(*hot.value), set()
    for _, _, s in _sets(batches, salt):
        order, parts = Order(s, frequencies, 0), []
        for r in np.flatnonzero(_fresh(s, seen)).tolist():
            first = order.prefix(r)
            pos = np.flatnonzero((order.level[first] > 0) == want_hot)
            if len(pos):
                parts.append(Entries(token=s.tokens[first[pos]], sig=np.full(len(pos), s.sig[r]), n=np.full(len(pos), s.size[r], np.uint32), pos=pos.astype(np.uint32)))
        if parts:
            yield Entries.joined(parts)


_BUCKETS = "token long, sig long, n int, pos int, lead struct<pos: int, n: int, sig: long>"


def bucketed(e: Entries) -> Entries:
    """Entries by token, the most central first (smallest pos, n, sig), of those that some other set of their token can be admitted with."""
    by = np.argsort(e.token)
    token = e.token[by]
    same = token[1:] == token[:-1]
    several = np.zeros(len(by), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    e = e.take(by[several])
    e = e.take(np.lexsort((e.sig, e.n, e.pos, e.token)))
    if len(e.token):  # a set that several tasks sent
        e = e.take(np.flatnonzero(np.concatenate([[True], (e.token[1:] != e.token[:-1]) | (e.sig[1:] != e.sig[:-1])])))
    if not len(e.token):
        return e
    starts = np.flatnonzero(np.concatenate([[True], e.token[1:] != e.token[:-1]]))
    count = np.diff(np.append(starts, len(e.token)))
    group = np.repeat(np.arange(len(starts)), count)
    n = e.n.astype(np.int64)
    reach = (4 * n - 7 * e.pos.astype(np.int64)) // 3  # the largest partner that pos allows

    def others(x: np.ndarray, sign: int) -> np.ndarray:
        """The least (sign 1) or most (-1) of the other members' x; a group of one has none."""
        by = np.lexsort((sign * x, group))
        first = x[by[starts]]
        second = np.where(count > 1, x[by[np.minimum(starts + 1, len(x) - 1)]], sign * (1 << 60))
        best = np.repeat(first, count)
        best[by[starts]] = second
        return best

    e = e.take(np.flatnonzero((others(n, 1) <= reach) & (others(reach, -1) >= n)))
    if not len(e.token):
        return e
    fresh = np.concatenate([[True], e.token[1:] != e.token[:-1]])
    return e.take(np.flatnonzero(~(fresh & np.append(fresh[1:], True))))


def rare_buckets(docs: DataFrame, hot, salt: int, entries: int) -> DataFrame:
    """The buckets of shingles that are not in the frequent table, by packed ranges of shingles."""
    wanted = -(-entries // RANGE_ENTRIES)
    ranges = max(1, wanted if wanted <= MOST_RANGES else max(MOST_RANGES, wanted // 32))
    block = max(RANGE_ENTRIES, 64 * ranges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[Entries]) -> pa.RecordBatch:
            e = Entries.joined(held)
            e = e.take(np.argsort(e.token))
            of = ((e.token >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            number, first = np.unique(of, return_index=True)
            body = [e.take(slice(a, b)).pack() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(body, pa.binary())], names=["range", "body"])

        held, size = [], 0
        for e in _prefix_entries(batches, hot, salt, want_hot=False):
            held.append(e)
            size += len(e.token)
            if size >= block:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bucketed(Entries.joined([Entries.unpack(body.as_py()) for batch in batches for body in batch.column("body")]))
        if not len(e.token):
            return
        starts = np.flatnonzero(np.concatenate([[True], e.token[1:] != e.token[:-1]]))
        lead = np.repeat(starts, np.diff(np.append(starts, len(e.token))))
        for a in range(0, len(lead), 1 << 16):
            at, of = slice(a, a + (1 << 16)), lead[a : a + (1 << 16)]
            column = lambda x: pa.array(x.astype(np.int32))
            leads = pa.StructArray.from_arrays([column(e.pos[of]), column(e.n[of]), pa.array(e.sig[of])], names=["pos", "n", "sig"])
            yield pa.RecordBatch.from_arrays([pa.array(e.token[at].view(np.int64)), pa.array(e.sig[at]), column(e.n[at]), column(e.pos[at]), leads], names=["token", "sig", "n", "pos", "lead"])

    packed = _texts(docs).mapInArrow(tidy(pack), "range int, body binary")
    return packed.repartitionById(ranges, F.col("range")).select("body").mapInArrow(tidy(gather), _BUCKETS)


def hot_buckets(docs: DataFrame, hot, salt: int) -> DataFrame:
    """The buckets of frequent shingles: leads are summed up before the shuffle, and skewed joins are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _prefix_entries(batches, hot, salt, want_hot=True):
            yield pa.RecordBatch.from_arrays([pa.array(e.token.view(np.int64)), pa.array(e.sig), pa.array(e.n.astype(np.int32)), pa.array(e.pos.astype(np.int32))], names=["token", "sig", "n", "pos"])

    rows = written(_texts(docs).mapInArrow(tidy(run), "token long, sig long, n int, pos int"), "frequent-prefixes")
    leads = rows.groupBy("token").agg(F.min(F.struct("pos", "n", "sig")).alias("lead"), F.max("sig").alias("_last"), F.min("sig").alias("_first")).where("_first < _last")
    table = written(rows.join(leads.select("token", "lead"), "token").dropDuplicates(["token", "sig"]), "frequent-buckets")
    drop(rows)
    return table


def buckets(docs: DataFrame, hot, salt: int, entries: int) -> DataFrame:
    """The first order's prefix rows whose shingle is in several sets, each with the bucket's lead: its most central set, with the fewest rarer shingles; written."""
    common = hot_buckets(docs, hot, salt)
    table = written(rare_buckets(docs, hot, salt, entries).unionByName(common), "buckets")
    drop(common)
    return table


def payloads(docs: DataFrame, wanted: DataFrame, hot, salt: int, orders: int) -> DataFrame:
    """(sig, body, order_1, order_2 …): one packed text of each wanted set, and its prefix shingles under the other orders, as 32 bits; written, bucketed by sig."""
    asked = docs.sparkSession.sparkContext.broadcast(Bitmap(wanted, "sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen, frequencies, bitmap = pa.Codec("zstd"), set(), Frequencies(*hot.value), asked.value
        for batch, at, s in _sets(batches, salt):
            rows = np.flatnonzero(_fresh(s, seen) & bitmap.may_hold(s.sig)).tolist()
            if not rows:
                continue
            texts = [batch.column("text")[at + k].as_py().encode() for k in rows]
            columns = [pa.array(s.sig[rows]), pa.array([len(t).to_bytes(8, "big") + codec.compress(t, asbytes=True) for t in texts], pa.binary())]
            for number in range(1, orders):
                order = Order(s, frequencies, number)
                columns.append(pa.array([(s.tokens[order.prefix(r)] >> np.uint64(32)).astype(np.uint32).view(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "body", *others])

    others = [f"order_{k}" for k in range(1, orders)]
    packed = _texts(docs).mapInArrow(tidy(run), ", ".join(["sig long", "body binary", *(f"{c} array<int>" for c in others)]))
    one = packed.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first(F.struct("body", *others)).alias("x"))
    table = written_by(one.select("sig", "x.*"), "sig", "bodies")
    asked.destroy()
    return table


def _both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Written pairs (a, b) with some columns of both sets; a set with very many pairs is left to Spark's splitting of skewed joins."""
    ends = F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("side", "sig")
    most = pairs.select(ends).groupBy("side", "sig").count().agg(F.max("count")).first()[0]
    sets = unbucketed(sets) if (most or 0) > MOST_PAIRS else sets
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sig").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def passing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written pairs that share a prefix shingle under every other order as well; written."""
    others = [c for c in sets.columns if c.startswith("order_")]
    found = _both(pairs, sets, others) if others else pairs
    for c in others:
        found = found.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    found = written(found.select("a", "b"), "passing")
    drop(pairs)
    return found


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose sets are linked; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        kept: dict[int, np.ndarray] = {}
        held = 0

        def tokens(sig: int, body: pa.BinaryScalar) -> np.ndarray:
            nonlocal held
            if sig not in kept:
                if held > KEPT_TOKENS:
                    kept.clear()
                    held = 0
                body = body.as_py()
                text = codec.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "big"), asbytes=True)
                kept[sig] = Sets(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)], dtype=np.int64)).tokens
                held += len(kept[sig])
            return kept[sig]

        for batch in batches:
            linked = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("body_a"), batch.column("body_b"), strict=True):
                two = tokens(a, x), tokens(b, y)
                shared = len(np.intersect1d(*two, assume_unique=True))
                linked.append(7 * shared >= 3 * (len(two[0]) + len(two[1])))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    links = written(_both(pairs, sets, ["body"]).select("a", "b", "body_a", "body_b").mapInArrow(tidy(run), "a long, b long"), "links")
    drop(pairs)
    return links


def _admits(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """What a link allows of a first common shingle: no more can be shared than stands at or after it in both sets."""
    return 7 * F.least(n - pos, other_n - other_pos) >= 3 * (n + other_n)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's members with its lead that this order admits; written."""
    star = rows.where((F.col("sig") != F.col("lead.sig")) & _admits(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    return written(star.select(F.least("sig", "lead.sig").alias("a"), F.greatest("sig", "lead.sig").alias("b")).distinct(), "pairs")


def cross_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a bucket in different components that this order admits; written."""
    rows = _labelled(rows.select("token", "sig", "n", "pos"), labels)
    counted = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    largest = counted.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    mixed = written(rows.join(largest, "token").withColumn("minor", F.col("label") != F.col("most")).drop("most", "labels"), "mixed")
    x, y = mixed.where("minor").alias("x"), mixed.alias("y")
    admitted = _admits(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    # of two members outside the largest component one order is enough
    once = ~F.col("y.minor") | (F.col("x.sig") < F.col("y.sig"))
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & once & admitted)
    pairs = written(found.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct(), "pairs")
    drop(mixed)
    return pairs


def _classes(docs: DataFrame, orders: int) -> tuple[DataFrame, int]:
    """doc_id, sig, n_shingles and component_id of every row; and the salt of sig."""
    table, salt = profiled(docs)
    rows = table.where("not counted").select("doc_id", "sig", "n")
    entries = rows.where("n > 0").agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    hot = docs.sparkSession.sparkContext.broadcast(frequent(table))
    bucket = buckets(docs, hot, salt, entries)
    sets = payloads(docs, bucket.select("sig").distinct(), hot, salt, orders)
    hot.destroy()

    links = verify(passing(star_pairs(bucket), sets), sets)
    labels = graph.components(links)
    pairs = cross_pairs(bucket, labels)
    drop(bucket)
    more = verify(passing(pairs, sets), sets)
    drop(sets)
    if more.limit(1).count():
        labels = graph.components(links.unionByName(more))
    drop(links, more)

    classed = _labelled(rows.where("n > 0"), labels)
    least = classed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = classed.join(least, "label").select("doc_id", "sig", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", "sig", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), salt


def near_duplicates(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """doc_id, sig, n_shingles and component_id of every row."""
    return _classes(docs, orders)[0]


def keep_one(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (equal rows: one of them); rows without shingles stay.

    Only rows that may share their doc_id with one that leaves are joined; the others pass straight through.
    """
    classes, salt = _classes(docs, orders)
    rows = classes.where("n_shingles > 0").groupBy("doc_id", "sig", "component_id").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id"))).where("not stays or copies > 1"), "affected")
    touched = docs.sparkSession.sparkContext.broadcast(Bitmap(rows, "doc_id"))
    columns, schema = docs.columns, docs.schema
    maybe_, sig_, id_, of_, stays_ = (unused(docs, c) for c in ("maybe", "sig_", "id_of", "sig_of", "stays"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = touched.value
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            maybe = bitmap.may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            sig = np.zeros(batch.num_rows, np.int64)
            if maybe.any():
                at = np.flatnonzero(maybe)
                sig[at] = np.concatenate([s.sig for _, _, s in _sets([batch.select(["text"]).take(pa.array(at))], salt)])
            yield batch.append_column(maybe_, pa.array(maybe)).append_column(sig_, pa.array(sig))

    signed = docs.mapInArrow(tidy(run), StructType([*schema.fields]).add(maybe_, BooleanType()).add(sig_, LongType()))
    affected = rows.select(F.col("doc_id").alias(id_), F.col("sig").alias(of_), F.col("stays").alias(stays_))
    asked = signed.where(F.col(maybe_)).join(affected, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(sig_) == F.col(of_)), "left")
    # of equal rows that stay any one is the same
    unaffected, decided = asked.where(F.col(of_).isNull()), asked.where(F.col(stays_)).dropDuplicates([id_, of_])
    return signed.where(~F.col(maybe_)).select(columns).unionByName(unaffected.select(columns)).unionByName(decided.select(columns))
