"""Hard-negative mining over k-means inverted lists.

Vectors are scaled and floored to integers, so scores (inner products) are exact.  For each
anchor its ``positives`` best rows of the same label are found first; then, for each of
these, the best ``negatives`` rows of other labels whose score lies between ``low`` and
``high`` percent of the positive's.

The index.  Centroids are fitted on a sample of at most SAMPLE_ROWS rows; every row is
assigned to its nearest centroid and rows are dealt by (centroid, label, hash), so a centroid
that draws a third of all rows is cut over many parts.  Inside a part a centroid's rows form
lists of at most LIST_ROWS, each stored with its own mean and radius (the distance of its
farthest row).  A part holds about PART_BYTES.

The search.  Anchors come in batches of neighbours, to every part.  By Cauchy-Schwarz a row x
of a list with mean c and radius r scores between ``a.c - |a| r`` and ``a.c + |a| r``.  Lists are
visited in the order of that upper bound; one whose bounds lie outside an anchor's windows
is skipped, and the visit stops where the bound falls strictly below every anchor's k-th best
score.  That score starts from the anchor's k-th best among the sample, which every part
knows.  The parts' answers, k rows an anchor each at most, are ranked again.

The answer is exact whatever the centroids; they only decide how many lists are skipped.

Defined results: rows with a null label, a null vector, or any null or non-finite component
take no part, and neither do rows with a null vec_id; shorter vectors count as padded
with zeros; scaled components are held within ±2^24; rows of the anchor's own vec_id are
neither its positives nor its negatives; repeated rows take ranks of their own, and repeated
anchors have results of their own; equal scores go by the smaller vec_id; anchors without
positives, or positives without rows in the window, give no rows; empty tables give no
rows; only the three columns are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.storage import drop, written
from terrazzo.llm.workers import tidy

#: Rows and bytes of the sample that centroids are fitted on, centroids at most and rows that one is meant for, rounds of the fit.
SAMPLE_ROWS, SAMPLE_BYTES, CENTROIDS, CENTROID_ROWS, ROUNDS = 1 << 14, 32 << 20, 256, 512, 8
#: Rows of a list, anchors of a batch, bytes of vectors in a part.
LIST_ROWS, BATCH_ROWS, PART_BYTES = 512, 256, 32 << 20
#: Scaled components are held within this.
MOST = 1 << 24
_NONE, _MANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def pack(m: np.ndarray) -> bytes:
    """An integer array in the narrowest type that holds it."""
    kind = next(k for k in "bhiq" if not m.size or (np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max))
    return kind.encode() + m.astype(kind).tobytes()


def unpack(data: bytes, width: int = 0) -> np.ndarray:
    out = np.frombuffer(data, dtype=chr(data[0]), offset=1)
    return out.reshape(-1, width) if width else out


def fit(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` centroids by Lloyd's rounds, from evenly chosen rows; an empty one stays where it was."""
    at = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        near = nearest(vectors, at)
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        at[found] = np.add.reduceat(vectors[order].astype(np.float64), first, axis=0) / np.diff(np.append(first, len(order)))[:, None]
    return at


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * (vectors.astype(np.float64) @ centroids.T), axis=1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where every partial sum fits them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The first ``k`` (score descending, id) of each of ``groups``; ``floor`` is a score that the k-th is known to reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.kth = k, floor.copy()
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        stay = place < self.k
        self.group, self.score, self.id = group[stay], score[order][stay], ids[order][stay]
        full = self.group[place[stay] == self.k - 1]
        last = self.score[place[stay] == self.k - 1]
        self.kth[full] = np.maximum(self.kth[full], last)


class Anchors:
    """A batch: ``low``, ``high`` and ``floor`` have a column a window; an empty window begins where no score is."""

    def __init__(self, keys, ids, labels, vectors, low, high, floor=None):
        self.keys, self.ids, self.labels, self.vectors, self.high = keys, ids, labels, vectors, high
        self.low = np.where(low > high, _MANY, low)
        self.floor = np.full(low.shape, _NONE) if floor is None else floor


class Lists:
    """Inverted lists held in memory: one part's, or the sample."""

    def __init__(self):
        self.ids, self.labels, self.vectors, self.means, self.radii = [], [], [], [], []
        self.visited = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, mean: np.ndarray, radius: float) -> None:
        for held, new in zip((self.ids, self.labels, self.vectors, self.means, self.radii), (ids, labels, vectors, mean, radius), strict=True):
            held.append(new)

    def search(self, anchors: Anchors, k: int, same: bool) -> Best:
        """For each anchor and window the first ``k`` rows in it of the same label, or of others; group = anchor * windows + window."""
        n, windows = anchors.low.shape
        best = Best(k, anchors.floor.ravel())
        if not self.ids:
            return best
        a = anchors.vectors.astype(np.float64)
        means, radii = np.stack(self.means), np.array(self.radii)
        middle, reach = a @ means.T, np.sqrt((a**2).sum(1))[:, None] * radii
        slack = 1e-9 * (np.sqrt((a**2).sum(1))[:, None] * (np.sqrt((means**2).sum(1)) + radii)) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        order = np.argsort(-upper.max(axis=0), kind="stable")
        high = anchors.high.max(axis=1)
        for at in order.tolist():
            kth = np.maximum(best.kth.reshape(n, windows), anchors.low)
            least = kth.min(axis=1)
            if upper[:, at].max() < least.min():
                break
            rows = np.flatnonzero((upper[:, at] >= least) & (lower[:, at] <= high))
            if not len(rows):
                continue
            self.visited += 1
            s = scores(anchors.vectors[rows], self.vectors[at])
            fits = (self.labels[at] == anchors.labels[rows, None]) if same else (self.labels[at] != anchors.labels[rows, None])
            fits &= self.ids[at] != anchors.ids[rows, None]
            fits &= (s >= least[rows, None]) & (s <= high[rows, None])
            i, j = np.nonzero(fits)
            if not len(i):
                continue
            i, score, ids = rows[i], s[i, j], self.ids[at][j]
            inside = (score[:, None] >= kth[i]) & (score[:, None] <= anchors.high[i])
            e, w = np.nonzero(inside)
            if len(e):
                best.add(i[e] * windows + w, score[e], ids[e])
        return best


def cleaned(rows: DataFrame, scale: int, dim: int) -> DataFrame:
    """(vec_id, label, vector, anchor) of the rows that take part; vector is scaled, floored, padded and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            size, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            full = np.zeros((len(size), dim))
            full[at, place] = flat
            whole = np.isfinite(full).all(axis=1)  # a null component has become NaN
            q = np.clip(np.floor(scale * full[whole]), -MOST, MOST).astype(np.int64)
            out = batch.filter(pa.array(whole)).drop_columns(["vector"])
            yield out.append_column("vector", pa.array([pack(v) for v in q], pa.binary())).select(["vec_id", "label", "anchor", "vector"])

    return rows.mapInArrow(tidy(run), "vec_id long, label long, anchor boolean, vector binary")


def assigned(rows: DataFrame, centroids, dim: int) -> DataFrame:
    """``rows`` with the number of the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = centroids.value
        for batch in batches:
            near = nearest(_matrix(batch.column("vector"), dim), at) if batch.num_rows else []
            yield batch.append_column("centroid", pa.array(near, pa.int32()))

    return rows.mapInArrow(tidy(run), "vec_id long, label long, anchor boolean, vector binary, centroid int")


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    return np.array([unpack(x) for x in packed.to_pylist()], dtype=np.int64).reshape(-1, dim)


_UNIT = "part int, kind int, batch long, keys binary, ids binary, labels binary, vectors binary, mean binary, radius double, low binary, high binary, floor binary"
_UNIT_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.float64(), *[pa.binary()] * 3]
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]


def _unit(**said) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([said.get(n)], t) for n, t in zip(_NAMES, _UNIT_TYPES, strict=True)], names=_NAMES)


def inverted(rows: DataFrame, parts: int, dim: int) -> DataFrame:
    """The lists: a row each, with ids, labels, vectors, mean and radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = _matrix(table.column("vector"), dim)
            mean = vectors.mean(axis=0)
            radius = float(np.sqrt(((vectors - mean) ** 2).sum(axis=1).max()))
            ids, labels = (table.column(n).to_numpy() for n in ("vec_id", "label"))
            yield _unit(part=part, kind=0, ids=pack(ids), labels=pack(labels), vectors=pack(vectors), mean=mean.tobytes(), radius=radius)

        now, size = None, 0
        for batch in batches:
            centroid = batch.column("centroid").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(centroid)) + 1).tolist(), len(centroid)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (centroid[a] != now or size == LIST_ROWS):
                        yield from flush()
                        held, size = [], 0
                    take = min(b - a, LIST_ROWS - size)
                    held.append(batch.slice(a, take))
                    now, size, a = centroid[a], size + take, a + take
        if held:
            yield from flush()

    place = ["centroid", "label", F.xxhash64("vec_id")]
    return rows.repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInArrow(tidy(run), _UNIT)


def batched(anchors: DataFrame, dim: int, sample, k: int, same: bool) -> DataFrame:
    """Rows (key, vec_id, label, vector, low, high: arrays, a window each) as batches, with floors from the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, known = TaskContext.get().partitionId() << 32, Lists()
        ids, labels, vectors = sample.value
        for at in range(0, len(ids), LIST_ROWS):
            mine = vectors[at : at + LIST_ROWS]
            mean = mine.mean(axis=0)
            known.add(ids[at : at + LIST_ROWS], labels[at : at + LIST_ROWS], mine, mean, float(np.sqrt(((mine - mean) ** 2).sum(axis=1).max())))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                low, high = _windows(rows.column("low"), _MANY), _windows(rows.column("high"), _NONE)
                one = Anchors(*(rows.column(n).to_numpy() for n in ("key", "vec_id", "label")), _matrix(rows.column("vector"), dim), low, high)
                floor = known.search(one, k, same).kth
                yield _unit(kind=1, batch=number, keys=pack(one.keys), ids=pack(one.ids), labels=pack(one.labels), vectors=pack(one.vectors), low=pack(low), high=pack(high), floor=pack(floor))
                number += 1

    return anchors.select("key", "vec_id", "label", "vector", "low", "high").mapInArrow(tidy(run), _UNIT)


def _windows(lists: pa.Array, missing: int) -> np.ndarray:
    """Arrays of different lengths as one matrix."""
    rows = lists.to_pylist()
    width = max(map(len, rows))
    return np.array([[*r, *[missing] * (width - len(r))] for r in rows], dtype=np.int64)


def searched(batches: DataFrame, lists: DataFrame, parts: int, dim: int, k: int, same: bool) -> DataFrame:
    """(key, window, id, score): the first ``k`` of every window among each part's lists."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, Lists()
        for batch in rows:
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, held = r["part"], Lists()
                if r["kind"] == 0:
                    held.add(unpack(r["ids"]).astype(np.int64), unpack(r["labels"]), unpack(r["vectors"], dim), np.frombuffer(r["mean"]), r["radius"])
                    continue
                keys = unpack(r["keys"])
                low, high, floor = (unpack(r[n]).astype(np.int64).reshape(len(keys), -1) for n in ("low", "high", "floor"))
                best = held.search(Anchors(keys, unpack(r["ids"]), unpack(r["labels"]), unpack(r["vectors"], dim), low, high, floor), k, same)
                which, window = np.divmod(best.group, low.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in ((keys[which], pa.int64()), (window, pa.int32()), (best.id, pa.int64()), (best.score, pa.int64()))], names=["key", "window", "id", "score"]
                )

    everywhere = batches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = lists.unionByName(everywhere).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "batch")
    return dealt.mapInArrow(tidy(run), "key long, window int, id long, score long")


def ranked(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from (vec_id, embedding, label); ``anchor`` says which rows are anchors."""
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vec_id is not null and label is not null and vector is not null")
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    valid = written(cleaned(rows, scale, max(dim, 1)), "negatives-rows")
    total, dim = valid.count(), max(dim, 1)
    if not total:
        drop(valid)
        return spark.createDataFrame([], schema)

    # the sample: rows with the smallest hashes, a bounded number
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    taken = valid.orderBy(F.xxhash64("vec_id", "label", "vector")).limit(size).select("vec_id", "label", "vector").toArrow()
    sample = taken.column("vec_id").to_numpy(), taken.column("label").to_numpy(), _matrix(taken.column("vector"), dim)
    shared = spark.sparkContext.broadcast(sample)
    centroids = spark.sparkContext.broadcast(fit(sample[2], max(1, min(CENTROIDS, len(sample[0]), total // CENTROID_ROWS))))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total * dim // PART_BYTES))
    near = assigned(valid, centroids, dim)
    lists = written(inverted(near, parts, dim), "negatives-lists")
    anchors = written(near.where("anchor").drop("anchor").withColumn("key", F.monotonically_increasing_id()), "negatives-anchors")

    def batches(of: DataFrame, k: int, same: bool) -> DataFrame:
        """Neighbours stand in one batch."""
        deal = max(1, min(parts, -(-total // (1 << 20))))
        return written(batched(of.repartitionByRange(deal, "centroid", "key").sortWithinPartitions("centroid", "key"), dim, shared, k, same), "negatives-batches")

    unbounded = [F.array(F.lit(x).cast("long")).alias(n) for n, x in (("low", _NONE), ("high", _MANY))]
    asked = batches(anchors.select("*", *unbounded), positives, True)
    best = ranked(searched(asked, lists, parts, dim, positives, True), positives, ["key"])
    first = written(best.select("key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # low * positive <= 100 * negative <= high * positive, in whole numbers
    up, down = f"({int(low)}L * positive_score)", f"({int(high)}L * positive_score)"
    bounds = first.select("key", "window", F.expr(f"({up} + pmod(-{up}, 100L)) div 100").alias("lo"), F.expr(f"({down} - pmod({down}, 100L)) div 100").alias("hi"))
    ordered = F.sort_array(F.collect_list(F.struct("window", "lo", "hi")))
    windows = bounds.groupBy("key").agg(ordered["lo"].alias("low"), ordered["hi"].alias("high"))
    asked_again = batches(anchors.join(windows, "key"), negatives, False)
    worst = ranked(searched(asked_again, lists, parts, dim, negatives, False), negatives, ["key", "window"])
    named = first.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    result = written(
        worst.join(named, ["key", "window"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ),
        "negatives-result",
    )
    drop(valid, lists, anchors, asked, asked_again, first)
    shared.destroy()
    centroids.destroy()
    return result
