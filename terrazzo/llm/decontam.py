"""Benchmark decontamination: size-partitioned MinHash containment search, in Spark expressions.

Test items are cut into distinct 5-word shingles and hashed.  Of an item's n shingles
the ``n - ceil(threshold * n) + 1`` smallest hashes are its MinHash sketch: a document
that contains the threshold's share of them must contain a sketch hash, for it can lack
only ``n - ceil(threshold * n)``.  The search therefore loses nothing, whatever the
document's length.

Items are partitioned into classes by size (powers of two), and each class is searched in its
own way.  A class of at most LISTED sketch hashes lists them, and a document sends to it
the listed hashes alone.  A larger class has a ceiling, the largest hash of its sketches, which is lower
the larger its items; a document sends to it the hashes up to that, and none where it has fewer
shingles than the smallest item of the class needs.  So a few tiny items, whose sketches lie
anywhere, list some hashes and leave the other classes' ceilings as they are, and a short
document is not searched for long items.

Documents stream through once: the remaining hashes meet the sketches in a hash join
whose small side is broadcast only if Spark measures it under its threshold, and
pairs (document, item) survive.  Survivors' texts are read again and verified by
the shingles themselves; a broadcast bitmap of bounded size tells most other texts apart
first, so that only texts which may be survivors are ever shuffled.

Words are runs of letters and digits in lower case, so punctuation and junk
symbols cannot hide a copy.

Defined results: null or empty texts contain nothing; an item with 1 to 4 words
is one shingle of that many words; an item without words is contained in nothing;
repeated items are searched as the union of their shingles; a repeated document id is
searched as the union of its rows' shingles; ``contained`` never reports a null document
id, but ``clean`` judges such rows by their texts; texts of any length are searched whole;
empty tables give no rows; other columns are handed on by ``clean``, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.storage import Segments, unused, written

WIDTH = 5
THRESHOLD = 0.75
#: Sketch hashes of a size class that are listed; a larger class has a ceiling.
LISTED = 256


@dataclass(frozen=True)
class Classes:
    """How the size classes of one shingle width are searched: ``listed`` hashes, and (shingles that a document needs, ceiling) of the larger classes."""

    listed: tuple[int, ...]
    ceilings: tuple[tuple[int, int], ...]

    def admits(self, key: Column, n: Column) -> Column:
        """Whether a hash of a document of ``n`` shingles may be in a sketch of some class."""
        tests = [key.isin(list(self.listed))] if self.listed else []
        if self.ceilings:
            limits = [F.when(n >= need, F.lit(ceiling)) for need, ceiling in self.ceilings]
            tests.append(F.coalesce(key <= (F.greatest(*limits) if len(limits) > 1 else limits[0]), F.lit(False)))
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: as a lambda's variable it cannot be inlined into inner loops."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _shingles(words: Column, width: int, of) -> Column:
    """``of`` applied to each run of ``width`` words; ``words`` is a bound variable."""
    n = F.size(words) - (width - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of([words[i + k] for k in range(width)]))


def _hash(run: list[Column]) -> Column:
    return F.xxhash64(*run)


def _text(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def _keyed(text: Column, widths: list[int], of, classes: dict[int, Classes] | None = None) -> Column:
    """Distinct (w, key): ``of`` over the runs of each width, those that some class admits.  Plain values are made distinct, not structs, which Spark compares pairwise."""

    def of_width(words: Column, w: int) -> Column:
        keys = _shingles(words, w, of)
        if classes and w in classes:
            n = F.size(words) - (w - 1)  # at least the distinct ones
            keys = F.filter(keys, lambda key: classes[w].admits(key, n))
        return F.transform(F.array_distinct(keys), lambda key: F.struct(F.lit(w).alias("w"), key.alias("key")))

    return _bound(_words(text), lambda v: F.concat(*[of_width(v, w) for w in widths]))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, w (words in its shingles), shingle, hash and n (distinct shingles), a row a shingle."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = None
    for w in range(1, width + 1):
        fits = F.size("words") >= width if w == width else F.size("words") == w
        runs = _bound(F.col("words"), lambda v: _shingles(v, w, lambda run: F.struct(_text(run).alias("shingle"), _hash(run).alias("hash"))))  # noqa: B023
        part = words.where(fits).select("item_id", F.lit(w).alias("w"), runs.alias("runs"))
        rows = part if rows is None else rows.unionByName(part)
    exploded = rows.select("item_id", "w", F.inline("runs")).distinct()  # repeated ids: the union of their shingles
    sizes = exploded.groupBy("item_id").agg(F.count("*").alias("n"))
    return exploded.join(sizes, "item_id")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The sketch hashes (item_id, w, n, size_class, hash) of every item."""
    ranked = shingles.withColumn("_rank", F.row_number().over(W.partitionBy("item_id").orderBy("hash", "shingle")))
    sketch = ranked.where(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1)
    return sketch.select("item_id", "w", "n", F.floor(F.log2("n")).cast("int").alias("size_class"), "hash").distinct()


def classes_of(sketch: DataFrame, threshold: float = THRESHOLD) -> dict[int, Classes]:
    """How the classes of each shingle width are searched; at most 64 classes a width, LISTED hashes each."""
    sizes = sketch.groupBy("w", "size_class").agg(F.countDistinct("hash").alias("hashes"), F.max("hash").alias("ceiling"), F.min(F.ceil(F.col("n") * F.lit(threshold))).alias("need"))
    small = sizes.where(F.col("hashes") <= LISTED)
    listed = sketch.join(F.broadcast(small.select("w", "size_class")), ["w", "size_class"]).select("w", "hash").distinct().collect()
    large = sizes.where(F.col("hashes") > LISTED).collect()
    return {
        w: Classes(tuple(sorted(r["hash"] for r in listed if r["w"] == w)), tuple(sorted((r["need"], r["ceiling"]) for r in large if r["w"] == w)))
        for w in sorted({r["w"] for r in [*listed, *large]})
    }


def _search(texts: DataFrame, items: DataFrame, threshold: float, width: int) -> DataFrame:
    """key, item_id, n_shared and n_item of every (key, text) that holds at least the threshold's share of an item."""
    shingles = written(item_shingles(items, width), "bench-shingles")
    sketch = written(sketches(shingles, threshold), "bench-sketches")
    classes = classes_of(sketch, threshold)
    widths = sorted(classes) or [width]

    hashed = texts.select("key", F.inline(_keyed(F.col("text"), widths, _hash, classes)).alias("w", "hash"))
    pairs = written(hashed.join(sketch.select("w", "hash", "item_id").distinct(), ["w", "hash"]).select("key", "item_id").distinct(), "bench-candidates")

    found_in = written(pairs.select("key").distinct(), "bench-suspects")
    # texts that cannot be among them stay where they are
    suspects = Segments(found_in, "key").marked(texts, F.col("key"), "maybe").where("maybe").select("key", "text").join(found_in, "key", "left_semi")
    exact = suspects.select("key", F.inline(_keyed(F.col("text"), widths, _text)).alias("w", "shingle"))
    found = exact.join(shingles, ["w", "shingle"]).select("key", "item_id", "n", "shingle").distinct()
    # every item a suspect shares shingles with is counted; those that pass the threshold are candidates by the sketch argument
    counted = found.groupBy("key", "item_id").agg(F.count("*").alias("n_shared"), F.max("n").alias("n_item")).join(pairs, ["key", "item_id"], "left_semi")
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold)))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every document that holds at least the threshold's share of an item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).where("key is not null")
    found = _search(texts, items, threshold, width)
    return found.select(F.col("key").alias("doc_id"), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _row_key(doc_id: Column, text: Column) -> Column:
    """What a row is judged by: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.concat(F.lit("text "), F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    key = _row_key(F.col("doc_id"), F.col("text"))
    hits = written(_search(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")), items, threshold, width).select("key").distinct(), "bench-hits")
    hit, maybe = unused(docs, "hit"), unused(docs, "maybe")
    marked = Segments(hits, "key").marked(docs, key, maybe)
    rest = marked.where(F.col(maybe)).join(hits.withColumnRenamed("key", hit), key == F.col(hit), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
