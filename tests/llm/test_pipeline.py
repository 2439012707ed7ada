"""The pipeline against its stages done plainly, on tables small enough for that."""

import hashlib
import math
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from terrazzo.llm import bpe, secretscan

from .conftest import prose
from .test_decontam import shingles as item_shingles
from .test_decontam import words
from .test_ngramjoin import brute as classes
from .test_quality import plain


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    item = prose(rng, 30)
    texts = [prose(rng, 120) for _ in range(8)]
    texts += [texts[0], texts[1] + " and more", f"{prose(rng, 60)} {item} {prose(rng, 60)}", prose(rng, 60) + " token = abcdef0123456789abcdef01 end", None, "short", "### " * 80]
    rows = list(enumerate(texts))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if plain(t)[-1]]
    stay = {i for i, n, c in classes(left) if not n or i == c}
    left = [(i, t) for i, t in left if i in stay]
    want = item_shingles(words(item))
    left = [(i, t) for i, t in left if len(want & item_shingles(words(t))) < math.ceil(0.75 * len(want))]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = []
    for i, t in left:
        hidden = {k for a, _, b in secretscan.find(t, secretscan.model())[1] for k in range(a, b)}
        t = "".join("[SECRET]" if k in hidden and k - 1 not in hidden else "" if k in hidden else c for k, c in enumerate(t))
        expected.append((i, hashlib.sha256(" ".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()))
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(expected) and {i for i, _ in got} == {0, 1, 2, 3, 4, 5, 6, 7, 11}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


def run(spark, path, rows, extra="sig long, maybe string, key string, hit int, words string"):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "m", "k", 2, "w") for i, t in rows], schema).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "seven words of a benchmark item here"), (2, None), (3, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return [(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(path)).collect()]


def test_awkward_documents(spark, tmp_path):
    rng = random.Random(4)
    long, near, other = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000)), prose(rng, 400), prose(rng, 90)
    rows = [(1, long), (2, long), (3, near), (4, near + " end"), (4, near + " end"), (None, other), (None, other), (None, prose(rng, 80) + " seven words of a benchmark item here " + prose(rng, 80)), (7, None), (8, ""), (9, "x " * 300)]
    got = run(spark, tmp_path, rows)
    assert sorted(i for i, _ in got if i is not None) == [1, 3] and [i for i, _ in got].count(None) == 1
    assert dict(got)[1] > 120_000


def test_empty_documents(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_stages_keep_the_columns(spark, tmp_path):
    run(spark, tmp_path, [(1, prose(random.Random(2), 90))])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
