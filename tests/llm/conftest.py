"""Small document tables with every awkward case."""

import random

import pytest

WORDS = "the of and to in that for with was on are by this from have which or had not but what all were when we there can an your each".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


def awkward():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(w if k % 40 else "changed" for k, w in enumerate(words))
    texts = [
        None, "", "   \n\t ", "one", "one two three", "ONE two three", base, base, near, base.upper(), prose(rng, 60), prose(rng, 80), "a\n\na\n a\nb\na", "x " * 200,
        "### $$$ " * 60, "été Ünïcode naïve " * 30, prose(rng, 30000), "\x00 nul\x1c and   separators  ", "😀😀 emoji 👩‍👩‍👧 family", prose(rng, 55) + "\nline one\nline one\nline two",
    ]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(6, base), (None, "null id"), (30, base + " tail words here now"), (31, None)]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Columns of documents, and extra ones whose names operators might use themselves."""
    wide = [(i, t, "en", "src", len(t or ""), "extra", 1, 2, 3.0) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, sig long, n long, token double"
    return spark.createDataFrame(wide, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
