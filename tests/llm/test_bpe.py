"""Encoding against the tokenizer library, and an exact round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terrazzo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_encode(docs, rows, library):
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t in rows)


def test_digests_and_small_blocks(docs, rows, library, monkeypatch):
    got = sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_empty(empty):
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_pattern_cuts_as_the_library(library):
    import regex

    text = "\x1c a\x85b  \n\n c's 'LL 12a½ ٣ 你好 ー ­ é ​﻿᠎ 🙂🏽 ^_^"
    cut = regex.compile(public_tokenizers.PATTERN).findall(text)
    whole = tiktoken.Encoding("whole", pat_str=bpe._WHOLE, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    assert [i for w in cut for i in whole.encode_ordinary(w)] == library.encode_ordinary(text)


def test_packed_columns():
    columns = [np.array([], np.uint32), np.array([0, 255, 256, 1 << 31], np.uint32), np.array([7], np.uint8)]
    assert [c.tolist() for c in bpe.unpack(bpe.pack(*columns))] == [c.tolist() for c in columns]
    words = ["", "a", "\0", "né", "🙂 " * 300]
    assert bpe.unpack_words(bpe.pack_words(words)) == words and bpe.unpack_words(bpe.pack_words([])) == []
