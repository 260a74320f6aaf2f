"""Byte-level BPE against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rootseek.llm import bytebpe, tokens

SCHEMA = "doc_id long, text string, id string, ids int, data int"
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PATTERN = public_tokenizers.PATTERN
assert PATTERN == bytebpe.PATTERN
WORDS = ["the", "The", "don't", "we'll", "x'sy", "naïve", "straße", "12345", "３.14", "日本語", "العربية", "🙂👍🏽", "é", "▁a", "<|endoftext|>", "--", "…", "\x1c", "﻿", "\x00", "aaaa"]
BLANKS = [" ", "  ", "\n", " \n", "\n ", "\t", " ", " 　", "\x1d", "\x85", "   \n\n  ", " "]
made = st.lists(st.one_of(st.sampled_from(WORDS), st.sampled_from(BLANKS), st.text(max_size=4)), max_size=25).map("".join)


def library(name):
    ranks = bytebpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    return library(request.param), bytebpe.Vocabulary(public_tokenizers.path(request.param), PATTERN).codec()


@settings(max_examples=600, deadline=None)
@given(made)
def test_ids_equal_the_library(pair, text):
    want, codec = pair
    ids = codec.ids(text)
    assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)
    assert codec.data(ids) == text.encode()


def test_every_token_as_a_text(pair):
    want, codec = pair
    texts = [t.decode() for t in codec.bytes if t.decode("utf-8", "ignore").encode() == t]
    assert len(texts) > 40_000
    assert all(np.frombuffer(codec.ids(t), "<u4").tolist() == want.encode_ordinary(t) for t in texts)


def test_long_stretches(pair):
    want, codec = pair
    r = random.Random(1)
    for text in ("a" * 30_000, "".join(r.choice("abcdefghij") for _ in range(50_000)), " " * 20_000 + "x", "é日" * 5_000, "ab " * 30_000, "9" * 5_000 + "\n" * 5_000):
        ids = codec.ids(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text) and codec.data(ids) == text.encode()


def test_cache_is_bounded(pair, monkeypatch):
    want, codec = pair
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    monkeypatch.setattr(tokens, "LEARNED", 40)
    monkeypatch.setattr(bytebpe, "LONG_CHARS", 5000)
    r = random.Random(2)
    for _ in range(40):
        text = " ".join("".join(r.choice("etaoin") for _ in range(r.choice([1, 2, 3, 9, 200]))) + r.choice(["", ",", ".", ".\nX"]) for _ in range(150))
        assert np.frombuffer(codec.ids(text), "<u4").tolist() == want.encode_ordinary(text)
        assert len(codec.known) + len(codec.older) <= 700


@settings(max_examples=200, deadline=None)
@given(made)
def test_long_words_go_by_matches(pair, text):
    want, codec = pair
    kept, bytebpe.LONGEST = bytebpe.LONGEST, 3
    try:
        assert np.frombuffer(codec.ids(text), "<u4").tolist() == want.encode_ordinary(text)
    finally:
        bytebpe.LONGEST = kept


def test_another_pattern():
    pattern = r"\p{L}{1,3}|\s*[\r\n]+|\s+|[^\s\p{L}]+"
    ranks = bytebpe.read_ranks(public_tokenizers.path(NAMES[0]))
    want = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    codec = bytebpe.Vocabulary(public_tokenizers.path(NAMES[0]), pattern).codec()
    text = "Hello there,\nyou  \r\n others 12345!? " * 3
    assert np.frombuffer(codec.ids(text), "<u4").tolist() == want.encode_ordinary(text)


@pytest.mark.parametrize("name", NAMES)
def test_tables(spark, name):
    path = public_tokenizers.path(name)
    texts = [None, "", "Hello world, it's  me\n\n don't ", "dup", "🙂 " * 2000, "".join(WORDS + BLANKS)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "dup"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    want = library(name)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = bytebpe.round_trip(df, path, PATTERN).collect()
    def row(i, t):
        ids = want.encode_ordinary(t or "")
        return i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())
    assert sorted(map(tuple, got), key=str) == sorted((row(i, t) for i, t in rows), key=str)
    encoded = bytebpe.encode(df, path, PATTERN)
    assert sorted(map(str, ((r.doc_id, r.ids) for r in encoded.collect()))) == sorted(str((i, want.encode_ordinary(t or ""))) for i, t in rows)
    decoded = bytebpe.decode(encoded, path, PATTERN).collect()
    assert sorted(str((r.doc_id, bytes(r.data))) for r in decoded) == sorted(str((i, (t or "").encode())) for i, t in rows)
    assert bytebpe.round_trip(df.limit(0), path, PATTERN).collect() == []


def test_decode_of_other_lists(spark):
    path = public_tokenizers.path(NAMES[0])
    lists = lambda rows: spark.createDataFrame(rows, "doc_id long, ids array<int>")
    assert [r.data for r in bytebpe.decode(lists([(1, None)]), path, PATTERN).collect()] == [None]
    for bad in ([50256], [-1], [None]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bytebpe.decode(lists([(1, bad)]), path, PATTERN).collect()
