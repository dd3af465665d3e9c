"""Token ids against the tokenizer, plans against bounds, and packed tables against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL

from sparrowtext.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return packing.WordEncoder(PATH)


def ids(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


CASES = [
    "", " ", "Hello World", "don't DON'T we'll I'M o'clock ''s", "É é ÀÖ straße ẞ İstanbul ŉ ſecret K", "a<|endoftext|>b <|startoftext|> <|x|>", "1234 3.14 ½ ² 1a2", "é ́e å", "x y\u0085z w​",
    "宋史 ひらがな カタカナ 한국어", "😀👍🏽 ©®", "ΑΣ ΣΑΣ σς Ǆ", "\x00\x01\x1c\x1d", "a" * 3000, "!!!???...---", "don’t", "ªº µ", "foo_bar-baz@qux.com", "</w> a</w>", "﻿x ",
]


@pytest.mark.parametrize("text", CASES)
def test_ids(enc, tok, text):
    assert ids(enc, text) == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_ids_of_any_text(enc, tok, text):
    assert ids(enc, text) == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("aeinorstéüßñ'’.,1 \ń ", max_size=12), max_size=12))
def test_ids_of_word_like_text(enc, tok, words):
    text = " ".join(words)
    assert ids(enc, text) == tok.encode(text, add_special_tokens=False).ids


def test_the_memory_of_words_is_bounded(tok):
    small = packing.WordEncoder(PATH, remember=50)
    text = " ".join(f"word{i % 170}x" for i in range(600))
    assert ids(small, text) == tok.encode(text, add_special_tokens=False).ids


def bins_of(hist, runs, capacity):
    """Fills bins by the runs; checks that every place is gapless and every piece placed."""
    held = defaultdict(list)
    for i, (n, r0, m, first, offset) in enumerate(runs):
        r1 = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else hist[n]
        for q in range(r1 - r0):
            held[first + q // m].append((offset + q % m * n, n))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(len(v) for v in held.values()) == sum(hist.values())
    return len(held)


def first_fit_decreasing(hist, capacity):
    rooms = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        for i, r in enumerate(rooms):
            if r >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    r, capacity = random.Random(seed), 256
    hist = defaultdict(int)
    for _ in range(r.choice([1, 7, 300, 1500])):
        n = {0: lambda: r.randint(1, capacity), 1: lambda: r.choice([capacity, 129, 128, 100, 86, 85]), 2: lambda: min(capacity, int(r.paretovariate(0.8)))}[seed % 3]()
        hist[n] += 1
    runs, n_bins = packing.plan(dict(hist), capacity)
    assert bins_of(dict(hist), runs, capacity) == n_bins
    least = -(-sum(n * c for n, c in hist.items()) // capacity)
    assert least <= n_bins <= first_fit_decreasing(hist, capacity) + 1


def test_plan_edges():
    assert packing.plan({}, 10) == ([], 0)
    assert packing.plan({10: 3, 1: 1}, 10)[1] == 4
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def check(docs, got, tok, capacity):
    want = []
    for doc_id, text in docs:
        e = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(e), capacity)):
            part = e[start : start + capacity]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held)


def test_table(spark, tok):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "house", "überzeugt", "x1"]) for _ in range(r.choice([0, 1, 5, 40, 63, 64, 200])))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (None, None), (900, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA + ", length int, rank int, t int")
    check(rows, packing.pack(docs, PATH, 64).collect(), tok, 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH, 64).count() == 0


def test_many_equal_lengths(spark, tok):
    rows = [(i, "one two three") for i in range(5000)] + [(9000 + i, "x " * 63) for i in range(700)]
    assert check(rows, packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(16), PATH, 64).collect(), tok, 64) == 700 + -(-5000 // 16)


def test_small_table_is_packed_tightly(spark, tok):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, PATH).collect()
    n = check(rows, got, tok, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c d"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).collect()} == {big, big + 2, None}
