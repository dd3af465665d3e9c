"""Tokens of literal inputs."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from sparrowtext.functions import analysis
from sparrowtext.operators import fields as fd
from sparrowtext.operators import index as ixs

STANDARD = {
    "don't stop": ["don't", "stop"], "hello'": ["hello"], "it' s": ["it", "s"], "hello, world! foo.": ["hello", "world", "foo"], "test123 456": ["test123", "456"],
    "c" * 300 + " short": ["c" * 255, "short"], "don’t": ["don’t"], "Société Café": ["société", "café"], "École": ["École"], "1,200": ["1", "200"], "3.14159": ["3", "14159"], "www.x.org": ["www", "x", "org"],
    "user@example.com": ["user", "example", "com"], "宋史": ["宋史"], "ひらがな": ["ひらがな"], "well-known": ["well", "known"], "foo_bar _private": ["foo_bar", "_private"], "": [], "   ": [], "a'_b": ["a", "_b"],
}
UNICODE = {
    "don't stop": ["don't", "stop"], "Société CAFÉ": ["société", "café"], "1,200": ["1,200"], "3.14159": ["3.14159"], "www.x.org": ["www.x.org"], "user@example.com": ["user", "example.com"],
    "宋史": ["宋", "史"], "ひらがな": list("ひらがな"), "カタカナ": ["カタカナ"], "한국어": ["한국어"], "well-known": ["well", "known"], "foo_bar _private": ["foo_bar", "_private"],
}


@pytest.mark.parametrize("name, table", [("standard", STANDARD), ("unicode", UNICODE)])
def test_tokens(spark, name, table):
    df = spark.createDataFrame([(k,) for k in table], "t string")
    got = {r.t: r.a for r in df.select("t", analysis.ANALYZERS[name](F.col("t")).alias("a")).collect()}
    assert got == table


def test_null_and_keyword(spark):
    df = spark.createDataFrame([(1, None), (2, "A b")], "i int, t string")
    got = {r.i: (r.s, r.u, r.k) for r in df.select("i", analysis.standard(F.col("t")).alias("s"), analysis.unicode(F.col("t")).alias("u"), analysis.keyword(F.col("t")).alias("k")).collect()}
    assert got == {1: ([], [], []), 2: (["a", "b"], ["a", "b"], ["A b"])}


def test_offsets_are_bytes(spark):
    docs = spark.createDataFrame([(0, "hello world"), (1, "É été x"), (2, None)], "doc long, t string")
    got = {(r.doc, r.term): (r.starts, r.lens) for r in ixs.field_postings(docs, fd.text("t", level="offsets")).collect()}
    assert got == {(0, "hello"): ([0], [5]), (0, "world"): ([6], [5]), (1, "É"): ([0], [2]), (1, "été"): ([3], [5]), (1, "x"): ([9], [1])}


def test_offsets_of_whole_texts(spark):
    from sparrowtext import catalogue

    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        folded, at, upto = (r.text or "").translate(str.maketrans(analysis.UPPER, analysis.LOWER)), 0, 0
        for pos, m in enumerate(re.finditer(r"\w+(?:['’][^\W_]\w*)*", folded)):
            at, upto = at + len(folded[upto : m.start()].encode()), m.start()
            want.append((m[0][:255], r.doc_id, pos, at, len(m[0][:255].encode())))
    got = catalogue.QUERIES["postings_offsets_text"](spark, SMALL).toPandas()
    assert sorted(got[["term", "doc", "pos", "start", "len"]].itertuples(index=False, name=None)) == sorted(want) and max(x[2] for x in want) > 1000


def test_own_analyzer(spark):
    analysis.register("commas", lambda c: F.split(c, ","))
    docs = spark.createDataFrame([(0, "a b,c,a b")], "doc long, t string")
    got = {r.term: r.tf for r in ixs.field_postings(docs, fd.text("t", analyzer="commas")).collect()}
    assert got == {"a b": 2, "c": 1}


def test_unicode_against_word_boundaries(spark):
    """Tokens of whole texts are the parts between default word boundaries that hold a letter or digit, by another implementation."""
    import regex

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").select("text", analysis.unicode(F.col("text")).alias("a")).collect()
    assert len(rows) > 100
    for r in rows:
        parts = regex.split(r"(?V1)(?w)\b", r.text.lower())
        assert r.a == [p for p in parts if regex.search(r"[\p{Alphabetic}\p{N}]", p)], r.text[:80]
