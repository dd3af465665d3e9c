"""Plans and files that keep an index's work in proportion to its documents: what is made within a row, what is not sorted, what is not shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparrowtext.functions import analysis
from sparrowtext.operators import fields as fd
from sparrowtext.operators import index as ixs
from sparrowtext.operators.search import Searcher
from sparrowtext.plans.query import Phrase, Term
from sparrowtext.sources import store as store_
from sparrowtext.sources.store import Store

MOVES = re.compile(r"Exchange|Sort|Aggregate|Window")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(n, seed=1):
    r = random.Random(seed)
    odd = [None, "", "  ,", "é" * 300 + " ab " + "é" * 299, "Ab aB AB", "don't – don’t"]
    return list(enumerate(odd + [" ".join(r.choice(["a", "b", "ü", "word7", "The"]) + r.choice(["", ",", " é"]) for _ in range(r.randrange(80))) for _ in range(n)]))


def brute(rows):
    """(term, doc) -> positions, byte starts, byte lengths; of a longer token the first 255 characters."""
    out = {}
    for doc, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for k, m in enumerate(re.finditer(r"\w+(?:['’]\w+)*", folded)):
            t = m[0][:255]
            out.setdefault((t, doc), []).append((k, len(folded[: m.start()].encode()), len(t.encode())))
    return out


@pytest.mark.parametrize("level", ["freqs", "positions", "offsets"])
def test_postings_are_made_within_a_row(spark, level):
    rows = texts(60)
    docs, want = spark.createDataFrame(rows, "doc long, text string"), brute(rows)
    post = ixs.field_postings(docs, fd.text("text", level=level))
    assert not MOVES.search(plan(post)) and plan(post).count("regexp_extract_all") == 1
    got = {(r.term, r.doc): r for r in post.collect()}
    assert got.keys() == want.keys() and all(r.tf == len(want[k]) and r.head == (want[k][0][0] == 0) for k, r in got.items())
    if level != "freqs":
        assert all(r.positions == [p for p, _, _ in want[k]] for k, r in got.items())
    if level == "offsets":
        assert all((r.starts, r.lens) == ([b for _, b, _ in want[k]], [n for _, _, n in want[k]]) for k, r in got.items())


def test_vectors_are_made_within_a_row(spark):
    rows = texts(20)
    vectors = ixs.term_vectors(spark.createDataFrame(rows, "doc long, text string"), fd.text("text", level="offsets"))
    assert not MOVES.search(plan(vectors))
    got = {(t.term, r.doc): list(zip(t.positions, t.starts, t.lens)) for r in vectors.collect() for t in r.terms}
    assert got == brute(rows)
    assert all([t.term for t in r.terms] == sorted(t.term for t in r.terms) for r in vectors.collect())


def test_texts_are_sorted_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(analysis, "SORTED_AT_ONCE", 50)  # less than the longest text
    rows = texts(60)
    post = ixs.field_postings(spark.createDataFrame(rows, "doc long, text string").coalesce(1), fd.text("text", level="offsets"))
    got = {(r.term, r.doc): list(zip(r.positions, r.starts, r.lens)) for r in post.collect()}
    assert got == brute(rows)


def test_a_segment_is_runs_of_bounded_size(spark, tmp_path, monkeypatch):
    rows, fields = texts(200), [fd.text("text"), fd.string("kind")]
    docs = spark.createDataFrame([(i, t, f"k{i % 3}") for i, t in rows], "id long, text string, kind string")
    tf, lengths, sizes = {k: len(p) for k, p in brute(rows).items()}, {}, []
    for (_, d), n in tf.items():
        lengths[d] = lengths.get(d, 0) + n
    for k, size in enumerate((1 << 20, 4096)):
        monkeypatch.setattr(store_, "RUN_BYTES", size)
        store = Store(spark, f"file://{tmp_path}/ix{k}")
        store.write(docs, "id", fields)
        files = store.open().postings.select("field", "term", "doc", "tf", F.input_file_name().alias("file")).collect()
        by = {}
        for r in files:
            by.setdefault(r.file, []).append((r.field, r.term, r.doc))
        assert all(x == sorted(x) and len({f for f, _, _ in x}) == 1 for x in by.values())
        assert sorted((r.term, r.doc, r.tf) for r in files if r.field == "text") == sorted((t, d, n) for (t, d), n in tf.items())
        norms = store.open().norms.collect()
        assert sorted((r.doc, r.dl) for r in norms if r.field == "text") == sorted(lengths.items())
        assert sum(r.field == "kind" and r.dl_q == 1 for r in norms) == len(rows)
        sizes.append(sum(x[0][0] == "text" for x in by.values()))
    total = sum(64 + len((t or "").encode()) for _, t in rows)
    assert sizes == [1, -(-total // 4096)]


@pytest.mark.parametrize("few, join", [(2, "BroadcastHashJoin"), (1, "ShuffledHashJoin")])
def test_deletes_leave_postings_unsorted(spark, tmp_path, monkeypatch, few, join):
    monkeypatch.setattr(store_, "FEW_DELETES", few)
    store = Store(spark, f"file://{tmp_path}/ix")
    docs = spark.createDataFrame([(i, f"common word{i % 3}") for i in range(12)], "id long, text string")
    store.write(docs.where("id < 6"), "id", [fd.text("text")])
    store.write(docs.where("id >= 6"), "id", [fd.text("text")], mode="append")
    store.delete(spark.createDataFrame([(1,), (8,)], "doc long"))
    now = plan(store.open().postings)
    assert join in now and "SortMergeJoin" not in now
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store.merge()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split
    x = Searcher(store.open())
    assert {r.doc for r in x.hits(Term("text", "common")).collect()} == set(range(12)) - {1, 8}
    assert {r.doc for r in x.hits(Term("text", "word1")).collect()} == {4, 7, 10} and store.open().norms.count() == 10


def test_documents_are_not_sorted_to_meet_their_ranks(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = plan(ixs.with_doc(spark.createDataFrame([("b", "x"), ("a", "y")], "k string, text string"), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "ShuffledHashJoin" in now and "SortMergeJoin" not in now


def test_phrases_are_met_within_a_row(spark):
    rows = [(0, "a a a b"), (1, "b a"), (2, "a b a b a"), (3, "c"), (4, "a c b"), (5, "a a b a a b")]
    index = ixs.build(spark.createDataFrame(rows, "id long, text string"), "id", [fd.text("text")], cache=True)
    x = Searcher(index)
    for words in (("a", "b"), ("a", "a"), ("a", "a", "b"), ("b", "a", "b", "a"), ("a",), ("a", "zzz")):
        hits = x.hits(Phrase("text", words))
        assert "explode(positions" not in plan(hits)
        assert {r.doc for r in hits.collect()} == {d for d, t in rows if any(tuple(t.split()[i : i + len(words)]) == words for i in range(9))}
