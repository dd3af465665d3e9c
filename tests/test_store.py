"""Index directories: versions, segments, deletes, merges, streams; fields and their values."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from sparrowtext.catalogue import KIND_FIELDS, every_kind
from sparrowtext.functions import encoding
from sparrowtext.functions.similarity import quantized_length
from sparrowtext.operators import fields as fd
from sparrowtext.operators import index as ixs
from sparrowtext.operators import terms as tm
from sparrowtext.operators.search import Searcher
from sparrowtext.plans import parser
from sparrowtext.plans.query import MUST, SHOULD, Bool, Term
from sparrowtext.sources import corpora
from sparrowtext.sources.store import Store
from sparrowtext.streaming.ingest import ingest

FIELDS = [fd.text("text"), fd.keyword("tag")]


def docs(spark, lo, hi):
    return spark.createDataFrame([(i, f"common word{i % 3} only{i}", f"t{i % 2}") for i in range(lo, hi)], "id long, text string, tag string")


def ranked(index, *terms):
    return [(r.doc, r.score) for r in Searcher(index).search(Bool([(SHOULD, Term("text", t)) for t in terms]), 50).collect()]


def test_versions_append_delete_merge(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    with pytest.raises(FileNotFoundError):
        store.open()
    assert store.write(docs(spark, 0, 0), "id", FIELDS) is None and store.versions() == []
    store.write(docs(spark, 0, 20), "id", FIELDS)
    store.write(docs(spark, 20, 30), "id", FIELDS, mode="append")
    assert store.versions() == [1, 2]
    once = Store(spark, f"file://{tmp_path}/whole")
    once.write(docs(spark, 0, 30), "id", FIELDS)
    want = ranked(once.open(), "word1", "only7")
    assert ranked(store.open(), "word1", "only7") == want
    assert len(ranked(store.open(1), "common")) == 20
    store.delete(spark.createDataFrame([(1,), (1,), (7,)], "doc long"))
    assert {d for d, _ in ranked(store.open(), "word1")} == {d for d, _ in ranked(once.open(), "word1")} - {1, 7}
    store.merge()
    merged = store.open()
    assert merged.deleted is None and merged.docs.count() == 28 and merged.stats.where("field = 'text'").first().doc_count == 28
    store.write(docs(spark, 20, 25), "id", FIELDS, mode="update", segment="batch")
    store.write(docs(spark, 20, 25), "id", FIELDS, mode="update", segment="batch")  # replaces itself
    assert len(store.manifest()["segments"]) == 2
    with pytest.raises(ValueError):
        store.write(docs(spark, 0, 1), "id", [fd.string("text")], mode="append")
    store.write(docs(spark, 0, 3), "id", FIELDS)
    assert store.open().docs.count() == 3


def test_segments_apart(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(docs(spark, 0, 4), "id", FIELDS, segment="a1")
    store.write(docs(spark, 4, 10), "id", FIELDS, mode="append", segment="b1")
    assert store.open(only="b").docs.count() == 6 and len(ranked(store.open(), "common")) == 10
    with pytest.raises(FileNotFoundError):
        store.open(only="c")
    got = {(r.segment, (x := json.loads(r.json))["field"]): x["sum_ttf"] for r in store.summary().collect()}
    assert got == {("a1", "text"): 12, ("a1", "tag"): 4, ("b1", "text"): 18, ("b1", "tag"): 6}


def test_every_kind_of_field(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"doc_{i}.txt").write_text(f"some words {i}\n" * (i + 1))
    files = corpora.text_files(spark, f"{tmp_path}/in")
    assert sorted((r.title, r.contents.count("\n"), r.size) for r in files.collect()) == [(f"doc_{i}", i + 1, 13 * (i + 1)) for i in range(4)]
    rows = files.select(F.regexp_extract("title", "[0-9]+", 0).cast("long").alias("doc_id"), F.col("contents").alias("text"), F.lit("disk").alias("source"))
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(every_kind(rows), "path", KIND_FIELDS)
    by = {r.field: r for r in ixs.summary(store.open()).collect()}
    assert len(by) == len(KIND_FIELDS) and by["contents"].sum_ttf == 30 and by["contents"].vector_docs == 4 and by["dv_number"].dv_docs == 2
    assert by["place"].point_docs == by["double_span"].point_docs == by["path"].dv_docs == 4 and by["weights"].sum_df == 4


def test_string_keys_of_segments_do_not_collide(spark, tmp_path):
    store, fields = Store(spark, f"file://{tmp_path}/ix"), [fd.text("text")]
    for k, text in (("a", "apple"), ("b", "pear"), ("c", "apple pear")):
        store.write(spark.createDataFrame([(k, text)], "path string, text string"), "path", fields, mode="append")
    assert sorted(r.doc for r in store.open().docs.collect()) == [0, 1, 2]
    both = Bool([(MUST, Term("text", "apple")), (MUST, Term("text", "pear"))])
    x = Searcher(store.open())
    assert [r.path for r in x.fetch(x.hits(both), "path").collect()] == ["c"]


def test_updates_replace_and_come_back(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(docs(spark, 0, 6), "id", FIELDS)
    store.delete(spark.createDataFrame([(1,)], "doc long"))
    store.write(docs(spark, 1, 2).withColumn("text", F.lit("new apple")), "id", FIELDS, mode="update")
    assert [d for d, _ in ranked(store.open(), "apple")] == [1] and 1 not in {d for d, _ in ranked(store.open(), "common")}
    store.update(docs(spark, 2, 4).withColumn("text", F.lit("changed")), "id", FIELDS)
    assert {d for d, _ in ranked(store.open(), "common")} == {0, 4, 5} and {d for d, _ in ranked(store.open(), "changed")} == {2, 3}
    x = Searcher(store.open())
    assert x.fetch(x.hits(Term("text", "changed")), "tag").count() == 2
    with pytest.raises(ValueError, match="update"):
        store.write(docs(spark, 5, 7), "id", FIELDS, mode="append")
    with pytest.raises(ValueError, match="share an id"):
        store.write(docs(spark, 8, 9).union(docs(spark, 8, 9)), "id", FIELDS, mode="append")
    before = store.versions()
    store.merge()
    assert len(store.versions()) == len(before) + 1 and {d for d, _ in ranked(store.open(), "common")} == {0, 4, 5}
    assert store.open().stats.where("field = 'text'").first().doc_count == 6


def test_a_list_cut_short_is_no_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(docs(spark, 0, 3), "id", FIELDS)
    (tmp_path / "ix" / "segments_2").write_text('{"segments": [')
    assert store.open().docs.count() == 3
    store.write(docs(spark, 3, 5), "id", FIELDS, mode="append")
    assert store.open().docs.count() == 5 and store.versions() == [1, 2, 3]


def test_opening_runs_no_job(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(docs(spark, 0, 9), "id", FIELDS, segment="a")
    store.write(docs(spark, 9, 30), "id", FIELDS, mode="append", segment="b")
    whole = ixs.build(docs(spark, 0, 30), "id", FIELDS).stats
    columns = store.open().stats.columns
    assert sorted(map(tuple, store.open().stats.collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    spark.sparkContext.setJobGroup("opening", "")
    ix = store.open()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ix.stats.columns == columns
    # listing file footers for the schema is all that may run
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("opening")) <= 2


def test_term_filter_reaches_the_scan(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.write(docs(spark, 0, 50), "id", FIELDS)
    plan = Searcher(store.open()).hits(Term("text", "word1"))._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "tf:int" in x)
    assert "EqualTo(term,word1)" in scan and "positions" not in scan.split("ReadSchema")[1]


def test_stream(spark, tmp_path):
    for k in range(3):
        docs(spark, 10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(stream, f"file://{tmp_path}/ix", "id", FIELDS, f"{tmp_path}/check").awaitTermination()
    store = Store(spark, f"file://{tmp_path}/ix")
    assert len(store.manifest()["segments"]) == 3 and len(ranked(store.open(), "common")) == 30


def test_terms(spark):
    ix = ixs.build(docs(spark, 0, 6), "id", FIELDS, cache=True)
    assert ix.full_stats().where("field = 'text'").first().term_count == 10
    assert [r.term for r in tm.terms(ix, "text", "w").collect()] == ["word0", "word1", "word2"]
    assert tm.seek_exact(ix, "text", "common").first().df == 6 and tm.seek_exact(ix, "text", "nope").count() == 0
    assert [tuple(tm.seek_ceil(ix, "text", t).first()) for t in ("word1", "worc", "x")] == [("FOUND", "word1"), ("NOT_FOUND", "word0"), ("END", None)]
    assert tuple(tm.bounds(ix, "text").first()) == ("common", "word2", 10)


def test_composite_keys_are_ranked(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1)], "k string, n int")
    assert {(r.k, r.n): r.doc for r in ixs.with_doc(df, ["k", "n"]).collect()} == {("a", 9): 0, ("b", 1): 1, ("b", 2): 2}


def test_shapes_and_values(spark):
    with pytest.raises(ValueError):
        fd.checked([fd.text("a"), fd.keyword("a")])
    df = spark.createDataFrame([(0, ["b", "a", "b"], [3, 1, 3]), (1, None, None)], "doc long, s array<string>, n array<long>")
    assert ixs.doc_values(df, fd.sorted_set_dv("s")).collect()[0].value == ["a", "b"]
    assert ixs.doc_values(df, fd.sorted_numeric_dv("n")).collect()[0].value == [1, 3, 3]
    bad = spark.createDataFrame([(0, (2, 1))], "doc long, r struct<min:int,max:int>")
    with pytest.raises(Exception, match="min exceeds"):
        ixs.point_columns(bad, fd.int_range("r")).collect()
    far = spark.createDataFrame([(0, (91.0, 0.0))], "doc long, p struct<lat:double,lon:double>")
    with pytest.raises(Exception, match="out of range"):
        ixs.point_columns(far, fd.lat_lon("p")).collect()
    edge = spark.createDataFrame([(0, (90.0, 180.0)), (1, (-90.0, -180.0)), (2, (0.0, 0.0))], "doc long, p struct<lat:double,lon:double>")
    assert [(r.lat, r.lon) for r in ixs.point_columns(edge, fd.lat_lon("p")).orderBy("doc").collect()] == [(2**31 - 1, 2**31 - 1), (-(2**31), -(2**31)), (0, 0)]


def test_feature_bits(spark):
    values = [0.5, 1.0, 3.14159, 1e-20, 1e20, 10.4, 255.99, 2.0**-126]
    df = spark.createDataFrame([(v,) for v in values], "v float").select("v", encoding.feature_freq(F.col("v")).alias("f"), encoding.feature_value(encoding.feature_freq(F.col("v"))).alias("b"))
    for r in df.collect():
        bits = struct.unpack("<I", struct.pack("<f", r.v))[0] >> 15
        assert r.f == bits and r.b == struct.unpack("<f", struct.pack("<I", bits << 15))[0]
    docs = spark.createDataFrame([(0, {"a": -1.0})], "doc long, m map<string,float>")
    with pytest.raises(Exception, match="positive"):
        ixs.field_postings(docs, fd.feature("m")).collect()


def test_length_norms(spark):
    def want(n):
        step = 2 ** ((n - 24).bit_length() - 4) if n >= 40 else 1
        return n if n < 40 else 24 + (n - 24) // step * step

    df = spark.range(0, 70_000).select(F.col("id").cast("int").alias("n")).select("n", quantized_length(F.col("n")).alias("q"))
    assert all(r.q == want(r.n) for r in df.collect()) and math.isfinite(want(69_999))


def test_parser():
    q = parser.parse("+a -b c d", msm=2)
    assert [(o, t.term) for o, t in q.clauses] == [("must", "a"), ("must_not", "b"), ("should", "c"), ("should", "d")] and q.msm == 2
    assert parser.parse("a b", msm=3).msm == 0 and isinstance(parser.parse("Word"), Term)
    with pytest.raises(ValueError):
        parser.parse("  ")
    assert len(parser.read_batch(['{"q": "a"}', "", '{"q": "a b", "msm": 1}'])) == 2


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.txt").write_text("héllo")
    got = corpora.text_files(spark, str(tmp_path)).first()
    assert (got.title, got.contents, got["size"]) == ("one", "héllo", 6)
