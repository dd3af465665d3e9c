"""Known rankings over a corpus of 15 short documents, given by term frequencies and lengths."""

import pytest
from pyspark.sql import functions as F

from sparrowtext.operators import fields as fd
from sparrowtext.operators import index as ixs
from sparrowtext.operators.search import Searcher
from sparrowtext.plans.parser import parse
from sparrowtext.plans.query import FILTER, MUST, SHOULD, Bool, Term

WORDS = "algorithms data systems distributed memory performance quantum computing networks security biology compilers".split()
# Length, then the frequency of each of WORDS.
CORPUS = [
    (41, 1, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0), (15, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0), (33, 0, 0, 2, 1, 0, 1, 0, 0, 0, 0, 1, 0), (48, 1, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0), (19, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (36, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (46, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0), (33, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (33, 0, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0), (55, 0, 1, 2, 0, 1, 0, 1, 1, 0, 0, 0, 0),
    (27, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (53, 2, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (35, 0, 1, 2, 0, 0, 1, 0, 0, 0, 0, 0, 0), (26, 0, 0, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0), (32, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0),
]
# Query, least SHOULD, hits, best documents with their scores.
RANKED = [
    ("+algorithms +data", 0, 4, "11:0.9744643 0:0.8020670 14:0.8000477 3:0.6710463"),
    ("+distributed +systems", 0, 6, "13:0.6466637 2:0.5788049 7:0.5369343 8:0.5369343 6:0.5074845 0:0.4957356"),
    ("+memory +performance", 0, 1, "0:1.1177642"),
    ("+quantum +computing", 0, 1, "9:1.7729266"),
    ("algorithms data", 0, 10, "11:0.9744643 0:0.8020670 14:0.8000477 3:0.6710463 5:0.2621497 1:0.2506270 10:0.2121821 12:0.1924969 6:0.1707188 9:0.1577401"),
    ("distributed systems", 0, 12, "13:0.6466637 2:0.5788049 7:0.5369343 8:0.5369343 6:0.5074845 0:0.4957356 12:0.1548606 3:0.1403393 4:0.1385187 9:0.1345176"),
    ("memory performance", 0, 7, "0:1.1177642 8:0.7110608 1:0.6353776 9:0.5691590 14:0.5055991 2:0.4995965 12:0.4880089"),
    ("+distributed -security", 0, 6, "13:0.4596379 2:0.4214391 7:0.4214391 8:0.4214391 0:0.3891023 6:0.3650910"),
    ("+memory -quantum", 0, 2, "8:0.7110608 0:0.6565015"),
    ("distributed -security", 0, 6, "13:0.4596379 2:0.4214391 7:0.4214391 8:0.4214391 0:0.3891023 6:0.3650910"),
    ("+algorithms data", 0, 4, "11:0.9744643 0:0.8020670 14:0.8000477 3:0.6710463"),
    ("+memory performance", 0, 3, "0:1.1177642 8:0.7110608 9:0.5691590"),
    ("distributed systems networks", 0, 12, "8:1.6444092 13:0.6466637 2:0.5788049 7:0.5369343 6:0.5074845 0:0.4957356"),
    ("quantum biology security", 0, 2, "2:1.1074749 9:0.8864633"),
    ("algorithms data systems networks compilers", 0, 15, "4:1.4667643 8:1.2229701 11:1.0687020 0:0.9087003 3:0.8113856 14:0.8000477 12:0.3473575 10:0.3365355 6:0.3131124 9:0.2922577"),
    ("+algorithms -systems -networks", 0, 1, "14:0.6006123"),
    ("+algorithms data systems", 0, 4, "11:1.0687020 0:0.9087003 3:0.8113856 14:0.8000477"),
    ("algorithms data systems", 2, 8, "11:1.0687020 0:0.9087003 3:0.8113856 14:0.8000477 12:0.3473575 10:0.3365355 6:0.3131124 9:0.2922577"),
    ("+nonexistent1 +nonexistent2", 0, 0, ""),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = []
    for doc, (length, *tfs) in enumerate(CORPUS):
        words = [w for w, n in zip(WORDS, tfs) for _ in range(n)]
        rows.append((doc, " ".join(words + [f"filler{doc}x{i}" for i in range(length - len(words))])))
    return ixs.build(spark.createDataFrame(rows, "id long, text string"), "id", [fd.text("text")], cache=True)


def test_statistics(index):
    s = index.stats.first()
    assert (s.max_doc, s.doc_count, s.sum_ttf) == (15, 15, 532)


@pytest.mark.parametrize("query, msm, hits, best", RANKED, ids=[r[0] for r in RANKED])
def test_ranking(index, query, msm, hits, best):
    x = Searcher(index)
    q = parse(query, msm=msm)
    got = x.search(q, 10).collect()
    assert x.count(q).first()[0] == hits
    want = [(int(d), float(s)) for d, s in (p.split(":") for p in best.split())]
    assert [r.doc for r in got][: len(want)] == [d for d, _ in want]
    assert all(abs(r.score - s) < 1e-5 for r, (_, s) in zip(got, want))


def test_batch_is_the_single_queries(index):
    queries = [parse(q, msm=m) for q, m, *_ in RANKED]
    got = {}
    for r in Searcher(index).search_batch(queries, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score, r.total_hits))
    for i, q in enumerate(queries):
        one = Searcher(index).search(q, 10).collect()
        assert [(d, s) for _, d, s, _ in sorted(got.get(i, []))] == [(r.doc, r.score) for r in one]
        assert all(n == RANKED[i][2] for *_, n in got.get(i, []))


def test_boost_and_filter(index):
    x = Searcher(index)
    plain, twice = (x.search(Term("text", "data", b), 1).first().score for b in (1.0, 2.0))
    assert abs(twice - 2 * plain) < 1e-6
    only = x.search(Bool([(FILTER, Term("text", "memory"))]), 10).collect()
    assert [(r.doc, r.score) for r in only] == [(0, 0.0), (8, 0.0), (9, 0.0)]
    both = x.search(Bool([(MUST, Term("text", "data")), (FILTER, Term("text", "memory"))]), 10).collect()
    alone = {r.doc: r.score for r in x.hits(Term("text", "data")).collect()}
    assert {r.doc: r.score for r in both} == {d: alone[d] for d in (0, 9)}
    again = x.search(Bool([(SHOULD, Term("text", "data")), (SHOULD, Term("text", "data"))]), 1).first().score
    assert abs(again - 2 * plain) < 1e-6


def test_paging(index):
    x, q = Searcher(index), parse("algorithms data systems networks compilers")
    whole = [(r.doc, r.score) for r in x.search(q, 15).collect()]
    assert [(r.doc, r.score) for r in x.search_after(whole[4], q, 5).collect()] == whole[5:10]
    assert [(r.doc, r.score) for r in x.page(q, 3, 4).collect()] == whole[3:7]
    assert x.search(q, 100).count() == 15
    for bad in (lambda: x.search(q, 0), lambda: x.search_after((99, 1.0), q, 5)):
        with pytest.raises(ValueError):
            bad()


def test_explain_parts_sum_up(index):
    x, q = Searcher(index), parse("algorithms data")
    parts = x.explain(q, 11).agg(F.sum(F.col("score").cast("double"))).first()[0]
    assert abs(parts - x.search(q, 1).first().score) < 1e-6
