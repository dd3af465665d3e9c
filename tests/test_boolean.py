"""Random boolean queries against brute force in 32-bit floats, and the rules for odd clauses."""

import math
import random

import numpy as np
import pytest

from sparrowtext.functions.similarity import BM25, Boolean
from sparrowtext.operators import fields as fd
from sparrowtext.operators import index as ixs
from sparrowtext.operators.search import Searcher
from sparrowtext.plans.query import FILTER, MUST, MUST_NOT, SHOULD, Bool, Fuzzy, MatchAll, MatchNone, Phrase, PointRange, Prefix, Term, Wildcard

VOCABULARY = [f"w{i}" for i in range(12)]


def corpus():
    r = random.Random(5)
    docs = [" ".join(r.choices(VOCABULARY, weights=range(12, 0, -1), k=r.choice([0, 1, 3, 30, 45, 90]))) for _ in range(120)]
    return [*docs, None]


def q(dl):
    if dl < 40:
        return dl
    step = 2 ** ((dl - 24).bit_length() - 4)
    return 24 + (dl - 24) // step * step


def postings(docs):
    words = [(d or "").split() for d in docs]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    avgdl = np.float32(total / n)
    out = {}
    for t in VOCABULARY:
        df = sum(t in w for w in words)
        idf = np.float32(math.log(1 + (n - df + 0.5) / (df + 0.5)))
        out[t] = {}
        for doc, w in enumerate(words):
            if tf := w.count(t):
                inv = np.float32(1) / (np.float32(1.2) * ((np.float32(1) - np.float32(0.75)) + np.float32(0.75) * np.float32(q(len(w))) / avgdl))
                out[t][doc] = idf - idf / (np.float32(1) + np.float32(tf) * inv)
    return out


def brute(post, clauses, msm):
    hit = lambda t: post.get(t, {})
    of = lambda o: [t for x, t in clauses if x == o]
    need = msm if msm or of(MUST) or of(FILTER) else 1
    if not (of(MUST) or of(FILTER) or of(SHOULD)):
        return {}
    out = {}
    for doc in range(121):
        ok = all(doc in hit(t) for t in of(MUST) + of(FILTER)) and not any(doc in hit(t) for t in of(MUST_NOT))
        if ok and sum(doc in hit(t) for t in of(SHOULD)) >= need:
            out[doc] = np.float32(math.fsum(float(hit(t)[doc]) for t in of(MUST) + of(SHOULD) if doc in hit(t)))
    return out


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, d, i % 10) for i, d in enumerate(corpus())]
    return ixs.build(spark.createDataFrame(rows, "id long, text string, n int"), "id", [fd.text("text"), fd.int_field("n")], cache=True)


def test_random_queries(index):
    r, post, x = random.Random(42), postings(corpus()), Searcher(index)
    queries = []
    for _ in range(60):
        clauses = [(r.choice([MUST, SHOULD, SHOULD, SHOULD, FILTER, MUST_NOT]), r.choice([*VOCABULARY, "absent"])) for _ in range(r.randint(1, 4))]
        queries.append((clauses, r.choice([0, 0, 1, 2, 3])))
    got = {}
    for row in x.search_batch([Bool([(o, Term("text", t)) for o, t in c], m) for c, m in queries], 1000).collect():
        got.setdefault(row.query_id, {})[row.doc] = row.score
    for i, (c, m) in enumerate(queries):
        want = brute(post, c, m)
        assert got.get(i, {}).keys() == want.keys(), (c, m)
        assert all(abs(got[i][d] - s) <= 2e-7 * max(1, abs(s)) for d, s in want.items()), (c, m)
    for c, m in queries[:8]:
        assert {r.doc for r in x.hits(Bool([(o, Term("text", t)) for o, t in c], m)).collect()} == brute(post, c, m).keys()


def docs_of(index, query):
    return {r.doc for r in Searcher(index).hits(query).collect()}


def test_rules(index):
    post, t = postings(corpus()), lambda w: Term("text", w)
    assert docs_of(index, Bool([(MUST_NOT, t("w0"))])) == set()
    assert docs_of(index, Bool([])) == set()
    assert docs_of(index, Bool([(MUST, t("w0")), (FILTER, t("absent"))])) == set()
    assert docs_of(index, Bool([(SHOULD, t("w0")), (SHOULD, t("absent"))])) == post["w0"].keys()
    assert docs_of(index, Bool([(SHOULD, t("w0"))], msm=2)) == set()
    assert docs_of(index, Term("nofield", "w0")) == set()
    with pytest.raises(ValueError, match="minShouldMatch"):
        Bool([(SHOULD, t("w0"))], msm=-1)
    nested = Bool([(MUST, Bool([(SHOULD, t("w10")), (SHOULD, t("w11"))])), (MUST_NOT, t("w0"))])
    assert docs_of(index, nested) == (post["w10"].keys() | post["w11"].keys()) - post["w0"].keys()


def test_other_queries(index):
    texts = corpus()
    has = lambda f: {i for i, d in enumerate(texts) if d and f(d.split())}
    assert docs_of(index, MatchAll()) == set(range(121)) and docs_of(index, MatchNone()) == set()
    assert docs_of(index, Prefix("text", "w1")) == has(lambda w: any(x.startswith("w1") for x in w))
    assert docs_of(index, Wildcard("text", "?1*")) == has(lambda w: any(x[1] == "1" for x in w))
    assert docs_of(index, Fuzzy("text", "w11", 1)) == has(lambda w: {"w1", "w10", "w11"} & set(w))
    assert docs_of(index, Phrase("text", ("w0", "w1", "w0"))) == has(lambda w: any(w[i : i + 3] == ["w0", "w1", "w0"] for i in range(len(w))))
    assert docs_of(index, PointRange("n", 3, 4)) == {i for i in range(121) if i % 10 in (3, 4)}
    assert {r.value: r.n for r in Searcher(index).facets(MatchAll(), "n").collect()} == {k: 12 + (k == 0) for k in range(10)}
    best = [r.n for r in Searcher(index).sort_by(MatchAll(), "n", 15, False).collect()]
    assert best == sorted(best, reverse=True)


def test_similarities(index):
    for bad in ({"k1": -1}, {"k1": float("nan")}, {"b": 1.5}):
        with pytest.raises(ValueError):
            BM25(**bad)
    flat = Searcher(index, Boolean()).hits(Bool([(SHOULD, Term("text", "w0", 2.0)), (SHOULD, Term("text", "w1"))])).collect()
    assert {r.score for r in flat} == {1.0, 2.0, 3.0}
