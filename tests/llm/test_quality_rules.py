"""Statistics against naive counts, exact bounds, and cutoffs on labelled rows."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL

from sparrowtext.llm import quality_rules as qr

SCHEMA, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


CASES = [None, "", " \n ", "one", "a b c d e f g h " * 3, "a\n\na\n a\nb\r\na", "x" * 50_000, "# * $ % & | < > é é", "a b c d e f g h i a b c d e f g h", "w " * 3000, "line one\nline one\n\t\nline one"]


@pytest.mark.parametrize("text", CASES)
def test_statistics(text):
    got = qr.statistics(text)
    assert {k: got[k] for k in naive(text)} == naive(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n#é", max_size=120))
def test_statistics_of_any_text(text):
    got = qr.statistics(text)
    assert {k: got[k] for k in naive(text)} == naive(text)


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 40, 0.05), (10, 10, 0.5), (0, 5000, 0.005), (30, 3000, 0.01)])
def test_binomial_tail(k, n, p):
    want = min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert abs(qr.binomial_tail(k, n, p) - want) < 1e-9


def corpus(n=4000):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(60)]
        good = r.random() < 0.7
        if not good and r.random() < 0.8:
            words = [w + "###" if r.random() < 0.8 else w for w in words]
        docs.append((i, " ".join(words), "en" if i % 2 else "fr"))
        if i % 2 == 0 or r.random() < 0.9:
            labels.append((i, int(good), 0))
    return docs, labels


def test_certified_cutoffs_hold(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in qr.quality(d, lab).collect()}
    truth = {i: q for i, q, _ in labels}
    for lang in ("en", "fr"):
        good = [r for r in got.values() if r.stratum == lang and truth.get(r.doc_id) == 1]
        bad = [r for r in got.values() if r.stratum == lang and truth.get(r.doc_id) == 0]
        wrong = sum(not r.kept for r in good)
        assert wrong <= 0.005 * len(good)  # by all rules together
        assert sum(not r.kept for r in bad) > 0.7 * len(bad)


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, SCHEMA)
    m = qr.measured(d)
    assert qr.certify(m, spark.createDataFrame(labels[:40], LABELS)) == {}
    assert qr.certify(m, spark.createDataFrame([], LABELS)) == {}


def test_fixed_sequence_stops_at_the_first_failure(spark):
    # every tenth good row scores at the top of one rule: no cutoff of this rule can be certified
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" ###" * 40 if i % 10 == 0 else ""), "en") for i in range(3000)]
    labels = [(i, 1, 0) for i in range(3000)]
    assert qr.certify(qr.measured(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(labels, LABELS)) == {}


def test_a_stratum_seldom_loses_more_than_alpha():
    # rule sets of which the third and later lose too much: none of them may be chosen more often than the level says
    r = random.Random(1)
    sets = [{"symbols": 60 - i} for i in range(6)]
    rates, alpha, level, n = [0.001, 0.002, 0.006, 0.01, 0.02, 0.04], 0.005, 0.05, 3000
    wrong = 0
    for _ in range(400):
        at = [next((i for i, p in enumerate(rates) if u < p), 6) for u in (r.random() for _ in range(n))]
        good, bad = [at.count(i) for i in range(7)], [20, 20, 500, 500, 500, 500, 0]
        got = qr.certified(sets, good, bad, alpha, level, 1.0)
        wrong += got.get("symbols", 61) <= 58
    assert wrong <= 400 * level + 3 * math.sqrt(400 * level * (1 - level))
    # the smallest number of good labels that can certify anything: none rejected, at the level of one of five strata
    least = next(n for n in range(1, 5000) if qr.binomial_tail(0, n, 0.005) <= 0.05 / 5)
    assert least == 919


def test_sequences_are_nested_and_do_not_use_the_stratum(spark):
    good = {k: [90, 10] + [0] * (qr.GRID - 1) for k in qr.RULES}
    bad = {k: [60, 0] + [0] * 30 + [40] + [0] * (qr.GRID - 32) for k in qr.RULES}
    path = qr.sequence(good, bad, 20.0)
    assert path and all(set(a.items()) <= set(b.items()) or all(b[k] <= v for k, v in a.items()) for a, b in zip(path, path[1:]))
    assert len(qr.sequence({k: [0] * 65 for k in qr.RULES}, {k: [0] * 65 for k in qr.RULES}, 20.0)) == qr.GRID


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b", "en"), (None, "c d", "en"), (big + 2, None, "en")], SCHEMA).coalesce(1)
    assert {r.doc_id for r in qr.quality(docs, spark.createDataFrame([], LABELS)).collect()} == {big, big + 2, None}


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None, "en"), (None, text, None), (2, "", "xx"), (3, text, "en"), (3, text, "en"), (4, "few words", "fr"), (5, "a b c d e f g h " * 4, "de")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", t int, n_words int, stratum string")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 1, 0), (3, 1, 0), (99, 0, 1)], LABELS)
    got = qr.quality(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].base_failed for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True] and by[None].stratum == by[2].stratum == "other"
    assert all(r.kept == (not r.base_failed) for r in got)
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == [3, 3, None]


def test_empty_table(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert qr.quality(empty, labels).count() == 0 and qr.keep_good(empty, labels).count() == 0


def test_filter_agrees_with_query(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in qr.quality(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in qr.keep_good(docs, labels).collect()} == kept
    for r in qr.quality(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = naive(r.text)
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
