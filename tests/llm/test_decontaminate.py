"""Windows against brute force over every place of every document, and odd rows."""

import math
import random
from collections import Counter

import pytest

from conftest import SMALL

from sparrowtext.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.decode() for w in (text or "").translate(LOWER).encode().split()]


def bag(ws, size):
    return Counter(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def brute(docs, items, least):
    """(doc_id, item_id) -> best similarity over all windows, if at least `least`."""
    held = {i: words(t) for i, t in items if words(t)}
    bags = {i: bag(w, min(5, len(w))) for i, w in held.items()}
    having = Counter(s for b in bags.values() for s in b)
    idf = lambda s: math.log1p(len(held) / having[s]) if s in having else math.log1p(len(held))
    out = {}
    for doc, text in docs:
        ws = words(text)
        grams = {k: bag(ws, k).keys() for k in {min(5, len(w)) for w in held.values()}}
        for item, iw in held.items():
            size, own = min(5, len(iw)), bags[item]
            if not own.keys() & grams[size]:
                continue
            for start in range(max(1, len(ws) - len(iw) + 1)):
                b = bag(ws[start : start + len(iw)], size)
                both = sum(min(n, b[s]) * idf(s) for s, n in own.items())
                total = sum(n * idf(s) for s, n in own.items()) + sum(n * idf(s) for s, n in b.items()) - both
                if both / total >= least:
                    out[doc, item] = max(out.get((doc, item), 0), both / total)
    return out


def found(spark, docs, items, **how):
    got = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how).collect()
    assert len({(r.doc_id, r.text_hash, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): r.similarity for r in got}


def planted(seed=6, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 12, 30, 60])))) for i in range(20)]
    items[3] = (3, items[2][1])  # two items of one text
    docs = []
    for i in range(n):
        ws = r.choices(vocabulary, k=r.choice([0, 4, 40, 300]))
        for _ in range(r.choice([0, 0, 1, 2])):
            passage = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                k = r.randrange(len(passage))
                r.choice([lambda: passage.insert(k, "new"), lambda: passage.pop(k) if len(passage) > 2 else None, lambda: passage.__setitem__(k, "other")])()
            at = r.randint(0, len(ws))
            ws[at:at] = [w.upper() if r.random() < 0.1 else w for w in passage]
        docs.append((i, r.choice([" ", "\n", "\t "]).join(ws)))
    return docs, items


@pytest.mark.parametrize("seed", [6, 7])
def test_planted_passages(spark, seed):
    docs, items = planted(seed)
    got, want = found(spark, docs, items), brute(docs, items, 0.8)
    assert all(abs(want[k] - s) < 1e-6 or want[k] >= s for k, s in got.items()) and got.keys() <= want.keys()
    assert got.keys() == want.keys()  # recall of 1 at this radius


@pytest.mark.parametrize("n, cut", [(200, 100), (60, 30), (60, 20), (90, 70)])
def test_swapped_parts_are_found(spark, n, cut):
    ws = [f"v{i}" for i in range(n)]
    items = [(1, " ".join(ws)), (2, "another item of some words that stands beside the first")]
    docs = [(1, "before it " + " ".join(ws[cut:] + ws[:cut]) + " behind it"), (2, " ".join(ws)), (3, " ".join(ws[cut:] + ["x"] + ws[:cut]))]
    got, want = found(spark, docs, items), brute(docs, items, 0.8)
    assert want.keys() == got.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and (1, 1) in got


def test_similar_pairs_lie_within_the_radius(spark):
    # items of uneven weights, each edited until it is near the threshold: how far do fingerprints differ?
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(40 if i % 2 else 4000)}" for _ in range(r.choice([20, 40, 80])))) for i in range(60)]
    docs = []
    for k in range(300):
        ws = words(r.choice(items)[1])
        for _ in range(max(1, len(ws) // 40)):
            ws[r.randrange(len(ws))] = "other"
        docs.append((k, " ".join(ws)))
    want = brute(docs, items, 0.8)
    got = found(spark, docs, items)
    assert len(want) > 150 and got.keys() == want.keys()
    near = found(spark, docs, items, radius=15)
    assert len(near) >= 0.9 * len(want)


def test_shuffled_join_gives_the_same(spark):
    docs, items = planted()
    assert found(spark, docs, items) == found(spark, docs, items, broadcast_rows=0)


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, " \n"), (4, item), (4, item), (5, item.upper() + " x"), (None, "before " + item), (6, "q0 q1 q2"), (7, ("z " * 150_000) + item), (8, item), (8, "other " + item), (9, item + " y " + item)]
    items = [(1, item), (1, "q0"), (2, None), (3, "  "), (None, "alone in its item with many words here"), (4, "q5"), (10, "Unrelated words of some other passage here")]
    frame = spark.createDataFrame([(*d, 1, 2, "z", 3) for d in docs], DOCS + ", w int, item_id int, _id string, _hash int")
    bench = spark.createDataFrame([(*i, 1) for i in items], ITEMS + ", n int")
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect())
    with_item = {(d, 1): 1 for d in (4, 5, None, 7, 9)} | {(8, 1): 2}
    one_word = {(d, 4): n for (d, _), n in with_item.items()}
    assert got == with_item | one_word
    left = dc.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted((r.doc_id for r in left.collect())) == [1, 2, 3, 6]


def test_empty_tables(spark):
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    docs, items = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert [dc.contaminated(a, b).count() for a, b in ((none_d, items), (docs, none_i), (none_d, none_i), (docs, items))] == [0, 0, 0, 1]
    assert dc.drop_contaminated(docs, none_i).count() == 1 and dc.drop_contaminated(none_d, items).count() == 0
    with pytest.raises(ValueError):
        dc.contaminated(docs, items, radius=64)


def test_small_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 0.8)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert got == want.keys()


def test_no_python_in_the_plan(spark):
    docs, items = planted(n=5)
    plan = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
