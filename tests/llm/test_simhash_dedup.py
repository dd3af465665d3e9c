"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash

from conftest import SMALL

from sparrowtext.llm import simhash_dedup as sd

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    table = {ord(c): ord(c) + 32 for c in map(chr, range(65, 91))}
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(table)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(items, radius=3):
    """items: (id, fp); row -> smallest id of its component."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    return [min((items[j][0] for j in range(len(items)) if find(j) == find(i) and items[j][0] is not None), default=None) for i in range(len(items))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "A B C d E", "x\x1cy z\x85w v", "é É ß " * 9, "word " * 70_000, "the quick brown fox " * 7 + "jumps"])
def test_fingerprint(text):
    assert sd.fingerprint(text) == brute_fingerprint(text)


def test_blocks_of_long_texts():
    r = random.Random(3)
    text = " ".join(str(r.randrange(500)) for _ in range(140_000))
    words = text.split()
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    assert sd.fingerprint(text) == sum((2 * v > len(words) - 2) << b for b, v in enumerate(votes))


def test_links_are_all_pairs_once(spark):
    r = random.Random(7)
    fps = {0, 1, 3, 7, 15, (1 << 63), (1 << 64) - 1}
    for base in [r.getrandbits(64) for _ in range(40)]:
        fps.add(base)
        for k in (1, 1, 2, 2, 3, 3, 3, 4):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), k)))
    hot = r.getrandbits(32)
    fps |= {hot << 32 | r.getrandbits(32) for _ in range(300)} | {r.getrandbits(32) << 32 | hot for _ in range(300)}
    signed = sorted(f - (1 << 64) * (f >> 63) for f in fps)
    got = [tuple(x) for x in sd.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        sd.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_variants_are_not_broadcast(spark):
    # a written table of classes is below the broadcast threshold, the 64 rows that come of each class are not
    classes = sd.cut(spark.range(1000).selectExpr("xxhash64(id) AS fp"), "classes")
    plan = sd.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250), (7, 7000)]
    edges = [(min(e), max(e)) for e in edges]
    got = {r.node: r.root for r in sd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and got[7000] == 0
    assert all(got[i] == 100 for i in range(101, 160)) and got[300] == got[250] == 200


def test_rows_with_nulls_ties_and_copies(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long + " extra"), (9, None), (2, ""), (None, long), (None, "lone words here"), (7, "one two three"), (7, "one two three"), (8, "  ONE two\tTHREE ")]
    got = sd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == sorted((repr(i), f"{brute_fingerprint(t):016x}", repr(c)) for (i, t), c in zip(rows, want))
    kept = [(r.doc_id, r.text) for r in sd.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert {i for i, _ in kept} == {c if c is not None else None for c in want} and len(kept) == len(set(want))


def test_equal_ids_of_different_texts(spark):
    rows = [(7, "one two three four five"), (3, "one two three four five"), (7, "quite another text than that"), (None, "nameless words one"), (None, "nameless words one"), (None, "others without name")]
    kept = sd.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([rows[1], rows[2], rows[3], rows[5]], key=repr)


def test_empty_and_other_columns(spark):
    assert sd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sd.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d", 1, 2, 3, 4), (2, "a b c d", 5, 6, 7, 8)], "doc_id long, text string, fp int, root int, _keep int, t int")
    assert sd.near_duplicates(odd).columns == ["doc_id", "fingerprint", "component_id"]
    kept = sd.keep_one(odd)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d", 1, 2, 3, 4)]


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sd.near_duplicates(docs).collect()}
    assert got == {i: (f"{brute_fingerprint(t):016x}", c) for (i, t), c in zip(rows, want)}


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b c d"), (None, "e f g h"), (big + 2, "i j k l")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in sd.near_duplicates(docs).collect()} == {big, big + 2, None}
