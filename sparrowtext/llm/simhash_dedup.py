"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at Hamming distance of at most 3. Cut into two segments of 32 bits,
of a linked pair's segments one differs in at most one bit (3 = 1 + 2), so the pair agrees on a
variant of that segment with one bit wildcarded. An equality join on (segment, wildcard, rest)
finds every such pair; the whole distance is verified inside the join. A pair that meets in
several variants is let through in one of them only, so the join puts out one row per link.

Texts with equal fingerprints are one class before the join, so copies cost nothing there.
Components are found by rounds of large-star and small-star contraction, in tables that are
written between rounds.

Edge cases: a null or blank text has fingerprint zero and links like any other; rows with the
same doc_id are rows of their own, but keep_one returns only one of rows equal in id and text; a row with null doc_id keeps its fingerprint and gets its
component's smallest known id (null if there is none); an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, ship

RADIUS = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text; bit set if set in over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    votes, block = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, block):  # a very long text in blocks: bounded memory
        part = words[at : min(n, at + block) + shingle - 1]
        line, ends, pos = b" ".join(part), [], -1
        for w in part:
            pos += len(w) + 1
            ends.append(pos)
        m = min(block, n - at)
        starts = [0, *(e + 1 for e in ends[: m - 1])]
        lasts = ends[shingle - 1 :] if len(part) >= shingle else ends[-1:]
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, lasts)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, mark (hash of the text), fp (the fingerprint's 64 bits as a signed long). Only texts go to Python."""
    import numpy as np

    @F.arrow_udf("long")
    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(text_col).alias("mark"), of_text(F.col(text_col)).alias("fp"))


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints at distance 1 to radius (at most 3), one row each.

    classes: distinct fp. Of each pair exactly one of the shared variants passes: the low segment
    if it differs in at most one bit, else the high one; of equal segments the first wildcard.
    """
    if radius > 3:
        raise ValueError("two segments with one wildcard cover a radius of at most 3")
    # 64 rows come of each class, so the few bytes of classes are dealt by what they grow to
    n = classes.count()
    dealt = classes.repartition(max(1, min(100_000, -(-n * 64 // 2_000_000))), "fp")
    # one number as the key: the variant above bit 32, the segment without the wildcard below
    keyed = dealt.select("fp", F.explode(F.expr("sequence(0L, 63L)")).alias("v")).select(
        "fp", F.expr("shiftleft(v, 32) | CASE WHEN v < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, CAST(v % 32 AS int))").alias("key")
    )
    differ, low, high = "(x.fp ^ y.fp)", "((x.fp ^ y.fp) & 4294967295L)", "shiftrightunsigned(x.fp ^ y.fp, 32)"
    wild = "shiftleft(1L, CAST(shiftright(x.key, 32) % 32 AS int))"
    # of a segment that is equal in both the first variant counts, else that of the bit that differs
    first = lambda part, v: f"({part} = {wild} OR {part} = 0L AND shiftright(x.key, 32) = {v})"
    # the planner takes keyed to be as small as classes, so it would send all 64 rows of each to the driver as a broadcast
    return (
        keyed.alias("x")
        .join(keyed.alias("y").hint("merge"), F.expr(f"""
            x.key = y.key AND x.fp < y.fp AND bit_count({differ}) <= {radius}
            AND CASE WHEN shiftright(x.key, 32) < 32 THEN {first(low, 0)} ELSE bit_count({low}) > 1 AND {first(high, 32)} END"""))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge (a, b).

    Alternates large-star and small-star until no edge changes; each node ends up tied to its
    root. A hot node's neighbours meet only in aggregates and joins that Spark can split.
    """
    cur = cut(edges.select("a", "b"), "edges")
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
        # large-star: tie every larger neighbour to the smallest in the neighbourhood
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small-star: tie every smaller neighbour, and the node, to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(low.select(F.col("m"), F.col("u"))).distinct()
        )
        nxt = cut(small, "edges")
        same = lambda d: d.agg(F.count("*"), F.sum(F.expr("xxhash64(a, b) % 1000000007")), F.expr("bit_xor(xxhash64(b, a))")).first()
        done = same(nxt) == same(cur)
        drop_cut(cur)
        cur = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Row marks (doc_id, mark, fp) and classes (fp, root, first: the class's first row in the order of
    ids, null last, and marks)."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark"))
    classes = cut(fps.groupBy("fp").agg(first.alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    return fps, classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    fps, classes = _marked(docs, id_col, text_col, shingle, radius)
    ids = classes.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    return fps.join(classes.join(ids, "root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (known ids before null); of
    rows that share this id, one of the text with the smallest hash."""
    fps, classes = _marked(docs, id_col, text_col, 3, RADIUS)
    doc, mark = fresh(docs, "_doc"), fresh(docs, "_mark")
    chosen = classes.groupBy("root").agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias(doc), F.col("x.mark").alias(mark))
    chosen = cut(chosen, "chosen")
    kept = docs.join(chosen, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (_mark(text_col) == F.col(mark)), "left_semi")
    repeated = fps.groupBy("doc_id", "mark").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.withColumn(mark, _mark(text_col)).dropDuplicates([id_col, mark]).drop(mark)
    return kept
