"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact similarity.

Words are lower-cased (A-Z). A shingle is five words (all words of a shorter item). Its weight in
an item or a window is how rare it is among the items, ln(1 + items / items that have it), times how
often it occurs; a shingle that no item has is as rare as can be. Windows are all runs of as many
words as an item has (a shorter document is one window). Windows and items get weighted 64-bit
SimHash fingerprints. These are cut into `radius` + 1 blocks, and an equality join on (words,
block, bits of the block) is the index: by the pigeonhole principle it finds every item within
`radius` bits of a window of its size. Each such pair is verified by the exact weighted Jaccard
similarity of the shingles. A pair that agrees in several blocks passes in the first only.

Not every window needs a fingerprint. Of each item the rarest shingles are its keys, as many as
leave less than the similarity asked for of its weight to the others: a window without any key of
an item can't be similar enough to it. So the windows taken are all of n words that hold a key of any item of n
words, wherever in the item the key is: this loses nothing, however a passage was reordered.

What can be lost is a similar pair beyond the radius. At similarity 0.8 fingerprints differ in about 10
bits with a deviation of 3; the tests compare with all windows of all documents, and README has the
recall measured so.

Everything is built-in functions. A document's windows are made once for each distinct text. What
hangs on the items (their shingles and fingerprints) is broadcast only after a count shows it under
`broadcast_rows`; beyond, the joins shuffle.

Edge cases: null or blank text has no words and no windows; items without words or without id are left out;
items with equal ids are merged by their longest text; a document shorter than the item is one
window; rows with the same id and text give one result row each only once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, words_of

SHINGLE, BITS = 5, 64


def shingles(words: Column, size: int) -> Column:
    """array<long>: a hash of each run of `size` words, by place."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), hashed)).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def _placed_shingles(words: Column, size: int) -> Column:
    """shingles() with the words computed once a row."""
    return F.transform(F.array(words), lambda w: shingles(w, size))[0]


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, n (words), size (of its shingles), sh (shingle hashes by place)."""
    one = benchmark.groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.max_by(text_col, F.struct(F.length(text_col), F.col(text_col))).alias("t"))
    w = one.select("item_id", words_of(ascii_lower(F.col("t"))).alias("w")).where((F.size("w") > 0) & F.col("item_id").isNotNull())
    sh = F.coalesce(*[F.when(F.size("w") == k, shingles(F.col("w"), k)) for k in range(1, SHINGLE)], shingles(F.col("w"), SHINGLE))
    return w.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), sh.alias("sh"))


def simhash(rows: DataFrame, keys: list[str], units: int, field: int, h: str = "h", weight: str = "w") -> DataFrame:
    """keys, fp: bit i is set if the weights (in 0..units) of hashes with bit i are over half of all. Sums of 63 // field
    bits stand side by side in one long, `field` bits each: no sum may reach 2 ** field."""
    each = 63 // field
    spread = lambda i: " + ".join(f"shiftleft(shiftrightunsigned({h}, {b}) & 1L, {field * k})" for k, b in enumerate(range(i, min(i + each, BITS))))
    w = F.round(F.col(weight) * units).cast("long")
    sums = [F.sum(F.col("_w") * F.expr(spread(i))).alias(f"_{i}") for i in range(0, BITS, each)]
    bit = lambda i: f"shiftrightunsigned(_{i - i % each}, {field * (i % each)}) & {2**field - 1}L"
    fp = F.expr(" | ".join(f"IF(2 * ({bit(i)}) > _all, shiftleft(1L, {i}), 0L)" for i in range(BITS)))
    return rows.select(*keys, h, w.alias("_w")).groupBy(*keys).agg(F.sum("_w").alias("_all"), *sums).select(*keys, fp.alias("fp"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = 23, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), n_words, hamming, similarity: the best window of each (document, item)."""
    if not 0 <= radius < BITS:
        raise ValueError("a radius must be within 0 and 63")
    items = cut(items_of(benchmark, item_col, item_text), "items")
    n_items, longest = items.agg(F.count("*"), F.max("n")).first()
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most 5
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, n_words int, hamming int, similarity double")
    at = items.select("item_id", "n", "size", F.explode("sh").alias("h"))
    weights = at.select("item_id", "h").distinct().groupBy("h").agg(F.log1p(F.lit(float(n_items)) / F.count("*")).alias("idf"))
    in_item = cut(at.groupBy("item_id", "n", "size", "h").agg(F.count("*").alias("times")).join(weights, "h"), "shingles")
    sent = F.broadcast if in_item.count() <= broadcast_rows else lambda d: d
    weights = in_item.select("h", "idf").distinct()
    most = math.log1p(n_items)  # the weight of a shingle that no item has; no weight is larger
    of_item = Window.partitionBy("item_id")
    rarest = of_item.orderBy(F.desc("idf"), "h").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("times") * F.col("idf")
    rest = F.sum(weight).over(of_item) - F.coalesce(F.sum(weight).over(rarest), F.lit(0.0))
    keys = in_item.withColumn("key", rest >= F.lit(similarity * (1 - 1e-9)) * F.sum(weight).over(of_item)).where("key").select("h", "size", "n").distinct()

    # where documents have keys
    key = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")]
    words = docs.select(*key, words_of(ascii_lower(F.col(text_col))).alias("w"))

    def placed(size: int) -> DataFrame:
        # outer, as the plain form makes Spark compute the shingles a second time, to filter empty arrays
        rows = words.select("doc_id", "text_hash", F.size("w").alias("len"), F.posexplode_outer(_placed_shingles(F.col("w"), size)).alias("p", "h")).where("p IS NOT NULL")
        return rows.join(sent(keys.where(F.col("size") == size).drop("size")), "h").select("doc_id", "text_hash", "len", F.lit(size).alias("size"), "n", "p")

    hits = cut(reduce(DataFrame.union, [placed(k) for k in sizes]), "hits")
    members = hits.select("doc_id", "text_hash").distinct()

    # one document of each distinct text, with its shingles
    # (written, so that the planner knows how small it is beside the texts)
    one = cut(hits.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.collect_set("size").alias("sizes")), "holders")
    again = docs.select(F.col(text_col).alias("t"), *key).alias("d").join(one.alias("b"), F.expr("d.doc_id <=> b.doc_id AND d.text_hash = b.text_hash"))
    shingled = F.coalesce(*[F.when(F.col("size") == k, _placed_shingles(F.col("w"), k)) for k in sizes])
    texts = again.select("d.text_hash", words_of(ascii_lower(F.col("t"))).alias("w"), F.explode("sizes").alias("size")).dropDuplicates(["text_hash", "size"])
    texts = cut(texts.select("text_hash", "size", shingled.alias("sh")), "texts")

    # every window that has a key: hits by place, each adding the starts that those before it have not
    by_place = Window.partitionBy("text_hash", "n").orderBy("p")
    low = F.expr("greatest(0, least(p - (n - size), len - n))")
    high = F.expr("greatest(0, least(p, len - n))")
    new = hits.select("text_hash", "len", "size", "n", "p").distinct().select("*", low.alias("low"), high.alias("high"))
    new = new.withColumn("low", F.greatest("low", F.coalesce(F.lag("high").over(by_place) + 1, F.lit(0)))).where("low <= high")
    # a window's shingles are those at places start .. start + n - size; in blocks, so that no row holds all starts of a long text
    places = new.select("text_hash", "size", "n", F.explode(F.sequence("low", "high")).alias("start"))
    places = places.groupBy("text_hash", "size", "n", F.floor(F.col("start") / 4096).alias("block")).agg(F.collect_list("start").alias("starts"))

    def shingles_of(rows: DataFrame, *more: str) -> DataFrame:
        """rows (text_hash, size, n, start, ...) with a row for each shingle h of the window; a text's rows stay in its task."""
        in_window = F.slice("sh", F.col("start") + 1, F.col("n") - F.col("size") + 1)
        return rows.select("text_hash", "size", "n", "start", *more, F.explode(in_window).alias("h"))

    dealt = texts.repartition("text_hash")
    each = dealt.join(places.repartition("text_hash").withColumnsRenamed({"text_hash": "of_text", "size": "of_size"}), F.expr("text_hash = of_text AND size = of_size"))
    bag = shingles_of(each.select("text_hash", "size", "n", "sh", F.explode("starts").alias("start")))
    bag = bag.join(sent(weights), "h", "left").withColumn("w", F.coalesce("idf", F.lit(most)) / F.lit(most))
    field = 21 if longest < 1 << 21 else 31
    units = max(1, min(255, (1 << field) // (longest + 1) - 1))
    windows = cut(simhash(bag, ["text_hash", "size", "n", "start"], units, field), "windows")
    # equal shingles stand apart, as in windows
    item_bag = in_item.select("item_id", "n", F.explode(F.array_repeat(F.struct("h", (F.col("idf") / F.lit(most)).alias("w")), F.col("times").cast("int"))).alias("x")).select("item_id", "n", "x.h", "x.w")
    item_fp = cut(simhash(item_bag, ["item_id", "n"], units, field), "fingerprints")

    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    parts = F.posexplode(F.array(*[F.expr(f"shiftrightunsigned(fp, {lo}) & {2 ** (hi - lo) - 1}L") for lo, hi in zip(edges, edges[1:])])).alias("block", "part")
    a, b = windows.select("*", parts), item_fp.select("item_id", F.col("n").alias("of_n"), F.col("fp").alias("own"), parts)
    # bits below the block, of which no whole block may agree
    earlier = " AND ".join(f"(block <= {i} OR (fp ^ own) & {(2 ** (hi - lo) - 1 << lo) - (1 << 64 if hi == BITS else 0)}L <> 0)" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    near = a.join(sent(b).withColumnsRenamed({"block": "of_block", "part": "of_part"}), F.expr(f"n = of_n AND block = of_block AND part = of_part AND bit_count(fp ^ own) <= {radius} AND {earlier}"))
    near = cut(near.select("text_hash", "size", "n", "start", "item_id", F.expr("bit_count(fp ^ own)").alias("hamming")), "near")

    # exact weighted Jaccard: sum of minima over (both sums less the minima)
    pairs = near.repartition("text_hash").withColumnsRenamed({"text_hash": "of_text", "size": "of_size"}).join(dealt, F.expr("text_hash = of_text AND size = of_size"))
    pair = ["text_hash", "size", "n", "start", "item_id", "hamming"]  # with both keys of the join, so that nothing moves again
    counted = shingles_of(pairs, "item_id", "hamming").groupBy(*pair, "h").agg(F.count("*").alias("times")).alias("g")
    own = in_item.select(F.col("item_id").alias("of_item"), F.col("h").alias("of_h"), F.col("times").alias("own"))
    shared = counted.join(sent(own), F.expr("item_id = of_item AND h = of_h"), "left").join(sent(weights), "h", "left").withColumn("w", F.coalesce("idf", F.lit(most)))
    sums = shared.groupBy(*pair).agg(F.sum(F.expr("least(times, coalesce(own, 0)) * w")).alias("both"), F.sum(F.expr("times * w")).alias("window_weight"))
    whole = in_item.groupBy("item_id").agg(F.sum(F.col("times") * F.col("idf")).alias("item_weight"))
    scored = sums.join(sent(whole), "item_id").withColumn("similarity", F.round(F.expr("both / (window_weight + item_weight - both)"), 9)).where(F.col("similarity") >= similarity)
    best = scored.groupBy("text_hash", "item_id").agg(F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("hamming"), -F.col("start"))).alias("x"))
    found = members.join(best, "text_hash")
    return found.select("doc_id", "text_hash", "item_id", "x.start", F.col("x.n").alias("n_words"), F.col("x.hamming").cast("int").alias("hamming"), "x.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    doc, text = fresh(docs, "_id"), fresh(docs, "_hash")
    bad = cut(contaminated(docs, benchmark, id_col, text_col, **how).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(text))
    return docs.join(bad, same, "left_anti")
