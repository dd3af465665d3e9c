"""Chat logs: keep maximal conversations of cumulative snapshots, then render.

A chat that is logged after every turn leaves conversations that are prefixes of longer ones. Each
turn gets its place in its conversation and a 128-bit hash of (place, role, text); the XOR of these
up to a turn is the rolling hash of the prefix that ends there. A conversation whose whole hash
(with its length) is a shorter prefix of any other is dropped by an anti-join; of equal
conversations that with the smallest id stays.

Everything is built-in functions. Places and hashes are summed in blocks of `block` turns and the
blocks' totals carried on, so a conversation that holds a third of all rows spreads over tasks, and
a conversation longer than `block` turns is rendered in parts of `block` turns, one row each
(part 0, 1, ...), which read one after the other give the whole.

A text or role that holds a marker's start is escaped, so it can't forge a turn.

Edge cases: equal rows (conv_id, turn, role, text) count once; turns are ordered by (turn, role,
text), nulls last; null role renders as "unknown", null text as empty, but both differ from these
words when conversations are compared; null conv_id is a conversation of its own; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _order(*names: str):
    return [F.asc_nulls_last(c) for c in names]


def placed(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, turn, role, text, pos (from 0), n (turns of the conversation)."""
    rows = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("b", F.floor(F.col("turn") / block))
    w = Window.partitionBy("conv_id", "b").orderBy(*_order("turn", "role", "text"))
    local = rows.withColumn("i", F.row_number().over(w) - 1)
    sums = rows.groupBy("conv_id", "b").agg(F.count("*").alias("c"))
    over = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("c").over(over.orderBy(*_order("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("sc"), F.col("b").alias("sb"), before.alias("before"), F.sum("c").over(over).alias("n"))
    both = local.join(sums, F.expr("conv_id <=> sc AND b <=> sb"))
    return both.select("conv_id", "turn", "role", "text", (F.col("i") + F.col("before")).alias("pos"), "n")


def prefixes(rows: DataFrame, block: int) -> DataFrame:
    """conv_id, pos, n, h1, h2: the rolling hash of the prefix that ends at pos."""
    g = rows.select("conv_id", "pos", "n", F.floor(F.col("pos") / block).alias("b"),
                    F.xxhash64("pos", F.col("role").isNull(), F.col("text").isNull(), "role", "text").alias("g1"),
                    F.xxhash64(F.lit("second"), "text", F.col("text").isNull(), F.col("role").isNull(), "role", "pos").alias("g2"))
    w = Window.partitionBy("conv_id", "b").orderBy("pos")
    local = g.withColumn("l1", F.bit_xor("g1").over(w)).withColumn("l2", F.bit_xor("g2").over(w))
    sums = g.groupBy("conv_id", "b").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    v = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select(F.col("conv_id").alias("sc"), F.col("b").alias("sb"), F.coalesce(F.bit_xor("x1").over(v), zero).alias("x1"), F.coalesce(F.bit_xor("x2").over(v), zero).alias("x2"))
    both = local.join(sums, F.expr("conv_id <=> sc AND b = sb"))
    return both.select("conv_id", "pos", "n", F.expr("l1 ^ x1").alias("h1"), F.expr("l2 ^ x2").alias("h2"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n, copies: conversations that no other continues, one of each."""
    whole = hashed.where("pos = n - 1").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashed.where("pos < n - 1").select((F.col("pos") + 1).alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n", "copies")


def plain(c):
    """A text in which no marker stands: "<|" is written "<\\|", and "<\\" is "<\\\\", so that it can be read back."""
    return F.replace(F.replace(c, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def render(turns: DataFrame, block: int = 1024, head: str = "<|{}|>\n", tail: str = "<|end|>\n") -> DataFrame:
    """conv_id, part, n_turns (of the conversation), copies, text: the maximal conversations in chat format."""
    rows = cut(placed(turns, block), "turns")
    keep = cut(maximal(prefixes(rows, block)).select(F.col("conv_id").alias("kc"), "n", "copies"), "maximal").alias("k")
    before, after = head.split("{}")
    line = F.concat(F.lit(before), plain(F.coalesce("role", F.lit("unknown"))), F.lit(after), plain(F.coalesce("text", F.lit(""))), F.lit("\n" if not tail.startswith("\n") else ""), F.lit(tail))
    kept = rows.alias("r").join(keep, F.expr("conv_id <=> kc")).select("conv_id", "k.n", "k.copies", "pos", F.floor(F.col("pos") / block).alias("part"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return kept.groupBy("conv_id", "part", "n", "copies").agg(text.alias("text")).select("conv_id", "part", F.col("n").alias("n_turns"), "copies", "text")


#: DuckDB: the same by ordered lists of turns instead of hashes.
ORACLE_SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
q AS (SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM p),
whole AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM q WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.pos < q.n AND q.pos = w.n AND q.prefix = w.prefix))
SELECT p.conv_id, (p.pos - 1) // 1024 AS part, p.n AS n_turns, any_value(k.copies) AS copies,
       string_agg('<|' || replace(replace(coalesce(role, 'unknown'), '<\\', '<\\\\'), '<|', '<\\|') || '|>' || chr(10) || replace(replace(coalesce(text, ''), '<\\', '<\\\\'), '<|', '<\\|') || chr(10) || '<|end|>' || chr(10), '' ORDER BY p.pos) AS text
FROM p JOIN kept k ON p.conv_id = k.conv_id GROUP BY p.conv_id, part, p.n
"""
