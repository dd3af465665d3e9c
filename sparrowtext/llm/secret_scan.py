"""Secrets in whole texts: three known forms, and tokens that a randomness battery finds.

Known forms (base): assignments to password-like names, access key ids, long hex runs. They are
found leftmost and non-overlapping per kind by marking all matches with a sentinel, splitting
there and summing lengths: only built-in functions, no Python.

The battery looks at other runs of 20 or more characters of [A-Za-z0-9+/_-] that mix character
classes, each against the encoding that its characters suggest (hex, base32, base36, base62,
base64). Three tests, each from two sides.

* Is it random? Under a uniform alphabet (1) the chi-squared statistic, (2) the number of runs of
  character classes and (3) the serial correlation of neighbouring codes have known means and
  deviations; a run that is over `LIMIT` deviations off in any is none. A random key is lost to
  this about once in a thousand.
* Could it be readable? The same three views are likelihood ratios of the uniform law to readable
  text, in bits: (2) of the sequence of classes, against a chain that changes class in up to
  CHANGES of its steps, at the rate that suits the run best; (1) of each letter or digit, given its
  class, against the letters' shares in the corpus' own words; (3) of each letter after a letter,
  against the corpus' pairs of letters instead of these shares. A part of every letter's probability is English's, and one is
  uniform, for names that are not spelled like the corpus. The three are factors of one likelihood by the chain rule,
  so their sum needs no assumption of independence and no normal tail: by Markov's inequality
  readable runs reach x bits with probability 2^-x at most.

False discoveries are controlled per encoding and length class over distinct runs (told apart by a
64-bit hash; copies are no tests of their own) by the Benjamini-Hochberg procedure for such
likelihood ratios, which holds under any dependence between runs: with m runs of a class, a run
counts if k runs reach log2(m / (fdr * k)) bits. Bits are counted in steps of 1/4, rounded down,
which is on the safe side. The level is one of the readable model above, not of every text that
people write: README has rates measured on names that had no part in making it.

Letters' shares and pairs come from all documents (distinct words of each, 27 * 26 numbers at the
driver), counts by step have at most 20 * 402 rows; nothing else leaves the executors.

Spans are code points, end exclusive; an added span overlaps no base span.

Edge cases: null text is empty; the sentinel U+E000 in a text counts as any other character; rows
with equal ids stay rows of their own; other columns are not read by scan() and kept by redact();
an empty table gives an empty result; a corpus without letters takes all letters as equally likely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
#: As the above, for finding: what [0-9a-f]+ drops as too short need not be marked.
MARKED = (ASSIGN, r"AKIA[A-Z0-9]+", r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Private-use characters: MARK stands around matches, OTHER for a MARK that the text itself holds.
MARK, OTHER, BLOCK = "\ue000", "\ue001", 128
CLASSES = (20, 28, 40, 64)
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: The most changes of class a step in readable runs, and the shares of a letter's probability that are uniform and ENGLISH.
CHANGES, LOOSE, COMMON = 0.3, 0.1, 0.35
#: Letters a to z in English texts, in percent.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Deviations from its mean under a uniform alphabet that each test allows.
LIMIT = 4.0
#: Characters of each encoding by class: lower, upper, digit, other (of hex and base36 one case occurs).
SIZES = {16: (6, 6, 10, 0), 32: (0, 26, 6, 0), 36: (26, 26, 10, 0), 62: (26, 26, 10, 0), 64: (26, 26, 10, 2)}
SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<s,k,e,m>> of all matches; their places are sums of lengths, in blocks, so that
    many matches in one text stay cheap."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def spans(parts: Column) -> Column:
        lens = F.transform(parts, F.length)
        return F.transform(F.array(lens), lambda n: F.struct(n.alias("n"), F.transform(
            F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x)).alias("sums")))

    def place(parts: Column, x: Column, i: Column) -> Column:
        upto = F.aggregate(F.slice(x["sums"], 1, F.floor(i / BLOCK).cast("int")), F.lit(0), lambda a, y: a + y)
        return upto + F.aggregate(F.slice(x["n"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, y: a + y)

    def all_of(parts: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        return F.flatten(F.transform(spans(parts), lambda x: F.transform(odd, lambda i: F.transform(F.array(place(parts, x, i)), lambda s: F.struct(
            s.alias("s"), F.lit(kind).alias("k"), (s + x["n"][i]).alias("e"), parts[i].alias("m")))[0])))

    held = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 2, all_of(p)).otherwise(F.expr(f"CAST(array() AS {SPAN})")))
    return held[0]


def base_spans(text: Column) -> Column:
    """Spans of the three known forms, each match's text in m."""
    ok = (
        lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8,
        lambda x: F.length(x["m"]) >= 16,
        lambda x: F.length(x["m"]) >= 32,
    )
    return F.concat(*[F.filter(_found(text, p, k), ok[k]) for k, p in enumerate(MARKED)])


def letter_pairs(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often a letter follows a letter, or a blank, in each document's distinct words of a-z (any case)."""
    words = F.array_distinct(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+"))
    pairs = F.regexp_extract_all(F.concat(F.lit(" "), F.array_join(words, " ")), F.lit("(?=([a-z ][a-z]))"), F.lit(1))
    rows = docs.select(F.explode_outer(pairs).alias("pair")).where("pair IS NOT NULL").groupBy("pair").agg(F.count("*").alias("n"))
    return {r.pair: r.n for r in rows.collect()}  # at most 27 * 26


class Readable:
    """log2 probabilities of letters in readable text: single[b], and pair[a * 26 + b], the gain of knowing the letter before."""

    def __init__(self, pairs: dict[str, int]):
        single = [1.0 + sum(pairs.get(a + b, 0) for a in " " + ALPHABET) for b in ALPHABET]
        share = [x / sum(single) for x in single]
        mixed = lambda p, e: math.log2((1 - LOOSE - COMMON) * p + COMMON * e / sum(ENGLISH) + LOOSE / 26)
        self.single, self.pair = [mixed(p, e) for p, e in zip(share, ENGLISH)], []
        for a in ALPHABET:
            row = [pairs.get(a + b, 0) for b in ALPHABET]
            self.pair += [mixed((n + 26 * p) / (sum(row) + 26), e) - q for n, p, q, e in zip(row, share, self.single, ENGLISH)]


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def battery(m: Column, letters: Readable) -> Column:
    """struct of one run of characters: k (its encoding), the deviations uniform, runs and serial from a uniform
    alphabet, and the bits against readable text of each of the three, bits_uniform, bits_runs, bits_serial."""
    single, pair = F.array(*map(F.lit, letters.single)), F.array(*map(F.lit, letters.pair))
    k = (
        F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(m.rlike("^[A-Z2-7]+$"), 32)
        .when(m.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36).when(m.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    )
    of_k = lambda values: F.element_at(F.array(*[F.lit(float(values[x])) for x in SIZES]), F.when(k == 16, 1).when(k == 32, 2).when(k == 36, 3).when(k == 62, 4).otherwise(5))
    shares = {x: [c / x for c in (sizes if x in (62, 64) else sizes[1:])] for x, sizes in SIZES.items()}
    p2, p3 = ({x: sum(c**e for c in cs) for x, cs in shares.items()} for e in (2, 3))

    def step(acc: Column, a: Column) -> Column:
        cls = F.when(a.between(97, 122), 0).when(a.between(65, 90), 1).when(a.between(48, 57), 2).otherwise(3)
        letter = F.when(a.between(97, 122), a - 97).when(a.between(65, 90), a - 65).otherwise(-1)
        follows = (acc["cls"].isin(0, 1)) & ((cls == 0) | ((cls == 1) & (acc["cls"] == 1)))
        zero = F.lit(0.0)
        return F.struct(
            cls.alias("cls"), letter.alias("letter"), (acc["changes"] + F.when((acc["cls"] >= 0) & (acc["cls"] != cls), 1).otherwise(0)).alias("changes"),
            *[(acc[f"n{c}"] + F.when(cls == c, 1).otherwise(0)).alias(f"n{c}") for c in range(4)],
            (acc["single"] + F.when(letter >= 0, F.element_at(single, letter + 1)).otherwise(zero)).alias("single"),
            (acc["pair"] + F.when(follows, F.element_at(pair, acc["letter"] * 26 + letter + 1)).otherwise(zero)).alias("pair"),
        )

    start = F.struct(F.lit(-1).alias("cls"), F.lit(-1).alias("letter"), F.lit(0).alias("changes"), *[F.lit(0).alias(f"n{c}") for c in range(4)], F.lit(0.0).alias("single"), F.lit(0.0).alias("pair"))
    codes = F.transform(F.split(m, ""), lambda c: F.ascii(c))
    n = F.length(m).cast("double")

    def serial(codes: Column) -> Column:
        real = F.transform(codes, lambda c: c.cast("double"))
        mean = F.aggregate(real, F.lit(0.0), lambda a, c: a + c) / n
        dev = F.transform(F.array(mean), lambda mu: F.transform(real, lambda c: c - mu))[0]
        prod = F.aggregate(F.zip_with(F.slice(dev, 1, F.length(m) - 1), F.slice(dev, 2, F.length(m) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        var = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
        return (F.when(var > 0, prod / var).otherwise(1.0) + 1 / n) * F.sqrt(n)

    def whole(t: Column) -> Column:
        kd, log2 = k.cast("double"), lambda x: math.log2(x) if x else 0.0
        squares = F.aggregate(F.array_distinct(F.split(m, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(m, c, F.lit(""))), F.lit(2.0)))
        x2 = kd / n * squares - n
        uniform = (x2 - (kd - 1)) / F.sqrt(2 * (kd - 1) * (n - 1) / n)
        p = 1 - of_k(p2)
        runs = (t["changes"] - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p) + 2 * (n - 2) * (of_k(p3) - of_k(p2) * of_k(p2)))
        # classes: their uniform probabilities, over the chain's (a change leads to one of two classes, the first is one of three)
        rate = F.greatest(F.lit(1e-3), F.least(F.lit(CHANGES), t["changes"] / (n - 1)))
        chain = t["changes"] * F.log2(rate / 2) + (n - 1 - t["changes"]) * F.log2(1 - rate) - math.log2(3)
        bits_runs = sum((t[f"n{c}"] * of_k({x: log2(sizes[c] / x) for x, sizes in SIZES.items()}) for c in range(4)), F.lit(0.0)) - chain
        # characters within their classes: letters over the corpus' shares, digits over ten equal ones
        in_class = (t["n0"] + t["n1"]) * of_k({x: -log2(sizes[1]) for x, sizes in SIZES.items()}) + t["n2"] * of_k({x: log2(10 / sizes[2]) for x, sizes in SIZES.items()})
        return F.struct(k.alias("k"), uniform.alias("uniform"), runs.alias("runs"), t["serial"].alias("serial"), (in_class - t["single"]).alias("bits_uniform"), bits_runs.alias("bits_runs"), (-t["pair"]).alias("bits_serial"))

    return _bound(codes, lambda x: _bound(F.aggregate(x, start, step).withField("serial", serial(x)), whole))


def evidence(m: Column, letters: Readable) -> Column:
    """struct<k,bits>: a run's encoding and its bits against readable text; -1 bit if it is not random."""
    random = lambda b: (F.abs(b["uniform"]) <= LIMIT) & (F.abs(b["runs"]) <= LIMIT) & (F.abs(b["serial"]) <= LIMIT)
    return _bound(battery(m, letters), lambda b: F.struct(b["k"].alias("k"), F.when(random(b), b["bits_uniform"] + b["bits_runs"] + b["bits_serial"]).otherwise(-1.0).alias("bits")))


def candidates(text: Column, letters: Readable) -> Column:
    """Runs that mix at least two of lower case, upper case and digits, with their bits (z), class of encoding and length (c) and hash (h)."""
    mixed = lambda x: (x["m"].rlike("[a-z]").cast("int") + x["m"].rlike("[A-Z]").cast("int") + x["m"].rlike("[0-9]").cast("int")) >= 2
    at = F.filter(_found(text, TOKEN, 3), mixed)
    of_length = lambda n: sum(((n >= c).cast("int") for c in CLASSES[1:]), F.lit(0))
    return F.transform(at, lambda x: _bound(evidence(x["m"], letters), lambda b: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m"), b["bits"].alias("z"), (b["k"] * 10 + of_length(F.length(x["m"]))).alias("c"), F.xxhash64(x["m"]).alias("h"))))


def _lone(cands: Column, base: Column) -> Column:
    return F.filter(cands, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))


def cutoffs(cands: DataFrame, fdr: float) -> dict[int, float]:
    """Class (c) -> the fewest bits (z) that count as a discovery, over distinct runs, from rows (c, z, h: the run's hash);
    classes without discoveries are absent."""
    step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(400.0), F.col("z"))) * 4).alias("step")
    steps = cands.select("c", step, "h").distinct().groupBy("c", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c")
    ranked = steps.withColumn("i", F.sum("n").over(w.orderBy(F.desc("step")))).withColumn("m", F.sum("n").over(w))
    found = ranked.where(F.col("step") / 4 >= F.log2(F.col("m") / (F.lit(fdr) * F.col("i")))).groupBy("c").agg((F.min("step") / 4).alias("z")).collect()
    return {r.c: float(r.z) for r in found}  # at most a row a class


def _chosen(cands: Column, cuts: dict[int, float]) -> Column:
    least = F.create_map(*[F.lit(x) for c, z in cuts.items() for x in (c, z)]) if cuts else None
    passed = (lambda x: x["z"] >= F.coalesce(F.try_element_at(least, x["c"]), F.lit(float("inf")))) if cuts else (lambda x: F.lit(False))
    return F.transform(F.filter(cands, passed), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _clean(text_col: str) -> Column:
    return F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(OTHER))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.001) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: one row per row of docs."""
    letters = Readable(letter_pairs(docs, text_col))
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), _clean(text_col).alias("t"))
    first = first.select("doc_id", base_spans(F.col("t")).alias("base"), candidates(F.col("t"), letters).alias("c"))
    first = cut(first.select("doc_id", _plain(F.col("base")).alias("base"), F.transform(_lone(F.col("c"), F.col("base")), lambda x: x.dropFields("m")).alias("c")), "spans")
    cuts = cutoffs(first.select(F.explode("c").alias("x")).select("x.c", "x.z", "x.h"), fdr)
    marked = first.select("doc_id", "base", _chosen(F.col("c"), cuts).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return marked.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, text_col: str = "text", fdr: float = 0.001, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span masked; n_chars, if there is one, follows. Other rows stay as they are."""
    letters, t = Readable(letter_pairs(docs, text_col)), _clean(text_col)
    base, spans = fresh(docs, "_base"), fresh(docs, "_spans")
    # each text is searched once: rows and what was found in them are written together
    found = docs.withColumn(base, base_spans(t)).withColumn(spans, candidates(t, letters))
    found = cut(found.withColumn(spans, F.transform(_lone(F.col(spans), F.col(base)), lambda x: x.dropFields("m"))).withColumn(base, _plain(F.col(base))), "found")
    seen = found.select(F.explode(spans).alias("x")).select("x.c", "x.z", "x.h")
    found = found.withColumn(spans, F.array_sort(F.concat(base, _chosen(F.col(spans), cutoffs(seen, fdr))))).drop(base)
    text, start = F.col(text_col), F.expr("CAST(named_struct('at', 0, 'out', array()) AS struct<at:int,out:array<string>>)")

    def step(a: Column, x: Column) -> Column:  # spans that overlap become one
        new = x["s"] >= a["at"]
        piece = F.concat(F.substr(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mask))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(new, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    masked = F.aggregate(F.col(spans), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    out = found.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).drop(spans)
    return out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns and text_col == "text" else out
