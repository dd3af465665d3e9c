"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Every document gets text statistics; each rule is a badness score that grows with junk, cut to a
grid of steps. For each stratum (language) there is one nested sequence of rule sets: each set
lowers the cutoff of one rule, so a set rejects all that the sets before it reject. The null
hypothesis of a set is that it rejects, by any of its rules, more than `alpha` of the stratum's good
documents; its p-value is the exact binomial tail (equivalently a Clopper-Pearson bound), over all
labelled rows of the stratum. Sets are tested in their order until one fails, which needs no
correction along the sequence; over the strata the level is Bonferroni-corrected. So with
probability 1 - delta no stratum loses more than alpha of its good documents to all its rules
together. Of the certified sets the one is chosen that rejects most bad rows for few good.

The order must not be learned from the rows that test it: a stratum's sequence comes from the labels
of all other strata (greedily, most bad rows per good one first), and where those are too few it is
all rules at equal steps from the top of the grid down.

Everything that grows with the corpus is an aggregate: the labelled rows meet the narrow table of
statistics in a join, and only counts by (stratum, rule, grid step) and by (stratum, place in the
sequence) reach the driver, at most (len(strata) + 1) * len(RULES) * (GRID + 1) rows each.

Edge cases: null text has no words, so it fails the base rule; a null or unlisted stratum is
"other"; label rows without id or quality are left out, repeated ones count once (worst label);
with no labels nothing is certified and the base rule alone decides; extra columns are kept.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, ship

STRATA = ("en", "fr", "de", "es")
GRID = 64
#: name -> (score from statistics, top of the grid); scores are cut to 0..top.
RULES = {
    "symbols": (lambda s: s["n_symbols"] / s["n_words"], 2.0),
    "dup_lines": (lambda s: s["n_dup_lines"] / max(s["n_lines"], 1), 1.0),
    "repeats": (lambda s: s["n_repeat_words"] / s["n_words"], 1.0),
    "stutter": (lambda s: s["n_stutter"] / s["n_words"], 1.0),
    "capitals": (lambda s: s["n_capitals"] / s["n_words"], 1.0),
    "shouts": (lambda s: s["n_shouts"] / s["n_words"], 2.0),
    "bars": (lambda s: s["n_bars"] / s["n_words"], 1.0),
    "sameness": (lambda s: 1 - s["n_distinct"] / s["n_words"], 1.0),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_capitals", "n_shouts", "n_bars", "n_distinct")


def statistics(text: str | None, window: int = 8) -> dict[str, int]:
    """Counts over one whole text."""
    import re

    import numpy as np

    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= window and len(ids) < n:
        # exact window ids by doubling: ranks of pairs of ranks
        r, step = a, 1
        while step < window:
            k = min(step, window - step)
            m = len(r) - k
            _, r = np.unique(r[:m] * (int(r.max()) + 1) + r[k:], return_inverse=True)
            step += k
        hot = np.bincount(r)[r] > 1
        if hot.any():
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hot)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            repeat = int((np.cumsum(cover[:n]) > 0).sum())
    return {
        "n_words": n,
        "word_chars": len(re.sub(r"[\x20\x09-\x0D]+", "", text)),
        "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "n_lines": len(lines),
        "n_stutter": int((a[1:] == a[:-1]).sum()),
        "n_capitals": sum(w.isupper() and len(w) > 2 for w in words),
        "n_shouts": text.count("!"),
        "n_bars": text.count("|"),
        "n_distinct": len(ids),
    }


def base_fails(s: dict[str, int]) -> bool:
    return s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]


def steps(s: dict[str, int]) -> dict[str, int]:
    """Each rule's score as a grid step from 0 (best) to GRID, rounded up to a step's edge; 0 without words."""
    return {k: min(GRID, math.ceil(GRID * f(s) / top)) if s["n_words"] else 0 for k, (f, top) in RULES.items()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in log space."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def stratum_of(c, strata):
    return F.when(c.isin(*strata), c).otherwise(F.lit("other"))


def measures_of(text: Column) -> Column:
    """struct of the statistics and the rules' steps of a text column. Only texts go to Python."""
    names = [*STATS, *(f"step_{k}" for k in RULES)]
    form = pa.struct([(k, pa.int64() if k in STATS else pa.int32()) for k in names])

    @F.arrow_udf("struct<" + ",".join(f"{k}:{'long' if k in STATS else 'int'}" for k in names) + ">")
    def of_texts(texts: pa.Array) -> pa.Array:
        rows = [(s := statistics(t.as_py()), steps(s)) for t in texts]
        return pa.array([{**{k: s[k] for k in STATS}, **{f"step_{k}": v for k, v in g.items()}} for s, g in rows], form)

    return of_texts(text)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", strata=STRATA) -> DataFrame:
    """Narrow table: doc_id, stratum, the statistics, and the rules' steps."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum_of(F.col(stratum_col), strata).alias("stratum"), measures_of(F.col(text_col)).alias("m"))
    return rows.select("doc_id", "stratum", "m.*")


Cutoffs = dict[str, int]  # rule -> the step from which on it rejects


def sequence(good: dict[str, list[int]], bad: dict[str, list[int]], good_cost: float, least: int = 50) -> list[Cutoffs]:
    """Nested rule sets, from counts by rule and step of rows other than those that will test them."""
    if not good or sum(next(iter(good.values()))) < least or sum(next(iter(bad.values()))) < least:
        return [dict.fromkeys(RULES, step) for step in range(GRID, 0, -1)]
    now, out = {}, []
    while True:
        best = None
        for rule in sorted(good):
            top = now.get(rule, GRID + 1)
            g = b = 0
            for step in range(top - 1, 0, -1):
                g, b = g + good[rule][step], b + bad[rule][step]
                if b > good_cost * g and bad[rule][step] and (best is None or (b / (g + 0.5), b) > best[0]):
                    below = next((x for x in range(step - 1, -1, -1) if good[rule][x] + bad[rule][x]), 0)
                    best = ((b / (g + 0.5), b), rule, (step + below + 1) // 2)  # amid the steps that no row has
        if best is None:
            return out
        now = {**now, best[1]: best[2]}
        out.append(now)


def certified(sets: list[Cutoffs], good: list[int], bad: list[int], alpha: float, level: float, good_cost: float) -> Cutoffs:
    """The set to use: good[i] and bad[i] count the rows that set i is the first to reject; the last
    entries those that no set rejects."""
    n, k, b, best = sum(good), 0, 0, (0.0, {})
    for rules, g, x in zip(sets, good, bad):
        k, b = k + g, b + x
        if not n or binomial_tail(k, n, alpha) > level:
            break
        best = max(best, (b - good_cost * k, rules), key=lambda v: v[0])
    return best[1]


def certify(measures: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, good_cost: float = 20.0, strata=STRATA) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> the grid step from which on the rule rejects; strata without a certified set are absent."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # rows that the base rule rejects are its business, not the cutoffs'
    ok = measures.where("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words")
    columns = [f"step_{k}" for k in RULES]
    seen = cut(ok.join(truth, "doc_id").groupBy("stratum", (F.col("quality") > 0).alias("good"), *columns).agg(F.count("*").alias("n")), "labelled")
    each = seen.select("stratum", "good", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"step_{k}").alias("step")) for k in RULES])).alias("x"))
    counts = each.groupBy("stratum", "good", F.col("x.rule").alias("rule"), F.col("x.step").alias("step")).agg(F.sum("n").alias("n")).collect()
    found = sorted({r.stratum for r in counts})

    def others(stratum: str, good: bool) -> dict[str, list[int]]:
        out = {k: [0] * (GRID + 1) for k in RULES}
        for r in counts:
            if r.stratum != stratum and r.good == good:
                out[r.rule][r.step] += r.n
        return out

    chosen: dict[tuple[str, str], int] = {}
    sets = {s: sequence(others(s, True), others(s, False), good_cost) for s in found}
    if not any(sets.values()):
        return chosen
    # a row's place: the first set that rejects it
    place = F.lit(None).cast("int")
    for s, path in sets.items():
        firsts = []
        for k in RULES:
            at = [next((i for i, c in enumerate(path) if step >= c.get(k, GRID + 1)), len(path)) for step in range(GRID + 1)]
            firsts.append(F.element_at(F.array(*map(F.lit, at)), F.col(f"step_{k}") + 1))
        place = F.when(F.col("stratum") == s, F.least(*firsts)).otherwise(place)
    table = {s: ([0] * (len(p) + 1), [0] * (len(p) + 1)) for s, p in sets.items()}
    for r in seen.groupBy("stratum", "good", place.alias("place")).agg(F.sum("n").alias("n")).collect():
        table[r.stratum][0 if r.good else 1][r.place] += r.n
    for s, path in sets.items():
        for rule, step in certified(path, *table[s], alpha, delta / (len(strata) + 1), good_cost).items():
            chosen[s, rule] = step
    return chosen


def verdicts(measures: DataFrame, cutoffs: dict[tuple[str, str], int]) -> DataFrame:
    """measures with base_failed, kept and the first rule that rejected."""
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    rejected = F.coalesce(*[F.when((F.col("stratum") == s) & (F.col(f"step_{k}") >= c), F.lit(k)) for (s, k), c in sorted(cutoffs.items())], F.lit(None).cast("string"))
    return measures.withColumn("base_failed", base).withColumn("rejected_by", rejected).withColumn("kept", ~base & F.col("rejected_by").isNull())


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, statistics, base_failed, kept, rejected_by: one row per row of docs."""
    m = cut(measured(docs), "measures")
    return verdicts(m, certify(m, labels, **how)).drop(*[f"step_{k}" for k in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str = "lang", strata=STRATA, **how) -> DataFrame:
    """docs without the rows that a rule rejects, all columns kept. Each text is measured once: rows and measures are written together."""
    ship(docs.sparkSession)
    held, stratum = fresh(docs, "_measures"), fresh(docs, "_stratum")
    both = cut(docs.withColumn(stratum, stratum_of(F.col(stratum_col), strata)).withColumn(held, measures_of(F.col(text_col))), "measured")
    narrow = both.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).alias("stratum"), f"{held}.*")
    cutoffs = certify(narrow, labels, strata=strata, **how)
    m = F.col(held)
    bad = [(F.col(stratum) == s) & (m[f"step_{k}"] >= c) for (s, k), c in sorted(cutoffs.items())]
    ok = (m["n_words"] >= 20) & (100 * m["n_repeat_words"] <= 30 * m["n_words"])
    for x in bad:
        ok &= ~x
    return both.where(ok).drop(held, stratum)
