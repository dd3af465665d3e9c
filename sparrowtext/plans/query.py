"""Query trees. Each compiles to a DataFrame (doc, score); what a boolean query asks of its clauses
is one group-by over the union of the clauses' hits, whatever their number."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import BM25, Similarity, f32, f32div
from ..operators.index import SearchIndex

MUST, SHOULD, FILTER, MUST_NOT = "must", "should", "filter", "must_not"
OCCURS = (MUST, SHOULD, FILTER, MUST_NOT)
#: Terms up to which a pattern's terms are pushed into the scan of the postings.
FEW_TERMS = 1000


@dataclass
class Context:
    index: SearchIndex
    similarity: Similarity = field(default_factory=BM25)
    with_scores: bool = True


class Query:
    boost: float = 1.0

    def compile(self, ctx: Context, boost: float = 1.0) -> DataFrame:
        """doc, score (float) of every match; boost multiplies the scores."""
        raise NotImplementedError


def any_of(c, words: list[str]):
    """c is one of the words: equalities that reach row groups one by one, as a long In is read as its whole range."""
    return reduce(lambda a, b: a | b, [c == w for w in words]) if 10 < len(words) <= 200 else c.isin(words)


def nothing(ctx: Context) -> DataFrame:
    return ctx.index.spark.createDataFrame([], "doc long, score float")


def _terms_hits(ctx: Context, clauses: list[tuple[int, str, str, float]]) -> DataFrame:
    """cid, doc, score of (cid, field, term, boost) clauses: one scan, terms pushed into it.

    The clause table, at most one row a clause, is what is broadcast.
    """
    ix = ctx.index
    words, names = sorted({c[2] for c in clauses}), sorted({c[1] for c in clauses})
    asked = ix.spark.createDataFrame(clauses, "cid int, field string, term string, boost float")
    only = lambda d: d.where(any_of(F.col("term"), words) & F.col("field").isin(names))
    post = only(ix.postings)
    if not ctx.with_scores:
        return post.select("field", "term", "doc").join(F.broadcast(asked), ["field", "term"]).select("cid", "doc", f32(0.0).alias("score"))
    sizes = ix.stats.where(F.col("field").isin(names)).select("field", "doc_count", "sum_ttf")
    known = asked.join(only(ix.terms).select("field", "term", "df"), ["field", "term"]).join(sizes, "field")
    known = known.select("field", "term", "cid", (F.col("boost") * ctx.similarity.idf(F.col("df"), F.col("doc_count"))).cast("float").alias("w"), f32div(F.col("sum_ttf"), F.col("doc_count")).alias("avgdl"))
    hits = post.select("field", "term", "doc", "tf", "dl_q").join(F.broadcast(known), ["field", "term"])
    return hits.select("cid", "doc", ctx.similarity.score(F.col("w"), F.col("tf"), F.col("dl_q"), F.col("avgdl")).alias("score"))


@dataclass
class Term(Query):
    """Documents with this very term (the term is not analyzed)."""

    field: str
    term: str
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        return _terms_hits(ctx, [(0, self.field, self.term, self.boost * boost)]).select("doc", "score")


@dataclass
class MatchAll(Query):
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        return ctx.index.docs.select("doc", f32(self.boost * boost).alias("score"))


@dataclass
class MatchNone(Query):
    def compile(self, ctx, boost=1.0):
        return nothing(ctx)


@dataclass
class TermFilter(Query):
    """Documents with any term for which the predicate (of the term column) holds; constant score."""

    field: str
    predicate: object
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        # the dictionary is asked first: few terms go into the postings' scan, many are joined
        terms = ctx.index.terms.where((F.col("field") == self.field) & self.predicate(F.col("term"))).select("term")
        some = [r.term for r in terms.limit(FEW_TERMS + 1).collect()]
        post = ctx.index.postings.where(F.col("field") == self.field).select("term", "doc")
        post = post.where(any_of(F.col("term"), some)) if len(some) <= FEW_TERMS else post.join(terms, "term", "left_semi")
        return post.select("doc").distinct().select("doc", f32(self.boost * boost).alias("score"))


def Prefix(field: str, prefix: str, boost: float = 1.0) -> Query:  # noqa: N802
    return TermFilter(field, lambda t: t.startswith(prefix), boost)


def Wildcard(field: str, pattern: str, boost: float = 1.0) -> Query:  # noqa: N802
    """* any run of characters, ? one."""
    like = "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in pattern)
    return TermFilter(field, lambda t: t.like(like), boost)


def Fuzzy(field: str, term: str, edits: int = 2, boost: float = 1.0) -> Query:  # noqa: N802
    near = lambda t: F.length(t).between(len(term) - edits, len(term) + edits) & (F.levenshtein(t, F.lit(term)) <= edits)
    return TermFilter(field, near, boost)


@dataclass
class Phrase(Query):
    """Terms at consecutive positions (a position field); scored as a term that occurs so often."""

    field: str
    terms: tuple[str, ...]
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        ix = ctx.index
        slots = ix.spark.createDataFrame([(i, t) for i, t in enumerate(self.terms)], "slot int, term string")
        post = ix.postings.where((F.col("field") == self.field) & F.col("term").isin(*set(self.terms)))
        # a document's lists of places, moved back by their slots, are met in its own row
        lists = post.join(F.broadcast(slots), "term").select("doc", "dl_q", F.struct("slot", F.transform("positions", lambda p: p - F.col("slot")).alias("p")).alias("x"))
        lists = lists.groupBy("doc", "dl_q").agg(F.collect_list("x").alias("xs")).where(F.size("xs") == len(self.terms))
        met = F.aggregate(F.slice("xs", 2, len(self.terms)), F.get("xs", F.lit(0))["p"], lambda a, x: F.array_intersect(a, x["p"]))
        freq = lists.select("doc", "dl_q", F.explode(F.array(F.size(met).cast("long"))).alias("tf")).where("tf > 0")
        sizes = ix.stats.where(F.col("field") == self.field)
        dfs = slots.join(ix.terms.where((F.col("field") == self.field) & F.col("term").isin(*set(self.terms))), "term")
        known = dfs.join(sizes.select("field", "doc_count", "sum_ttf"), "field").groupBy("doc_count", "sum_ttf").agg(F.sum(ctx.similarity.idf(F.col("df"), F.col("doc_count")).cast("double")).cast("float").alias("idf"))
        known = known.select((f32(self.boost * boost) * F.col("idf")).alias("w"), f32div(F.col("sum_ttf"), F.col("doc_count")).alias("avgdl"))
        # known has at most one row
        return freq.join(F.broadcast(known), how="cross").select("doc", ctx.similarity.score(F.col("w"), F.col("tf"), F.col("dl_q"), F.col("avgdl")).alias("score"))


@dataclass
class PointRange(Query):
    """Documents whose numeric field lies within [low, high]; constant score."""

    field: str
    low: object
    high: object
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        c = F.col(ctx.index.field(self.field).source)
        return ctx.index.docs.where(c.between(self.low, self.high)).select("doc", f32(self.boost * boost).alias("score"))


@dataclass
class GeoBox(Query):
    """Documents whose point (a struct of lat and lon) lies within the box; where west exceeds east it crosses the 180th meridian. Constant score."""

    field: str
    south: float
    north: float
    west: float
    east: float
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        c = F.col(ctx.index.field(self.field).source)
        lon = c["lon"].between(self.west, self.east) if self.west <= self.east else (c["lon"] >= self.west) | (c["lon"] <= self.east)
        return ctx.index.docs.where(c["lat"].between(self.south, self.north) & lon).select("doc", f32(self.boost * boost).alias("score"))


#: Metres of the earth's mean radius.
EARTH = 6_371_008.7714


@dataclass
class GeoDistance(Query):
    """Documents whose point lies within so many metres of a place, along the great circle. Constant score."""

    field: str
    lat: float
    lon: float
    metres: float
    boost: float = 1.0

    def compile(self, ctx, boost=1.0):
        c = F.col(ctx.index.field(self.field).source)
        lat, lon = F.radians(c["lat"]), F.radians(c["lon"])
        lat0, lon0 = math.radians(self.lat), math.radians(self.lon)
        half = F.pow(F.sin((lat - lat0) / 2), 2) + math.cos(lat0) * F.cos(lat) * F.pow(F.sin((lon - lon0) / 2), 2)
        near = 2 * EARTH * F.asin(F.sqrt(F.least(half, F.lit(1.0)))) <= self.metres
        # a band of latitudes first: it needs no sines and reaches the scan
        band = c["lat"].between(self.lat - math.degrees(self.metres / EARTH) - 1e-9, self.lat + math.degrees(self.metres / EARTH) + 1e-9)
        return ctx.index.docs.where(band & near).select("doc", f32(self.boost * boost).alias("score"))


@dataclass
class Bool(Query):
    """Clauses (occur, query) and the least number of SHOULD clauses that must match.

    Without MUST and FILTER at least one SHOULD must match; with only MUST_NOT nothing does. FILTER
    and MUST_NOT do not score. A clause that is given twice counts and scores twice.
    """

    clauses: list[tuple[str, Query]]
    msm: int = 0
    boost: float = 1.0

    def __post_init__(self):
        if self.msm < 0:
            raise ValueError("minimum should match (minShouldMatch) must not be negative")
        if any(o not in OCCURS for o, _ in self.clauses):
            raise ValueError(f"occur must be one of {OCCURS}")

    def add(self, occur: str, query: Query) -> Bool:
        return Bool([*self.clauses, (occur, query)], self.msm, self.boost)

    def compile(self, ctx, boost=1.0):
        n = {o: sum(x == o for x, _ in self.clauses) for o in OCCURS}
        required = n[MUST] + n[FILTER]
        need = self.msm if self.msm or required else 1
        if need > n[SHOULD] or required + n[SHOULD] == 0:
            return nothing(ctx)
        kept = list(enumerate(self.clauses))
        if not ctx.with_scores and required and not self.msm:
            kept = [(i, c) for i, c in kept if c[0] != SHOULD]
        outer, parts = boost * self.boost, []
        plain = [(i, q.field, q.term, q.boost * outer) for i, (_, q) in kept if isinstance(q, Term)]
        if plain:
            parts.append(_terms_hits(ctx, plain))
        for i, (occur, q) in kept:
            if not isinstance(q, Term):
                inner = ctx if occur in (MUST, SHOULD) else Context(ctx.index, ctx.similarity, False)
                parts.append(q.compile(inner, outer).select(F.lit(i).alias("cid"), "doc", "score"))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        ids = {o: [i for i, (x, _) in kept if x == o] for o in OCCURS}
        among = lambda o: F.col("cid").isin(*ids[o]) if ids[o] else F.lit(False)
        scoring = among(MUST) | among(SHOULD)
        seen = hits.groupBy("doc").agg(
            *[F.count_if(among(o)).alias(o) for o in OCCURS],
            F.sum(F.when(scoring, F.col("score").cast("double")).otherwise(0.0)).cast("float").alias("score"),
        )
        ok = (F.col(MUST) == n[MUST]) & (F.col(FILTER) == n[FILTER]) & (F.col(MUST_NOT) == 0)
        if SHOULD in {c[0] for _, c in kept}:
            ok &= F.col(SHOULD) >= need
        return seen.where(ok).select("doc", "score")
