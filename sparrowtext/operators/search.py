"""Searching: ranked pages, counts, batches and collectors over compiled queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import BM25, Similarity, f32div
from ..plans.query import FILTER, MUST, MUST_NOT, OCCURS, SHOULD, Bool, Context, Query, Term, any_of
from .index import SearchIndex

ORDER = (F.desc, F.asc)


class Searcher:
    def __init__(self, index: SearchIndex, similarity: Similarity | None = None):
        self.index, self.similarity = index, similarity or BM25()

    def hits(self, query: Query, with_scores: bool = True) -> DataFrame:
        """doc, score of all matches that are not deleted."""
        out = query.compile(Context(self.index, self.similarity, with_scores))
        return out if self.index.deleted is None else out.join(self.index.deleted, "doc", "left_anti")

    def search(self, query: Query, n: int = 10) -> DataFrame:
        """The n best: score descending, doc ascending."""
        if n <= 0:
            raise ValueError("n must be positive")
        return self.hits(query).orderBy(F.desc("score"), F.asc("doc")).limit(n)

    def search_after(self, after: tuple[int, float], query: Query, n: int = 10) -> DataFrame:
        """The n best behind (doc, score) in that order."""
        doc, score = after
        if doc > (self.index.docs.agg(F.max("doc")).first()[0] or 0):
            raise ValueError("the document to search after is beyond the index")
        s = F.lit(float(score)).cast("float")
        rest = self.hits(query).where((F.col("score") < s) | ((F.col("score") == s) & (F.col("doc") > doc)))
        return rest.orderBy(F.desc("score"), F.asc("doc")).limit(n)

    def page(self, query: Query, start: int, how_many: int) -> DataFrame:
        """Hits start .. start + how_many - 1 of the ranking."""
        return self.hits(query).orderBy(F.desc("score"), F.asc("doc")).offset(start).limit(how_many)

    def count(self, query: Query) -> DataFrame:
        """total_hits, exact."""
        return self.hits(query, with_scores=False).agg(F.count("*").alias("total_hits"))

    def collect_with(self, query: Query, collector: Callable[[DataFrame], DataFrame], with_scores: bool = True) -> DataFrame:
        """Any function of the hits."""
        return collector(self.hits(query, with_scores))

    def fetch(self, hits: DataFrame, *columns: str) -> DataFrame:
        """Stored columns of the hits."""
        return hits.join(self.index.docs.select("doc", *columns), "doc")

    def sort_by(self, query: Query, column: str, n: int = 10, ascending: bool = True) -> DataFrame:
        """Matches by a doc value, then doc; those without a value last."""
        rows = self.fetch(self.hits(query, False).select("doc"), column)
        return rows.orderBy(F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column), "doc").limit(n)

    def facets(self, query: Query, column: str) -> DataFrame:
        """value, n: matches by the values of a column."""
        return self.fetch(self.hits(query, False).select("doc"), column).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def highlight(self, hits: DataFrame, column: str, terms: list[str], before: str = "<b>", after: str = "</b>") -> DataFrame:
        """hits with the column's text, every token that is one of the terms (any ASCII case) marked."""
        words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
        pattern = rf"(?i)(?<![\p{{IsAlphabetic}}\p{{N}}_'’])({words})(?![\p{{IsAlphabetic}}\p{{N}}_]|['’][\p{{IsAlphabetic}}\p{{N}}])"
        marked = F.regexp_replace(F.col(column), F.lit(pattern), F.lit(f"{before}$1{after}"))
        return self.fetch(hits, column).withColumn(column, marked if terms else F.col(column))

    def explain(self, query: Term | Bool, doc: int) -> DataFrame:
        """The parts of one document's score, a row a term clause."""
        terms = [query] if isinstance(query, Term) else [q for o, q in query.clauses if isinstance(q, Term) and o in (MUST, SHOULD)]
        out = None
        for t in terms:
            one = self.hits(t).where(F.col("doc") == doc).select(F.lit(t.field).alias("field"), F.lit(t.term).alias("term"), "score")
            out = one if out is None else out.unionByName(one)
        return out

    def search_batch(self, queries: list[Query], n: int = 10) -> DataFrame:
        """query_id, rank, doc, score, total_hits of many queries in one job.

        All clauses of flat queries go into one broadcast table; the postings are scanned once for them. Other queries
        (nested, phrases, ranges) are compiled one by one and join the others' hits. Ranks are made per
        query after a cut to the best n of each task's share of (query, doc bucket), so a query that
        matches a third of everything is ranked in many tasks.
        """
        ix, rows, needs, others = self.index, [], [], []
        for qid, q in enumerate(queries):
            b = q if isinstance(q, Bool) else Bool([(SHOULD, q)])
            if any(not isinstance(x, Term) for _, x in b.clauses):
                others.append(self.hits(q).select(F.lit(qid).alias("query_id"), "doc", "score"))
                continue
            count = {o: sum(x == o for x, _ in b.clauses) for o in OCCURS}
            required = count[MUST] + count[FILTER]
            need = b.msm if b.msm or required else 1
            if need <= count[SHOULD] and required + count[SHOULD]:
                needs.append((qid, count[MUST], count[FILTER], need))
                rows += [(qid, o, t.field, t.term, float(t.boost * b.boost)) for o, t in b.clauses]
        schema = "query_id int, occur string, field string, term string, boost float"
        asked = ix.spark.createDataFrame(rows, schema)
        limits = ix.spark.createDataFrame(needs, "query_id int, n_must long, n_filter long, need long")
        words, names = sorted({r[3] for r in rows}), sorted({r[2] for r in rows})
        only = lambda d: d.where(any_of(F.col("term"), words) & F.col("field").isin(names))
        known = asked.join(only(ix.terms).select("field", "term", "df"), ["field", "term"]).join(ix.stats.select("field", "doc_count", "sum_ttf"), "field")
        known = known.select("query_id", "occur", "field", "term", (F.col("boost") * self.similarity.idf(F.col("df"), F.col("doc_count"))).cast("float").alias("w"), f32div(F.col("sum_ttf"), F.col("doc_count")).alias("avgdl"))
        hits = only(ix.postings).select("field", "term", "doc", "tf", "dl_q").join(F.broadcast(known), ["field", "term"])
        part = self.similarity.score(F.col("w"), F.col("tf"), F.col("dl_q"), F.col("avgdl")).cast("double")
        has = lambda o: F.count_if(F.col("occur") == o)
        seen = hits.groupBy("query_id", "doc").agg(
            has(MUST).alias("m"), has(FILTER).alias("f"), has(MUST_NOT).alias("x"), has(SHOULD).alias("s"),
            F.sum(F.when(F.col("occur").isin(MUST, SHOULD), part).otherwise(0.0)).cast("float").alias("score"),
        )
        ok = seen.join(F.broadcast(limits), "query_id").where("m = n_must AND f = n_filter AND x = 0 AND s >= need").select("query_id", "doc", "score")
        if ix.deleted is not None:
            ok = ok.join(ix.deleted, "doc", "left_anti")
        for hits in others:
            ok = ok.unionByName(hits)
        best = Window.partitionBy("query_id", "bucket").orderBy(F.desc("score"), F.asc("doc"))
        local = ok.withColumn("bucket", F.pmod(F.hash("doc"), F.lit(64))).withColumn("r", F.row_number().over(best))
        totals = local.groupBy("query_id", "bucket").agg(F.count("*").alias("c"))
        totals = totals.groupBy("query_id").agg(F.sum("c").alias("total_hits"))
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
        top = local.where(F.col("r") <= n).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n)
        return top.join(totals, "query_id").select("query_id", "rank", "doc", "score", "total_hits")
