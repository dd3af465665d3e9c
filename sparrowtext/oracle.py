"""DuckDB SQL for the catalogue: the same semantics, written independently of the engine."""

from __future__ import annotations

WORDS = r"[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}][\p{L}\p{N}_]*)*"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def tokens(table="documents", doc="doc_id", text="text", name="tok") -> str:
    return f"{name} AS (SELECT {doc} AS doc, unnest(regexp_extract_all(translate({text}, {AZ}), '{WORDS}')) AS term FROM {table})"


def q(dl: str) -> str:
    return f"(CASE WHEN {dl} < 40 THEN {dl} ELSE 24 + ((({dl} - 24) >> (length(bin({dl} - 24)) - 4)) << (length(bin({dl} - 24)) - 4)) END)"


def postings(table="documents", doc="doc_id", text="text", pre="") -> str:
    """CTEs tok, dl, st, post, dfs (with a prefix)."""
    return (
        tokens(table, doc, text, f"{pre}tok")
        + f", {pre}dl AS (SELECT doc, count(*) AS dl FROM {pre}tok GROUP BY doc), {pre}st AS (SELECT count(*) AS n, sum(dl) AS s FROM {pre}dl)"
        + f", {pre}post AS (SELECT term, doc, count(*) AS tf FROM {pre}tok GROUP BY term, doc), {pre}dfs AS (SELECT term, count(*) AS df FROM {pre}post GROUP BY term)"
    )


def scores(pre="", k1=1.2, b=0.75) -> str:
    """CTE sc(term, doc, score) with boost 1; w and inv apart for boosts."""
    return f"""{pre}sc AS (SELECT p.term, p.doc, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT AS w, p.tf,
      (1.0::FLOAT / ({k1}::FLOAT * ((1.0::FLOAT - {b}::FLOAT) + ({b}::FLOAT * {q('dl')}::FLOAT) / (s::DOUBLE / n)::FLOAT)))::FLOAT AS inv
      FROM {pre}post p JOIN {pre}dl USING (doc) JOIN {pre}dfs USING (term), {pre}st)"""


SCORE = "({w} - {w} / (1.0::FLOAT + tf::FLOAT * inv))"


def clause_hits(clauses, source="sc") -> str:
    """(cid, occur, doc, score) of (occur, term, boost) clauses."""
    rows = ", ".join(f"({i}, '{o}', '{t}', {b}::FLOAT)" for i, (o, t, b) in enumerate(clauses))
    return f"SELECT c.cid, c.occur, sc.doc, {SCORE.format(w='(c.boost * sc.w)')} AS score FROM (VALUES {rows}) c(cid, occur, term, boost) JOIN {source} sc ON sc.term = c.term"


def matched(hits: str, clauses, msm=0) -> str:
    """(doc, score) of a boolean query over clause hits."""
    n = {o: sum(c[0] == o for c in clauses) for o in ("must", "should", "filter", "must_not")}
    need = msm if msm or n["must"] + n["filter"] else 1
    has = lambda o: f"count(*) FILTER (occur = '{o}')"
    return (
        f"SELECT doc, coalesce(sum(score::DOUBLE) FILTER (occur IN ('must', 'should')), 0)::FLOAT AS score FROM ({hits}) GROUP BY doc "
        f"HAVING {has('must')} = {n['must']} AND {has('filter')} = {n['filter']} AND {has('must_not')} = 0 AND {has('should')} >= {need} "
        f"AND {has('must')} + {has('filter')} + {has('should')} > 0"
    )


OUT = "doc, round(score::DOUBLE, 5) AS score"


def boolean(clauses, msm=0, limit="LIMIT 10", k1=1.2, b=0.75, where="") -> str:
    clauses = [(c[0], c[1], c[2] if len(c) > 2 else 1.0) for c in clauses]
    return f"WITH {postings()}, {scores(k1=k1, b=b)}, hits AS ({matched(clause_hits(clauses), clauses, msm)}) SELECT {OUT} FROM hits {where} ORDER BY hits.score DESC, doc {limit}"
