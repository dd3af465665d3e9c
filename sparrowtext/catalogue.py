"""The catalogue of queries: one per operator, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from .functions import analysis
from .functions.similarity import BM25
from .operators import fields as fd
from .operators import index as ixs
from .operators import terms as tm
from .operators.index import SearchIndex
from .operators.search import Searcher
from .plans import parser
from .plans.query import FILTER, MUST, MUST_NOT, SHOULD, Bool, Fuzzy, GeoBox, GeoDistance, MatchAll, MatchNone, Phrase, PointRange, Prefix, Term, Wildcard
from .sources import corpora, durable
from .sources.store import Store
from .streaming.ingest import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_OPEN: dict[tuple[str, str, str], SearchIndex] = {}


def _dir(spark: SparkSession) -> str:
    return f"{durable.shared_dir(spark)}/sparrowtext-index/{spark.sparkContext.applicationId}"


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, sf_dir: str, name: str, make) -> SearchIndex:
    """The index of one table, written once a session and input, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPEN:
        df, at, fields = make(spark, sf_dir)
        store = Store(spark, f"{_dir(spark)}/{name}-{abs(hash(sf_dir))}")
        store.write(df, at, fields)
        _OPEN[key] = store.open()
    return _OPEN[key]


def documents(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "documents", lambda s, d: (table(s, d, "documents"), "doc_id", [fd.text("text"), fd.keyword("lang"), fd.long_field("n_chars", stored=True), fd.sorted_dv("source")]))


def events(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "events", lambda s, d: (table(s, d, "events"), "event_id", [fd.keyword("event_type"), fd.double_field("value"), fd.long_field("user_id")]))


def pages(spark, sf_dir) -> SearchIndex:
    return _index(spark, sf_dir, "pages", lambda s, d: (table(s, d, "pages"), "page_id", [fd.text("html", level="freqs"), fd.text("url", level="freqs")]))


def register(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def scored(hits: DataFrame) -> DataFrame:
    return hits.select("doc", F.round(F.col("score").cast("double"), 5).alias("score"))


# ---- term and boolean queries over documents.text -------------------------------------------------

_B = {
    "term_topk": [(SHOULD, "of")],
    "term_missing": [(SHOULD, "zzzznotthere")],
    "bool_must2": [(MUST, "the"), (MUST, "of")],
    "bool_must3": [(MUST, "the"), (MUST, "of"), (MUST, "tion")],
    "bool_should2": [(SHOULD, "tion"), (SHOULD, "que")],
    "bool_should3": [(SHOULD, "tion"), (SHOULD, "que"), (SHOULD, "der")],
    "bool_should4": [(SHOULD, "tion"), (SHOULD, "que"), (SHOULD, "der"), (SHOULD, "los")],
    "bool_should5": [(SHOULD, "tion"), (SHOULD, "que"), (SHOULD, "der"), (SHOULD, "los"), (SHOULD, "license")],
    "bool_must_not": [(MUST, "tion"), (MUST_NOT, "of")],
    "bool_must_not_multi": [(MUST, "the"), (MUST_NOT, "tion"), (MUST_NOT, "and")],
    "bool_should_must_not": [(SHOULD, "que"), (MUST_NOT, "les")],
    "bool_only_must_not": [(MUST_NOT, "the")],
    "bool_mixed_must_should": [(MUST, "the"), (SHOULD, "tion")],
    "bool_mixed_must_2should": [(MUST, "the"), (SHOULD, "tion"), (SHOULD, "license")],
    "bool_filter": [(MUST, "tion"), (FILTER, "the")],
    "bool_filter_only": [(FILTER, "license")],
    "bool_dup_clause": [(SHOULD, "tion"), (SHOULD, "tion"), (SHOULD, "und")],
    "bool_boost": [(SHOULD, "tion", 2.5), (SHOULD, "und", 0.5)],
}
_MSM = {
    "bool_msm2_of_3": (2, [(SHOULD, "the"), (SHOULD, "tion"), (SHOULD, "license")]),
    "bool_msm2_of_4": (2, [(SHOULD, "tion"), (SHOULD, "que"), (SHOULD, "der"), (SHOULD, "the")]),
    "bool_msm3_of_4": (3, [(SHOULD, "tion"), (SHOULD, "of"), (SHOULD, "and"), (SHOULD, "the")]),
    "bool_must_msm2": (2, [(MUST, "the"), (SHOULD, "tion"), (SHOULD, "of"), (SHOULD, "license")]),
    "bool_msm_eq_n": (2, [(SHOULD, "tion"), (SHOULD, "of")]),
    "bool_msm_gt_n": (3, [(SHOULD, "tion"), (SHOULD, "of")]),
}


def _query(clauses, msm=0) -> Bool:
    return Bool([(c[0], Term("text", c[1], c[2] if len(c) > 2 else 1.0)) for c in clauses], msm)


for _name, (_m, _c) in {**{k: (0, c) for k, c in _B.items()}, **_MSM}.items():
    register(_name, sql.boolean(_c, _m))(lambda s, d, c=_c, m=_m: scored(Searcher(documents(s, d)).search(_query(c, m), 10)))

_CL = [(MUST, "the"), (SHOULD, "tion")]
_ALL = sql.boolean(_CL, limit="")


@register("bool_nested", f"""WITH {sql.postings()}, {sql.scores()}, hin AS ({sql.matched(sql.clause_hits([(SHOULD, 'tion', 1.0), (SHOULD, 'license', 1.0)]), [(SHOULD, 'tion'), (SHOULD, 'license')])}),
    hout AS (SELECT 0 AS cid, 'must' AS occur, doc, score FROM hin UNION ALL {sql.clause_hits([(SHOULD, 'of', 1.0), (MUST_NOT, 'was', 1.0)])}),
    hits AS ({sql.matched('SELECT * FROM hout', [(MUST, ''), (SHOULD, ''), (MUST_NOT, '')])}) SELECT {sql.OUT} FROM hits ORDER BY hits.score DESC, doc LIMIT 10""")  # fmt: skip
def bool_nested(s, d):
    inner = _query([(SHOULD, "tion"), (SHOULD, "license")])
    outer = Bool([(MUST, inner), (SHOULD, Term("text", "of")), (MUST_NOT, Term("text", "was"))])
    return scored(Searcher(documents(s, d)).search(outer, 10))


@register("bm25_custom_k1_b", sql.boolean([(SHOULD, "tion"), (SHOULD, "of")], k1=0.9, b=0.4))
def bm25_custom(s, d):
    return scored(Searcher(documents(s, d), BM25(0.9, 0.4)).search(_query([(SHOULD, "tion"), (SHOULD, "of")]), 10))


@register("search_after_page2", f"SELECT doc, score FROM ({_ALL}) LIMIT 10 OFFSET 10")
def search_after_page2(s, d):
    x = Searcher(documents(s, d))
    last = x.search(_query(_CL), 10).collect()[-1]
    return scored(x.search_after((last.doc, last.score), _query(_CL), 10))


@register("topdocs_range_10_20", f"SELECT doc, score FROM ({_ALL}) LIMIT 10 OFFSET 10")
def topdocs_range(s, d):
    return scored(Searcher(documents(s, d)).page(_query(_CL), 10, 10))


@register("total_hits_count", f"SELECT count(*) AS total_hits FROM ({_ALL})")
def total_hits_count(s, d):
    return Searcher(documents(s, d)).count(_query(_CL))


@register("score_mode_count_only", f"SELECT doc FROM ({_ALL})")
def score_mode_count_only(s, d):
    return Searcher(documents(s, d)).hits(_query(_CL), with_scores=False).select("doc")


@register("collector_score_stats", f"SELECT count(*) AS n, max(score) AS best FROM ({_ALL})")
def collector_score_stats(s, d):
    return Searcher(documents(s, d)).collect_with(_query(_CL), lambda h: scored(h).agg(F.count("*").alias("n"), F.max("score").alias("best")))


BATCH = [
    '{"q": "of"}', '{"q": "+the +tion"}', '{"q": "que les"}', '{"q": "+tion -the"}', '{"q": "der -und"}', '{"q": "+the tion"}', '{"q": "pour los de"}', '{"q": "+the +of +and"}',
    '{"q": "+the -tion -license"}', '{"q": "+the tion license"}', '{"q": "los que der tion"}', '{"q": "the of tion", "msm": 2}', '{"q": "the of and license", "msm": 2}', '{"q": "the of and tion", "msm": 3}', '{"q": "+the of and license", "msm": 2}',
]


def _batch_sql() -> str:
    parts = []
    for i, query in enumerate(parser.read_batch(BATCH)):
        b = query if isinstance(query, Bool) else Bool([(SHOULD, query)])
        clauses = [(o, t.term, 1.0) for o, t in b.clauses]
        parts.append(f"SELECT {i} AS query_id, doc, score FROM ({sql.matched(sql.clause_hits(clauses), clauses, b.msm)})")
    return f"""WITH {sql.postings()}, {sql.scores()}, allhits AS ({' UNION ALL '.join(parts)}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY query_id) AS total_hits FROM allhits)
      SELECT query_id, rank, doc, round(score::DOUBLE, 5) AS score, total_hits FROM r WHERE rank <= 10"""


@register("query_string_batch", _batch_sql())
def query_string_batch(s, d):
    return Searcher(documents(s, d)).search_batch(parser.read_batch(BATCH), 10).withColumn("score", F.round(F.col("score").cast("double"), 5))


# ---- other fields --------------------------------------------------------------------------------


@register("term_keyword_topk", """WITH k AS (SELECT event_type AS term, count(*) AS df FROM events GROUP BY 1), st AS (SELECT count(*) AS n FROM events WHERE event_type IS NOT NULL),
    w AS (SELECT ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT AS w, (1.0::FLOAT / (1.2::FLOAT * ((1.0::FLOAT - 0.75::FLOAT) + 0.75::FLOAT * 1.0::FLOAT / 1.0::FLOAT)))::FLOAT AS inv FROM k, st WHERE term = 'purchase')
    SELECT event_id AS doc, round((w - w / (1.0::FLOAT + 1.0::FLOAT * inv))::DOUBLE, 5) AS score FROM events, w WHERE event_type = 'purchase' ORDER BY doc LIMIT 10""")  # fmt: skip
def term_keyword_topk(s, d):
    return scored(Searcher(events(s, d)).search(Term("event_type", "purchase"), 10))


@register("multi_field_bool", f"""WITH {sql.postings('pages', 'page_id', 'html', 'h')}, {sql.scores('h')}, {sql.postings('pages', 'page_id', 'url', 'u')}, {sql.scores('u')},
    hits AS ({sql.matched(sql.clause_hits([(MUST, 'the', 1.0)], 'hsc') + ' UNION ALL ' + sql.clause_hits([(SHOULD, 'blog', 2.0)], 'usc'), [(MUST, ''), (SHOULD, '')])}) SELECT {sql.OUT} FROM hits ORDER BY hits.score DESC, doc LIMIT 10""")  # fmt: skip
def multi_field_bool(s, d):
    return scored(Searcher(pages(s, d)).search(Bool([(MUST, Term("html", "the")), (SHOULD, Term("url", "blog", 2.0))]), 10))


# ---- statistics and the dictionary ------------------------------------------------------------------

_P = f"WITH {sql.postings()}"


@register("term_stats", f"{_P} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term")
def term_stats(s, d):
    return documents(s, d).terms.where("field = 'text'").select("term", "df", "ttf")


@register("collection_stats", f"{_P} SELECT (SELECT count(*) FROM documents) AS max_doc, count(DISTINCT doc) AS doc_count, sum(tf)::BIGINT AS sum_ttf, count(*) AS sum_df, count(DISTINCT term) AS term_count FROM post")
def collection_stats(s, d):
    return documents(s, d).full_stats().where("field = 'text'").select("max_doc", "doc_count", "sum_ttf", "sum_df", "term_count")


@register("norms", f"{_P} SELECT doc, dl AS dl, {sql.q('dl')}::INTEGER AS dl_q FROM dl")
def norms(s, d):
    return documents(s, d).norms.where("field = 'text'").select("doc", F.col("dl").cast("long").alias("dl"), "dl_q")


@register("avg_field_length", f"{_P} SELECT round((s::DOUBLE / n)::FLOAT::DOUBLE, 4) AS avgdl FROM st")
def avg_field_length(s, d):
    return documents(s, d).stats.where("field = 'text'").select(F.round((F.col("sum_ttf") / F.col("doc_count")).cast("float").cast("double"), 4).alias("avgdl"))


@register("idf_table", f"{_P} SELECT term, round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT::DOUBLE, 5) AS idf FROM dfs, st")
def idf_table(s, d):
    ix = documents(s, d)
    n = ix.stats.where("field = 'text'").first().doc_count
    return ix.terms.where("field = 'text'").select("term", F.round(BM25().idf(F.col("df"), F.lit(n)).cast("double"), 5).alias("idf"))


@register("terms_enum", f"{_P} SELECT term, df FROM dfs")
def terms_enum(s, d):
    return tm.terms(documents(s, d), "text").select("term", "df")


@register("terms_with_prefix", f"{_P} SELECT term, df FROM dfs WHERE term LIKE 'lic%'")
def terms_prefix(s, d):
    return tm.terms(documents(s, d), "text", "lic").select("term", "df")


@register("seek_exact", f"{_P} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post WHERE term = 'license' GROUP BY term")
def seek_exact(s, d):
    return tm.seek_exact(documents(s, d), "text", "license")


for _n, _t in (("found", "license"), ("notfound", "licenso"), ("end", "￿")):
    register(f"seek_ceil_{_n}", f"{_P} SELECT CASE WHEN min(term) IS NULL THEN 'END' WHEN min(term) = '{_t}' THEN 'FOUND' ELSE 'NOT_FOUND' END AS status, min(term) AS term FROM dfs WHERE term >= '{_t}'")(
        lambda s, d, t=_t: tm.seek_ceil(documents(s, d), "text", t)
    )


@register("min_max_term", f"{_P} SELECT min(term) AS min_term, max(term) AS max_term, count(*) AS term_count FROM dfs")
def min_max_term(s, d):
    return tm.bounds(documents(s, d), "text")


# ---- postings, vectors, analysis --------------------------------------------------------------------


@register("postings_docs", f"{_P} SELECT term, doc FROM post")
def postings_docs(s, d):
    return documents(s, d).postings.where("field = 'text'").select("term", "doc")


@register("postings_freqs", f"{_P} SELECT term, doc, tf::INTEGER AS tf FROM post")
def postings_freqs(s, d):
    return documents(s, d).postings.where("field = 'text'").select("term", "doc", "tf")


_LISTS = f"lists AS (SELECT doc_id AS doc, regexp_extract_all(translate(text, {sql.AZ}), '{sql.WORDS}') AS l FROM documents), placed AS (SELECT doc, unnest(l) AS term, unnest(range(len(l))) AS pos FROM lists)"


@register("postings_positions", f"WITH {_LISTS} SELECT term, doc, pos::INTEGER AS pos FROM placed")
def postings_positions(s, d):
    return documents(s, d).postings.where("field = 'text'").select("term", "doc", F.explode("positions").alias("pos"))


@register("postings_offsets", f"""WITH parts AS (SELECT p_partkey AS doc, regexp_extract_all(translate(p_name, {sql.AZ}), '{sql.WORDS}') AS l, regexp_split_to_array(translate(p_name, {sql.AZ}), '{sql.WORDS}') AS g FROM part),
    x AS (SELECT doc, unnest(l) AS term, unnest(range(len(l))) AS i, l, g FROM parts)
    SELECT term, doc, i::INTEGER AS pos, (list_sum(list_transform(g[1:i+1], lambda e: strlen(e))) + coalesce(list_sum(list_transform(l[1:i], lambda e: strlen(e))), 0))::INTEGER AS start, strlen(term)::INTEGER AS len FROM x""")  # fmt: skip
def postings_offsets(s, d):
    docs = ixs.with_doc(table(s, d, "part"), "p_partkey")
    post = ixs.field_postings(docs, fd.text("p_name", level="offsets"))
    return post.select("term", "doc", F.explode(F.arrays_zip("positions", "starts", "lens")).alias("x")).select("term", "doc", F.col("x.positions").alias("pos"), F.col("x.starts").alias("start"), F.col("x.lens").alias("len"))


@register("postings_offsets_text")  # whole texts; no SQL: the list sums above are quadratic in a text's tokens
def postings_offsets_text(s, d):
    docs = ixs.with_doc(corpora.spread(table(s, d, "documents")), "doc_id")
    post = ixs.field_postings(docs, fd.text("text", level="offsets"))
    return post.select("term", "doc", F.explode(F.arrays_zip("positions", "starts", "lens")).alias("x")).select("term", "doc", F.col("x.positions").alias("pos"), F.col("x.starts").alias("start"), F.col("x.lens").alias("len"))


@register("term_vectors", f"WITH {_LISTS}, g AS (SELECT doc, term, count(*) AS tf FROM placed GROUP BY doc, term) SELECT doc, count(*) AS n_terms, string_agg(term || ':' || tf, ' ' ORDER BY term) AS vector FROM g GROUP BY doc")
def term_vectors(s, d):
    tv = ixs.term_vectors(ixs.with_doc(corpora.spread(table(s, d, "documents")), "doc_id"), fd.text("text"))
    return tv.select("doc", F.size("terms").cast("long").alias("n_terms"), F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string"))), " ").alias("vector"))


@register("analyze_standard", f"WITH {_LISTS} SELECT doc, len(l) AS n, array_to_string(l, ' ') AS tokens FROM lists")
def analyze_standard(s, d):
    return corpora.spread(table(s, d, "documents")).select(F.col("doc_id").alias("doc"), analysis.standard(F.col("text")).alias("t")).select("doc", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@register("analyze_unicode")
def analyze_unicode(s, d):
    return corpora.spread(table(s, d, "documents")).select(F.col("doc_id").alias("doc"), analysis.unicode(F.col("text")).alias("t")).select("doc", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@register("analyze_keyword", "SELECT event_id AS doc, event_type AS term FROM events WHERE event_type IS NOT NULL")
def analyze_keyword(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("doc"), F.explode(analysis.keyword(F.col("event_type"))).alias("term"))


# ---- doc values, points, stored fields, features -------------------------------------------------------


def _dv(s, d, name, key, field):
    return ixs.doc_values(ixs.with_doc(table(s, d, name), key), field)


@register("dv_numeric", "SELECT doc_id AS doc, n_chars AS value FROM documents WHERE n_chars IS NOT NULL")
def dv_numeric(s, d):
    return _dv(s, d, "documents", "doc_id", fd.numeric_dv("n_chars"))


@register("dv_binary", "SELECT event_id AS doc, lower(hex(encode(event_type))) AS value FROM events WHERE event_type IS NOT NULL")
def dv_binary(s, d):
    return _dv(s, d, "events", "event_id", fd.binary_dv("event_type")).select("doc", F.lower(F.hex("value")).alias("value"))


@register("dv_sorted_ord", "SELECT doc_id AS doc, source AS value, dense_rank() OVER (ORDER BY source) - 1 AS ord FROM documents WHERE source IS NOT NULL")
def dv_sorted_ord(s, d):
    return ixs.with_ordinals(_dv(s, d, "documents", "doc_id", fd.sorted_dv("source")))


@register("dv_sorted_set", "SELECT doc_id AS doc, array_to_string(list_sort(list_distinct([lang, source, lang])), ',') AS value FROM documents")
def dv_sorted_set(s, d):
    docs = table(s, d, "documents").withColumn("tags", F.array("lang", "source", "lang")).withColumn("doc", F.col("doc_id"))
    return ixs.doc_values(docs, fd.sorted_set_dv("tags")).select("doc", F.array_join("value", ",").alias("value"))


@register("dv_sorted_numeric", "SELECT doc_id AS doc, array_to_string(list_sort([n_chars, doc_id % 7, 3]), ',') AS value FROM documents")
def dv_sorted_numeric(s, d):
    docs = table(s, d, "documents").withColumn("ns", F.array(F.col("n_chars"), F.col("doc_id") % 7, F.lit(3).cast("long"))).withColumn("doc", F.col("doc_id"))
    return ixs.doc_values(docs, fd.sorted_numeric_dv("ns")).select("doc", F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("value"))


@register("dv_sparse", "SELECT doc_id AS doc, quality::BIGINT AS value FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def dv_sparse(s, d):
    docs = table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")
    return ixs.doc_values(ixs.with_doc(docs, "doc_id"), fd.numeric_dv("quality"))


def _points(name, key, field, cast):
    return lambda s, d: ixs.point_columns(ixs.with_doc(table(s, d, name), key), field).select("doc", F.col("value").cast(cast).alias("value"))


register("points_int", "SELECT p_partkey AS doc, p_size::INTEGER AS value FROM part")(_points("part", "p_partkey", fd.int_field("p_size"), "int"))
register("points_long", "SELECT event_id AS doc, user_id::BIGINT AS value FROM events WHERE user_id IS NOT NULL")(_points("events", "event_id", fd.long_field("user_id"), "long"))
register("points_float", "SELECT p_partkey AS doc, round(p_retailprice::FLOAT::DOUBLE, 2) AS value FROM part")(
    lambda s, d: _points("part", "p_partkey", fd.float_field("p_retailprice"), "double")(s, d).withColumn("value", F.round("value", 2))
)
register("points_double", "SELECT event_id AS doc, value FROM events WHERE value IS NOT NULL")(_points("events", "event_id", fd.double_field("value"), "double"))


@register("points_latlon_quantize", "SELECT doc_id AS doc, floor((doc_id % 180 - 89.5::DOUBLE) * 4294967296.0::DOUBLE / 180.0::DOUBLE)::INTEGER AS lat, floor((doc_id % 360 - 179.25::DOUBLE) * 4294967296.0::DOUBLE / 360.0::DOUBLE)::INTEGER AS lon FROM documents")
def points_latlon(s, d):
    at = F.struct((F.col("doc_id") % 180 - 89.5).alias("lat"), (F.col("doc_id") % 360 - 179.25).alias("lon"))
    return ixs.point_columns(ixs.with_doc(table(s, d, "documents"), "doc_id").withColumn("at", at), fd.lat_lon("at"))


@register("points_range_fields", "SELECT doc_id AS doc, n_chars AS min, n_chars + 100 AS max FROM documents")
def points_range_fields(s, d):
    docs = ixs.with_doc(table(s, d, "documents"), "doc_id").withColumn("r", F.struct(F.col("n_chars").alias("min"), (F.col("n_chars") + 100).alias("max")))
    return ixs.point_columns(docs, fd.long_range("r"))


@register("points_count", "SELECT count(value) AS point_count, count(DISTINCT event_id) FILTER (value IS NOT NULL) AS doc_count, CEIL(count(value) / 512.0)::BIGINT AS num_leaves FROM events")
def points_count(s, d):
    p = ixs.point_columns(ixs.with_doc(table(s, d, "events"), "event_id"), fd.double_field("value"))
    return p.agg(F.count("*").alias("point_count"), F.countDistinct("doc").alias("doc_count"), F.ceil(F.count("*") / 512).alias("num_leaves"))


@register("stored_fields_fetch", f"WITH h AS ({sql.boolean(_CL)}) SELECT h.doc, h.score, lang, n_chars FROM h JOIN documents ON doc = doc_id")
def stored_fields_fetch(s, d):
    x = Searcher(documents(s, d))
    return x.fetch(scored(x.search(_query(_CL), 10)), "lang", "n_chars")


@register("field_summary", f"""{_P} SELECT 'text' AS field, count(DISTINCT term) AS term_count, sum(tf)::BIGINT AS sum_ttf, count(*) AS sum_df, count(DISTINCT doc) AS doc_count, 0::BIGINT AS dv_docs, 0::BIGINT AS point_docs FROM post
    UNION ALL SELECT 'lang', count(DISTINCT lang), count(lang), count(lang), count(lang), count(lang), 0 FROM documents
    UNION ALL SELECT 'n_chars', 0, 0, 0, 0, count(n_chars), count(n_chars) FROM documents UNION ALL SELECT 'source', 0, 0, 0, 0, count(source), 0 FROM documents""")  # fmt: skip
def field_summary(s, d):
    return ixs.summary(documents(s, d)).select("field", "term_count", "sum_ttf", "sum_df", "doc_count", "dv_docs", "point_docs")


#: A field of every kind, each with a column that every_kind() makes of a document's id, text, source and length.
KIND_FIELDS = [
    fd.keyword("path", stored=True), fd.string("title", stored=True), fd.text("contents", level="offsets", vectors=True),
    *(make(kind) for kind, make in (("an_int", fd.int_field), ("a_long", fd.long_field), ("a_float", fd.float_field), ("a_double", fd.double_field))),
    *(make(kind) for kind, make in (("int_span", fd.int_range), ("long_span", fd.long_range), ("float_span", fd.float_range), ("double_span", fd.double_range))),
    fd.lat_lon("place"), fd.feature("weights"), fd.stored("note"),
    *(make(kind) for kind, make in (("dv_number", fd.numeric_dv), ("dv_bytes", fd.binary_dv), ("dv_word", fd.sorted_dv), ("dv_words", fd.sorted_set_dv), ("dv_numbers", fd.sorted_numeric_dv))),
]


def every_kind(docs: DataFrame) -> DataFrame:
    """doc_id, text, source -> the columns of KIND_FIELDS; dv_number is there for even ids only."""
    n, key = F.length("text"), F.col("doc_id")
    span = lambda kind: F.struct(n.cast(kind).alias("min"), (n + 10).cast(kind).alias("max"))
    numbers = [n.cast(kind).alias(name) for name, kind in (("an_int", "int"), ("a_long", "long"), ("a_float", "float"), ("a_double", "double"))]
    spans = [span(kind).alias(f"{name}_span") for name, kind in (("int", "int"), ("long", "long"), ("float", "float"), ("double", "double"))]
    return docs.select(
        F.concat_ws("/", "source", key.cast("string")).alias("path"), F.concat(F.lit("no "), key).alias("title"), F.col("text").alias("contents"), *numbers, *spans,
        F.struct((key % 90).cast("double").alias("lat"), (key % 180).cast("double").alias("lon")).alias("place"), F.create_map(F.lit("length"), (n + 1).cast("float")).alias("weights"), F.lit("a note").alias("note"),
        F.when(key % 2 == 0, key).alias("dv_number"), F.col("source").alias("dv_bytes"), F.col("source").alias("dv_word"), F.array("source", "source").alias("dv_words"), F.array(key, n.cast("long")).alias("dv_numbers"),
    )


def _every_kind_sql() -> str:
    has, n = "count(*) FILTER (text IS NOT NULL)", "count(*)"
    feature = f"""z AS (SELECT (length(text) + 1)::FLOAT::DOUBLE AS v FROM documents WHERE text IS NOT NULL), fe AS (SELECT v, floor(log2(v)) AS e0 FROM z),
      fx AS (SELECT v, CASE WHEN pow(2, e0) > v THEN e0 - 1 WHEN pow(2, e0 + 1) <= v THEN e0 + 1 ELSE e0 END AS e FROM fe),
      ff AS (SELECT count(*) AS c, sum(((e + 127) * 256 + floor((v / pow(2, e) - 1) * 256))::BIGINT)::BIGINT AS t FROM fx)"""
    rows = ["SELECT 'contents', count(DISTINCT term), sum(tf)::BIGINT, count(*), count(DISTINCT doc), 0::BIGINT, 0::BIGINT, count(DISTINCT doc), count(DISTINCT doc) FROM post", "SELECT 'weights', 1, t, c, c, 0, 0, 0, 0 FROM ff"]
    rows += [f"SELECT '{f}', {n}, {n}, {n}, {n}, {dv}, 0, 0, 0 FROM documents" for f, dv in (("path", n), ("title", 0))]
    number = [f"SELECT '{f}', 0, 0, 0, 0, {has}, {has}, 0, 0 FROM documents" for f in ("an_int", "a_long", "a_float", "a_double")]
    rows += [*number, *(f"SELECT '{f}_span', 0, 0, 0, 0, 0, {n}, 0, 0 FROM documents" for f in ("int", "long", "float", "double")), f"SELECT 'place', 0, 0, 0, 0, 0, {n}, 0, 0 FROM documents", "SELECT 'note', 0, 0, 0, 0, 0, 0, 0, 0"]
    rows += [f"SELECT 'dv_number', 0, 0, 0, 0, {n}, 0, 0, 0 FROM documents WHERE doc_id % 2 = 0", *(f"SELECT '{f}', 0, 0, 0, 0, {n}, 0, 0, 0 FROM documents" for f in ("dv_bytes", "dv_word", "dv_words", "dv_numbers"))]
    return f"WITH {sql.postings()}, {feature} SELECT * FROM ({' UNION ALL '.join(rows)}) r(field, term_count, sum_ttf, sum_df, doc_count, dv_docs, point_docs, norm_docs, vector_docs)"


@register("all_field_summary", _every_kind_sql())
def all_field_summary(s, d):
    ix = _index(s, d, "kinds", lambda s, d: (every_kind(table(s, d, "documents")), "path", KIND_FIELDS))
    return ixs.summary(ix).select("field", "term_count", "sum_ttf", "sum_df", "doc_count", "dv_docs", "point_docs", "norm_docs", "vector_docs")


@register("feature_freq_encode", """WITH v AS (SELECT doc_id AS doc, ((n_chars % 100) / 10.0::DOUBLE + 0.5::DOUBLE)::FLOAT::DOUBLE AS v FROM documents),
    e AS (SELECT doc, v, floor(log2(v)) AS e0 FROM v), f AS (SELECT doc, v, CASE WHEN pow(2, e0) > v THEN e0 - 1 WHEN pow(2, e0 + 1) <= v THEN e0 + 1 ELSE e0 END AS e FROM e)
    SELECT doc, 'pagerank' AS term, ((e + 127) * 256 + floor((v / pow(2, e) - 1) * 256))::INTEGER AS tf FROM f""")  # fmt: skip
def feature_freq_encode(s, d):
    value = (F.col("n_chars") % 100 / F.lit(10.0) + 0.5).cast("float")
    docs = ixs.with_doc(table(s, d, "documents"), "doc_id").withColumn("features", F.create_map(F.lit("pagerank"), value))
    return ixs.field_postings(docs, fd.feature("features")).select("doc", "term", "tf")


# ---- segments, streaming, extensions ---------------------------------------------------------------------


@register("segment_append_search", sql.boolean(_CL))
def segment_append_search(s, d):
    docs, fields = table(s, d, "documents"), [fd.text("text")]
    store = Store(s, f"{_dir(s)}/appended-{abs(hash(d))}")
    parity = F.col("doc_id") % 2
    store.write(docs.where(parity == 0), "doc_id", fields)
    store.write(docs.where(parity == 1), "doc_id", fields, mode="append")
    return scored(Searcher(store.open()).search(_query(_CL), 10))


@register("segment_terms", f"""WITH t AS (SELECT unnest(regexp_extract_all(translate(text, {sql.AZ}), '{sql.WORDS}')) AS term FROM documents WHERE doc_id % 2 = 1) SELECT term, count(*) AS ttf FROM t GROUP BY term""")
def segment_terms(s, d):
    docs, fields = table(s, d, "documents"), [fd.text("text", level="freqs")]
    store = Store(s, f"{_dir(s)}/halves-{abs(hash(d))}")
    store.write(docs.where("doc_id % 2 = 0"), "doc_id", fields, segment="even")
    store.write(docs.where("doc_id % 2 = 1"), "doc_id", fields, mode="append", segment="odd")
    return tm.terms(store.open(only="od"), "text").select("term", "ttf")


@register("stream_ingest_search", sql.boolean(_CL))
def stream_ingest_search(s, d):
    at = f"{_dir(s)}/streamed-{uuid.uuid4().hex}"
    schema = table(s, d, "documents").schema
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    whole = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet" if whole else "documents.parquet")
    stream = stream.parquet(f"{d}/documents.parquet" if whole else d)
    ingest(stream, f"{at}/index", "doc_id", [fd.text("text")], f"{at}/checkpoint").awaitTermination()
    return scored(Searcher(Store(s, f"{at}/index").open()).search(_query(_CL), 10))


@register("delete_docs", f"SELECT doc, score FROM ({_ALL}) WHERE doc % 3 <> 0 ORDER BY score DESC, doc LIMIT 10")
def delete_docs(s, d):
    store = _new_store(s, "deleted")
    store.write(table(s, d, "documents"), "doc_id", [fd.text("text")])
    store.delete(store.open().docs.where("doc % 3 = 0").select("doc"))
    return scored(Searcher(store.open()).search(_query(_CL), 10))


def _new_store(s, name) -> Store:
    return Store(s, f"{_dir(s)}/{name}-{uuid.uuid4().hex}")


def _over(docs: str, clauses, more: str) -> str:
    """SQL of all hits where the documents are those of a subquery (doc_id, text)."""
    three = [(c[0], c[1], 1.0) for c in clauses]
    return f"WITH u AS ({docs}), {sql.postings('u')}, {sql.scores()}, hits AS ({sql.matched(sql.clause_hits(three), three)}) {more}"


@register("merge_search", _over("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0", _CL, f"SELECT {sql.OUT} FROM hits ORDER BY hits.score DESC, doc LIMIT 10"))
def merge_search(s, d):
    docs, fields, store = table(s, d, "documents"), [fd.text("text")], _new_store(s, "merged")
    store.write(docs.where("doc_id % 2 = 0"), "doc_id", fields)
    store.write(docs.where("doc_id % 2 = 1"), "doc_id", fields, mode="append")
    store.delete(store.open().docs.where("doc % 3 = 0").select("doc"))
    store.merge()
    return scored(Searcher(store.open()).search(_query(_CL), 10))


@register("update_docs", _over("SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text || ' the license' FROM documents WHERE doc_id % 5 = 0", [(MUST, "the"), (SHOULD, "license")],
    "SELECT doc % 1000000000 AS doc, round(score::DOUBLE, 5) AS score FROM hits WHERE doc >= 1000000000 OR doc % 5 <> 0"))
def update_docs(s, d):
    docs, fields, store = table(s, d, "documents"), [fd.text("text")], _new_store(s, "updated")
    store.write(docs, "doc_id", fields)
    store.update(docs.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" the license"))), "doc_id", fields)
    return scored(Searcher(store.open()).hits(_query([(MUST, "the"), (SHOULD, "license")])))


@register("append_string_keys", f"SELECT 'd' || doc AS key, score FROM ({_ALL})")
def append_string_keys(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), "text", "doc_id")
    fields, store = [fd.text("text"), fd.stored("key")], _new_store(s, "keyed")
    store.write(docs.where("doc_id % 2 = 0"), "key", fields)
    store.write(docs.where("doc_id % 2 = 1"), "key", fields, mode="append")
    x = Searcher(store.open())
    return x.fetch(scored(x.hits(_query(_CL))), "key").select("key", "score")


@register("multi_valued_text", f"WITH u AS (SELECT doc_id, text || ' ' || source AS text FROM documents), {sql.postings('u')} SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term")
def multi_valued_text(s, d):
    docs = ixs.with_doc(table(s, d, "documents").withColumn("parts", F.array("text", "source")), "doc_id")
    return ixs.term_table(ixs.field_postings(docs, fd.text("parts", level="freqs"))).select("term", "df", "ttf")


def _constant(where: str) -> str:
    return f"{_P} SELECT DISTINCT doc, 1.0::DOUBLE AS score FROM post WHERE {where}"


def _all_hits(query):
    return lambda s, d: scored(Searcher(documents(s, d)).hits(query))


register("match_all", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents")(_all_hits(MatchAll()))
register("match_none", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents WHERE false")(_all_hits(MatchNone()))
register("bool_empty", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents WHERE false")(_all_hits(Bool([])))
register("ext_prefix", _constant("term LIKE 'licen%'"))(_all_hits(Prefix("text", "licen")))
register("ext_wildcard", _constant("term LIKE 'l_cen%ed'"))(_all_hits(Wildcard("text", "l?cen*ed")))
register("ext_fuzzy", _constant("levenshtein(term, 'licence') <= 1"))(_all_hits(Fuzzy("text", "licence", 1)))
register("ext_phrase", f"""WITH {sql.postings()}, {_LISTS}, p AS (SELECT a.doc AS doc, count(*) AS tf FROM placed a JOIN placed b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc),
    w AS (SELECT sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT::DOUBLE)::FLOAT AS w FROM dfs, st WHERE term IN ('of', 'the')),
    x AS (SELECT doc, tf, w, (1.0::FLOAT / (1.2::FLOAT * ((1.0::FLOAT - 0.75::FLOAT) + (0.75::FLOAT * {sql.q('dl')}::FLOAT) / (s::DOUBLE / n)::FLOAT)))::FLOAT AS inv FROM p JOIN dl USING (doc), st, w)
    SELECT doc, round({sql.SCORE.format(w='w')}::DOUBLE, 5) AS score FROM x""")(_all_hits(Phrase("text", ("of", "the"))))  # fmt: skip


@register("explain_score", f"WITH {sql.postings()}, {sql.scores()}, h AS ({sql.clause_hits([(MUST, 'the', 1.0), (SHOULD, 'tion', 1.0)])}) SELECT c.term, round(h.score::DOUBLE, 5) AS score FROM h JOIN (VALUES (0, 'the'), (1, 'tion')) c(cid, term) USING (cid) WHERE h.doc = (SELECT doc FROM ({_ALL}) ORDER BY score DESC, doc LIMIT 1)")
def explain_score(s, d):
    x = Searcher(documents(s, d))
    best = x.search(_query(_CL), 1).first().doc
    return x.explain(_query(_CL), best).select("term", F.round(F.col("score").cast("double"), 5).alias("score"))


register("ext_range_points", "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 500 AND 600")(_all_hits(PointRange("n_chars", 500, 600)))
register("ext_sort_by_dv", f"SELECT doc, n_chars FROM ({_ALL}) JOIN documents ON doc = doc_id ORDER BY n_chars DESC, doc LIMIT 10")(lambda s, d: Searcher(documents(s, d)).sort_by(_query(_CL), "n_chars", 10, False).select("doc", "n_chars"))
register("ext_facet_counts", f"SELECT source AS value, count(*) AS n FROM ({_ALL}) JOIN documents ON doc = doc_id GROUP BY 1")(lambda s, d: Searcher(documents(s, d)).facets(_query(_CL), "source"))


# ---- analyzers with filters, places, suggestions, highlights, mixed batches -------------------------------

_WORDS_OF_TEXT = f"SELECT unnest(regexp_extract_all(translate(text, {sql.AZ}), '{sql.WORDS}')) AS term FROM documents"


def _counted(analyzer):
    return lambda s, d: corpora.spread(table(s, d, "documents")).select(F.explode_outer(analyzer(F.col("text"))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("ttf"))


register("analyze_stop_words", f"SELECT term, count(*) AS ttf FROM ({_WORDS_OF_TEXT}) WHERE term NOT IN ('the', 'of', 'and') GROUP BY term")(lambda s, d: _counted(analysis.without(analysis.standard, ["the", "of", "and"]))(s, d))
register("analyze_synonyms", f"SELECT CASE term WHEN 'und' THEN 'and' WHEN 'et' THEN 'and' WHEN 'der' THEN 'the' ELSE term END AS term, count(*) AS ttf FROM ({_WORDS_OF_TEXT}) GROUP BY 1")(
    lambda s, d: _counted(analysis.with_synonyms(analysis.standard, {"und": "and", "et": "and", "der": "the"}))(s, d)
)
register("analyze_stemmed", f"""SELECT CASE WHEN regexp_matches(t, '[^ea]ies$') THEN t[:-4] || 'y' WHEN t LIKE '%ies' THEN t WHEN regexp_matches(t, '[^aeo]es$') THEN t[:-2] WHEN t LIKE '%es' THEN t WHEN regexp_matches(t, '[^us]s$') THEN t[:-2] ELSE t END AS term,
    count(*) AS ttf FROM (SELECT term AS t FROM ({_WORDS_OF_TEXT})) GROUP BY 1""")(lambda s, d: _counted(analysis.stemmed(analysis.standard))(s, d))  # fmt: skip


def _placed(s, d) -> Searcher:
    """Documents with places that their ids make."""
    place = F.struct((F.col("doc_id") % 180 - 89.5).alias("lat"), (F.col("doc_id") % 360 - 179.25).alias("lon"))
    return Searcher(ixs.build(table(s, d, "documents").withColumn("at", place), "doc_id", [fd.lat_lon("at")]))


_AT = "SELECT doc_id AS doc, doc_id % 180 - 89.5::DOUBLE AS lat, doc_id % 360 - 179.25::DOUBLE AS lon FROM documents"
register("geo_box", f"SELECT doc FROM ({_AT}) WHERE lat BETWEEN -20 AND 45 AND (lon >= 170 OR lon <= -30)")(lambda s, d: _placed(s, d).hits(GeoBox("at", -20, 45, 170, -30)).select("doc"))
register("geo_distance", f"SELECT doc FROM ({_AT}) WHERE 2 * 6371008.7714::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon + 80) / 2), 2)))) <= 2000000")(
    lambda s, d: _placed(s, d).hits(GeoDistance("at", 10, -80, 2_000_000)).select("doc")
)
register("suggest_terms", f"{_P} SELECT term, df FROM dfs WHERE term LIKE 'th%' ORDER BY df DESC, term LIMIT 10")(lambda s, d: tm.suggest(documents(s, d), "text", "th"))


@register("highlight_hits", f"WITH h AS ({sql.boolean([(MUST, 'license')])}) SELECT doc, regexp_replace(text, '\\b(license)\\b', '<b>\\1</b>', 'gi') AS text FROM h JOIN documents ON doc = doc_id")
def highlight_hits(s, d):
    x = Searcher(documents(s, d))
    return x.highlight(x.search(_query([(MUST, "license")]), 10).select("doc"), "text", ["license"]).select("doc", "text")


@register("batch_of_any_queries", f"""WITH {sql.postings()}, {_LISTS}, p AS (SELECT DISTINCT a.doc AS doc FROM placed a JOIN placed b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')
    SELECT 0 AS query_id, count(*) AS total_hits FROM p UNION ALL SELECT 1, count(DISTINCT doc) FROM post WHERE term LIKE 'licen%' UNION ALL SELECT 2, count(DISTINCT doc) FROM post WHERE term = 'tion'""")  # fmt: skip
def batch_of_any_queries(s, d):
    queries = [Phrase("text", ("of", "the")), Bool([(MUST, Prefix("text", "licen"))]), Term("text", "tion")]
    return Searcher(documents(s, d)).search_batch(queries, 5).select("query_id", "total_hits").distinct()
