"""Building an index: tables derived from the documents by group-bys, one pass over each text."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import analysis, encoding
from ..functions.similarity import quantized_length
from ..sources import durable
from .fields import Field, checked

POSTINGS = "field string, term string, doc long, tf int, dl int, dl_q int, positions array<int>, starts array<int>, lens array<int>"
NORMS = "field string, doc long, dl int, dl_q int"
NONE = "CAST(NULL AS array<int>)"


@dataclass
class SearchIndex:
    """Tables of one index. deleted: doc ids that searches leave out."""

    spark: SparkSession
    fields: list[Field]
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    deleted: DataFrame | None = None
    norms: DataFrame | None = None
    extra: dict = dc_field(default_factory=dict)

    def full_stats(self) -> DataFrame:
        """stats with term_count, which is counted over the terms of all segments."""
        return self.stats.join(self.terms.groupBy("field").agg(F.count("*").alias("term_count")), "field")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)


def source_text(docs: DataFrame, f: Field) -> Column:
    """The text of a tokenized field; several values are one text, a blank between them."""
    c = F.col(f.source)
    return F.array_join(c, " ") if docs.schema[f.source].dataType.typeName() == "array" else c


def _terms(docs: DataFrame, f: Field) -> DataFrame:
    """doc, dl (tokens of the document), groups: a document's terms in byte order, each with its frequency,
    places and, at level offsets, byte starts and lengths.

    Everything happens within a document's own row, so no token is shuffled, sorted across documents or spilled.
    docs has one row a document.
    """
    places = f.level in ("positions", "offsets")
    if f.level != "offsets":
        both = docs.select("doc", analysis.ANALYZERS[f.analyzer](source_text(docs, f)).alias("t"))
        return both.select("doc", F.size("t").alias("dl"), analysis.term_groups(F.col("t"), places).alias("groups"))
    raw, gaps = analysis.pieces(source_text(docs, f), f.analyzer)
    both = docs.select("doc", raw.alias("t"), gaps.alias("g"))
    # a token's end is the sum of the gaps and tokens up to it
    term = (lambda x: F.substring(x, 1, analysis.MAX_TOKEN)) if f.analyzer == "standard" else lambda x: x
    steps = F.transform("t", lambda x, i: F.octet_length(x) + F.octet_length(F.get("g", i)))
    return both.select("doc", F.size("t").alias("dl"), analysis.term_groups(F.transform("t", term), places, steps, F.transform("t", F.octet_length)).alias("groups"))


def field_postings(docs: DataFrame, f: Field) -> DataFrame:
    """Postings of one field, from docs with a `doc` column. head marks the term that a tokenized text begins with."""
    if f.feature:
        kv = docs.select("doc", F.explode(f.source).alias("term", "v")).select("doc", "term", F.when(F.col("v") > 0, encoding.feature_freq(F.col("v"))).otherwise(F.raise_error(F.lit("feature values must be positive"))).alias("tf"))
        return kv.selectExpr(f"'{f.name}' AS field", "term", "doc", "CAST(tf AS int) AS tf", "CAST(NULL AS int) AS dl", "1 AS dl_q", f"{NONE} AS positions", f"{NONE} AS starts", f"{NONE} AS lens", "false AS head")
    if not f.tokenized:
        value = F.col(f.source)
        multi = docs.schema[f.source].dataType.typeName() == "array"
        values = F.explode(F.array_distinct(value)) if multi else value.cast("string")
        terms = docs.select("doc", values.alias("term")).where("term IS NOT NULL").select("doc", F.col("term").cast("string"))
        return terms.selectExpr(f"'{f.name}' AS field", "term", "doc", "1 AS tf", "CAST(NULL AS int) AS dl", "1 AS dl_q", f"{NONE} AS positions", f"{NONE} AS starts", f"{NONE} AS lens", "false AS head")
    # outer, as the plain form makes Spark tokenize a second time, to filter empty arrays
    post = _terms(docs, f).select("doc", "dl", F.explode_outer("groups").alias("x")).where("x IS NOT NULL")
    tf = F.col("x.tf") if f.level != "docs" else F.lit(1)
    return post.select(F.lit(f.name).alias("field"), "x.term", "doc", tf.alias("tf"), "dl", quantized_length(F.col("dl")).alias("dl_q"), "x.positions", "x.starts", "x.lens", "x.head")


def all_postings(docs: DataFrame, fields: list[Field]) -> DataFrame:
    out = None
    for f in fields:
        if f.level != "none":
            one = field_postings(docs, f)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"{POSTINGS}, head boolean")


def field_norms(docs: DataFrame, f: Field) -> DataFrame:
    """field, doc, dl, dl_q: a row for each document that has the field; dl is null where lengths do not count."""
    c = F.col(f.source)
    if f.tokenized:
        rows = docs.select("doc", F.size(analysis.ANALYZERS[f.analyzer](source_text(docs, f))).alias("dl")).where("dl > 0")
        return rows.select(F.lit(f.name).alias("field"), "doc", "dl", quantized_length(F.col("dl")).alias("dl_q"))
    many = docs.schema[f.source].dataType.typeName() == "array"
    held = F.size(F.array_compact(c)) > 0 if many else F.size(c) > 0 if f.feature else c.isNotNull()
    return docs.where(held).select(F.lit(f.name).alias("field"), "doc", F.lit(None).cast("int").alias("dl"), F.lit(1).alias("dl_q"))


def all_norms(docs: DataFrame, fields: list[Field]) -> DataFrame:
    out = None
    for f in fields:
        if f.level != "none":
            one = field_norms(docs, f)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], NORMS)


def term_table(postings: DataFrame) -> DataFrame:
    """field, term, df, ttf."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("ttf"))


def stat_table(norms: DataFrame, terms: DataFrame, max_doc: int) -> DataFrame:
    """One row per field: max_doc, doc_count, sum_ttf, sum_df, max_df, min_term, max_term."""
    by_doc = norms.groupBy("field").agg(F.count("*").alias("doc_count"))
    of_terms = terms.groupBy("field").agg(F.sum("ttf").alias("sum_ttf"), F.sum("df").alias("sum_df"), F.max("df").alias("max_df"), F.min("term").alias("min_term"), F.max("term").alias("max_term"))
    return of_terms.join(by_doc, "field").select("field", F.lit(max_doc).cast("long").alias("max_doc"), "doc_count", "sum_ttf", "sum_df", "max_df", "min_term", "max_term")


def check_stats(row) -> None:
    """What must hold of a field's statistics (a mapping), or scores would be off."""
    if not 0 < row["doc_count"] <= row["max_doc"] or not row["doc_count"] <= row["sum_df"] <= row["sum_ttf"] or row["max_df"] > row["doc_count"]:
        raise ValueError(f"statistics of field {row['field']} contradict each other (do documents share an id?): {dict(row)}")


def with_doc(df: DataFrame, key: str | list[str], base: int = 0) -> DataFrame:
    """df with `doc`: a long key itself, else base plus the rank of the (composite) key in its order.

    The rank is made by range partitions and their counts, not in one task.
    """
    if is_number(df, key):
        return df.withColumn("doc", F.col(key).cast("long"))
    keys = [key] if isinstance(key, str) else key
    # the ranks are hashed, so that the documents are not sorted to meet them
    return df.join(ranks(df.select(*keys).distinct(), "doc").withColumn("doc", F.col("doc") + base).hint("shuffle_hash"), keys)


def is_number(df: DataFrame, key: str | list[str]) -> bool:
    return isinstance(key, str) and df.schema[key].dataType.typeName() in ("long", "integer")


def ranks(distinct: DataFrame, name: str) -> DataFrame:
    """Distinct rows with their rank from 0 in their order."""
    return durable.ranked(distinct, distinct.columns, name)


def build(df: DataFrame, key: str | list[str], fields: list[Field], cache: bool = False) -> SearchIndex:
    """An index of df in tables that are not written; write with sources.store."""
    fields = checked(fields)
    docs = with_doc(df, key)
    postings = all_postings(docs, fields)
    if cache:
        postings = postings.cache()
    terms, norms = term_table(postings), all_norms(docs, fields)
    return SearchIndex(df.sparkSession, fields, docs, postings, terms, stat_table(norms, terms, docs.count()), norms=norms)


def doc_values(docs: DataFrame, f: Field) -> DataFrame:
    """doc, value of one doc-value field, normalised; documents without a value are left out."""
    c: Column = F.col(f.source)
    array = docs.schema[f.source].dataType.typeName() == "array"
    value = {
        "numeric": lambda: c.cast("long"),
        "binary": lambda: c.cast("binary"),
        "sorted": lambda: c.cast("string"),
        "sorted_set": lambda: F.array_sort(F.array_distinct(c if array else F.array(c.cast("string")))),
        "sorted_numeric": lambda: F.array_sort(c if array else F.array(c)),
    }[f.doc_values]()
    return docs.where(c.isNotNull()).select("doc", value.alias("value"))


def with_ordinals(values: DataFrame) -> DataFrame:
    """Ordinals of sorted values, from 0 in byte order. Distinct values are ranked, then joined back."""
    return values.join(ranks(values.select("value").distinct(), "ord"), "value").select("doc", "value", "ord")


def point_columns(docs: DataFrame, f: Field) -> DataFrame:
    """doc and the encoded point of one field; a range's mins must not exceed its maxs."""
    c, bad = F.col(f.source), lambda m: F.raise_error(F.lit(m))
    rows = docs.where(c.isNotNull())
    if f.point == "lat_lon":
        ok = c["lat"].between(-90, 90) & c["lon"].between(-180, 180)
        lat = F.when(ok, encoding.quantize_lat(c["lat"])).otherwise(bad("latitude or longitude out of range").cast("int"))
        return rows.select("doc", lat.alias("lat"), encoding.quantize_lon(c["lon"]).alias("lon"))
    if f.point.endswith("_range"):
        kind = f.point.removesuffix("_range")
        low = F.when(c["min"] <= c["max"], c["min"]).otherwise(bad("a range's min exceeds its max").cast(kind))
        return rows.select("doc", low.cast(kind).alias("min"), c["max"].cast(kind).alias("max"))
    return rows.select("doc", c.cast(f.point).alias("value"))


def term_vectors(docs: DataFrame, f: Field) -> DataFrame:
    """doc, field, terms: each document's terms of a tokenized field in order, with their places; made within its row."""
    # a generated column, as a filter on groups would be made before them, with a second tokenization
    held = _terms(docs, f).select("doc", F.explode_outer(F.when(F.size("groups") > 0, F.array("groups"))).alias("terms")).where("terms IS NOT NULL")
    return held.select("doc", F.lit(f.name).alias("field"), F.transform("terms", lambda x: x.dropFields("head")).alias("terms"))


def summary(index: SearchIndex) -> DataFrame:
    """One row per declared field with its counts, as a diagnostic of an index."""
    rows = []
    for f in index.fields:
        dv = doc_values(index.docs, f).agg(F.count("*").alias("dv_docs")) if f.doc_values else None
        pt = point_columns(index.docs, f).agg(F.count("*").alias("point_docs")) if f.point else None
        one = index.spark.createDataFrame([(f.name, f.level, f.norms, f.vectors, f.doc_values or "none")], "field string, level string, norms boolean, vectors boolean, doc_values string")
        for part, name in ((dv, "dv_docs"), (pt, "point_docs")):
            one = one.withColumn(name, F.lit(0).cast("long")) if part is None else one.join(F.broadcast(part), how="cross")
        rows.append(one)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    held = lambda flag, name: F.when(F.col(flag), F.coalesce("doc_count", F.lit(0))).otherwise(0).cast("long").alias(name)
    return out.join(index.full_stats(), "field", "left").select(
        "field", "level", "norms", "vectors", "doc_values", "dv_docs", "point_docs", held("norms", "norm_docs"), held("vectors", "vector_docs"), *map(zero, ("term_count", "sum_ttf", "sum_df", "doc_count"))
    )
