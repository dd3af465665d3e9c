"""The term dictionary: enumeration and seeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import SearchIndex

FOUND, NOT_FOUND, END = "FOUND", "NOT_FOUND", "END"


def terms(index: SearchIndex, field: str, prefix: str = "") -> DataFrame:
    """term, df, ttf of a field, in byte order."""
    rows = index.terms.where(F.col("field") == field)
    return (rows.where(F.col("term").startswith(prefix)) if prefix else rows).select("term", "df", "ttf").orderBy("term")


def seek_exact(index: SearchIndex, field: str, term: str) -> DataFrame:
    return index.terms.where((F.col("field") == field) & (F.col("term") == term)).select("term", "df", "ttf")


def seek_ceil(index: SearchIndex, field: str, term: str) -> DataFrame:
    """One row (status, term): the smallest term that is not below the given one."""
    low = index.terms.where((F.col("field") == field) & (F.col("term") >= term)).agg(F.min("term").alias("term"))
    status = F.when(F.col("term").isNull(), END).when(F.col("term") == term, FOUND).otherwise(NOT_FOUND)
    return low.select(status.alias("status"), "term")


def bounds(index: SearchIndex, field: str) -> DataFrame:
    return index.full_stats().where(F.col("field") == field).select("min_term", "max_term", "term_count")


def suggest(index: SearchIndex, field: str, prefix: str, n: int = 10) -> DataFrame:
    """term, df: the n terms with the prefix that most documents have."""
    return index.terms.where((F.col("field") == field) & F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(n).select("term", "df")
