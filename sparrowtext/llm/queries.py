"""The subpackage's queries for __spark_entry__.py: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpora import spread
from . import chat_format, decontaminate, license_scan, packing, page_text, quality_rules, secret_scan, simhash_dedup, suffix_tree_lm, warc_zstd

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CAPACITY)


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark, sf_dir):
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op4_suffix_tree_lm(spark, sf_dir):
    return suffix_tree_lm.score(_table(spark, sf_dir, "documents"))


#: Documents have no paths: the query files them under source, language and hundreds of ids; short ones are notices of their directory.
PATH = "concat_ws('/', source, lang, CAST(floor(doc_id / 100) AS bigint), CASE WHEN length(text) <= 200 THEN concat('NOTICE-', doc_id) ELSE concat(doc_id, '.txt') END)"


def op5_license_scan(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH).alias("path"))
    return license_scan.scan(files).withColumn("similarity", F.round("similarity", 6))


def op6_warc_zstd(spark, sf_dir):
    return warc_zstd.digests(_table(spark, sf_dir, "pages"))


def op8_chat_format(spark, sf_dir):
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op7_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_quality_rules, op3_html_extraction, op4_suffix_tree_lm, op5_license_scan, op6_warc_zstd, op7_benchmark_decontamination, op8_chat_format, op9_secret_scan, op10_simhash_dedup)
}
ORACLE: dict[str, str] = {"op5_license_scan": license_scan.oracle_sql(PATH), "op6_warc_zstd": warc_zstd.ORACLE_SQL, "op8_chat_format": chat_format.ORACLE_SQL}
