"""The pipeline stage by stage against brute force, and its odd rows."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from test_decontaminate import brute as contaminated
from test_packing import check as packed_right
from test_quality_rules import naive
from test_simhash_dedup import brute_components, brute_fingerprint

from sparrowtext.llm import quality_rules, secret_scan


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        results.append(docs.collect())
        docs = spark.createDataFrame(results[-1], docs.schema)
        if len(results) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    good, single, clean, safe, packed = results
    ids = lambda rs: {r.doc_id for r in rs}
    verdict = quality_rules.quality(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(good) == {r.doc_id for r in verdict.collect() if r.kept}
    assert all((s := naive(r.text))["n_words"] >= 20 and 100 * s["n_repeat_words"] <= 30 * s["n_words"] for r in good)
    assert ids(single) == set(brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in good]))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {d for d, _ in contaminated([(r.doc_id, r.text) for r in single], items, 0.8)}
    assert ids(clean) == ids(single) - bad
    assert ids(safe) == ids(clean) and all(r.n_chars == len(r.text) for r in safe)
    assert all(rows[r.doc_id].text == r.text or "[SECRET]" in r.text for r in safe)
    assert secret_scan.scan(spark.createDataFrame(safe, spark.read.parquet(f"{SMALL}/documents.parquet").schema)).where("n_assign + n_access + n_hex > 0").count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed_right([(r.doc_id, r.text) for r in safe], packed, tok, 2048)


def test_run(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SMALL)
    assert out.select("doc_id").distinct().count() > 50


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_pass_each_stage(spark, k):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    text = " ".join(f"w{i}" for i in range(40))
    odd = [(None, None, None, None, None), (1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, "", "zz", None, 0), (None, text + " more words", "fr", "s", 9), (3, "token=abcdefgh1 " * 3 + text, "en", "s", 5)]
    for rows in (odd, []):
        out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, schema), SMALL)
        assert out.count() <= len(rows) and (k == 4 or out.schema.names == schema.names)
