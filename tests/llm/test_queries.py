"""The registered queries: their columns as agreed, and their SQL where there is any."""

import pytest

from compare import connect, rows
from conftest import SMALL

from sparrowtext.llm import queries

COLUMNS = {
    "op1": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5": {"doc_id": "bigint", "license": "string"},
    "op6": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7": {"doc_id": "bigint", "item_id": "bigint", "similarity": "double"},
    "op8": {"conv_id": "bigint", "text": "string"},
    "op9": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    types = dict(df.dtypes)
    want = COLUMNS[name.split("_")[0]]
    assert {k: types.get(k) for k in want} == want
    got = df.toPandas()
    assert len(got)
    if name in queries.ORACLE:
        assert rows(got) == rows(connect(SMALL).execute(queries.ORACLE[name]).df())
