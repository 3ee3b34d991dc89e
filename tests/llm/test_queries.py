"""The registered training-data queries: contracts' columns, and SQL twins."""

import pytest

from shelfmark.llm import queries as llm
from tests.compare import compare, connect
from tests.conftest import SF

COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op6_sp_dropout": {"doc_id": "bigint", "n_ids": "bigint", "lossless": "boolean"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "licenses": "string"},
    "op9_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "pipeline": {"doc_id": "bigint", "start": "bigint", "length": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = llm.queries()[name](spark, SF)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    n = out.count()
    if name in ("op1_language_id", "op4_quality", "op5_line_dedup", "op6_sp_dropout", "op7_simhash", "op8_license_scan"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ("op2_url_filter", "op3_warc"):
        assert n == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_sql_twins(spark):
    con = connect(SF)
    for name, sql in llm.oracle_sql().items():
        compare(spark, con, SF, name, llm.queries()[name], sql)
