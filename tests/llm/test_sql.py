"""Queries with SQL agree with it on the smallest tables; the others run and keep their columns."""

from __future__ import annotations

import pytest

from evidentia.llm.oracles import ORACLES
from evidentia.llm.queries import QUERIES
from tests.checks import connection, same

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_pages": {"page_id", "url", "text", "n_chars"},
    "op6_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_quality": {"doc_id", "held_out", "score", "predicted"},
    "op10_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(QUERIES[name](spark, FOLDER).toPandas(), connection(FOLDER).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert COLUMNS[name] <= set(out.columns)
    table = "pages" if name == "op3_pages" else "documents"
    assert out.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
