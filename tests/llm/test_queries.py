"""Registered queries: names, columns, and SQL where there is some."""

import duckdb
import pytest

from millrace.llm import queries

from ..conftest import SMALL
from ..test_entry import TABLES, rows

COLUMNS = {
    "op1_quality": "doc_id held_out score predicted", "op2_codes": "doc_id start n_tokens ids_crc32", "op3_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_language": "doc_id held_out lang_pred score", "op5_toxicity": "doc_id held_out score predicted", "op6_jaccard": "doc_id n_shingles component_id",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    got = df.toPandas()
    assert len(got) >= n if name == "op9_packing" else len(got) == n
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
        assert rows(got) == rows(con.execute(queries.SQL[name]).df())
