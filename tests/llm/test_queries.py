"""Registered queries on the smallest tables: schema, row counts, and SQL where there is some."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_file
from dockside.llm.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op2_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint"
    " sequence_id:bigint offset:bigint",
    "op3_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint"
    " items_sha256:string contaminated:boolean",
    "op4_nearest": "query_id:bigint rank:int vec_id:bigint score:double",
    "op5_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op6_substring_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op7_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint"
    " last_word:bigint base_labels:string labels:string score:double",
    "op8_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint"
    " grown_shard:int",
    "op9_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op10_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
    "op11_class_scores": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint"
    " train_tokens:bigint base_score:double score:double",
    "op12_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint"
    " middle_chars:bigint output_sha256:string restored_sha256:string",
    "op13_conversation_repair": "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint"
    " truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert " ".join(f"{c}:{t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    table = {"op1_html_extraction": "pages", "op4_nearest": "embeddings"}.get(name, "documents")
    (n,) = duck.execute(f"SELECT COUNT(*) FROM {table}").fetchone()
    if name not in ("op2_packing", "op4_nearest", "op13_conversation_repair"):
        assert len(rows) == n
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        assert [d[0] for d in result.description] == df.columns
        assert sorted(map(repr, rows)) == sorted(map(repr, result.fetchall()))


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and {*QUERIES, "pipeline"} <= set(entry_file.queries())
    assert set(ORACLE_SQL) <= set(entry_file.oracle_sql())
