"""Every query of the subpackage against its oracle, or for its shape, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import TESTDATA, oracle_connection, oracle_rows, spark_rows
from tidemark.llm import queries

SF_DIR = f"{TESTDATA}/sf0.001"
COLUMNS = {
    "op1_top_k": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op2_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op3_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op4_sentencepiece": "doc_id:bigint n_tokens:bigint ids:array<int> round_trip:boolean",
    "op5_exact_dedup": "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
    "op6_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op7_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op8_ngram_jaccard": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op9_html_text": "page_id:bigint url:string text:string n_chars:bigint",
    "op10_language": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op11_fingerprints": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op12_conversation_trie": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
    "op13_runs": "doc_id:bigint n_runs:bigint start:bigint length:bigint period:bigint exponent_milli:bigint runs_sha256:string collapsed_sha256:string",
}


@pytest.mark.parametrize("key", list(queries.QUERIES))
def test_columns_and_oracle(spark, key):
    result = queries.QUERIES[key](spark, SF_DIR)
    assert set(COLUMNS[key].split()) <= {f"{c}:{t}" for c, t in result.dtypes}
    if key in queries.ORACLES:
        assert spark_rows(result) == oracle_rows(oracle_connection(SF_DIR), queries.ORACLES[key])
    else:
        assert not result.isEmpty()


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
