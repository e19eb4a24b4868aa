"""Registered queries: the two with SQL against it, all for their contract's columns."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from wakeline.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_main_text": "page_id url text n_chars",
    "op3_near_duplicates": "doc_id n_shingles component_id kept",
    "op4_nbest_segmentation": "doc_id n_pieces ids_crc32",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_nearest_vectors": "query_id rank vec_id score",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_repeated_spans": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_imatch": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    diff, n = compare(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])
    assert diff is None and n


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(queries.queries()[name](spark, SF).columns)


def test_all_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())
    assert set(queries.queries()) == set(COLUMNS)
