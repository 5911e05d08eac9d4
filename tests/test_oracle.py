"""Queries against their SQL oracles on the smallest tables.

By default one query per kind of plan; ``ALMANAC_ALL=1`` runs every key.
"""

import os

import pytest

import __spark_entry__ as contract
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "star_join", "insert_ignore", "key_valid_mask", "load_result_message", "rank_by_year", "top_n_ranked",
    "year_growth", "compare_two", "meta_counts", "best_year_for_location",
    "reshape_nested_json", "reshape_wide_unnamed", "reshape_country_names", "reshape_transposed", "reshape_regex_melt",
    "clean_long", "dq_gate", "extractor_contract", "resolve_extractor", "profile_json_shape",
    "batch_ingest_split", "upsert_update", "patch_coalesce", "retry_route", "run_funnel", "errors_concat", "union_logs",
    "sniff_format", "pdf_magic_filter", "read_workbook_grid", "write_silver",
    "chunk_fixed", "page_assemble", "bbox_exclude", "vector_topk", "vector_topk_blocks", "rag_context",
    "q_classify", "alias_contains_join", "q_indicator", "answer_text",
    "inc_load_facts", "stream_errors_window",
]
KEYS = sorted(contract.oracle_sql()) if os.environ.get("ALMANAC_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, con, key):
    result = compare(spark, con, SF, key)
    assert result.startswith("ok") and "types" not in result, result


def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
