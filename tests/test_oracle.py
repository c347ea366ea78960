"""Registered queries against DuckDB on the small tables (all of them with WARDSTONE_ALL=1)."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from wardstone.plans import load

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["d01_detect_candidates", "d06_adjust_confidence", "d09_detect_json", "a21_anonymize", "a25_residual_scan", "k03_k_anonymise", "g01_verdicts", "q01_validate_schema",
          "c04_chunk_by_content", "s10_anonymized_export", "v04_three_way_merge", "v09_tree_hash", "l06_admit_edges", "x05_authorize", "u02_verify_chain", "e06_auto_disable",
          "e11_rate_limit_token_bucket", "e14_brute_force", "m02_sample_stratified", "p13_flag_injection", "a15_anonymize_json", "a22_anonymization_stats", "d12_detect_chunked", "d14_suppress_allowlist", "m06_corpus_entries",
          "p12_sanitize_text", "s05_file_report", "s07_put_content", "v07_apply_updates", "v17_version_stats", "k10_privacy_ledger_basic", "stream_d16_route_by_pii"]
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("WARDSTONE_ALL") else SAMPLE)
def test_query(spark, con, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
