"""Registered queries against their SQL on the smallest tables.

The default set covers every module; RANKMILL_QUERIES=all runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF_DIR = os.environ.get("RANKMILL_SF_DIR", "/root/testdata/sf0.001")
DEFAULT = (
    "t09_category_text", "t15_hash_embedding", "l02_bm25", "l06_fuzzy", "l12_profile_sweep", "d01_exact_knn", "d09_sparse_search",
    "h01_minmax_fuse", "h09_rerank", "e05_evaluate", "e10_robustness_grid", "e27_radial_calibration", "q03_label_conflicts", "q12_compare_content",
    "f05_sort_plan", "j06_changes_in_jobs", "i05_supersede_jobs", "i07_apply_embeddings", "i17_validate_generation", "i18_scope_fingerprint",
    "m03_route_latency", "m10_alerts", "m12_error_rate", "s01_read_catalog_tsv", "s06_run_round_trip", "s10_read_telemetry_log",
    "e15_compare_families", "e27_capture_faults", "e32_facet_compare", "q12_differing_rows", "s14_verify_sparse", "j12_changed_keys", "t08_plain_text",
    "st1_stream_latest", "st2_stream_apply", "st3_stream_latency", "st4_stream_failure_runs",
)
NAMES = list(entry.queries()) if os.environ.get("RANKMILL_QUERIES") == "all" else DEFAULT


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, detail = compare(spark, con, name, SF_DIR, entry.queries(), entry.oracle_sql())
    assert status == ("ok" if name in entry.oracle_sql() else "rows"), detail


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables")
def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_plans_have_no_cartesian_product(spark):
    queries = entry.queries()
    for name in ("l02_bm25_all_matches", "e05_evaluate", "i12_resolved_changes", "i05_supersede_jobs", "j09_subtree_products"):
        plan = queries[name](spark, SF_DIR)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan
