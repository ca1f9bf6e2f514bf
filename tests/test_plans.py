"""Plan shape: no cross product, no unpartitioned window over rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

HOT = ["keep_first_pair", "tier_cascade", "stratified_kfold", "bio_pair_features", "negative_sampling", "metrics_table",
       "referral_metrics", "kg_edges", "paired_bootstrap_hash", "name_to_id_cascade", "similarity_join", "feature_audit",
       "snapshot_diff", "mapping_unmatched", "state_metrics_long"]


@pytest.mark.parametrize("key", HOT)
def test_no_cross_product(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["similarity_join", "feature_audit", "snapshot_diff", "mapping_unmatched"])
def test_no_window_over_all_rows(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or "Window" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["accuracy_suite"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


@pytest.mark.parametrize("key", ["label_display", "match_runs", "runs_union_unique", "runs_prefer_primary", "run_grid_check", "run_key_codec", "stable_order"])
def test_run_queries_read_their_runs_from_the_table(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" not in plan and "event_type:string" in plan
