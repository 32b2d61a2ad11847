"""Registered queries against their SQL on the smallest tables.

By default one query per family runs; PANELWRIGHT_ALL=1 runs every query. tests/compare.py does the same at
any scale and reports timings.
"""

import os

import pytest

from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "scan_flows_typed flow_audit concentration revealed_advantage edge_violations two_hop_exposure path_contributions "
    "scenario_decomposition sector_features future_perturbation_check peer_summary regime_classification macro_profile "
    "asof_latest_value financial_sheet simple_baselines rolling_percentile_60m purged_training_window publication_boundary "
    "revision_upsert active_versions table_fingerprint line_diff coverage_window observation_audit union_sources "
    "rank_auc calibration_bins block_bootstrap_ci latency_quantiles metric_slices page_text page_links pattern_facts "
    "table_series_values normalize_panel_records explode_forecast_maps text_normalize route_top1 batch_answers typed_claims "
    "report_facts table_layout_facts table_cells_lateral line_diff_replay interval_totals question_answers text_fold range_lookup "
    "history_window totals_reconcile stream_sliding_counts stream_compacted_table stream_expiring_revisions"
).split()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def names():
    if os.environ.get("PANELWRIGHT_ALL") != "1":
        return SAMPLE
    from panelwright.plans import catalogue

    return sorted(catalogue.oracles())


@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, connection, name):
    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, SF), connection, entry.oracle_sql()[name]) == []


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
