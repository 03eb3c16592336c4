"""Registered queries against their DuckDB oracle on the smallest scale
factor, plus the driver contract and stream = batch."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["a01_incident_rollup", "s04_source_fallback", "u01_union_snapshots", "a02_listing_counters",
        "f01_listings_clean_v2", "a03_area_features_v1", "a08_area_median_fill_v2", "j03_join_audit",
        "m03_ols_hc3_one_regressor", "w01_durbin_watson", "m10_kfold_assignment", "m19_ridge_path",
        "a11_vif_three_predictors", "t01_stream_incident_rollup", "c09_text_flags_documents",
        "m03_ols_qr_polynomial", "m03_ols_absorbed_factor", "m01_absorbed_level_effects", "a10_wide_correlation_pairs",
        "a11_vif_dependent_columns", "s01_csv_audit", "m25_scatter_sample", "m19_ridge_choice_two_predictors",
        "t01_stream_progress", "m15_column_preprocessor", "c11_month_flag", "m25_trend_tables_v2", "s06_diagnostics_report_v2"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "mean_log_price" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert res["status"] == "ok", res
