"""A sample of the registry against DuckDB; tests/check_oracle.py runs all of it."""

import pytest
from check_oracle import compare
from conftest import ROOT

SAMPLE = [
    "x01_series_batch", "s01_scan_load", "j08_model_pairs", "q03_filter_report", "q21_inject_gaps", "i03_interpolate_linear", "i04_lag_fill",
    "d09_period_label", "c04_pre_post_holiday", "w05_blf_baseline", "e05_metrics_cube", "e08_wilcoxon", "e18_rank_models", "r06_cusum",
    "h03_summation_matrix", "m13_combine_best", "m28_smooth_weights", "k15_smooth_profiles", "b02_correction_factors", "x01_stream_load",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    from wattline.plans.registry import ORACLES, QUERIES

    status, n = compare(spark, con, QUERIES[name], ORACLES[name], ROOT)
    assert status == "ok" and n > 0, status


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 250 and set(o) <= set(q) and e.FLAGSHIP in o
