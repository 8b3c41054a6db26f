"""Registered queries against their DuckDB statements on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")

NAMES = [
    "bars_weekly_nation", "panel_returns", "panel_fill_ffill", "panel_stats", "feature_rolling_kurtosis", "feature_variance_ratio", "feature_trend_linearity", "feature_hurst_rs", "normalize_combined",
    "split_label", "expression_pareto", "metric_all", "policy_threshold", "tune_quintile", "backtest_summary", "runs_aggregate", "reversal_question",
    "feature_autocorr_decay", "feature_hurst_dfa", "feature_up_down_run_ratio", "feature_wavelet_noise_to_signal", "feature_asof_weekly", "kernel_of_columns", "source_file_report", "feature_summary", "tune_threshold", "tune_kelly",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    cell = lambda v: None if v is None or v != v else str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else f"{float(v):.6g}"
    return columns, sorted(tuple(str(cell(v)) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    got, want = rows(entry.queries()[name](spark, DATA).toPandas()), rows(duck.execute(entry.oracle_sql()[name]).df())
    assert got[0] == want[0] and got[1] == want[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
