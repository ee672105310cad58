"""A sample of the registered queries against their SQL, at the smallest size; the driver compares all of them."""

import duckdb
import pytest

import __spark_entry__
from quillpanel import registry

NAMES = (
    "panel_trade flag_ohlcv taint_forward merge_upsert source_reconcile log_returns rolling_volatility ema_rsi limit_bias alpha_002 alpha_013 alpha_039 alpha_104 asof_previous asof_next"
    " ensemble_ranks cs_rank_masked magnitude_label quintile_label adaptive_bucket regime_monthly market_ema market_breadth rolling_folds fold_range_join spearman_matrix ndcg_daily"
    " store_and_scan csv_round_trip fold_liquidity calendar_split rolling_ir market_gate precision_at_k performance_report regime_islands outlier_report block_sign_flip moving_block_bootstrap holm_correction suggested_block price_limits rank_weighted_picks score_models significance_family"
    " incremental_upsert change_detection last_trading_day rescale_volume rolling_extremes distinct_columns permutation_importances effective_n autocorrelation_table signals_gated event_windows event_sessions"
    " offset_sensitivity vendor_scan stream_bars paired_returns clean_universe alpha_007 alpha_035 alpha_055"
).split()


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for table in ("supplier", "lineitem", "orders", "events"):
        found.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return found


def plain(rows):
    show = lambda v: "" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, db, name):
    made = registry.QUERIES[name](spark, sf)
    columns = sorted(made.columns)
    expected = db.sql(registry.ORACLES[name])
    assert sorted(expected.columns) == columns
    assert plain(made.select(*columns).collect()) == plain(expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["date", "n", "excess"]
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(registry.QUERIES) <= set(__spark_entry__.queries())
