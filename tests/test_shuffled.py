"""What the wide queries write and shuffle, and the array windows that they run on."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from quillpanel.functions import rolling
from quillpanel.registry import QUERIES


def written(spark, table_of) -> tuple[list[str], int]:
    """The tables that a query writes for its own use, and the exchanges of what is left to run."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    plan = table_of()._jdf.queryExecution().executedPlan().toString()
    return sorted(set(os.listdir(folder)) - before), plan.count("Exchange hashpartitioning")


def test_alphas_are_not_written_stage_by_stage(spark, sf):
    """Two exchanges make the panel; four more are symbol (that of the panel), date, symbol, date."""
    tables, exchanges = written(spark, lambda: QUERIES["alpha_catalogue"](spark, sf))
    assert tables == [] and exchanges <= 5


def test_compact_columns_lose_nothing():
    """Rounded values, whole numbers, others, missing ones and groups of several widths come back bit for bit."""
    import pyarrow as pa

    from quillpanel.functions import compact

    rng = np.random.default_rng(0)
    groups = [np.round(rng.normal(size=(50, 3)) * size, 6) for size in (1e-5, 1.0, 1e4)] + [rng.normal(size=(9, 3)), np.full((4, 3), np.nan), np.array([[np.inf, 0, -1.5]]), np.zeros((0, 3))]
    for x in groups[1:]:
        x[: len(x) // 4, 1] = np.nan
    sent = [compact.squeeze(x, 6) for x in groups]
    made = compact.stretch(pa.chunked_array(sent, pa.binary()), 3, 6)
    assert np.array_equal(made, np.concatenate(groups), equal_nan=True)
    assert len(sent[1][0].as_py()) == 1 + 3 * 3 and len(sent[3][0].as_py()) == 1 + 3 * 8
    assert np.array_equal(compact.plain(compact.binary(groups[1])[3:], np.float64), groups[1][3:], equal_nan=True)


def test_ranks_travel_as_whole_numbers():
    from quillpanel.operators import alphas

    rng = np.random.default_rng(1)
    made = {c: alphas.day_rank(np.round(rng.normal(size=997), 1), rng.random(997) < 0.9) for c in ("R_a", "R_b")} | {"mkt": np.full(997, 0.1 + 0.2)}
    import pyarrow as pa

    ranks, same = alphas.ranks_sent(made, list(made))
    found = alphas.ranks_met(pa.table({"_ranks": ranks, "_same": same}), list(made))
    assert all(np.array_equal(found[c], made[c], equal_nan=True) for c in made) and len(ranks[0].as_py()) == 1 + 2 * 2


def test_bars_do_not_travel_through_dates(spark, sf):
    """Between symbols and dates there are keys and bytes, no column of bars and none of alphas."""
    import re

    text = QUERIES["alpha_catalogue"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    inputs = [line for line in text.splitlines() if "FlatMapGroupsInArrow" in line]
    assert len(inputs) >= 3 and "FlatMapCoGroupsInArrow" in text
    assert sum(bool(re.search(r"[\[ ,](date#\d+)\]?.*_ranked#|_last#.*_free#", line)) for line in text.splitlines()) >= 2
    assert sum("close#" in line and "before(" in line for line in inputs) == 1 and not any("close#" in line and ("across(" in line or "ranked(" in line) for line in inputs)


def test_array_windows_equal_pandas():
    rng = np.random.default_rng(0)
    x, y = rng.normal(100, 1, 80), rng.normal(size=80)
    x[[0, 7, 8, 30]] = y[[3, 30, 41]] = np.nan
    p, q = pd.Series(x), pd.Series(y)
    both = p.notna() & q.notna()
    for n, least in ((5, None), (12, 4)):
        r = p.rolling(n, min_periods=least or n)
        for made, expected in (
            (rolling.mean(x, n, least), r.mean()), (rolling.total(x, n, least), r.sum()), (rolling.std(x, n, least), r.std()), (rolling.skew(x, n, least), r.skew()),
            (rolling.cov(x, y, n, least), p.where(both).rolling(n, min_periods=least or n).cov(q.where(both))), (rolling.corr(x, y, n, least), p.where(both).rolling(n, min_periods=least or n).corr(q.where(both))),
        ):
            assert made == pytest.approx(expected.to_numpy(), rel=1e-8, nan_ok=True)
    assert rolling.lag(x, -3) == pytest.approx(p.shift(-3).to_numpy(), nan_ok=True) and np.isnan(rolling.lag(x[:2], 5)).all() and np.isnan(rolling.lag(x[:2], -5)).all()


def test_a_frame_of_equal_values_has_no_spread():
    x = np.full(30, 0.1)
    assert (rolling.std(x, 7)[6:] == 0).all() and np.isnan(rolling.corr(x, np.arange(30.0), 7)).all() and np.isnan(rolling.skew(x, 7)).all()


def test_features_are_written_once_and_ranked_in_place(spark, sf):
    """One table is written; what follows are a symbol's, a date's and the last count's exchange, and those of the small table of dates."""
    tables, exchanges = written(spark, lambda: QUERIES["build_features"](spark, sf))
    assert [t.split("-")[0] for t in tables] == ["features"] and exchanges <= 16


def test_features_of_a_symbol_equal_the_column_functions(spark, sf):
    from quillpanel.operators import features as f
    from quillpanel.sources.panels import walk_panel

    panel = walk_panel(spark, sf)
    for step in (f.log_returns, f.volatilities, f.simple_averages, f.exponential_features, f.volume_features, f.volume_quality, f.turnover, f.limit_bias, f.amihud, f.adtv):
        panel = step(panel)
    table = panel.where("symbol = 1").orderBy("date").toPandas()
    made = f.of_symbol({c: table[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")})
    assert len(table) > 100 and len(made) == len(table.columns) - 7
    for c, x in made.items():
        assert x == pytest.approx(table[c].astype(float).to_numpy(), rel=1e-9, abs=1e-12, nan_ok=True), c


@pytest.mark.parametrize("name", ["score_models", "significance_family", "outlier_report", "select_value"])
def test_a_panel_that_is_read_often_is_made_once(spark, sf, name):
    """What is left to run reads the saved panel, not the lines that it comes from."""
    assert "lineitem" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_upserts_make_the_panel_once(spark, sf):
    assert "bars" in [t.split("-")[0] for t in written(spark, lambda: QUERIES["incremental_upsert"](spark, sf))[0]]


def test_a_stream_of_bars_has_no_file_of_a_whole_period(spark, sf, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_):
        raise AssertionError("one task would write, and one read, all bars of a period")

    monkeypatch.setattr(DataFrame, "coalesce", refuse)
    assert QUERIES["stream_bars"](spark, sf).count() > 0


def test_simple_averages_are_no_frames(spark, sf):
    assert "-199" not in QUERIES["sma_distance"](spark, sf)._jdf.queryExecution().toString()
