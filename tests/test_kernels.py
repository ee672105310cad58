"""Stateful and fitted operators against small worked examples and properties."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel import registry
from quillpanel.functions import ewm
from quillpanel.operators import features, folds, metrics, selection, simulation
from quillpanel.plans import walkforward
from quillpanel.queries import iterative
from quillpanel.sources import partitions
from quillpanel.sources.panels import walk_panel
from quillpanel.streaming import ingest


def test_decay_row_by_row():
    assert np.allclose(ewm.decay(np.array([np.nan, 1, np.nan, 3]), ewm.span(3)), [np.nan, 1, 1, 2.33333333], equal_nan=True)
    x = np.random.default_rng(1).normal(size=200)
    x[[0, 5, 6, 90]] = np.nan
    want, state, weight = [], np.nan, 1.0
    for v in x:
        if np.isnan(state):
            state = v
        else:
            weight *= 0.8
            if not np.isnan(v):
                state, weight = (weight * state + 0.2 * v) / (weight + 0.2), 1.0
        want.append(state)
    assert np.allclose(ewm.decay(x, 0.2), want, equal_nan=True)


@pytest.mark.parametrize("kind", [folds.Rolling, folds.Expanding])
def test_folds_tile_and_keep_the_gap(kind):
    found = list(kind(100, 10, 0.8).slices(300))
    assert found and all(b + 10 == c and d <= 300 for _, b, c, d in found)
    assert all(x[3] == y[2] for x, y in zip(found, found[1:], strict=False)) and list(kind(100, 10, 0.8).slices(50)) == []
    with pytest.raises(ValueError):
        kind(10, 10)


def test_pruning_goes_on_after_a_drop():
    """a and b are alike and a is weaker; a, though dropped, still drops c."""
    rho = {("a", "b"): 0.9, ("a", "c"): 0.9, ("b", "c"): 0.1}
    kept = selection.prune({"a": 0.5, "b": 0.6, "c": 0.4}, rho, [["a", "b", "c"]])
    assert kept == ["b"]


def test_features_do_not_look_ahead(spark, sf):
    panel = walk_panel(spark, sf).where("symbol = 1")
    cut = date(1999, 1, 4)
    changed = panel.withColumn("close", F.when(F.col("date") >= F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))
    one, two = ([r for r in features.log_returns(p).where(F.col("date") <= F.lit(cut)).orderBy("date").select("date", "log_ret_1w", "log_ret_1m").collect()] for p in (panel, changed))
    assert one == two and len(one) > 100


def test_simulation_keeps_value_with_flat_prices(spark):
    """Prices never move, so only fees are lost."""
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    panel = spark.createDataFrame([(s, d, 10.0, 10.0, 10.0, 10.0, 1e6) for s in (1, 2, 3) for d in days], "symbol long, date date, open double, high double, low double, close double, volume double")
    scores = spark.createDataFrame([(s, d, float(s)) for s in (1, 2, 3) for d in days], "symbol long, date date, pred_score double")
    scenario = simulation.picks(scores, 2).withColumn("scenario", F.lit("flat"))
    found = simulation.simulate(panel, scenario, simulation.Rules(capital=1e9, unit=1000.0)).where("kind = 'value'").orderBy("date").toPandas()
    assert len(found) == 60
    value = found["amount"].to_numpy(float)
    assert value[0] == 1e9 and (np.diff(value) <= 1e-6).all() and 0.99e9 < value[-1] < 1e9


def test_dates_must_match(spark):
    a = spark.createDataFrame([(date(2020, 1, 1),)], "date date")
    b = spark.createDataFrame([(date(2020, 1, 2),)], "date date")
    with pytest.raises(simulation.DateMismatch):
        simulation.check_dates(a, b)


def test_walk_forward_scores_each_test_row_once(spark, sf):
    table = iterative.weekly(spark, sf)
    made, scores = walkforward.walk_forward(table, iterative.FEATURES, "linear", initial=150, gap=4, ratio=0.75, k=3, penalties=2, folds=2)
    rows = made.select("symbol", "date", "fold_index", "pred_score").toPandas()
    assert len(rows) and not rows.duplicated(["symbol", "date"]).any() and rows["pred_score"].notna().all()
    assert rows["fold_index"].nunique() == scores.count() >= 1


def test_combined_factors_run(spark, sf):
    assert registry.QUERIES["factor_combination"](spark, sf).where("pred_score is not null").count() > 0


def test_stream_upserts_like_a_batch(spark, tmp_path):
    schema = "symbol long, date date, open double, high double, low double, close double, volume double"
    source = str(tmp_path / "in")
    row = lambda s, close: (s, date(2020, 1, 2), 1.0, 2.0, 0.5, close, 10.0)
    spark.createDataFrame([row(1, 1.0), row(2, 1.5)], schema).write.parquet(source)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    ingest.upsert_stream(ingest.bars(spark, source, schema), out, marks).awaitTermination(120)
    spark.createDataFrame([row(1, 1.25)], schema).write.mode("append").parquet(source)
    ingest.upsert_stream(ingest.bars(spark, source, schema), out, marks).awaitTermination(120)
    found = {r["symbol"]: r for r in partitions.read(spark, out).collect()}
    assert found[1]["close"] == 1.25 and found[1]["close_raw"] == 1.0 and found[2]["close"] == 1.5 and len(found) == 2


def test_event_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert ingest.event_counts(events).agg(F.sum("n")).first()[0] == events.count() == ingest.sessions(events).agg(F.sum("n")).first()[0]


def _trade(closes: dict, plan: dict, capital: float):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(6)]
    prices = pd.DataFrame([(d, s, x) for s, xs in closes.items() for d, x in zip(days, xs, strict=True)], columns=["date", "symbol", "close"])
    values, holdings, skipped = simulation.trade(prices, {days[0]: plan}, {}, simulation.Rules(capital=capital, unit=1000.0, fee=0.0))
    return values, {s: n for d, s, n in holdings if d == days[-1]}, skipped


def test_orders_that_do_not_fill_reserve_no_cash():
    """b does not trade on the day of the orders and c leaps over its ceiling; a gets the cash that either would have taken."""
    flat = [10.0] * 6
    _, held, skipped = _trade({"b": [10.0, 10.0, 10.0, np.nan, 10.0, 10.0], "c": [10.0, 10.0, 10.0, 12.0, 12.0, 12.0], "a": flat}, {"b": 1.0, "c": 1.0, "a": 1.0}, 10_700_000.0)
    assert held == {"a": 1000} and {s[1:] for s in skipped} == {("b", "buy", "no trade"), ("c", "buy", "close above ceiling")}


def test_short_cash_goes_to_the_orders_that_come_first():
    """Cash for about three fifths of what is wanted: the plan's order decides, not the weights."""
    flat = [10.0] * 6
    _, held, _ = _trade({"a": flat, "b": flat}, {"b": 0.6, "a": 0.9}, 10_000_000.0)
    assert held == {"b": 600, "a": 300}
    _, held, _ = _trade({"a": flat, "b": flat}, {"a": 0.9, "b": 0.6}, 10_000_000.0)
    assert held == {"a": 900}


def test_buys_run_from_the_worst_pick_to_the_best(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(6)]
    panel = spark.createDataFrame([(s, d, 10.0) for s in "abc" for d in days], "symbol string, date date, close double")
    scores = spark.createDataFrame([(s, d, x) for s, x in (("a", 3.0), ("b", 2.0), ("c", 1.0)) for d in days], "symbol string, date date, pred_score double")
    scenario = simulation.picks(scores, 2).withColumn("scenario", F.lit("x"))
    assert {r["symbol"]: r["place"] for r in scenario.collect()} == {"a": 1, "b": 2}
    last = simulation.simulate(panel, scenario.withColumn("weight", F.lit(0.9)), simulation.Rules(capital=1e7, unit=1000.0, fee=0.0)).where("kind = 'holding'").where(F.col("date") == F.lit(days[-1]))
    assert {r["symbol"]: r["amount"] for r in last.collect()} == {"b": 900.0}
    with pytest.raises(simulation.DateMismatch):
        walkforward.backtest(panel.where(F.col("date") != F.lit(days[2])), scores, [1])


def test_nth_largest_by_bucket_counts(spark):
    x = np.concatenate([np.random.default_rng(5).exponential(size=900), np.zeros(50), [7.5] * 30, [1e12]])
    table = spark.createDataFrame(pd.DataFrame({"x": x}))
    for n in (1, 2, 20, 33, 500, 940, len(x)):
        assert metrics.nth_largest(table, "x", n, buckets=16, few=5) == np.sort(x)[-n]


def test_spearman_matrix_equals_pandas(spark):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 3, 500).astype(float), "c": np.zeros(500)})
    rows["d"] = rows["a"] + rng.normal(size=500)
    found = {(r["a"], r["b"]): r["rho"] for r in selection.spearman_matrix(spark.createDataFrame(rows), list("abcd")).collect()}
    want = rows.corr("spearman")
    assert len(found) == 6 and all((np.isnan(want.loc[k]) and v is None) or v == pytest.approx(want.loc[k]) for k, v in found.items())
