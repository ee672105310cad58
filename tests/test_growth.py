"""What keeps a query's time and memory from growing faster than its tables: what is made once, what is shuffled, how many tasks there are."""

import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it registers the queries
from quillpanel.functions import cs
from quillpanel.operators import features as f
from quillpanel.operators import joins, labels, lasso, models, selection
from quillpanel.plans import walkforward
from quillpanel.queries import iterative
from quillpanel.registry import QUERIES
from quillpanel.sources.panels import walk_panel


def plan(table) -> str:
    return table._jdf.queryExecution().executedPlan().toString()


def test_weekly_makes_its_columns_once(spark, sf):
    table = iterative.weekly(spark, sf)
    assert "lineitem" not in table._jdf.queryExecution().toString() and "percentile" not in plan(table)


def test_weekly_equals_the_column_functions(spark):
    sf = "/root/testdata/sf0.01"
    panel = walk_panel(spark, sf, weekly=True)
    table = f.adtv(f.volume_quality(f.volume_features(f.volatilities(f.log_returns(panel)))))
    table = labels.magnitude(f.risk_adjusted(f.targets(table)))
    made = iterative.weekly(spark, sf)
    expected = table.select(*made.columns).dropna().orderBy("symbol", "date").toPandas()
    made = made.orderBy("symbol", "date").toPandas()
    assert len(made) == len(expected) > 10_000
    for c in made.columns[2:]:
        assert made[c].to_numpy() == pytest.approx(expected[c].to_numpy(), rel=1e-9, abs=1e-9), c


def sample(spark, folds=2, dates=30, symbols=20, seed=0):
    """Rows with ties and gaps, in each of the folds."""
    rng = np.random.default_rng(seed)
    rows = [(k, s, date(2020, 1, 1) + timedelta(d)) for k in range(folds) for d in range(dates) for s in range(symbols)]
    table = pd.DataFrame(rows, columns=["fold", "symbol", "date"])
    for c in ("a", "b", "y"):
        table[c] = np.round(rng.normal(size=len(table)), 1)
        table.loc[rng.random(len(table)) < 0.1, c] = np.nan
    frame = spark.createDataFrame(table)
    return frame.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("a", "b", "y")})


def test_places_equal_the_rank_column(spark):
    table = sample(spark, folds=1).withColumn("r", cs.rank(F.round("a", 10))).toPandas()
    for _, day in table.groupby("date"):
        assert cs.places(day["a"].to_numpy(float)) == pytest.approx(day["r"].to_numpy(float), nan_ok=True)
    assert cs.correlation(np.array([1.0, 1, np.nan]), np.array([1.0, 2, 3])) is None and np.isnan(cs.places(np.array([np.nan]))).all()


def test_daily_ics_are_no_windows(spark):
    table = sample(spark, folds=1)
    ics = selection.daily_ic(table, ["a", "b"], "y")
    assert "Window" not in plan(ics)
    ranks = table.select("date", *(cs.rank(F.round(c, 10)).alias(c) for c in ("a", "b", "y")))
    expected = ranks.groupBy("date").agg(*(selection.guarded_corr(F.col(c), F.col("y")).alias(f"ic_{c}") for c in "ab")).orderBy("date").toPandas()
    made = ics.orderBy("date").toPandas()
    assert made["ic_a"].to_numpy() == pytest.approx(expected["ic_a"].to_numpy()) and made["ic_b"].to_numpy() == pytest.approx(expected["ic_b"].to_numpy())


def test_folds_share_their_daily_ics(spark, sf, monkeypatch):
    """The folds' ICs come from one pass, and are those of each fold's own rows."""
    calls, own = [], selection.daily_ic
    monkeypatch.setattr(selection, "daily_ic", lambda *a: calls.append(a) or own(*a))
    found, choose = {}, walkforward.choose_features

    def compared(train, names, target, threshold, prune_at, groups, ics):
        mine = choose(train, names, target, threshold, prune_at, groups, ics)
        found[train.agg(F.min("fold")).first()[0]] = (mine, choose(train, names, target, threshold, prune_at, groups, own(train, names, target)))
        return mine

    monkeypatch.setattr(walkforward, "choose_features", compared)
    walkforward.walk_forward(iterative.weekly(spark, sf), iterative.FEATURES, "linear", initial=60, gap=4, ratio=0.6, k=3, penalties=2, folds=2, threshold=0.02, prune_at=0.75, adtv_limit=100.0)
    assert len(calls) == 1 and len(found) > 2 and all(a == b for a, b in found.values())


def test_blocks_sort_only_dates_that_are_cut(spark):
    table = sample(spark).where("fold = 0 or symbol < 7")
    made = lasso.blocks(table, "y", 7)
    assert made.columns == [*table.columns, "block"]
    rows = made.toPandas()
    for _, part in rows.groupby("fold"):
        part = part.sort_values(["date", "symbol"])
        assert part["block"].tolist() == [i for i, x in enumerate(np.array_split(np.arange(len(part)), 7)) for _ in x]
    text = made._jdf.queryExecution().optimizedPlan().toString()
    cut = text[: text.index("Window [row_number")]
    assert "Union" in cut  # all other rows stand beside the window, not below it


def test_rank_correlations_with_frequent_values(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(4000, 3)), 2)
    x[:2500, 0], x[rng.random(4000) < 0.3, 1], x[:, 2] = 1.5, -0.0, np.round(x[:, 2] + x[:, 0], 2)
    made = selection.spearman_matrix(spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(5), list("abc"))
    expected = pd.DataFrame(x, columns=list("abc")).corr(method="spearman")
    rows = made.collect()
    assert len(rows) == 3 and all(r["rho"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-12) for r in rows)


def test_a_value_that_fills_a_range_has_one_of_its_own():
    borders, alone = selection.value_ranges([1.0, 2.0, 2.0, 2.0, 3.0])
    at = np.searchsorted(borders, [0.5, 1.0, 2.0, 2.5, 3.0], side="right")
    assert alone[at].tolist() == [False, False, True, False, False] and len(set(at.tolist())) == 5 and selection.value_ranges([])[1].tolist() == [False]


def test_combined_folds_are_ranked_together(spark):
    """All folds in one plan, no window but the count of dates; each fold equals the combination of its own rows."""
    table = sample(spark, dates=40)
    last = F.col("date") > F.lit(date(2020, 1, 25))
    train, test = table.where(~last), table.where(last)
    made = models.fit_predict_folds("combined_factors", train, test, {0: ["a", "b"], 1: ["b"]}, target="y", window=10, lag=3)
    text = plan(made)
    assert text.count("Window [") == 1 and text.count("FlatMapCoGroupsInArrow") == 1
    for fold, names in ((0, ["a", "b"]), (1, ["b"])):
        own = models.combine(table.where(F.col("fold") == fold).drop("fold"), names, "y", window=10, lag=3).where(last).orderBy("date", "symbol").toPandas()
        rows = made.where(F.col("fold") == fold).orderBy("date", "symbol").toPandas()
        assert len(rows) == len(own) == 300 and rows["pred_score"].to_numpy() == pytest.approx(own["pred_score"].to_numpy(), abs=1e-12) and rows["pred_score"].abs().max() > 0


def test_ensemble_tasks_do_not_grow_to_a_size(spark, sf):
    """Two exchanges, by symbol and by date, each with a given number of tasks; lines are read once."""
    text = QUERIES["ensemble_ranks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)#.*?(\w+), \[plan_id", text) == [("date", "REPARTITION_BY_NUM"), ("symbol", "REPARTITION_BY_NUM")]
    assert text.count("Scan parquet") == 1


def test_ensemble_of_columns_equals_that_of_tables(spark):
    table = sample(spark, folds=1).drop("fold")
    one = joins.ensemble_columns(table, ["a", "b"]).orderBy("date", "symbol").toPandas()
    many = joins.ensemble([table.withColumn("pred_score", F.col(c)) for c in "ab"]).orderBy("date", "symbol").toPandas()
    assert one["pred_score"].to_numpy(float) == pytest.approx(many["pred_score"].to_numpy(float), nan_ok=True) and one["pred_score"].isna().any()
