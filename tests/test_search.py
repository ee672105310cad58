"""Symbolic search: values and metrics against plain ones, and a planted factor that is found."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import search
from quillpanel.sources.market import Scratch

TREES = [("add", 0, ("mul", 1, 2)), ("div", 0, ("sub", 1, 1)), ("sub", ("div", 2, 1), 0.25), 1, 0.5]


def rows(seed=1, dates=15, symbols=40):
    rng = np.random.default_rng(seed)
    table = pd.DataFrame({"date": np.repeat(pd.date_range("2020-01-01", periods=dates).date, symbols), "symbol": np.tile(np.arange(symbols), dates)})
    for c in "abc":
        table[c] = rng.normal(size=len(table))
    table["y"] = table.a * table.b - table.c + 0.05 * rng.normal(size=len(table))
    return table


def test_trees_as_arrays_and_columns(spark):
    table = rows()
    table.loc[3, "a"] = np.nan
    made = search.factors(spark.createDataFrame(table), TREES, ["a", "b", "c"]).orderBy("date", "symbol").toPandas()
    x = np.nan_to_num(table[["a", "b", "c"]].to_numpy())
    for i, t in enumerate(TREES):
        assert np.allclose(made[f"GP_Alpha_{i}"], search.value(t, x, {}))
    assert np.allclose(search.value(TREES[0], x, {}), x[:, 0] + x[:, 1] * x[:, 2]) and (search.value(TREES[1], x, {}) == 1).all()
    t = TREES[2]
    assert search.size(t) == 5 and [search.part(t, n) for n in range(5)] == [t, ("div", 2, 1), 2, 1, 0.25] and search.swapped(t, 3, 0) == ("sub", ("div", 2, 0), 0.25)


@pytest.mark.parametrize("metric", ["pearson", "rank_ic"])
def test_fitness_by_brute_force(spark, metric):
    table = rows(2)
    packed = search.pack(spark.createDataFrame(table).repartition(5), ["a", "b", "c"], "y", Scratch(spark))
    found = search.fitness(packed, TREES, 3, search.Settings(metric=metric, share=1.0))
    table["r"] = table.groupby("date").y.rank(pct=True) - 0.5
    x = table[["a", "b", "c"]].to_numpy()
    for t, f in zip(TREES, found, strict=True):
        v = table.assign(v=search.value(t, x, {}))
        with np.errstate(all="ignore"):
            c = v.v.corr(v.r) if metric == "pearson" else v.groupby("date")[["v", "r"]].apply(lambda d: d.v.rank().corr(d.r.rank())).mean()
        assert f == pytest.approx(0 if np.isnan(c) else abs(c), abs=1e-6)
    both = search.correlations(packed, TREES[:3], 3)
    assert np.allclose(np.corrcoef([search.value(t, x, {}) for t in (TREES[0], TREES[2])])[0, 1], both[0, 2]) and both[1, 1] == 0


def test_a_planted_factor_is_found(spark):
    train = spark.createDataFrame(rows(3))
    s = search.Settings(generations=8, population=250, components=3, fame=20, share=1.0, metric="rank_ic")
    trees = search.mine(train, ["a", "b", "c"], "y", s)
    assert len(trees) == 3 and trees == search.mine(train.repartition(6), ["a", "b", "c"], "y", s)
    other = rows(4)
    scores = search.fitness(search.pack(spark.createDataFrame(other), ["a", "b", "c"], "y", Scratch(spark)), trees, 3, s)
    assert scores.max() > 0.95
    assert search.factors(train.where(F.lit(False)), trees, ["a", "b", "c"]).count() == 0
