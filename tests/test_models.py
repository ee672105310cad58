"""Boosted trees, lasso paths and the recurrent model against plain versions of themselves."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillpanel.operators import boosting, lasso, models, recurrent


def sample(seed=1, dates=12, symbols=25, noise=0.3):
    rng = np.random.default_rng(seed)
    rows = [(0, d, s) for d in range(dates) for s in range(symbols)]
    table = pd.DataFrame(rows, columns=["fold", "day", "symbol"])
    for c in "abc":
        table[c] = np.round(rng.normal(size=len(table)), 2)
    table["y"] = np.round(3 * (table.a > 0.3) + table.b * 1.5 + noise * rng.normal(size=len(table)), 3)
    table["date"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(table.day, "D")
    table["date"] = table["date"].dt.date
    return table.drop(columns="day")


def plain_tree(x, g, h, s, allowed):
    """Greedy splits of every node over all (feature, value) cuts, row by row; leaves by path."""
    def score(rows):
        a, b = sum(g[r] for r in rows), sum(h[r] for r in rows)
        return max(abs(a) - s.lasso, 0) ** 2 / (b + s.ridge)

    def grow(rows, level):
        if level == s.depth:
            a, b = sum(g[r] for r in rows), sum(h[r] for r in rows)
            return -math.copysign(max(abs(a) - s.lasso, 0), a) / (b + s.ridge) * s.rate
        best = None
        for f in allowed:
            for cut in sorted(set(x[rows, f]))[:-1]:
                left, right = [r for r in rows if x[r, f] <= cut], [r for r in rows if x[r, f] > cut]
                if min(sum(h[r] for r in left), sum(h[r] for r in right)) >= s.least:
                    gain = score(left) + score(right) - score(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                        best = gain, f, cut, left, right
        if best is None:
            return grow(rows, level + 1)
        return best[1], best[2], grow(best[3], level + 1), grow(best[4], level + 1)

    return grow(list(range(len(x))), 0)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("loss", ["squared", "ndcg"])
def test_boosting_by_brute_force(spark, loss):
    table = sample(dates=6, symbols=12)
    table["y"] = (table["y"] - table["y"].min()).round(3)
    s = boosting.Settings(loss=loss, rounds=4, depth=2, rate=0.3, rows=1.0, columns=1.0, ridge=0.5, lasso=0.1, least=0.2 if loss == "ndcg" else 3.0, keep=2)
    forest = boosting.fit(spark.createDataFrame(table), {0: ["a", "b", "c"]}, "y", s)[0]
    x, y = table[["a", "b", "c"]].to_numpy(), table["y"].to_numpy()
    margin = np.zeros(len(x))
    base = y.mean() if loss == "squared" else 0.0
    for _ in range(s.rounds):
        if loss == "squared":
            g, h = margin + base - y, np.ones(len(y))
        else:
            g, h = np.zeros(len(y)), np.zeros(len(y))
            for _, day in table.groupby("date"):
                at = day.sort_values("symbol").index.to_numpy()
                g[at], h[at] = boosting.ndcg_slopes(y[at], margin[at], s.pairs)
        tree = plain_tree(x, g, h, s, [0, 1, 2])
        margin += [walk(tree, r) for r in x]
    assert np.allclose(forest.predict(x), margin + base, atol=1e-5)
    assert np.corrcoef(forest.predict(x), y)[0, 1] > 0.6


def test_ndcg_slopes_are_the_pairs_sums():
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 9, 15).astype(float), np.round(rng.normal(size=15), 1)
    g, h = boosting.ndcg_slopes(y, s, 5)
    order = sorted(range(15), key=lambda i: -s[i])
    ideal = sum(v / math.log2(k + 2) for k, v in enumerate(sorted(y, reverse=True)))
    want = np.zeros((2, 15))
    for p in range(5):
        for q in range(p + 1, 15):
            i, j = order[p], order[q]
            if y[i] == y[j]:
                continue
            up, down = (i, j) if y[i] > y[j] else (j, i)
            rho = 1 / (1 + math.exp(s[up] - s[down]))
            gain = abs((y[i] - y[j]) * (1 / math.log2(p + 2) - 1 / math.log2(q + 2))) / ideal
            want[0, up] -= rho * gain
            want[0, down] += rho * gain
            want[1, [up, down]] += rho * (1 - rho) * gain
    assert np.allclose([g, h], want)


def test_boosting_does_not_follow_the_partitions(spark):
    table = sample(3)
    both = pd.concat([table, table[table.symbol < 15].assign(fold=1), table.iloc[:1].assign(fold=2, a=np.nan)])
    s = boosting.Settings(rounds=5, keep=2, bins=16)
    features = {0: ["a", "b", "c"], 1: ["b", "c"], 2: ["a"], 3: ["a"]}
    one, many = (boosting.fit(spark.createDataFrame(both).repartition(n), features, "y", s) for n in (1, 9))
    for f in (0, 1):
        for a, b in zip(one[f].trees, many[f].trees, strict=True):
            assert (a.feature == b.feature).all() and (a.limit == b.limit).all() and (a.value == b.value).all()
        assert len(one[f].trees) == 5
    assert all(t.feature.min() >= 1 or (t.limit[t.feature == 0] == 16).all() for t in one[1].trees)  # fold 1 may not use a
    made = boosting.predict(spark.createDataFrame(both.assign(fold=both.fold + 0)), one, features).toPandas()
    assert made.pred_score.notna().all() and np.corrcoef(made.pred_score[made.fold == 0], made.y[made.fold == 0])[0, 1] > 0.7


def test_boosting_samples_rows_and_columns():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 20_000)
    shares = [boosting.drawn(keys, n, 0.7).mean() for n in range(5)]
    assert all(abs(x - 0.7) < 0.02 for x in shares) and not (boosting.drawn(keys, 0, 0.7) == boosting.drawn(keys, 1, 0.7)).all() and boosting.drawn(keys, 3, 1.0).all()


def test_lasso_path_by_brute_force(spark):
    """LassoCV by its definition on the rows themselves: scaled by the whole spread, contiguous blocks of rows, centred training parts."""
    table = sample(5, dates=11, symbols=13, noise=3.0)
    table = pd.concat([table, table[table.symbol % 2 == 0].assign(fold=1)])
    names = ["a", "b", "c"]
    found = lasso.fit(spark.createDataFrame(table).repartition(5), {0: names, 1: ["a", "c"]}, "y", folds=5, penalties=20)

    def solve(x, y, penalty):
        """Proximal gradient steps on the rows."""
        w, step = np.zeros(x.shape[1]), 1 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
        for _ in range(5000):
            v = w - step * (x.T @ (x @ w - y) / len(x))
            w = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0)
        return w

    for f, mine in ((0, names), (1, ["a", "c"])):
        rows = table[table.fold == f].sort_values(["date", "symbol"])
        x, y = rows[mine].to_numpy(), rows["y"].to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        top = np.abs(z.T @ (y - y.mean())).max() / len(y)
        grid, errors = np.geomspace(top, top * 1e-3, 20), np.zeros(20)
        for block in np.array_split(np.arange(len(y)), 5):
            rest = np.setdiff1d(np.arange(len(y)), block)
            m, ym = z[rest].mean(axis=0), y[rest].mean()
            for i, p in enumerate(grid):
                w = solve(z[rest] - m, y[rest] - ym, p)
                errors[i] += ((y[block] - ym - (z[block] - m) @ w) ** 2).mean() / 5
        best = grid[int(np.argmin(errors))]
        w = solve(z, y - y.mean(), best)
        assert math.isclose(found[f].penalty, best, rel_tol=1e-6) and np.allclose(found[f].weights, w / x.std(axis=0), atol=1e-6)
        assert math.isclose(found[f].intercept, y.mean() - (w / x.std(axis=0)) @ x.mean(axis=0), abs_tol=1e-6)
    made = lasso.predict(spark.createDataFrame(table), found).toPandas()
    assert np.allclose(made[made.fold == 1].pred_score, made[made.fold == 1][["a", "c"]].to_numpy() @ found[1].weights + found[1].intercept)


def test_lasso_edges(spark):
    table = sample(6).assign(d=1.0)
    table.loc[table.index[:5], "a"] = np.nan
    table = spark.createDataFrame(table).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    lines = lasso.fit(table, {0: ["a", "d"], 7: ["a"]}, "y", folds=3, penalties=5)
    assert lines[0].weights[1] == 0 and lines[0].weights[0] > 0 and lines[7].weights.tolist() == [0]
    assert lasso.predict(table, lines).where("pred_score is null").count() == 5


def test_recurrent_slope_by_differences():
    rng = np.random.default_rng(0)
    net = recurrent.Network.start(["a", "b"], 3, 1, np.zeros(2), np.ones(2), 0.0, 1.0)
    x, y = rng.normal(size=(4, 5, 2)), rng.normal(size=4)
    slope = net.slope(x, y)
    for i in rng.choice(len(slope), 25, replace=False):
        losses = []
        for d in (1e-5, -1e-5):
            moved = recurrent.Network(net.flat.copy(), net.features, 3, net.mean, net.spread, 0.0, 1.0)
            moved.flat[i] += d
            losses.append(((moved.run(x)[0] - y) ** 2).sum() / 2)
        assert math.isclose(slope[i], (losses[0] - losses[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_recurrent_does_not_follow_the_partitions(spark):
    table = sample(7, dates=20, symbols=20, noise=0.1)
    both = pd.concat([table, table[table.symbol < 8].assign(fold=1)])
    s = recurrent.Settings(length=3, hidden=6, epochs=6, batches=3, rate=0.03, chunk=40)
    features = {0: ["a", "b"], 1: ["a", "b"]}
    one, many = (recurrent.fit(spark.createDataFrame(both).repartition(n), features, "y", s) for n in (1, 7))
    assert all((one[f].flat == many[f].flat).all() for f in (0, 1)) and not (one[0].flat == one[1].flat).all()
    last = both.date.max()
    train, test = (spark.createDataFrame(both[m]) for m in (both.date < last, both.date == last))
    short = spark.createDataFrame(both[both.date == last].head(1).assign(symbol=999))
    made = recurrent.predict(train, test.union(short), one, features, s).toPandas()
    assert len(made) == 20 + 8 + 1 and made.pred_score.notna().all() and np.corrcoef(made.pred_score[:28], made.y[:28])[0, 1] > 0.5
    assert recurrent.fit(train, features, "y", recurrent.Settings(length=50)) == {}


def test_one_fold_through_the_registry(spark):
    table = sample(8).drop(columns="fold")
    train, test = (spark.createDataFrame(table[m]) for m in (table.symbol < 20, table.symbol >= 20))
    for name, options in (("boosted_mse", {"rounds": 3}), ("ranked_trees", {"rounds": 3}), ("linear", {}), ("recurrent_mse", {"length": 2, "epochs": 1, "hidden": 4})):
        made = models.fit_predict(name, train, test, ["a", "b", "c"], target="y", **options)
        assert {"pred_score", "qid"} <= set(made.columns) and "fold" not in made.columns
        rows = made.select("qid", "pred_score").collect()
        assert len(rows) == 5 * 12 and sorted({r["qid"] for r in rows}) == list(range(12)) and all(r["pred_score"] is not None for r in rows)
