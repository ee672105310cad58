"""How the passes of boosting are dealt out, and the array forms they use."""

import numpy as np
import pandas as pd

from quillpanel.operators import boosting
from quillpanel.sources.market import Scratch


def test_packed_dates_are_dealt_over_the_cores(spark):
    """A few bytes of many dates are not joined to one partition, or every pass would run in one task."""
    days = [d.date() for d in pd.date_range("2020-01-01", periods=60)]
    table = spark.createDataFrame(pd.DataFrame([(0, d, s, float(s), 1.0) for d in days for s in range(4)], columns=["fold", "date", "symbol", "a", "y"]))
    with Scratch(spark) as scratch:
        packed = boosting.pack(table, ["a"], "y", {0: [np.array([1.5])]}, 1, scratch)
        assert len(packed.inputFiles()) >= spark.sparkContext.defaultParallelism and packed.count() == 60


def test_a_node_by_columns_is_the_walk_row_by_row():
    rng = np.random.default_rng(3)
    tree = boosting.Tree.empty(3, 256)
    tree.feature[1:8], tree.limit[1:8] = rng.integers(0, 4, 7), [100, 50, 256, 200, 128, 30, 255]
    b = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    for levels in range(4):
        at = np.ones(len(b), np.int64)
        for _ in range(levels):
            at = at * 2 + (b[np.arange(len(b)), tree.feature[at]] > tree.limit[at])
        assert (tree.node(b, levels) == at).all() and (tree.node(b.astype(np.int64), levels) == at).all()


def test_a_level_is_one_job_of_one_stage(spark):
    """No shuffle, no table and no broadcast between levels: more rounds are `depth` more jobs each."""
    days = [d.date() for d in pd.date_range("2020-01-01", periods=12)]
    rng = np.random.default_rng(0)
    table = spark.createDataFrame(pd.DataFrame([(0, d, s, float(rng.normal()), float(rng.normal())) for d in days for s in range(20)], columns=["fold", "date", "symbol", "a", "y"]))
    context, jobs, stages = spark.sparkContext, {}, {}
    for rounds in (1, 4):
        context.setJobGroup(f"boosting-{rounds}", "")
        boosting.fit(table, {0: ["a"]}, "y", boosting.Settings(rounds=rounds, depth=2, keep=1))
        jobs[rounds] = context.statusTracker().getJobIdsForGroup(f"boosting-{rounds}")
        stages[rounds] = [len(context.statusTracker().getJobInfo(j).stageIds) for j in sorted(jobs[rounds])]
    context.setJobGroup("", "")
    assert len(jobs[4]) - len(jobs[1]) == 3 * 2
    assert sum(stages[4]) - sum(stages[1]) <= 2 * 3 * 2  # a stage before, which deals the rows, is skipped


def test_dates_are_dealt_out_by_their_rows(spark):
    """No task has more than one date above another, and none more rows than its share and the longest date."""
    days = [d.date() for d in pd.date_range("2020-01-01", periods=41)]
    table = spark.createDataFrame(pd.DataFrame([(0, d, s, float(s), 1.0) for k, d in enumerate(days) for s in range(1 + k % 9)], columns=["fold", "date", "symbol", "a", "y"]))
    with Scratch(spark) as scratch:
        rows = boosting.dealt(boosting.pack(table, ["a"], "y", {0: [np.array([1.5])]}, 1, scratch))
        parts = rows.map(lambda r: len(r[2])).glom().collect()
        rows.unpersist()
    lengths = [len(x) for x in parts]
    assert sum(lengths) == 41 and max(lengths) - min(lengths) <= 1 and max(map(sum, parts)) <= table.count() / len(parts) + 9


def test_gradients_in_runs_of_rows_are_those_of_the_whole_date():
    rng = np.random.default_rng(5)
    y, s = rng.uniform(0, 100, 700), np.round(rng.normal(size=700) * 40, 1)  # scores lie more than 50 apart
    order = np.argsort(-s, kind="stable")
    want, place = np.zeros((2, 700)), np.arange(700)
    ideal = (np.sort(y)[::-1] / np.log2(place + 2)).sum()
    for p in range(20):
        for q in range(p + 1, 700):
            i, j = order[p], order[q]
            sign = np.sign(y[i] - y[j])
            rho = 1 / (1 + np.exp(np.clip(sign * (s[i] - s[j]), -50, 50)))
            gain = abs((y[i] - y[j]) * (1 / np.log2(p + 2) - 1 / np.log2(q + 2))) / ideal
            want[:, i] += -sign * rho * gain, rho * (1 - rho) * gain
            want[:, j] += sign * rho * gain, rho * (1 - rho) * gain
    for run in (7, 512, 1000):
        made = boosting.ndcg_slopes(y, s, 20, boosting.ideal_gain(y), run)
        assert np.allclose(made, want, rtol=1e-9, atol=1e-14)
    assert [len(x) for x in boosting.ndcg_slopes(np.zeros(0), np.zeros(0), 20)] == [0, 0]


def test_a_step_of_the_recurrent_model_reads_its_own_batch(spark):
    from pyspark.sql import functions as F

    from quillpanel.operators import recurrent

    days = [d.date() for d in pd.date_range("2020-01-01", periods=40)]
    table = spark.createDataFrame(pd.DataFrame([(0, d, s, float(s), [[0.5]], 1.0) for d in days for s in range(4)], columns=["fold", "date", "symbol", "a", "_q", "_y"]))
    s = recurrent.Settings(length=1, batches=4)
    net = recurrent.Network.start(["a"], s.hidden, 1, np.zeros(1), np.ones(1), 0.0, 1.0)
    with Scratch(spark) as scratch:
        packed = recurrent.pack(table, {0: net}, 8, s, scratch)
        assert "PartitionFilters: [isnotnull(batch" in packed.where(F.col("batch") == 1)._jdf.queryExecution().toString()
        assert packed.where("chunk % 4 <> batch").count() == 0 and packed.agg(F.sum("n")).first()[0] == 160


def test_a_step_of_the_recurrent_model_is_one_job_of_one_stage(spark):
    """Rows are packed as single floats; an epoch more is a job more for each of its batches, without a shuffle."""
    from quillpanel.operators import recurrent

    days = [d.date() for d in pd.date_range("2020-01-01", periods=12)]
    rng = np.random.default_rng(0)
    table = spark.createDataFrame(pd.DataFrame([(0, d, s, float(rng.normal()), float(rng.normal())) for d in days for s in range(9)], columns=["fold", "date", "symbol", "a", "y"]))
    context, jobs, stages = spark.sparkContext, {}, {}
    for epochs in (1, 3):
        context.setJobGroup(f"recurrent-{epochs}", "")
        net = recurrent.fit(table, {0: ["a"]}, "y", recurrent.Settings(length=3, hidden=4, epochs=epochs, batches=2))[0]
        jobs[epochs] = context.statusTracker().getJobIdsForGroup(f"recurrent-{epochs}")
        stages[epochs] = sum(len(context.statusTracker().getJobInfo(j).stageIds) for j in jobs[epochs])
    context.setJobGroup("", "")
    assert len(jobs[3]) - len(jobs[1]) == stages[3] - stages[1] == 2 * 2
    known = recurrent.sequences(table, ["a"], 3).where("_q is not null").withColumn("_y", table["y"])
    with Scratch(spark) as scratch:
        rows = recurrent.pack(known, {0: net}, 2, recurrent.Settings(length=3, batches=2), scratch).collect()
    assert sum(r["n"] for r in rows) == 90 and all(len(r["x"]) == r["n"] * 3 * 4 and len(r["y"]) == r["n"] * 4 for r in rows)


def test_windows_of_predictions_equal_those_taken_by_hand(spark):
    """Also with values missing, and where a fold's short windows need its training rows."""
    from quillpanel.operators import recurrent

    rng = np.random.default_rng(2)
    days = [d.date() for d in pd.date_range("2020-01-01", periods=9)]
    table = pd.DataFrame([(f, d, s, rng.normal(), rng.normal()) for f in (0, 1) for d in days for s in range(5)], columns=["fold", "date", "symbol", "a", "b"])
    table.loc[rng.random(len(table)) < 0.1, "a"] = np.nan
    table = table[(table.fold == 0) | (table.symbol > 0) | (table.date == days[-1])]  # symbol 0 has one row in fold 1
    frame = spark.createDataFrame(table).selectExpr("cast(fold as int) fold", "date", "symbol", "nanvl(a, null) a", "b")
    nets = {f: recurrent.Network.start(["a", "b"], 6, f, np.array([0.1, -0.2]), np.array([1.5, 0.5]), 3.0, 2.0) for f in (0, 1)}
    late = frame["date"] >= days[7]
    made = recurrent.predict(frame.where(~late), frame.where(late), nets, {0: ["a", "b"], 1: ["a", "b"]}, recurrent.Settings(length=4)).toPandas()
    assert len(made) == 10 + 9 and set(made.columns) == {*table.columns, "pred_score"}
    for r in made.itertuples():
        rows = table[(table.fold == r.fold) & (table.symbol == r.symbol) & (table.date <= r.date)].sort_values("date").tail(4)
        if len(rows) == 4:
            x = nets[r.fold].scaled(rows[["a", "b"]].to_numpy()[None])
            assert abs(r.pred_score - (nets[r.fold].run(x)[0][0] * 2 + 3)) < 1e-5
        else:
            assert (r.fold, r.symbol) == (1, 0) and np.isfinite(r.pred_score) and r.pred_score != 0


def test_subtrees_of_a_long_date_are_held_for_a_run_of_rows():
    """Sums in runs are the sums of the whole date, and no call sees more rows than a run."""
    from quillpanel.operators import search

    x, y = np.random.default_rng(1).normal(size=(5000, 2)), np.random.default_rng(2).normal(size=5000)
    runs = list(search.slices(x, y))
    assert [len(a) for a, _ in runs] == [2048, 2048, 904] and np.concatenate([a for a, _ in runs]).tolist() == x.tolist() and np.concatenate([b for _, b in runs]).tolist() == y.tolist()
