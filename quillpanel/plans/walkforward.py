"""Walk-forward validation, today's signal, and the choice of a parameter."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quillpanel.functions import cs
from quillpanel.operators import metrics, models, selection, simulation, statistics
from quillpanel.operators.features import fold_liquid
from quillpanel.operators.folds import Expanding, Rolling, Windows, assign, date_index, fold_table
from quillpanel.sources.market import saved


def choose_features(train: DataFrame, features: list[str], target: str, threshold: float | None = 0.02, prune_at: float | None = None, groups: list[list[str]] | None = None, ics: DataFrame | None = None) -> list[str]:
    """Features of enough |ICIR|, without the weaker of correlated pairs in a group. All of them if none is left. ics: train's daily ICs, where they are known."""
    ics = selection.daily_ic(train, features, target) if ics is None else ics
    kept, ir = selection.select_by_ics(ics, features, -1.0 if threshold is None else threshold)
    if prune_at is not None and len(kept) > 1:
        parts = [[c for c in g if c in kept] for g in (groups or [kept])]
        parts += [[c] for c in kept if not any(c in g for g in parts)]
        kept = selection.prune(ir, selection.correlations(train, kept), parts, prune_at)
    return kept or features


def walk_forward(
    panel: DataFrame, features: list[str], model: str, initial: int = 756, gap: int = 21, ratio: float = 0.8, expanding: bool = False, adtv_limit: float | None = None,
    threshold: float | None = None, prune_at: float | None = None, groups: list[list[str]] | None = None, ret: str = "next_1m_ret", k: int = 20, parallel: int = 4, **parameters,
) -> tuple[DataFrame, DataFrame]:
    """All folds' test rows with pred_score, qid and pred_quintile, and a row for each fold: fold_index, test_start, test_end, ndcg, precision, excess.

    The feature table is written once. Folds are chosen features for by a few driver threads, from daily ICs that are taken once for all folds, as a date has the same rows in each;
    they are fitted together: a model's passes go over the training rows of all folds.
    """
    windows: Windows = (Expanding if expanding else Rolling)(initial, gap, ratio)
    target = parameters.get("target", models.REGISTRY[model].target)
    panel = saved(panel, "walk-forward-panel")
    folds = fold_table(panel, windows).orderBy("fold").collect()
    if not folds:
        raise ValueError("the panel has too few dates for a fold")
    spark = panel.sparkSession
    table = spark.createDataFrame(folds, "fold int, train_lo date, train_hi date, test_lo date, test_hi date")
    both = assign(panel, table)
    if adtv_limit is not None:
        both = fold_liquid(both, adtv_limit)
    train, test = (both.where(F.col("part") == part).drop("part") for part in ("train", "test"))

    chosen = {r["fold"]: features for r in folds}
    if threshold is not None or prune_at is not None:
        rows = panel if adtv_limit is None else fold_liquid(panel, adtv_limit)
        ics = saved(selection.daily_ic(rows.where(F.col("date") <= F.lit(max(r["train_hi"] for r in folds))), features, target), "daily-ics")

        def used(r: Row) -> list[str]:
            return choose_features(train.where(F.col("fold") == r["fold"]), features, target, threshold, prune_at, groups, ics.where(F.col("date").between(r["train_lo"], r["train_hi"])))

        with ThreadPoolExecutor(parallel) as pool:
            chosen = dict(zip(chosen, pool.map(used, folds), strict=True))
    made = models.fit_predict_folds(model, train, test, chosen, **parameters)
    made = made.withColumn("pred_quintile", cs.bucket(F.col("symbol"), cs.even("pred_score"), 5, Window.partitionBy("fold", "date"))).withColumnRenamed("fold", "fold_index")
    made = saved(made, "predictions")
    return made, fold_scores(made, table, target, ret, k)


def fold_scores(made: DataFrame, folds: DataFrame, label: str, ret: str, k: int) -> DataFrame:
    """A row for each fold: its test dates and the means of its days' NDCG, precision and excess return. Test windows don't overlap, so a date tells its fold."""
    rows = made.where(F.col(label).isNotNull())
    days = made.select("date", "fold_index").distinct()
    out = folds.select(F.col("fold").alias("fold_index"), F.col("test_lo").alias("test_start"), F.col("test_hi").alias("test_end"))
    for daily, name in ((metrics.ndcg(rows, "pred_score", label), "ndcg"), (metrics.precision_at_k(rows, "pred_score", ret, k), "precision"), (metrics.topk_excess(rows, "pred_score", ret, k), "excess")):
        out = out.join(F.broadcast(daily.join(days, "date").groupBy("fold_index").agg(F.avg(name).alias(name))), "fold_index", "left")
    return out


def score(table: DataFrame, label: str, ret: str, k: int = 20) -> DataFrame:
    """One row: mean daily NDCG, precision of the k best, and their excess return."""
    rows = table.where(F.col(label).isNotNull())
    return metrics.ndcg(rows, "pred_score", label).agg(F.avg("ndcg").alias("ndcg")).join(metrics.precision_at_k(rows, "pred_score", ret, k).agg(F.avg("precision").alias("precision"))).join(metrics.topk_excess(rows, "pred_score", ret, k).agg(F.avg("excess").alias("excess")))


def signals(panel: DataFrame, today: DataFrame, held: DataFrame, features: list[str], model: str, dates: int = 735, buy: int = 20, trend: str | None = None, threshold: float = 0.0, **parameters) -> DataFrame:
    """(symbol, action, rank, live_score) from the last `dates` labelled dates: buy (the best, with the trend above its threshold, and not held), hold, sell (held, but
    not among the best), gone (held, without a row today); other ranked symbols have no action."""
    index = date_index(panel)
    first = index.orderBy(F.desc("i")).limit(dates).agg(F.min("date")).first()[0]
    made = models.fit_predict(model, panel.where(F.col("date") >= first), today, features, **parameters)
    placed = made.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("pred_score"), "symbol")))
    strong = F.coalesce(F.col(trend), F.lit(0.0)) > threshold if trend else F.lit(True)
    own = held.select("symbol", F.lit(True).alias("_held"))
    rows = placed.withColumn("_strong", strong).join(own, "symbol", "full_outer")
    best = F.col("rank") <= buy
    mine = F.coalesce("_held", F.lit(False))
    action = F.when(mine & F.col("rank").isNull(), "gone").when(mine & best, "hold").when(mine, "sell").when(best & F.col("_strong"), "buy")
    return rows.select("symbol", action.alias("action"), "rank", F.col("pred_score").alias("live_score"))


def actionable(signal: DataFrame) -> dict[str, list]:
    """Lists of symbols by action; a signal has a few hundred rows."""
    out: dict[str, list] = {"buy": [], "hold": [], "sell": [], "gone": []}
    for r in signal.where("action is not null").orderBy("rank").collect():
        out[r["action"]].append(r["symbol"])
    return out


def today_signals(signal: DataFrame, gate: DataFrame, top: int = 20) -> DataFrame:
    """signal_date, filter_active and the best symbols; only the date and the flag while the market filter is active."""
    best = signal.where("rank is not null").orderBy("rank").limit(top).select("rank", "symbol", "live_score")
    g = gate.select(F.col("date").cast("string").alias("signal_date"), "filter_active")
    return g.join(best.withColumn("_on", F.lit(True)), ~F.col("filter_active") & F.col("_on"), "left").drop("_on")


def plateau(values: DataFrame, level: float = 0.05) -> float:
    """values: (value, score, p_holm against the best). The lower middle of the values that are not significantly worse."""
    near = [r[0] for r in values.where((F.col("p_holm").isNull()) | (F.col("p_holm") >= level)).orderBy("value").select("value").collect()]
    return near[(len(near) - 1) // 2]


def select_value(panel: DataFrame, values: list[float], seeds: list[int], fit: Callable[[DataFrame, float, int], DataFrame], ret: str = "next_1m_ret", iterations: int = 1000, block: int = 21) -> tuple[float, DataFrame]:
    """A parameter's value by plateau: each value's seeds are averaged by rank, daily ICs are compared with the best value's, with Holm's correction."""
    from quillpanel.operators.joins import ensemble

    ics = {}
    for v in values:
        made = ensemble([fit(panel, v, s) for s in seeds])
        rows = made.join(panel.select("symbol", "date", ret), ["symbol", "date"])
        ics[v] = rows.select("date", cs.rank(F.round("pred_score", 10)).alias("a"), cs.rank(F.round(ret, 10)).alias("b")).groupBy("date").agg(selection.guarded_corr(F.col("a"), F.col("b")).alias("avg"))
        ics[v] = saved(ics[v], "daily-ic")
    means = {v: ics[v].agg(F.avg("avg")).first()[0] or 0.0 for v in values}
    best = max(values, key=lambda v: means[v])
    rest = {str(v): statistics.delta(ics[best], ics[v]) for v in values if v != best}
    spark = panel.sparkSession
    table = spark.createDataFrame([(float(v), float(means[v]), str(v)) for v in values], "value double, score double, comparison string")
    tested = statistics.analyse(rest, iterations=iterations, block=block).select("comparison", "p_value", "p_holm") if rest else None
    table = table.join(tested, "comparison", "left") if tested is not None else table.withColumn("p_holm", F.lit(None).cast("double"))
    return plateau(table), table


def backtest(panel: DataFrame, predictions: DataFrame, ks: list[int], rules: simulation.Rules | None = None, rank_weighted: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """One simulated scenario for each k. Prices and predictions must cover the same dates. entries: (date, symbol, multiplier) of what a buy order may spend."""
    panel, predictions = saved(panel.select("symbol", "date", "close"), "backtest-prices"), saved(predictions.select("symbol", "date", "pred_score"), "backtest-predictions")
    simulation.check_dates(panel, predictions)
    scenarios = None
    for k in ks:
        s = simulation.picks(predictions, k, rank_weighted=rank_weighted).withColumn("scenario", F.lit(f"top{k}"))
        scenarios = s if scenarios is None else scenarios.unionByName(s)
    multipliers = None if entries is None else entries.join(scenarios.select("scenario", "symbol").distinct(), "symbol").select("scenario", "date", "symbol", "multiplier")
    return simulation.simulate(panel, scenarios, rules, multipliers)
