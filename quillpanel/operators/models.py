"""Ranking models behind one registry: fit(train, test, features, parameters) gives the test rows with pred_score. train and test have a column fold; features are named for each fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillpanel.functions import cs
from quillpanel.operators import boosting, lasso, recurrent

Features = dict[int, list[str]]
Fit = Callable[[DataFrame, DataFrame, Features, dict], DataFrame]


@dataclass(frozen=True)
class Model:
    fit: Fit
    target: str
    parameters: dict = field(default_factory=dict)


REGISTRY: dict[str, Model] = {}


def register(name: str, target: str, **parameters) -> Callable[[Fit], Fit]:
    def add(fit: Fit) -> Fit:
        REGISTRY[name] = Model(fit, target, parameters)
        return fit

    return add


def known(p: dict, kind: type) -> dict:
    """Those of the parameters that a settings class has."""
    return {k: v for k, v in p.items() if k in kind.__dataclass_fields__}


@register("boosted_mse", "target_magnitude")
def boosted_mse(train: DataFrame, test: DataFrame, features: Features, p: dict) -> DataFrame:
    """Boosted trees on squared error."""
    return boosting.predict(test, boosting.fit(train, features, p["target"], boosting.Settings(**(known(p, boosting.Settings) | {"loss": "squared"}))), features)


@register("ranked_trees", "target_magnitude")
def ranked_trees(train: DataFrame, test: DataFrame, features: Features, p: dict) -> DataFrame:
    """Boosted trees on the pairwise gradients of NDCG, date by date."""
    return boosting.predict(test, boosting.fit(train, features, p["target"], boosting.Settings(**(known(p, boosting.Settings) | {"loss": "ndcg"}))), features)


@register("linear", "target_magnitude", folds=5, penalties=100, span=1e-3)
def linear(train: DataFrame, test: DataFrame, features: Features, p: dict) -> DataFrame:
    """Lasso on standardised features; its penalty is chosen over contiguous blocks of rows from a log-spaced path below the largest useful one."""
    return lasso.predict(test, lasso.fit(train, features, p["target"], p["folds"], p["penalties"], p["span"]))


@register("recurrent_mse", "target_magnitude")
def recurrent_mse(train: DataFrame, test: DataFrame, features: Features, p: dict) -> DataFrame:
    """An LSTM on each symbol's last rows."""
    settings = recurrent.Settings(**known(p, recurrent.Settings))
    return recurrent.predict(train, test, recurrent.fit(train, features, p["target"], settings), features, settings)


@dataclass(frozen=True)
class Combination:
    """window: dates that weights are taken from, all earlier ones by default; lag: how far the last of them lies back; the gates of |IC| and |ICIR|; the most factors; the ridge penalty."""

    window: int | None = 40
    lag: int = 22
    ic_least: float = 0.02
    ir_least: float = 0.2
    most: int = 10
    penalty: float = 1.0


def centred_ranks(rows: pa.Table, k: int) -> np.ndarray:
    """Ranks of a date's last k columns, less a half."""
    return np.column_stack([cs.places(c.to_numpy(zero_copy_only=False).astype(float)) for c in rows.columns[-k:]]) - 0.5


def daily_sums(rows: DataFrame, names: list[str], target: str) -> DataFrame:
    """(fold, date, ic, xx, xy): each date's ICs, and the sums of products of centred ranks over its rows with a target, xx as the upper triangle."""
    k = len(names)
    upper = np.triu_indices(k)

    def run(day: pa.Table) -> pa.Table:
        x, y = np.split(centred_ranks(day, k + 1), [k], axis=1)
        known = ~np.isnan(y[:, 0])
        z = np.nan_to_num(x[known])
        values = ([cs.correlation(c, y[:, 0]) for c in x.T], (z.T @ z)[upper], z.T @ y[known, 0])
        return pa.table([*(day.column(c).slice(0, 1) for c in (0, 1)), *(pa.array([v], pa.list_(pa.float64())) for v in values)], names=["fold", "date", "ic", "xx", "xy"])

    narrow = rows.select("fold", "date", *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*names, target])))
    return narrow.groupBy("fold", "date").applyInArrow(run, f"fold {dict(rows.dtypes)['fold']}, date {dict(rows.dtypes)['date']}, ic array<double>, xx array<double>, xy array<double>")


def daily_weights(ic: np.ndarray, xx: np.ndarray, xy: np.ndarray, c: Combination) -> Iterator[np.ndarray]:
    """The factors' weights for each date in turn, from the dates up to c.lag before it."""
    k = ic.shape[1]
    upper = np.triu_indices(k)
    for t in range(len(ic)):
        end = t - c.lag + 1
        begin = 0 if c.window is None else max(0, end - c.window)
        w = np.zeros(k)
        if end > begin:
            part = ic[begin:end]
            n = (~np.isnan(part)).sum(axis=0)
            mean = np.divide(np.nansum(part, axis=0), n, out=np.zeros(k), where=n > 0)
            var = np.nansum((part - mean) ** 2, axis=0) / np.maximum(n - 1, 1)
            ir = np.where(n > 1, mean / (np.sqrt(var) + 1e-8), 0.0)
            enough = n >= max(1, (c.window or len(part)) // 2)
            chosen = [i for i in np.argsort(-np.abs(ir), kind="stable") if enough[i] and abs(mean[i]) >= c.ic_least and abs(ir[i]) >= c.ir_least][: c.most]
            if not chosen and enough.any():
                chosen = [int(np.argmax(np.where(enough, np.abs(ir), -1)))]
            if chosen:
                gram = np.zeros((k, k))
                gram[upper] = xx[begin:end].sum(axis=0)
                gram = np.triu(gram) + np.triu(gram, 1).T
                sign = np.where(mean[chosen] < 0, -1.0, 1.0)
                a = gram[np.ix_(chosen, chosen)] * np.outer(sign, sign) + c.penalty * np.eye(len(chosen))
                w[chosen] = sign * np.linalg.solve(a, sign * xy[begin:end].sum(axis=0)[chosen])
        yield w


def combine_folds(rows: DataFrame, wanted: DataFrame, features: Features, target: str, c: Combination) -> DataFrame:
    """Factors combined anew for each date of a fold (column fold) from the dates up to c.lag before it: gated by |IC| and |ICIR| (the single best if none passes), the
    strongest c.most of them, signs turned to positive, weighted by a ridge regression of centred ranks. wanted: whole dates of rows; they come back with pred_score.

    A date is ranked by one kernel, twice: once for the daily ICs and Gram sums, rows of a small table, and once, if it is wanted, for the scores. It must fit in a task.
    """
    names = list(dict.fromkeys(x for f in features.values() for x in f))
    k, types = len(names), dict(rows.dtypes)

    def solve(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date")
        mine = features[int(days["fold"].iloc[0])]
        at = np.array([names.index(x) for x in mine])
        ic, xx, xy = (np.array([[np.nan if v is None else v for v in r] for r in days[x]], float) for x in ("ic", "xx", "xy"))
        place = np.zeros((k, k), int)
        place[np.triu_indices(k)] = np.arange(k * (k + 1) // 2)
        place = np.maximum(place, place.T)
        i, j = np.triu_indices(len(at))
        out = np.zeros((len(days), k))
        for t, w in enumerate(daily_weights(ic[:, at], xx[:, place[at[i], at[j]]], xy[:, at], c)):
            out[t, at] = w
        return pd.DataFrame({"fold": days["fold"], "date": days["date"], "w": out.tolist()})

    weights = daily_sums(rows, names, target).groupBy("fold").applyInPandas(solve, f"fold {types['fold']}, date {types['date']}, w array<double>")

    def score(day: pa.Table, weight: pa.Table) -> pa.Table:
        if not day.num_rows:
            return day.drop_columns([f"_x{i}" for i in range(k)]).append_column("pred_score", pa.array([], pa.float64()))
        made = np.nan_to_num(centred_ranks(day, k)) @ np.array(weight.column("w")[0].as_py())
        return day.drop_columns([f"_x{i}" for i in range(k)]).append_column("pred_score", pa.array(made))

    schema = StructType([*wanted.schema.fields, StructField("pred_score", DoubleType())])
    kept = wanted.withColumns({f"_x{i}": F.col(x).cast("double") for i, x in enumerate(names)})
    return kept.groupBy("fold", "date").cogroup(weights.groupBy("fold", "date")).applyInArrow(score, schema)


def combine(panel: DataFrame, features: list[str], target: str, window: int | None = 40, lag: int = 22, ic_least: float = 0.02, ir_least: float = 0.2, most: int = 10, penalty: float = 1.0) -> DataFrame:
    """combine_folds() of one panel, all of whose dates are scored."""
    rows = panel.withColumn("fold", F.lit(0))
    return combine_folds(rows, rows, {0: features}, target, Combination(window, lag, ic_least, ir_least, most, penalty)).drop("fold")


@register("combined_factors", "next_1m_ret", window=40, lag=22)
def combined_factors(train: DataFrame, test: DataFrame, features: Features, p: dict) -> DataFrame:
    """combine_folds() over each fold's own dates, training and test together; positions are the fold's. Only dates with test rows are scored."""
    both = train.withColumn("_t", F.lit(0)).unionByName(test.withColumn("_t", F.lit(1)), allowMissingColumns=True).where(F.col("fold").isin(*features))
    days = test.select("fold", "date").distinct()
    made = combine_folds(both, both.join(F.broadcast(days), ["fold", "date"], "left_semi"), features, p["target"], Combination(**known(p, Combination)))
    return made.where("_t = 1").drop("_t")


def fit_predict_folds(name: str, train: DataFrame, test: DataFrame, features: Features, **parameters) -> DataFrame:
    """Both tables have a column fold, so a row may stand in several folds of train. All folds are fitted together; test rows come back with pred_score and their fold's qid."""
    model = REGISTRY[name]
    p = {"target": model.target} | model.parameters | parameters
    made = model.fit(train, test, features, p).drop("qid")
    days = test.select("fold", "date").distinct()  # of what came in: made would be computed once more
    days = days.withColumn("qid", (F.row_number().over(Window.partitionBy("fold").orderBy("date")) - 1).cast("int"))
    return made.join(F.broadcast(days), ["fold", "date"])


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: list[str], **parameters) -> DataFrame:
    return fit_predict_folds(name, train.withColumn("fold", F.lit(0)), test.withColumn("fold", F.lit(0)), {0: features}, **parameters).drop("fold")
