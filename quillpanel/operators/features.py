"""Features of a symbol's row at a date, from rows before it only. Windows share one exchange by symbol."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.functions import ewm, kernel, ts
from quillpanel.functions import rolling as w

RETURNS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}
VOLATILITIES = {"1w": 5, "1m": 21, "3m": 63, "6m": 126}
AVERAGES = (9, 21, 50, 100, 200)


def rescale_volume(panel: DataFrame) -> DataFrame:
    """Volume in adjusted shares where the panel has close_raw."""
    return panel.withColumn("volume", F.col("volume") * ts.ratio("close_raw", "close")) if "close_raw" in panel.columns else panel


def log_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"log_ret_{k}": ts.log_ratio(ts.delay("close", 1), ts.delay("close", n + 1)) for k, n in RETURNS.items()})


def volatilities(panel: DataFrame) -> DataFrame:
    out = panel.withColumn("_r", ts.log_ratio(ts.delay("close", 1), ts.delay("close", 2)))
    out = out.withColumns({f"volatility_{k}": ts.std("_r", n) * ts.YEAR for k, n in VOLATILITIES.items()})
    shocks = {"volatility_shock_monthly": ts.ratio("volatility_1m", "volatility_3m"), "volatility_shock_weekly": ts.ratio("volatility_1w", "volatility_1m")}
    return out.withColumns(shocks).drop("_r")


def simple_averages(panel: DataFrame) -> DataFrame:
    out = panel.withColumn("_c", ts.delay("close", 1))
    out = kernel.along(out, {f"SMA_{n}": ("_c", lambda x, n=n: w.mean(x, n)) for n in AVERAGES})  # a frame of 200 rows would be gone through again for each row
    return out.withColumns({f"dist_SMA_{n}": ts.ratio("_c", f"SMA_{n}") for n in AVERAGES}).drop("_c")


def exponential_features(panel: DataFrame) -> DataFrame:
    """EMA_n, dist_EMA_n and RSI_14 of the lagged close, in one kernel. Without losses RSI is 100, without moves NULL."""
    out = panel.withColumn("_c", ts.delay("close", 1)).withColumn("_d", ts.delta("_c", 1))
    out = out.withColumns({"_g": F.greatest("_d", F.lit(0.0)) + F.col("_d") * 0, "_l": F.greatest(-F.col("_d"), F.lit(0.0)) + F.col("_d") * 0})
    out = ewm.averages(out, {f"EMA_{n}": ("_c", ewm.span(n)) for n in AVERAGES} | {"_ag": ("_g", 1 / 14), "_al": ("_l", 1 / 14)})
    rsi = F.when((F.col("_al") == 0) & (F.col("_ag") > 0), 100.0).otherwise(100 - 100 / (1 + ts.ratio("_ag", "_al")))
    return out.withColumns({f"dist_EMA_{n}": ts.ratio("_c", f"EMA_{n}") for n in AVERAGES} | {"RSI_14": rsi}).drop("_c", "_d", "_g", "_l", "_ag", "_al")


def volume_features(panel: DataFrame) -> DataFrame:
    out = panel.withColumn("_v", ts.delay("volume", 1)).withColumns({"vol_5d": ts.mean("_v", 5), "vol_1m": ts.mean("_v", 21), "vol_3m": ts.mean("_v", 63)})
    return out.withColumns({"volume_surge_monthly": ts.ratio("vol_1m", "vol_3m"), "volume_surge_weekly": ts.ratio("vol_5d", "vol_1m")}).drop("_v")


def volume_quality(panel: DataFrame) -> DataFrame:
    """obv_trend and price_vol_divergence; needs vol_1m, volume_surge_monthly and log_ret_1m."""
    out = panel.withColumn("_s", F.signum(ts.delay("close", 1) - ts.delay("close", 2)) * ts.delay("volume", 1))
    return out.withColumns({"obv_trend": F.try_divide(ts.total("_s", 21), F.col("vol_1m")), "price_vol_divergence": F.col("log_ret_1m") / (F.col("volume_surge_monthly") + 0.001)}).drop("_s")


def price_structure(panel: DataFrame) -> DataFrame:
    out = panel.withColumn("_c", ts.delay("close", 1))
    return out.withColumns({"dist_52w_high": ts.ratio("_c", ts.highest("_c", 252)), "log_ret_skip1m": ts.log_ratio(ts.delay("close", 22), ts.delay("close", 127))}).drop("_c")


def turnover(panel: DataFrame, short: int = 252, long: int = 504) -> DataFrame:
    out = panel.withColumn("_v", ts.delay("volume", 1))
    return out.withColumn("turnover_12m", ts.mean("_v", short, short // 2) / (ts.mean("_v", long, long // 2) + 1)).drop("_v")


def limit_bias(panel: DataFrame, n: int = 60, move: float = 0.065) -> DataFrame:
    """Share of days near the upper price limit less that near the lower; a missing return is neither."""
    r = F.try_divide(ts.delay("close", 1), ts.delay("close", 2)) - 1
    out = panel.withColumn("_r", r)
    hit = {"_u": F.coalesce(F.col("_r") > move, F.lit(False)).cast("double"), "_d": F.coalesce(F.col("_r") < -move, F.lit(False)).cast("double")}
    return out.withColumns(hit).withColumn("limit_bias_60d", ts.mean("_u", n, n // 2) - ts.mean("_d", n, n // 2)).drop("_r", "_u", "_d")


def amihud(panel: DataFrame) -> DataFrame:
    r = F.try_divide(ts.delay("close", 1), ts.delay("close", 2)) - 1
    return panel.withColumn("_x", F.abs(r) / (ts.delay("volume", 1) + 1)).withColumn("amihud_illiquidity", F.log1p(ts.mean("_x", 21, 5))).drop("_x")


def adtv(panel: DataFrame) -> DataFrame:
    return panel.withColumn("_t", ts.delay(F.col("close") * F.col("volume"), 1)).withColumn("adtv", ts.mean("_t", 21, 10)).drop("_t")


def liquid(panel: DataFrame, limit: float | None) -> DataFrame:
    """is_liquid: adtv at the limit or above, a missing one is not; without a limit all rows are."""
    return panel.withColumn("is_liquid", F.lit(True) if limit is None else F.coalesce(F.col("adtv") >= limit, F.lit(False)))


def fold_liquid(panel: DataFrame, limit: float) -> DataFrame:
    """Rows of a fold with adtv at the limit or above; here a missing one stays."""
    return panel.where(F.col("adtv").isNull() | (F.col("adtv") >= limit))


def targets(panel: DataFrame) -> DataFrame:
    """Forward returns over 21 and 5 rows; rows without them go."""
    out = panel.withColumns({"next_1m_ret": ts.log_ratio(ts.ahead("close", 21), F.col("close")), "next_1w_ret": ts.log_ratio(ts.ahead("close", 5), F.col("close"))})
    return out.dropna(subset=["next_1m_ret", "next_1w_ret"])


def risk_adjusted(panel: DataFrame) -> DataFrame:
    return panel.withColumn("risk_adj_ret", ts.ratio("next_1m_ret", "volatility_3m"))


def daily_sigma(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("_r", ts.log_ratio(F.col("close"), ts.delay("close", 1))).withColumn("sigma_daily", ts.std("_r", n)).drop("_r")


def impact(panel: DataFrame, order: float, eta: float = 0.1, beta: float = 0.6) -> DataFrame:
    """Per symbol: mean daily sigma, mean volume, and the estimated price impact of an order; needs sigma_daily."""
    per = panel.groupBy("symbol").agg(F.avg("sigma_daily").alias("sigma"), F.avg("volume").alias("mean_volume"))
    return per.withColumn("impact", eta * F.col("sigma") * F.pow(F.lit(order) / F.col("mean_volume"), F.lit(beta)))


def ranker_rows(close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    """What a ranker needs of a symbol's rows, in one pass: some of the features, adtv, the forward returns and risk_adj_ret."""
    c, v, r = w.lag(close, 1), w.lag(volume, 1), w.log_ratio(w.lag(close, 1), w.lag(close, 2))
    month = w.mean(v, 21)
    out = {f"log_ret_{k}": w.log_ratio(c, w.lag(close, RETURNS[k] + 1)) for k in ("1w", "1m")} | {"volatility_1m": w.std(r, 21) * ts.YEAR}
    out |= {"volume_surge_weekly": w.ratio(w.mean(v, 5), month), "obv_trend": w.ratio(w.total(np.sign(c - w.lag(close, 2)) * v, 21), month), "adtv": w.mean(w.lag(close * volume, 1), 21, 10)}
    out |= {"next_1m_ret": w.log_ratio(w.lag(close, -21), close), "next_1w_ret": w.log_ratio(w.lag(close, -5), close)}
    return out | {"risk_adj_ret": w.ratio(out["next_1m_ret"], w.std(r, 63) * ts.YEAR)}


def of_symbol(bars: dict[str, np.ndarray], move: float = 0.065) -> dict[str, np.ndarray]:
    """All features of a symbol's own rows, as arrays of its bars: what log_returns() to adtv() give, for a kernel that computes all of them in one pass."""
    close, volume = bars["close"], bars["volume"]
    c, v = w.lag(close, 1), w.lag(volume, 1)
    before = w.lag(close, 2)
    out = {f"log_ret_{k}": w.log_ratio(c, w.lag(close, n + 1)) for k, n in RETURNS.items()}
    r = w.log_ratio(c, before)
    out |= {f"volatility_{k}": w.std(r, n) * ts.YEAR for k, n in VOLATILITIES.items()}
    out |= {"volatility_shock_monthly": w.ratio(out["volatility_1m"], out["volatility_3m"]), "volatility_shock_weekly": w.ratio(out["volatility_1w"], out["volatility_1m"])}
    out |= {f"SMA_{n}": w.mean(c, n) for n in AVERAGES}
    out |= {f"dist_SMA_{n}": w.ratio(c, out[f"SMA_{n}"]) for n in AVERAGES}
    d = w.delta(c, 1)
    gain, loss = (kernel.decayed(1 / 14)(np.maximum(x, 0.0)) for x in (d, -d))
    out |= {f"EMA_{n}": kernel.decayed(ewm.span(n))(c) for n in AVERAGES}
    out |= {f"dist_EMA_{n}": w.ratio(c, out[f"EMA_{n}"]) for n in AVERAGES}
    out["RSI_14"] = np.where((loss == 0) & (gain > 0), 100.0, 100 - 100 / (1 + w.ratio(gain, loss)))
    out |= {k: w.mean(v, n) for k, n in (("vol_5d", 5), ("vol_1m", 21), ("vol_3m", 63))}
    out |= {"volume_surge_monthly": w.ratio(out["vol_1m"], out["vol_3m"]), "volume_surge_weekly": w.ratio(out["vol_5d"], out["vol_1m"])}
    out["obv_trend"] = w.ratio(w.total(np.sign(c - before) * v, 21), out["vol_1m"])
    out["price_vol_divergence"] = out["log_ret_1m"] / (out["volume_surge_monthly"] + 0.001)
    out["turnover_12m"] = w.mean(v, 252, 126) / (w.mean(v, 504, 252) + 1)
    simple = w.ratio(c, before) - 1
    out["limit_bias_60d"] = w.mean((simple > move).astype(float), 60, 30) - w.mean((simple < -move).astype(float), 60, 30)
    out["amihud_illiquidity"] = np.log1p(w.mean(np.abs(simple) / (v + 1), 21, 5))
    out["adtv"] = w.mean(w.lag(close * volume, 1), 21, 10)
    return out
