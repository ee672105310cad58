"""Feature and alpha queries on the suppliers' random-walk panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.operators import alphas
from quillpanel.operators import features as f
from quillpanel.queries import sqltext as q
from quillpanel.registry import query
from quillpanel.sources.panels import shuffle_parts, walk_panel


def rounded(table: DataFrame, columns: list[str], digits: int | dict[str, int] = 6, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """digits: of all columns, or of each."""
    kinds, of = dict(table.dtypes), lambda c: digits[c] if isinstance(digits, dict) else digits
    return table.select(*keys, *((F.round(F.col(c) + 1.7e-9, of(c)) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def _feature(name: str, make: Callable[[DataFrame], DataFrame], columns: dict[str, str], stages: tuple = (), source: str = "panel", digits: int = 6) -> None:
    """A query of make(panel)'s columns, and its oracle: each column's SQL over `source`, after the stages."""
    body = ", ".join(q.rnd(sql, c, digits) for c, sql in columns.items())
    sql = "WITH " + ",\n".join([q.DAILY, *stages]) + f"\nSELECT symbol, date, {body} FROM {source}"
    query(name, sql)(lambda spark, sf_dir: rounded(make(walk_panel(spark, sf_dir)), list(columns), digits))


c1 = q.lag("close", 1)
_feature("log_returns", f.log_returns, {f"log_ret_{k}": q.lnr(c1, q.lag("close", n + 1)) for k, n in f.RETURNS.items()})
_r = f"r AS (SELECT *, {q.lnr(c1, q.lag('close', 2))} AS r FROM panel)"
_v = "v AS (SELECT *, " + ", ".join(f"{q.roll('stddev_samp', 'r', n)} * sqrt(252) AS volatility_{k}" for k, n in f.VOLATILITIES.items()) + " FROM r)"
_feature("rolling_volatility", f.volatilities, {**{f"volatility_{k}": f"volatility_{k}" for k in f.VOLATILITIES}, "volatility_shock_monthly": q.div("volatility_1m", "volatility_3m"), "volatility_shock_weekly": q.div("volatility_1w", "volatility_1m")}, (_r, _v), "v")
_lc = f"lc AS (SELECT *, {c1} AS c, {q.lag('volume', 1)} AS v FROM panel)"
_sma = "sma AS (SELECT *, " + ", ".join(f"{q.roll('avg', 'c', n)} AS SMA_{n}" for n in f.AVERAGES) + " FROM lc)"
_feature("sma_distance", f.simple_averages, {**{f"SMA_{n}": f"SMA_{n}" for n in f.AVERAGES}, **{f"dist_SMA_{n}": q.div("c", f"SMA_{n}") for n in f.AVERAGES}}, (_lc, _sma), "sma")
_vol = "vol AS (SELECT *, " + ", ".join(f"{q.roll('avg', 'v', n)} AS {k}" for k, n in (("vol_5d", 5), ("vol_1m", 21), ("vol_3m", 63))) + " FROM lc)"
_feature("volume_surge", f.volume_features, {"vol_5d": "vol_5d", "vol_1m": "vol_1m", "vol_3m": "vol_3m", "volume_surge_monthly": q.div("vol_1m", "vol_3m"), "volume_surge_weekly": q.div("vol_5d", "vol_1m")}, (_lc, _vol), "vol")
_obv = f"obv AS (SELECT *, sign(c - {q.lag('close', 2)}) * v AS s, {q.lnr('c', q.lag('close', 22))} AS lr FROM vol)"
_feature(
    "obv_trend", lambda p: f.volume_quality(f.volume_features(f.log_returns(p))),
    {"obv_trend": q.div(q.roll("sum", "s", 21), "vol_1m"), "price_vol_divergence": f"lr / ({q.div('vol_1m', 'vol_3m')} + 0.001)"}, (_lc, _vol, _obv), "obv",
)
_feature("price_structure", f.price_structure, {"dist_52w_high": q.div("c", q.roll("max", "c", 252)), "log_ret_skip1m": q.lnr(q.lag("close", 22), q.lag("close", 127))}, (_lc,), "lc")
_feature("turnover", f.turnover, {"turnover_12m": f"{q.roll('avg', 'v', 252, 126)} / ({q.roll('avg', 'v', 504, 252)} + 1)"}, (_lc,), "lc")
_ret = f"ret AS (SELECT *, {q.div(c1, q.lag('close', 2))} - 1 AS r FROM panel)"
_hits = "hits AS (SELECT *, CASE WHEN r > 0.001 THEN 1.0 ELSE 0.0 END AS u, CASE WHEN r < -0.001 THEN 1.0 ELSE 0.0 END AS d FROM ret)"
_feature("limit_bias", lambda p: f.limit_bias(p, move=0.001), {"limit_bias_60d": f"{q.roll('avg', 'u', 60, 30)} - {q.roll('avg', 'd', 60, 30)}"}, (_ret, _hits), "hits")
_am = f"am AS (SELECT *, abs(r) / ({q.lag('volume', 1)} + 1) AS x FROM ret)"
_feature("amihud", f.amihud, {"amihud_illiquidity": f"ln(1 + {q.roll('avg', 'x', 21, 5)})"}, (_ret, _am), "am", 9)
_tv = f"tv AS (SELECT *, {q.lag('close * volume', 1)} AS t FROM panel)"
_feature("adtv", f.adtv, {"adtv": q.roll("avg", "t", 21, 10)}, (_tv,), "tv", 4)
_feature("daily_sigma", f.daily_sigma, {"sigma_daily": q.roll("stddev_samp", "r", 20)}, (f"r AS (SELECT *, {q.lnr('close', q.lag('close', 1))} AS r FROM panel)",), "r")


@query("forward_targets", f"""WITH {q.DAILY}, t AS (SELECT symbol, date, {q.lnr(q.lead('close', 21), 'close')} AS a, {q.lnr(q.lead('close', 5), 'close')} AS b FROM panel)
SELECT symbol, date, {q.rnd('a', 'next_1m_ret')}, {q.rnd('b', 'next_1w_ret')} FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")  # fmt: skip
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.targets(walk_panel(spark, sf_dir)), ["next_1m_ret", "next_1w_ret"])


@query("price_impact", f"""WITH {q.DAILY}, r AS (SELECT *, {q.lnr('close', q.lag('close', 1))} AS r FROM panel), s AS (SELECT symbol, volume, {q.roll('stddev_samp', 'r', 20)} AS s FROM r)
SELECT symbol, {q.rnd('avg(s)', 'sigma')}, {q.rnd('avg(volume)', 'mean_volume')}, {q.rnd('0.1 * avg(s) * pow(1000 / avg(volume), 0.6)', 'impact')} FROM s GROUP BY symbol""")  # fmt: skip
def price_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.impact(f.daily_sigma(walk_panel(spark, sf_dir)), 1000.0), ["sigma", "mean_volume", "impact"], keys=("symbol",))


def _fold_sql(x: str, alpha: str) -> str:
    """The recursive average as a reduction of the list so far."""
    return f"list_reduce(list({x}) FILTER (({x}) IS NOT NULL) OVER ({q.S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda p, n: p * (1 - {alpha}) + n * {alpha})"


_gl = f"gl AS (SELECT *, CASE WHEN c - {q.lag('c', 1)} IS NOT NULL THEN greatest(c - {q.lag('c', 1)}, 0) END AS g, CASE WHEN c - {q.lag('c', 1)} IS NOT NULL THEN greatest({q.lag('c', 1)} - c, 0) END AS s FROM lc)"
_ew = "ew AS (SELECT *, " + ", ".join(f"{_fold_sql('c', f'(2.0 / {n + 1})')} AS EMA_{n}" for n in f.AVERAGES) + f", {_fold_sql('g', '(1.0 / 14)')} AS ag, {_fold_sql('s', '(1.0 / 14)')} AS al FROM gl)"
_feature(
    "ema_rsi", f.exponential_features,
    {**{f"EMA_{n}": f"EMA_{n}" for n in f.AVERAGES}, **{f"dist_EMA_{n}": q.div("c", f"EMA_{n}") for n in f.AVERAGES}, "RSI_14": "CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"},
    (_lc, _gl, _ew), "ew",
)

# Alphas: SQL of what each needs in the stages after the lagged bars.
_FIRST = {
    "dlr": f"ln(c) - {q.lag('ln(c)', 1)}", "r": f"{q.div('c', q.lag('c', 1))} - 1", "r21": q.lnr("c", q.lag("c", 21)), "r252": q.lnr("c", q.lag("c", 252)), "m20c": q.roll("avg", "c", 20),
    "m20v": q.roll("avg", "v", 20), "m20v10": q.roll("avg", "v", 20, 10), "m100c": q.roll("avg", "c", 100), "lnh": "ln(h)", "min21l": q.roll("min", "l", 21), "dc21": f"{q.lag('c', 21)} - c",
    "gap": q.lnr("o", q.lag("c", 1)), "x38": q.div("(c - l) - (h - c)", "h - l + 1e-8"), "park": f"pow({q.lnr('h', 'l')}, 2)",
}


def _mom(x: str) -> str:
    return f"({x} - {q.lag(x, 21)}) / (abs({q.lag(x, 21)}) + 0.001)"


R10 = lambda x: f"round({x}, 10)"
_SQL: dict[str, tuple[dict[str, str], list[str], str]] = {
    "002": ({"xa": f"ln(v + 1) - {q.lag('ln(v + 1)', 7)}", "xb": "(c - o) / (o + 0.001)"}, ["xa", "xb"], f"-({q.corr('R_xa', 'R_xb', 21)})"),
    "006": ({"y": q.corr("o", "v", 21)}, [], "-y"),
    "007": ({"y": q.rank_in("round(abs(r21), 10)", 60, 10)}, [], "CASE WHEN y IS NOT NULL THEN CASE WHEN v > m20v THEN -y * sign(r21) ELSE 0 END END"),
    "013": ({"xa": q.lnr("c", "m20c"), "xb": "ln((v + 1) / (m20v + 1))"}, ["xa", "xb"], "RANKED " + q.cov("R_xa", "R_xb", 21)),
    "016": ({"xa": q.lnr("h", "m20c"), "xb": "ln((v + 1) / (m20v + 1))"}, ["xa", "xb"], "RANKED " + q.cov("R_xa", "R_xb", 21)),
    "019": ({"xa": "r252"}, ["xa"], "-sign(r21) * (1 + R_xa)"),
    "024": ({"rise": f"(m100c - {q.lag('m100c', 100)}) / ({q.lag('c', 100)} + 0.001)", "lo": q.roll("min", "c", 100)}, [], f"CASE WHEN rise IS NOT NULL THEN CASE WHEN rise <= 0.05 THEN -{q.lnr('c', 'lo')} ELSE -r21 END END"),
    "028": ({"xa": q.corr("m20v", "l", 21), "xb": "ln((h + l) / 2 / c)"}, ["xa", "xb"], "R_xa + R_xb"),
    "035": ({"a": q.rank_in("v", 32), "b": q.rank_in("round(c + h - l, 10)", 16), "d": q.rank_in("round(dlr, 10)", 32)}, [], "a * (1 - b) * (1 - d)"),
    "039": ({"xa": q.roll("avg", "v / (m20v10 + 1)", 21, 10), "xb": "r252"}, ["xa", "xb"], "PRODUCT"),
    "040": ({"xa": q.roll("stddev_samp", "lnh", 21, 5), "y": q.corr("h", "v", 21)}, ["xa"], "-R_xa * y"),
    "043": ({"a": q.rank_in("round(v / (m20v + 1), 10)", 63), "b": q.rank_in("round(dc21, 10)", 63)}, [], "a * b"),
    "052": ({"xa": q.lnr(q.lag("c", 21), q.lag("c", 252)), "y": q.lnr(q.lag("min21l", 21), "min21l"), "t": q.rank_in("v", 21)}, ["xa"], "y * R_xa * t"),
    "055": ({"lo": q.roll("min", "l", 63, 30), "hi": q.roll("max", "h", 63, 30)}, ["(c - lo) / (hi - lo + 1e-8)", "v"], "-(" + q.corr("R_0", "R_1", 21) + ")"),
    "102": ({"y": f"ln(c) - 2 * ln({q.lag('c', 21)}) + ln({q.lag('c', 42)})"}, [], "y"),
    "103": ({"y": q.roll("max", "c", 252, 60)}, [], "c / (y + 0.001) - 1"),
    "104": ({}, ["MKT"], f"-({q.cov('r', 'mkt', 60, 20)}) / (CASE WHEN count(mkt) {q.frame(60)} >= 20 THEN var_samp(mkt) {q.frame(60)} END + 1e-8)"),
    "105": ({"y": q.lnr(q.lag("c", 21), q.lag("c", 252))}, [], "y"),
    "110": ({"y": q.roll("max", "dlr", 21)}, [], "-y"),
    "111": ({"y": q.roll("skewness", "dlr", 63)}, [], "-y"),
    "112": ({"y": q.lnr(q.lag("c", 126), q.lag("c", 252))}, [], "y"),
    "113": ({"y": q.lnr(q.lag("c", 21), q.lag("c", 126)), "s": q.roll("stddev_samp", "dlr", 126, 63)}, [], "y / (s * sqrt(105) + 1e-8)"),
    "114": ({"a": f"CASE WHEN count(r) {q.frame(252)} >= 126 THEN avg(CASE WHEN r < 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) {q.frame(252)} END", "b": f"CASE WHEN count(r) {q.frame(252)} >= 126 THEN avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) {q.frame(252)} END"}, [], "-sign(r252) * (a - b)"),
    "115": ({"y": q.roll("avg", "gap", 21, 10)}, [], "y"),
    "116": ({"y": q.roll("avg", "x38", 21, 10)}, [], "y"),
    "117": ({"a": q.roll("avg", "v", 21, 10), "b": q.roll("avg", "v", 252, 126)}, [], "ln((a + 1) / (b + 1))"),
    "118": ({"y": q.roll("avg", "park", 21, 10)}, [], "-sqrt(y / (4 * ln(2)))"),
    "201": ({"a": _mom("c"), "b": _mom("v")}, [], "a * b"),
    "202": ({}, ["MKT"], f"{q.roll('sum', 'r - mkt', 252, 60)} - ({q.roll('sum', 'r - mkt', 21, 10)})"),
}


def _alpha_sql(name: str, exact: bool = False) -> str:
    second, ranks, final = _SQL[name]
    every = " ".join([*second.values(), *ranks, final]) + (" r" if "MKT" in ranks else "") + (" r21" if final == "PRODUCT" else "")
    first = "".join(f", {sql} AS {k}" for k, sql in _FIRST.items() if q.uses(every, k))
    stages = [q.DAILY, f"b0 AS (SELECT symbol, date, {q.lag('open', 1)} AS o, {q.lag('high', 1)} AS h, {q.lag('low', 1)} AS l, {q.lag('close', 1)} AS c, {q.lag('volume', 1)} AS v FROM panel)", f"b1 AS (SELECT *{first} FROM b0)"]
    stages.append("b2 AS (SELECT *" + "".join(f", {sql} AS {k}" for k, sql in second.items()) + " FROM b1)")
    named = [x if x in second else f"{i}" for i, x in enumerate(ranks)]
    stages.append("b3 AS (SELECT *" + "".join(f", avg(r) OVER (PARTITION BY date) AS mkt" if x == "MKT" else f", {q.day_rank(R10(x))} AS R_{n}" for x, n in zip(ranks, named, strict=True)) + " FROM b2)")
    value = final
    if final == "PRODUCT":
        stages += [f"b4 AS (SELECT *, {q.day_rank(R10('r21 * (1 - R_xa)'))} AS R_p FROM b3)"]
        value = "-R_p * (1 + R_xb)"
    elif final.startswith("RANKED "):
        stages += [f"b3b AS (SELECT *, {final[7:]} AS y FROM b3)", f"b4 AS (SELECT *, {q.day_rank(R10('y'))} AS R_y FROM b3b)"]
        value = "-R_y"
    else:
        stages += ["b4 AS (SELECT * FROM b3)"]
    return "WITH " + ",\n".join(stages) + f"\nSELECT symbol, date, {f'{value} AS alpha' if exact else q.rnd(value, 'alpha')} FROM b4"


def _alpha(name: str) -> None:
    query(f"alpha_{name}", _alpha_sql(name))(lambda spark, sf_dir: rounded(alphas.generate(walk_panel(spark, sf_dir), [name], "").withColumnRenamed(name, "alpha"), ["alpha"]))


for _name in [*alphas.DEFAULT, *alphas.OPTIONAL]:
    _alpha(_name)


_CATALOGUE = "WITH " + ",\n".join(f"a{n} AS ({_alpha_sql(n)})" for n in alphas.DEFAULT) + "\nSELECT symbol, date, " + ", ".join(f"a{n}.alpha AS WQ_Alpha_{n}" for n in alphas.DEFAULT)
_CATALOGUE += f" FROM a{alphas.DEFAULT[0]}" + "".join(f" JOIN a{n} USING (symbol, date)" for n in alphas.DEFAULT[1:])


@query("alpha_catalogue", _CATALOGUE)
def alpha_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default alphas together."""
    table = alphas.generate(walk_panel(spark, sf_dir, parts=shuffle_parts(spark)), digits=6, shift=1.7e-9)  # as rounded() does
    return rounded(table, [c for c in table.columns if c.startswith("WQ_Alpha_")])
