"""The whole feature table, upserts by partition, importances and the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpanel.functions import kernel
from quillpanel.operators import alphas, selection, statistics
from quillpanel.operators import features as f
from quillpanel.plans import build, walkforward
from quillpanel.queries import features as fq
from quillpanel.queries import sqltext as q
from quillpanel.queries.features import rounded
from quillpanel.queries.relational import _ACF, _MOM, _NEW, _OLD, _PLACED, R, _corr, _ema, _hash, delta, flat, scored
from quillpanel.registry import ORACLES, QUERIES, query
from quillpanel.sources import market, partitions, vendor
from quillpanel.sources.panels import walk_panel
from quillpanel.streaming import ingest, state

# The feature table: all features, all default alphas, labels and market columns, full windows, fifty symbols a date.

_HITS = "hits AS (SELECT *, CASE WHEN r > 0.065 THEN 1.0 ELSE 0.0 END AS u, CASE WHEN r < -0.065 THEN 1.0 ELSE 0.0 END AS d FROM ret)"
_PRICE = {
    "lret": ("panel", {f"log_ret_{k}": q.lnr(fq.c1, q.lag("close", n + 1)) for k, n in f.RETURNS.items()}),
    "vols": ("v", {**{f"volatility_{k}": f"volatility_{k}" for k in f.VOLATILITIES}, "volatility_shock_monthly": q.div("volatility_1m", "volatility_3m"), "volatility_shock_weekly": q.div("volatility_1w", "volatility_1m")}),
    "smas": ("sma", {**{f"SMA_{n}": f"SMA_{n}" for n in f.AVERAGES}, **{f"dist_SMA_{n}": q.div("c", f"SMA_{n}") for n in f.AVERAGES}}),
    "emas": ("ew", {**{f"EMA_{n}": f"EMA_{n}" for n in f.AVERAGES}, **{f"dist_EMA_{n}": q.div("c", f"EMA_{n}") for n in f.AVERAGES}, "RSI_14": "CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"}),
    "surge": ("vol", {"vol_5d": "vol_5d", "vol_1m": "vol_1m", "vol_3m": "vol_3m", "volume_surge_monthly": q.div("vol_1m", "vol_3m"), "volume_surge_weekly": q.div("vol_5d", "vol_1m")}),
    "qual": ("obv", {"obv_trend": q.div(q.roll("sum", "s", 21), "vol_1m"), "price_vol_divergence": f"lr / ({q.div('vol_1m', 'vol_3m')} + 0.001)"}),
    "turn": ("lc", {"turnover_12m": f"{q.roll('avg', 'v', 252, 126)} / ({q.roll('avg', 'v', 504, 252)} + 1)"}),
    "lim": ("hits", {"limit_bias_60d": f"{q.roll('avg', 'u', 60, 30)} - {q.roll('avg', 'd', 60, 30)}"}),
    "ami": ("am", {"amihud_illiquidity": f"ln(1 + {q.roll('avg', 'x', 21, 5)})"}),
    "adt": ("tv", {"adtv": q.roll("avg", "t", 21, 10)}),
}
_FEATURES = [c for _, columns in _PRICE.values() for c in columns]


def _day(n: int) -> str:
    return f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _features_sql(least: int) -> str:
    """Stages on the whole panel; then `trimmed`, without rows that lack a target, is what alphas, labels and market columns see."""
    full = q.WEEKLY
    stages = [fq._r, fq._v, fq._lc, fq._sma, fq._vol, fq._obv, fq._gl, fq._ew, fq._ret, _HITS, fq._am, fq._tv]
    parts = [f"{name} AS (SELECT symbol, date, {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {source})" for name, (source, columns) in _PRICE.items()]
    trimmed = f"trimmed AS (SELECT * FROM (SELECT *, {q.lnr(q.lead('close', 21), 'close')} AS next_1m_ret, {q.lnr(q.lead('close', 5), 'close')} AS next_1w_ret FROM panel) WHERE next_1m_ret IS NOT NULL AND next_1w_ret IS NOT NULL)"
    cut = f"{full.replace('panel AS (', 'whole AS (')}, {trimmed.replace('FROM panel', 'FROM whole')}, panel AS (SELECT symbol, date, open, high, low, close, volume FROM trimmed)"
    each = [f"al{n} AS ({fq._alpha_sql(n, exact=True).replace(q.DAILY, cut)})" for n in alphas.DEFAULT]
    joined = "base AS (SELECT trimmed.*, " + ", ".join(_FEATURES) + " FROM trimmed" + "".join(f" JOIN {name} USING (symbol, date)" for name in _PRICE) + ")"
    risk = f"risk AS (SELECT *, {q.div('next_1m_ret', 'volatility_3m')} AS risk_adj_ret FROM base), edge AS (SELECT date, min(risk_adj_ret) AS lo, max(risk_adj_ret) AS hi FROM risk GROUP BY date)"
    label = "labelled AS (SELECT risk.*, CASE WHEN risk_adj_ret IS NOT NULL AND hi > lo THEN (risk_adj_ret - lo) / (hi - lo) * 100 END AS target_magnitude FROM risk JOIN edge USING (date))"
    regime = f"""m0 AS (SELECT symbol, date, {q.div('close', q.lag('close', 21))} - 1 AS m FROM base), m1 AS (SELECT symbol, date, {q.lag('m', 1)} AS m FROM m0), mid AS (SELECT date, median(m) AS mid FROM m1 GROUP BY date),
mad AS (SELECT date, median(abs(m - mid)) AS mad FROM m1 JOIN mid USING (date) GROUP BY date), sm AS (SELECT date, round(CASE WHEN count(mad) {_day(63)} >= 31 THEN avg(mad) {_day(63)} END, 10) AS x FROM mad),
hist AS (SELECT date, x, list(x) FILTER (x IS NOT NULL) {_day(252)} AS l FROM sm), rk AS (SELECT date, x, CASE WHEN x IS NOT NULL AND len(l) >= 252 THEN (len(list_filter(l, lambda y: y < x)) + (len(list_filter(l, lambda y: y = x)) + 1) / 2.0) / len(l) END AS rk FROM hist),
dn AS (SELECT date, avg(log_ret_3m) AS a3, avg(log_ret_1m) AS a1, avg(CASE WHEN log_ret_1m > 0 THEN 1.0 WHEN log_ret_1m IS NOT NULL THEN 0.0 END) AS up, row_number() OVER (ORDER BY date) AS i FROM base GROUP BY date),
em AS (SELECT date, {_ema('a3', 63)} AS market3m_ema63, {_ema('a1', 21)} AS market1m_ema21, {_ema('up', 21)} AS breadth_ema21 FROM dn), eb AS (SELECT *, lag(breadth_ema21) OVER (ORDER BY date) AS pb FROM em),
low AS (SELECT *, CASE WHEN count(pb) {_day(252)} >= 126 THEN quantile_cont(pb, 0.25) {_day(252)} END AS low FROM eb),
days AS (SELECT date, x AS regime_mad, rk AS regime_rank, CASE WHEN rk <= 0.25 THEN 'Q1' WHEN rk <= 0.5 THEN 'Q2' WHEN rk <= 0.75 THEN 'Q3' WHEN rk <= 1 THEN 'Q4' END AS regime_bucket, market3m_ema63, market1m_ema21, breadth_ema21, coalesce(breadth_ema21 < low, false) AS narrow_breadth FROM rk JOIN low USING (date))"""
    every = "every AS (SELECT labelled.*, " + ", ".join(f"al{n}.alpha AS WQ_Alpha_{n}" for n in alphas.DEFAULT) + ", days.* EXCLUDE (date) FROM labelled" + "".join(f" JOIN al{n} USING (symbol, date)" for n in alphas.DEFAULT) + " JOIN days USING (date))"
    gates = [*_FEATURES, *(f"WQ_Alpha_{n}" for n in alphas.DEFAULT), "regime_mad", "regime_rank", "regime_bucket", "market3m_ema63", "market1m_ema21", "breadth_ema21"]
    kept = f"kept AS (SELECT * FROM every WHERE {' AND '.join(f'{c} IS NOT NULL' for c in gates)})"
    shown = [R(c, c, 5) if c not in ("regime_bucket",) else c for c in gates] + ["narrow_breadth", R("next_1m_ret", "next_1m_ret", 5), R("next_1w_ret", "next_1w_ret", 5), R("risk_adj_ret", "risk_adj_ret", 5), R("target_magnitude", "target_magnitude", 4)]
    return f"WITH {full}, " + ",\n".join([*stages, *parts, trimmed, *each, joined, risk, label, regime, every, kept]) + f"\nSELECT symbol, date, {', '.join(shown)} FROM kept QUALIFY count(*) OVER (PARTITION BY date) >= {least}"


@query("build_features", _features_sql(50))
def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the weekly panel, where a date has fifty symbols or more from sf0.01 on."""
    table = build.build_features(walk_panel(spark, sf_dir, weekly=True), least_per_date=50)
    shown = [c for c in table.columns if c not in ("symbol", "date", *market.BARS, "is_liquid")]
    return rounded(table, shown, {c: 4 if c == "target_magnitude" else 5 for c in shown})


# Storage


_CLOSES = f"""WITH {q.DAILY}, old AS (SELECT *, close * 2 AS close_raw FROM panel WHERE {_OLD}), new AS (SELECT symbol, date, volume, close + 1 AS close, close * 3 AS close_raw FROM panel WHERE {_NEW}),
fresh AS (SELECT n.symbol, n.date, n.close, coalesce(o.close_raw, n.close_raw) AS close_raw FROM new n LEFT JOIN old o USING (symbol, date)),
every AS (SELECT symbol, date, close, close_raw, 0 AS p FROM old UNION ALL SELECT symbol, date, close, close_raw, 1 FROM fresh),
kept AS (SELECT symbol, date, close, close_raw FROM every WHERE date >= DATE '1996-01-01' QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY p DESC) = 1)"""


@query("incremental_upsert", f"{_CLOSES} SELECT symbol, date, {R('close', 'close', 4)}, {R('close_raw', 'close_raw', 4)}, coalesce(abs(close / {q.lag('close', 1)} - 1) > 0.02, false) AS f_big_move FROM kept")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored panel takes three batches, by thirds of the symbols; only partitions that can change are written."""
    panel, path = market.saved(walk_panel(spark, sf_dir), "bars"), market.shared_path(spark, "upserts")
    old = panel.where(F.expr(_OLD)).where("date >= '1996-01-01'").withColumn("close_raw", F.col("close") * 2)
    new = panel.where(F.expr(_NEW)).withColumn("close_raw", F.col("close") * 3).withColumn("close", F.col("close") + 1)
    partitions.create(old, path, buckets=2, move=0.02)
    for third in range(3):
        partitions.upsert(spark, path, new.where(F.col("symbol") % 3 == third), 2, "1996-01-01", move=0.02)
    return rounded(partitions.read(spark, path), ["close", "close_raw", "f_big_move"], 4)


@query("change_detection", f"WITH {q.DAILY} SELECT count(*) AS n, true AS same_in_any_order, true AS changed_by_one_value FROM panel")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the panel, of its rows in another order, and with one volume changed."""
    panel = market.saved(walk_panel(spark, sf_dir), "panel")
    first = panel.agg(F.min(F.struct("symbol", "date")).alias("k")).first()["k"]
    edited = panel.withColumn("volume", F.when((F.col("symbol") == first["symbol"]) & (F.col("date") == F.lit(first["date"])), F.col("volume") + 1).otherwise(F.col("volume")))
    a, b, c = (market.fingerprint(t).withColumnsRenamed({"n": f"n{i}", "hash": f"h{i}"}) for i, t in enumerate((panel, panel.orderBy(F.desc("volume"), "date"), edited)))
    return a.join(b).join(c).select(F.col("n0").alias("n"), (F.col("h0") == F.col("h1")).alias("same_in_any_order"), (F.col("h0") != F.col("h2")).alias("changed_by_one_value"))


@query("last_trading_day", """WITH t AS (SELECT ts, CASE WHEN hour(ts) * 60 + minute(ts) >= 885 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS d FROM events)
SELECT CAST(CASE WHEN isodow(d) = 6 THEN d - 1 WHEN isodow(d) = 7 THEN d - 2 ELSE d END AS DATE) AS trading_day, count(*) AS n FROM t GROUP BY 1""")  # fmt: skip
def last_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(market.trading_day("ts").alias("trading_day")).agg(F.count(F.lit(1)).alias("n"))


@query("rescale_volume", f"WITH {q.DAILY} SELECT symbol, date, {R('volume * 2 * close / close', 'volume')} FROM panel")
def rescale_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(f.rescale_volume(walk_panel(spark, sf_dir).withColumn("close_raw", F.col("close") * 2)), ["volume"])


# Order statistics and columns


@query("rolling_extremes", f"""WITH {q.DAILY}, w AS (SELECT symbol, date, list(close) {q.frame(63)} AS l, {q.roll('max', 'close', 252, 60)} AS hi, {q.roll('min', 'close', 100)} AS lo, {q.rank_in('volume', 63, 20)} AS k FROM panel)
SELECT symbol, date, CAST(CASE WHEN len(l) >= 63 THEN list_position(l, list_max(l)) END AS DOUBLE) AS argmax, {R('hi', 'highest')}, {R('lo', 'lowest')}, {R('k', 'rank')} FROM w""")  # fmt: skip
def rolling_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"argmax": ("close", kernel.argmax(63)), "highest": ("close", kernel.highest(252, 60)), "lowest": ("close", kernel.lowest(100)), "rank": ("volume", kernel.rank(63, 20))}
    return rounded(kernel.along(walk_panel(spark, sf_dir), columns), list(columns))


@query("distinct_columns", "SELECT unnest(['close', 'volume', 'high']) AS name")
def distinct_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that repeat an earlier one's contents, as `twin` does, are left out."""
    panel = walk_panel(spark, sf_dir).withColumn("twin", F.col("close") + 0)
    return spark.createDataFrame([(c,) for c in alphas.distinct_columns(panel, ["close", "volume", "twin", "high"])], "name string")


# Models and statistics


def _mix(symbol: str, feature: int) -> str:
    h = f"((CAST({symbol} AS BIGINT) * 1000003 + {feature * 7919 + 42}) % 2147483647)"
    for _ in range(2):
        h = f"(({h} * 48271 + 11) % 2147483647)"
    return f"(({h} * 48271 + 11) % 2147483647)"


def _importance_sql() -> str:
    names = ["score", "volume", "spread"]
    base = "p AS (SELECT symbol, date, score, volume, spread, ret FROM (SELECT *, round(high / low, 10) AS spread FROM mom) WHERE score IS NOT NULL AND ret IS NOT NULL)"
    stages, unions = [base], ["SELECT '' AS feature, date, score * 2 + volume / 100 - spread AS s, ret FROM p"]
    for i, c in enumerate(names):
        stages += [f"a{i} AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {_mix('symbol', i)}, symbol) AS h, row_number() OVER (PARTITION BY date ORDER BY symbol) AS k FROM p)"]
        mixed = " + ".join(f"{'y' if c == n else 'x'}.{n} * {w}" for n, w in (("score", "2"), ("volume", "0.01"), ("spread", "(-1)")))
        unions.append(f"SELECT '{c}', x.date, {mixed.replace('* 0.01', '/ 100')}, x.ret FROM a{i} x JOIN a{i} y ON x.date = y.date AND x.h = y.k")
    ranks = "r AS (SELECT feature, date, " + ", ".join(q.day_rank(f"round({x}, 10)").replace("PARTITION BY date", "PARTITION BY feature, date") + f" AS {n}" for x, n in (("s", "a"), ("ret", "b"))) + " FROM u)"
    return f"WITH {q.DAILY}, {_MOM}, {', '.join(stages)}, u AS ({' UNION ALL '.join(unions)}), {ranks}, i AS (SELECT feature, date, {_corr('a', 'b')} AS ic FROM r GROUP BY 1, 2), m AS (SELECT feature, avg(ic) AS m FROM i GROUP BY 1) SELECT feature, {R('m', 'mean_ic')}, {R(chr(40) + 'SELECT m FROM m WHERE feature = ' + repr('') + ') - m', 'importance')} FROM m WHERE feature <> ''"


@query("permutation_importances", _importance_sql())
def permutation_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a given linear score's three features."""
    panel = scored(spark, sf_dir).withColumn("spread", F.round(F.col("high") / F.col("low"), 10)).where("score is not null and ret is not null").select("symbol", "date", "score", "volume", "spread", "ret")
    model = lambda t: t.withColumn("pred_score", F.col("score") * 2 + F.col("volume") / 100 - F.col("spread"))
    return rounded(selection.importances(panel, ["score", "volume", "spread"], "ret", model), ["mean_ic", "importance"], keys=("feature",))


def _two_deltas(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = scored(spark, sf_dir)
    universe = statistics.universe_average(t, "ret")
    return {f"top{k} vs universe": statistics.delta(statistics.topk_average(t, "score", "ret", k), universe) for k in (3, 5)}


_TWO = f"{q.DAILY}, {_MOM}, {_PLACED}, s AS ({' UNION ALL '.join(f'SELECT {chr(39)}top{k} vs universe{chr(39)} AS c, date, avg(CASE WHEN p <= {k} THEN ret END) - avg(ret) AS delta FROM pl GROUP BY date' for k in (3, 5))})"


@query("offset_sensitivity", f"""WITH {_TWO}, n AS (SELECT c, delta, row_number() OVER (PARTITION BY c ORDER BY date) - 1 AS i FROM s WHERE delta IS NOT NULL), t AS (SELECT c, i % 21 AS o, i // 21 AS b, delta FROM n),
m AS (SELECT c, o, sum(delta) / count(*) AS mean, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT c, o, it, sum(delta * ({_hash('it', 'CAST(b AS BIGINT)')} % 2 * 2 - 1)) / count(*) AS f FROM t, (SELECT unnest(range(0, 2000)) AS it) GROUP BY 1, 2, 3),
p AS (SELECT c, o, (sum(CASE WHEN abs(f) >= abs(mean) - 1e-12 THEN 1 ELSE 0 END) + 1) / 2001.0 AS p FROM f JOIN m USING (c, o) GROUP BY 1, 2)
SELECT c AS comparison, {R('min(p)', 'p_min')}, {R('median(p)', 'p_median')}, {R('max(p)', 'p_max')}, {R('avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)', 'share_significant')} FROM p GROUP BY c""")  # fmt: skip
def offset_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(statistics.offset_sensitivity(_two_deltas(spark, sf_dir), 21, 2000))


@query("effective_n", f"{_ACF}, k AS (SELECT count(x) AS n FROM lg) SELECT {R('max(n) / greatest(1, 1 + 2 * sum(greatest(ac, 0)))', 'n_eff')} FROM ac, k")
def effective_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = market.saved(delta(spark, sf_dir), "delta")
    return flat(statistics.effective_n(statistics.autocorrelation(days, lags=10), days.where("delta is not null").count()))


def _acf_of(name: str) -> str:
    """The columns of autocorrelation_table() for one comparison, over ten lags."""
    lags = f"lg{name} AS (SELECT delta AS x" + "".join(f", lag(delta, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 11)) + f" FROM s WHERE c LIKE 'top{name} %' AND delta IS NOT NULL)"
    acf = f"ac{name} AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, {_corr('x', f'l{k}')} AS ac, 1.96 / sqrt(count(x)) AS band, count(x) AS n FROM lg{name}" for k in range(1, 11)) + ")"
    ahead = "OVER (ORDER BY lag ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
    return f"{lags}, {acf}, w{name} AS (SELECT *, min(CASE WHEN abs(ac) < band THEN 1 ELSE 0 END) {ahead} AS calm, count(*) {ahead} AS k FROM ac{name})"


@query("autocorrelation_table", f"WITH {_TWO}, {_acf_of('3')}, {_acf_of('5')} " + " UNION ALL ".join(f"SELECT 'top{k} vs universe' AS comparison, max(n) AS n, {R('max(band)', 'band')}, {R('max(n) / greatest(1, 1 + 2 * sum(greatest(ac, 0)))', 'n_eff')}, coalesce(min(CASE WHEN calm = 1 AND k = 3 THEN lag END), max(lag)) AS block FROM w{k}" for k in ("3", "5")))
def autocorrelation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(statistics.autocorrelation_table(_two_deltas(spark, sf_dir), 10))


@query("signals_gated", f"""WITH g AS ({ORACLES['market_gate']}), k AS (WITH {q.DAILY}, {_MOM} SELECT symbol, score, row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) AS rank FROM mom WHERE date = (SELECT max(date) FROM mom) AND score IS NOT NULL)
SELECT CAST(g.date AS VARCHAR) AS signal_date, filter_active, CAST(rank AS INT) AS rank, symbol, {R('score', 'live_score')} FROM g LEFT JOIN (SELECT * FROM k WHERE rank <= 20) k ON NOT filter_active""")  # fmt: skip
def signals_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date's twenty best by momentum, unless the market filter is active."""
    table = scored(spark, sf_dir)
    last = table.agg(F.max("date")).first()[0]
    placed = table.where((F.col("date") == F.lit(last)) & F.col("score").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("score"), "symbol")))
    signal = placed.select("symbol", "rank", F.col("score").alias("live_score"))
    return flat(walkforward.today_signals(signal, QUERIES["market_gate"](spark, sf_dir)))


_NAVS = "na AS (SELECT date, sum(close) / count(*) AS v FROM panel GROUP BY date), nb AS (SELECT date, sum(close * volume) / sum(volume) AS v FROM panel WHERE extract(day FROM date) < 28 GROUP BY date)"


@query("paired_returns", f"WITH {q.DAILY}, {_NAVS}, ra AS (SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS a FROM na), rb AS (SELECT date, v / lag(v) OVER (ORDER BY date) - 1 AS b FROM nb) SELECT date, {R('a', 'a')}, {R('b', 'b')} FROM ra JOIN rb USING (date) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mean and the volume-weighted price, the latter on other dates."""
    return rounded(statistics.paired_returns(*_navs(spark, sf_dir)), ["a", "b"], keys=("date",))


def _navs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = walk_panel(spark, sf_dir)
    a = panel.groupBy("date").agg((F.sum("close") / F.count(F.lit(1))).alias("total_value"))
    b = panel.where(F.dayofmonth("date") < 28).groupBy("date").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("total_value"))
    return a, b


@query("clean_universe", "SELECT DISTINCT trim(s) AS symbol FROM (SELECT CASE WHEN event_id % 3 = 0 THEN '  ' || event_type WHEN event_id % 3 = 1 THEN event_type || ' ' ELSE ' ' END AS s FROM events) WHERE trim(s) <> ''")
def clean_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that come with blanks, twice, or empty."""
    rest, name = F.col("event_id") % 3, F.col("event_type")
    dirty = F.when(rest == 0, F.concat(F.lit("  "), name)).when(rest == 1, F.concat(name, F.lit(" "))).otherwise(" ")
    return market.clean_symbols(spark.read.parquet(f"{sf_dir}/events.parquet").select(dirty.alias("symbol")))


# Streams


@query("stream_bars", f"""WITH {q.DAILY}, {fq._lc}, {fq._gl}, {fq._ew} SELECT symbol, date, high < low OR high < open OR high < close OR low > open OR low > close OR least(open, high, low, close) <= 0 AS f_bad_ohlc,
coalesce(abs(close / {q.lag('close', 1)} - 1) > 0.01, false) AS f_big_move, {R('EMA_9', 'EMA_9')}, {R('EMA_50', 'EMA_50')}, {R('CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END', 'RSI_14')} FROM ew""")  # fmt: skip
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a stream of three batches of files, one after the other in time; flags and averages are carried from batch to batch by the checkpoint."""
    panel, folder = market.saved(walk_panel(spark, sf_dir), "bars"), market.shared_path(spark, "stream")
    for first, last in (("1900-01-01", "1996-12-31"), ("1997-01-01", "1999-12-31"), ("2000-01-01", "2999-12-31")):
        panel.where(F.col("date").between(first, last)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(panel.schema).parquet(f"{folder}/in")
        run = state.follow(stream, 0.01).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").where("not late"), ["f_bad_ohlc", "f_big_move", "EMA_9", "EMA_50", "RSI_14"])


@query("event_windows", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value) + 1.7e-9, 4) + 0.0 AS value FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stream of counts, over the whole table at once."""
    found = ingest.event_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.select("start", "event_type", "n", (F.round(F.col("value") + 1.7e-9, 4) + F.lit(0.0)).alias("value"))


@query("event_sessions", """WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


# Services


@query("vendor_scan", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_suppkey IN (1, 2, 3, 5) AND CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND l_quantity > 10")
def vendor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem stands for a service that answers by symbol and dates; each task asks for its symbols only."""
    path = f"{sf_dir}/lineitem.parquet"

    def fetch(symbols: list, first, last):
        import pyarrow as pa
        import pyarrow.dataset as ds

        day = ds.field("l_shipdate").cast(pa.date32())
        test = ds.field("l_suppkey").isin(symbols)
        test = test if first is None else test & (day >= first)
        test = test if last is None else test & (day <= last)
        return ds.dataset(path).to_table({"symbol": ds.field("l_suppkey"), "date": day, "quantity": ds.field("l_quantity").cast(pa.float64()), "price": ds.field("l_extendedprice").cast(pa.float64())}, filter=test)

    universe = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()]
    rows = vendor.scan(spark, "lineitem_service", "symbol long, date date, quantity double, price double", universe, fetch)
    return rows.where(F.col("symbol").isin(1, 2, 3, 5) & F.col("date").between("1998-01-01", "1998-12-31") & (F.col("quantity") > 10))
