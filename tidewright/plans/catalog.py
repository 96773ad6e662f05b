"""All queries over the star schema and, where SQL expresses them, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.config import Config
from tidewright.functions.columns import finite, money, percent, phi_inv_sql, phi_sql, plain_ratio, vix_regime, vol_regime_label
from tidewright.operators import correlation, engine, hmm, metrics, regime, report, runner, signals, strategies
from tidewright.plans import oracle as o
from tidewright.sources import bars
from tidewright.sources.scratch import stash

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
ON, OFF = list(o.ON), list(o.OFF)
BLOCK_ON, BLOCK_OFF = {"AFRICA": 0.4, "AMERICA": 0.3, "ASIA": 0.2, "MIDDLE EAST": 0.1}, {"EUROPE": 0.5, "ASIA": 0.2, "AFRICA": 0.1, "cash": 0.2}


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return bars.build_panel(bars.bars_of_tables(spark, sf), bars.assets_of_tables(spark, sf))


def dates(p: DataFrame, freq: str = "monthly") -> DataFrame:
    return bars.period_last(p, freq)


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def on_panel(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, sql)(lambda spark, sf: f(panel(spark, sf)))


def on_written(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """As ``on_panel``, for queries of many plans: the panel is written once."""
    add(name, sql)(lambda spark, sf: f(stash(panel(spark, sf), "panel")))


def valued(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    on_panel(name, lambda p: f(p).select("date", "ticker", r6(F.col("value"), "value")), sql)


# sources
@add("s02_bars", f"{o.BASE} SELECT ticker, category, date, close, round(high, 8) AS high, round(low, 8) AS low, volume FROM bars")
def _bars(spark, sf):
    return bars.bars_of_tables(spark, sf).select("ticker", "category", "date", "close", F.round("high", 8).alias("high"), F.round("low", 8).alias("low"), "volume")


on_panel("s03_panel", lambda p: p.select("date", "ticker", "tradable", "px", r6(F.col("ret"), "ret"), "available"), f"{o.BASE} SELECT date, ticker, tradable, px, round(ret, 6) AS ret, available FROM p")


@add("s01_append_new_bars", f"{o.BASE} SELECT ticker, count(*) AS added, min(date) AS first, max(date) AS last FROM bars WHERE date > DATE '1997-06-30' GROUP BY 1")
def _append(spark, sf):
    every = bars.bars_of_tables(spark, sf)
    return bars.update_report(bars.append_bars(every.filter("date <= DATE'1997-06-30'"), every))


@add("s05_data_status", f"{o.BASE} SELECT a.ticker, min(date) AS first, max(date) AS last, count(date) AS obs, avg(CASE WHEN date IS NOT NULL THEN CASE WHEN close IS NULL THEN 1.0e0 ELSE 0.0e0 END END) AS missing FROM assets a LEFT JOIN bars b ON a.ticker = b.ticker GROUP BY 1")
def _status(spark, sf):
    return bars.data_status(bars.assets_of_tables(spark, sf), bars.bars_of_tables(spark, sf))


@add("s03_weekly_panel", f"""{o.BASE}, wk AS (SELECT *, row_number() OVER (PARTITION BY ticker, date_trunc('week', date) ORDER BY date DESC) AS n FROM bars)
SELECT CAST(date_trunc('week', date) AS DATE) + 4 AS date, ticker, close FROM wk WHERE n = 1""")
def _weekly(spark, sf):
    p = bars.build_panel(bars.bars_of_tables(spark, sf), bars.assets_of_tables(spark, sf), weekly=True)
    own = bars.bars_of_tables(spark, sf).select("ticker", F.date_add(F.date_trunc("week", "date").cast("date"), 4).alias("date")).distinct()
    return p.join(own, ["ticker", "date"], "left_semi").select("date", "ticker", "close")


@add("s09_ohlc_of_ticks", "SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def _ohlc(spark, sf):
    return bars.ohlc_of_ticks(spark.read.parquet(f"{sf}/events.parquet")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# predicates
add("p09_universe", f"{o.BASE} SELECT category, count(*) AS members, CAST(sum(CASE WHEN tradable THEN 1 ELSE 0 END) AS BIGINT) AS tradables FROM assets GROUP BY 1")(lambda s, sf: bars.assets_of_tables(s, sf).groupBy("category").agg(F.count("*").alias("members"), F.sum(F.col("tradable").cast("long")).alias("tradables")))
on_panel("p02_date_slice", lambda p: p.filter("date BETWEEN DATE'1995-01-01' AND DATE'1995-06-30'").groupBy("ticker").agg(F.count("*").alias("rows"), F.count("px").alias("prices")), f"{o.BASE} SELECT ticker, count(*) AS rows, count(px) AS prices FROM p WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' GROUP BY 1")
on_panel("p03_trailing_rows", lambda p: signals.trailing_rows(p, 20).groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("first")), f"{o.BASE}, l AS (SELECT date FROM cal ORDER BY date DESC LIMIT 20) SELECT ticker, count(*) AS rows, min(date) AS first FROM p WHERE date IN (SELECT date FROM l) GROUP BY 1")
on_panel("p04_available", lambda p: strategies.available(p, dates(p)).select("date", "ticker"), f"{o.BASE}{o.DATES} SELECT date, ticker FROM p WHERE date IN (SELECT date FROM d) AND tradable AND px IS NOT NULL")
on_panel("p11_finite", lambda p: p.select("date", "ticker", finite("ret").alias("ok")), f"{o.BASE} SELECT date, ticker, ret IS NOT NULL AND NOT isnan(ret) AND NOT isinf(ret) AS ok FROM p")

# joins
_asked = "SELECT CAST(d AS DATE) AS date FROM (VALUES ('1990-01-01'), ('1994-07-03'), ('1996-12-25'), ('2030-01-01')) x(d)"
on_panel("j01_as_of", lambda p: signals.as_of(signals.total_return(p, 63), p.sparkSession.sql(_asked)).filter("value IS NOT NULL").select("date", "ticker", r6(F.col("value"), "value")), f"""{o.BASE}, q AS ({_asked}), tr AS (SELECT date, ticker, {o.change('px', 63)} AS v FROM p),
x AS (SELECT q.date, tr.ticker, arg_max(struct_pack(v := tr.v), tr.date) AS v FROM q JOIN tr ON tr.date <= q.date GROUP BY 1, 2) SELECT date, ticker, round(v.v, 6) AS value FROM x WHERE v.v IS NOT NULL""")
on_panel("j05_pair_counts", lambda p: correlation.pairs(p).groupBy("a", "b").agg(F.count("x").alias("n")), f"{o.BASE}{o.PAIRS} SELECT a, b, count(x) AS n FROM j GROUP BY 1, 2")
on_panel("j07_lead_lag", lambda p: correlation.lead_lag(p, "NATION_0", "NATION_1", 5).select(F.col("lag").cast("long").alias("lag"), r6(F.col("c"), "c")), f"""{o.BASE}, w AS (SELECT date, max(CASE WHEN ticker = 'NATION_0' THEN ret END) AS l, max(CASE WHEN ticker = 'NATION_1' THEN ret END) AS f, row_number() OVER (ORDER BY date) AS n FROM p GROUP BY 1),
k AS (SELECT unnest(range(-5, 6)) AS lag) SELECT CAST(lag AS BIGINT) AS lag, round(corr(x.l, y.f), 6) AS c FROM k, w y JOIN w x ON x.n = y.n - k.lag GROUP BY lag""")

# windows
valued("w01_total_return", signals.total_return, o.value(o.change("px", 252)))
valued("w02_momentum_score", signals.momentum_score, o.value(o.momentum({252: 0.5, 126: 0.3, 63: 0.2})))
valued("w02_momentum_skip", lambda p: signals.momentum_score(p, {252: 1.0, 63: 1.0}, 21), o.value(o.momentum({252: 1.0, 63: 1.0}, 21)))
_rank = lambda v: f"CASE WHEN {v} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY date ORDER BY {v} DESC NULLS LAST) AS BIGINT) END"
on_panel("w03_momentum_rank", lambda p: signals.ranked(signals.momentum_score(p).withColumn("value", F.round("value", 9))).select("date", "ticker", F.col("rank").cast("long").alias("rank")).filter("rank IS NOT NULL"), f"{o.BASE}, v AS (SELECT date, ticker, round({o.momentum({252: 0.5, 126: 0.3, 63: 0.2})}, 9) AS v FROM p) SELECT date, ticker, {_rank('v')} AS rank FROM v WHERE v IS NOT NULL")
on_panel("w05_dual_momentum", lambda p: signals.dual_momentum(p).select("date", "ticker", F.col("rank").cast("long").alias("rank")).filter("rank IS NOT NULL"), f"{o.BASE}, v AS (SELECT date, ticker, {o.change('px', 252)} AS v FROM p), k AS (SELECT date, ticker, v, {_rank('v')} AS rank FROM v) SELECT date, ticker, rank FROM k WHERE v > 0")
valued("w06_volume_ratio", signals.volume_ratio, o.value(f"volume / nullif({o.roll('avg', 'volume', 20, 10)}, 0)"))
valued("w06_dollar_volume_ratio", signals.dollar_volume_ratio, o.value(f"dollar_volume / nullif({o.roll('avg', 'dollar_volume', 20, 10)}, 0)"))
valued("w07_volume_trend", signals.volume_trend, o.value(o.change("m", 1), "s", f", s AS (SELECT date, ticker, {o.roll('avg', 'volume', 20, 10)} AS m FROM p)"))
_signed = f", s AS (SELECT *, sign(round(close - {o.lag('close', 1)}, 12)) * volume AS sv, close * volume AS dv, sign(close - {o.lag('close', 1)}) * close * volume AS sdv FROM p)"
on_panel("w08_obv", lambda p: signals.obv(p).select("date", "ticker", r6(F.col("value"), "value")), f"{o.BASE}{_signed.replace('round(', '(').replace(', 12)', ')')} SELECT date, ticker, round(sum(coalesce(sv, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS value FROM s")
valued("w09_money_flow", signals.money_flow, o.value(f"{o.roll('sum', 'sdv', 20, 10)} / nullif({o.roll('sum', 'dv', 20, 10)}, 0)", "s", _signed))
valued("w17_inflow_outflow", signals.inflow_outflow, o.value(f"{o.roll('sum', 'sdv', 20, 1)} / nullif({o.roll('sum', 'dv', 20, 1)}, 0)", "s", _signed))
valued("w10_realized_vol", signals.realized_vol, o.value(f"{o.roll('stddev_samp', 'ret', 21, 10)} * sqrt(252)"))
_tr = f", s AS (SELECT *, greatest(high - low, abs(high - {o.lag('close', 1)}), abs(low - {o.lag('close', 1)})) AS tr FROM p)"
valued("w11_atr", signals.atr, o.value(o.roll("avg", "tr", 14, 7), "s", _tr))
valued("w12_atr_pct", signals.atr_pct, o.value(f"{o.roll('avg', 'tr', 14, 7)} / close", "s", _tr))
valued("w13_rolling_avg_correlation", lambda p: correlation.rolling_avg_correlation(p, 120), f"{o.BASE}{o.pair_corr(120)}, u AS (SELECT date, a AS ticker, c FROM c UNION ALL SELECT date, b, c FROM c) SELECT date, ticker, round(avg(c), 6) AS value FROM u GROUP BY 1, 2")
on_panel("w14_correlation_change", lambda p: correlation.correlation_change(p).select("date", r6(F.col("value"), "value")), f"{o.BASE}{o.pair_corr(60)}, g AS (SELECT date, avg(c) AS m FROM c GROUP BY 1) SELECT date, round(m - lag(m) OVER (ORDER BY date), 6) AS value FROM g")
on_panel("w15_market_correlation", lambda p: correlation.market_correlation(p.filter(F.col("ticker").isin(ON)), 40).select("date", r6(F.col("value"), "value")), (f"{o.BASE}{o.pair_corr(40)}, n AS (SELECT date, ticker, count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS n FROM p) SELECT c.date, round(avg(CASE WHEN x.n >= 20 AND y.n >= 20 THEN c END), 6) AS value FROM c JOIN n x ON x.date = c.date AND x.ticker = a JOIN n y ON y.date = c.date AND y.ticker = b WHERE a IN ({o.names(o.ON)}) AND b IN ({o.names(o.ON)}) GROUP BY 1"))
valued("w16_relative_strength", signals.relative_strength, o.value("v - avg(v) OVER (PARTITION BY date)", "s", f", s AS (SELECT date, ticker, {o.change('px', 63)} AS v FROM p)"))
valued("w16_relative_to_benchmark", lambda p: signals.relative_strength(p, 63, "NATION_0"), o.value("v - max(CASE WHEN ticker = 'NATION_0' THEN v END) OVER (PARTITION BY date)", "s", f", s AS (SELECT date, ticker, {o.change('px', 63)} AS v FROM p)"))
on_panel("w18_sleeve_mean", lambda p: regime.sleeve(p, ON, 63).select("date", r6(F.col("value"), "value")), f"{o.BASE}{o.REGIME} SELECT date, round(s_on, 6) AS value FROM s1")
add("w19_vix_deviation", f"{o.BASE}{o.REGIME} SELECT date, round(dev, 6) AS dev FROM v1")(lambda s, sf: regime.vix_deviation(bars.vix_of_tables(s, sf), 63).select("date", r6(F.col("dev"), "dev")))
valued("w20_wealth_drawdown", signals.wealth_drawdown, o.value(f"w / nullif({o.roll('max', 'w', 40, 20)}, 0) - 1", "s", f", s AS (SELECT date, ticker, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w FROM p)"))
valued("w21_drawdown", signals.drawdown, o.value("px / nullif(max(px) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1"))
on_panel("w22_under_water", lambda p: metrics.under_water(metrics.curve(p.filter("px IS NOT NULL").withColumn("equity", F.col("px")), ["ticker"]), ["ticker"]), f"""{o.BASE}{o.CURVE}, z AS (SELECT ticker, date, dd < -1e-12 AS f, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, dd < -1e-12 ORDER BY date) AS g FROM e)
SELECT ticker, min(date) AS first, max(date) AS last, CAST(max(date) - min(date) AS BIGINT) AS days, count(*) AS rows FROM z WHERE f GROUP BY ticker, g""")
on_panel("w24_availability", lambda p: signals.availability(p, 252), f"{o.BASE}, s AS (SELECT date, sum(CASE WHEN available THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS age FROM p WHERE tradable) SELECT date, CAST(sum(CASE WHEN age >= 252 THEN 1 ELSE 0 END) AS BIGINT) AS ready FROM s GROUP BY 1")
on_panel("w27_cycle_length", lambda p: signals.cycle_length(p).select(r6(F.col("cycle"), "cycle"), F.col("flips").cast("long").alias("flips"), "span"), f"""{o.BASE}, s AS (SELECT date, stddev_samp(ret) AS x FROM p GROUP BY 1 HAVING stddev_samp(ret) IS NOT NULL),
k AS (SELECT date, sign(x - avg(x) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) AS s FROM s), z AS (SELECT s <> lag(s) OVER (ORDER BY date) AS f FROM k WHERE s <> 0)
SELECT round(2.0e0 * (SELECT count(*) FROM k) / nullif(sum(CASE WHEN f THEN 1 ELSE 0 END), 0), 6) AS cycle, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS flips, (SELECT count(*) FROM k) AS span FROM z""")
valued("f16_zscore", lambda p: signals.zscore(signals.total_return(p, 63)), o.value("CASE WHEN v IS NULL THEN NULL WHEN stddev_pop(v) OVER (PARTITION BY date) > 1e-12 THEN (v - avg(v) OVER (PARTITION BY date)) / stddev_pop(v) OVER (PARTITION BY date) ELSE 0 END", "s", f", s AS (SELECT date, ticker, {o.change('px', 63)} AS v FROM p)"))

# aggregates
for _freq, _unit in (("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter")):
    on_panel(f"a01_rebalance_{_freq}", lambda p, f=_freq: dates(p, f), f"{o.BASE} SELECT max(date) AS date FROM cal GROUP BY date_trunc('{_unit}', date)")


def curves(p: DataFrame) -> DataFrame:
    """Each ticker's price as an equity curve."""
    return p.filter("px IS NOT NULL").select("ticker", "date", F.col("px").alias("equity"))


_months = o.CURVE + """, g AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + r) - 1 AS ret FROM e WHERE r IS NOT NULL GROUP BY 1, 2),
k AS (SELECT ticker, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM g GROUP BY 1), mm AS (SELECT k.ticker, k.month, coalesce(ret, 0) AS ret FROM k LEFT JOIN g ON k.ticker = g.ticker AND k.month = g.month)"""
on_panel("a02_monthly_returns", lambda p: metrics.monthly_returns(curves(p), ["ticker"]).select("ticker", "month", r6(F.col("ret"), "ret")), f"{o.BASE}{_months} SELECT ticker, month, round(ret, 6) AS ret FROM mm")
on_panel("a02_monthly_table", lambda p: metrics.monthly_table(curves(p), ["ticker"]).select("ticker", F.col("year").cast("long").alias("year"), *(r6(F.col(c), c) for c in [*(f"m{i}" for i in range(1, 13)), "year_return"])), f"{o.BASE}{_months} SELECT ticker, year(month) AS year, {', '.join(f'round(max(CASE WHEN month(month) = {i} THEN ret END), 6) AS m{i}' for i in range(1, 13))}, round(product(1 + ret) - 1, 6) AS year_return FROM mm GROUP BY 1, 2")
on_panel("a03_annual_returns", lambda p: metrics.annual_returns(curves(p), ["ticker"]).select("ticker", "year", r6(F.col("ret"), "ret")), f"{o.BASE}{o.CURVE} SELECT ticker, year(date) AS year, round(product(1 + r) - 1, 6) AS ret FROM e WHERE r IS NOT NULL GROUP BY 1, 2")
on_panel("a04_cross_section", lambda p: signals.cross_section(signals.valued(p, F.col("ret"))).select("date", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), r6(F.col("sd_pop"), "sd_pop"), "n"), f"{o.BASE} SELECT date, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(stddev_pop(ret), 6) AS sd_pop, count(ret) AS n FROM p GROUP BY 1")
_last120 = ", l AS (SELECT date FROM cal ORDER BY date DESC LIMIT 120)"
_matrix = f"{_last120}{o.PAIRS}, h AS (SELECT a, b, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS c FROM j WHERE date IN (SELECT date FROM l) GROUP BY 1, 2), mx AS (SELECT a AS ticker_a, b AS ticker_b, c FROM h UNION ALL SELECT b, a, c FROM h UNION ALL SELECT ticker, ticker, CASE WHEN var_samp(ret) > 0 THEN 1.0e0 END FROM p WHERE date IN (SELECT date FROM l) GROUP BY 1)"
on_panel("a06_correlation_matrix", lambda p: correlation.correlation_matrix(p, 120).select("ticker_a", "ticker_b", r6(F.col("c"), "c")), f"{o.BASE}{_matrix} SELECT ticker_a, ticker_b, round(c, 6) AS c FROM mx")
on_panel("a07_off_diagonal_mean", lambda p: correlation.off_diagonal_mean(correlation.correlation_matrix(p, 120)).select("ticker", r6(F.col("avg_corr"), "avg_corr")), f"{o.BASE}{_matrix} SELECT ticker_a AS ticker, round(avg(c), 6) AS avg_corr FROM mx WHERE ticker_a <> ticker_b GROUP BY 1")
on_panel("a15_enough_values", lambda p: signals.trailing_rows(p, 120).groupBy("ticker").agg(F.count("ret").alias("n")).filter("n >= 60"), f"{o.BASE}{_last120} SELECT ticker, count(ret) AS n FROM p WHERE date IN (SELECT date FROM l) GROUP BY 1 HAVING count(ret) >= 60")
on_panel("r05_best_lag", lambda p: correlation.best_lag(correlation.lead_lag(p, "NATION_0", "NATION_1", 5)).select(F.col("best_lag").cast("long").alias("best_lag"), r6(F.col("c"), "c")), _sql["j07_lead_lag"].replace("SELECT CAST(lag AS BIGINT) AS lag, round(corr(x.l, y.f), 6) AS c FROM k, w y JOIN w x ON x.n = y.n - k.lag GROUP BY lag", "SELECT CAST(coalesce(max(lag), 0) AS BIGINT) AS best_lag, round(max(c), 6) AS c FROM (SELECT * FROM (SELECT lag, corr(x.l, y.f) AS c FROM k, w y JOIN w x ON x.n = y.n - k.lag GROUP BY lag) WHERE c IS NOT NULL ORDER BY abs(c) DESC, lag LIMIT 1)"))
on_panel("r07_pca_explained", lambda p: correlation.pca_explained(p).select("component", r6(F.col("ratio"), "ratio")))

# regimes and rotation
add("r01_risk_score", f"{o.BASE}{o.REGIME} SELECT date, round(score, 6) AS score FROM score")(lambda s, sf: regime.risk_score(panel(s, sf), bars.vix_of_tables(s, sf), ON, OFF).select("date", r6(F.col("score"), "score")))


def labels(s: SparkSession, sf: str) -> DataFrame:
    return regime.classify(regime.risk_score(panel(s, sf), bars.vix_of_tables(s, sf), ON, OFF))


add("r02_classify_regime", f"{o.BASE}{o.REGIME} SELECT date, regime, round(score, 6) AS score FROM regime")(lambda s, sf: labels(s, sf).select("date", "regime", r6(F.col("score"), "score")))
add("r03_regime_at", f"{o.BASE}{o.REGIME}, q AS ({_asked}) SELECT q.date, coalesce(arg_max(regime, r.date), 'neutral') AS regime FROM q LEFT JOIN regime r ON r.date <= q.date GROUP BY 1")(lambda s, sf: regime.regime_at(labels(s, sf), s.sql(_asked)))
add("x15_risk_off_spans", f"{o.BASE}{o.REGIME}, z AS (SELECT date, regime = 'risk_off' AS f, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY regime = 'risk_off' ORDER BY date) AS g FROM regime) SELECT min(date) AS first, max(date) AS last, CAST(max(date) - min(date) AS BIGINT) AS days, count(*) AS rows FROM z WHERE f GROUP BY g")(lambda s, sf: report.risk_off_spans(labels(s, sf)))
_flow63 = f"{o.roll('sum', 'sdv', 63, 1)} / nullif({o.roll('sum', 'dv', 63, 1)}, 0)"
on_panel("r04_category_rotation", lambda p: regime.category_rotation(p).select("category", r6(F.col("strength"), "strength"), r6(F.col("flow"), "flow"), "status"), f"""{o.BASE}{_signed}, v AS (SELECT date, ticker, category, tradable, {o.change('px', 63)} AS v, {_flow63} AS flow FROM s), u AS (SELECT *, v - avg(v) OVER (PARTITION BY date) AS rs FROM v),
g AS (SELECT category, avg(rs) AS strength, avg(flow) AS flow FROM u WHERE tradable AND date = (SELECT max(date) FROM cal) GROUP BY 1)
SELECT category, round(strength, 6) AS strength, round(flow, 6) AS flow, CASE WHEN strength > 1e-3 AND flow > 0 THEN 'inflow' WHEN strength < -1e-3 AND flow < 0 THEN 'outflow' ELSE 'neutral' END AS status FROM g""")
add("f02_vix_regime", f"{o.BASE} SELECT date, CASE WHEN vix < 15 THEN 'low' WHEN vix < 25 THEN 'normal' WHEN vix < 35 THEN 'high' WHEN vix IS NOT NULL THEN 'extreme' END AS label FROM vix")(lambda s, sf: bars.vix_of_tables(s, sf).select("date", vix_regime(F.col("vix")).alias("label")))
add("f03_vol_label", f"{o.BASE} SELECT c.date, CASE WHEN vix < 15 THEN 'low' WHEN vix < 25 OR vix IS NULL THEN 'normal' WHEN vix < 35 THEN 'high' ELSE 'extreme' END AS label FROM cal c LEFT JOIN vix v ON c.date = v.date")(lambda s, sf: panel(s, sf).select("date").distinct().join(bars.vix_of_tables(s, sf), "date", "left").select("date", vol_regime_label(F.col("vix")).alias("label")))
_grid = "SELECT CAST(x AS DOUBLE) / 8 AS x FROM range(-40, 41) t(x)"
add("f08_normal_distribution", f"WITH g AS ({_grid}) SELECT x, round({phi_sql('x')}, 6) AS p, round({phi_inv_sql('((x + 5.001e0) / 10.002e0)')}, 6) AS q FROM g")(lambda s, sf: s.range(-40, 41).select((F.col("id") / 8).alias("x")).select("x", F.round(F.expr(phi_sql("x")), 6).alias("p"), F.round(F.expr(phi_inv_sql("((x + 5.001e0) / 10.002e0)")), 6).alias("q")))
on_panel("f14_formatters", lambda p: metrics.compute(curves(p), ["ticker"]).select("ticker", percent(F.round("cagr", 9)).alias("cagr"), plain_ratio(F.round("sharpe", 9)).alias("sharpe"), money(F.round("final_equity", 6)).alias("final")), f"{o.BASE}{o.METRICS} SELECT ticker, printf('%.1f%%', round(cagr, 9) * 100) AS cagr, printf('%.2f', round(sharpe, 9)) AS sharpe, '$' || format('{{:,}}', CAST(round(e1, 0) AS BIGINT)) AS final FROM m")


@add("r08_market_features")
def _features(s, sf):
    f = regime.market_features(panel(s, sf), bars.vix_of_tables(s, sf), ON)
    return f.select("date", *(r6(F.col(c), c) for c in hmm.FEATURES))


@add("r09_hmm_regime")
def _hmm(s, sf):
    return hmm.classify_hmm(regime.market_features(panel(s, sf), bars.vix_of_tables(s, sf), ON).orderBy("date"))


# strategies
def weighted(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    on_panel(name, lambda p: f(p, dates(p)).select("date", "ticker", r6(F.col("w"), "w")), sql)


_topn = f"{o.DATES}, s AS (SELECT date, ticker, px, tradable, {o.change('px', 252)} AS v FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v DESC, ticker) AS n FROM s WHERE tradable AND px IS NOT NULL AND v IS NOT NULL AND date IN (SELECT date FROM d)), tn AS (SELECT date, ticker, 1.0e0 / count(*) OVER (PARTITION BY date) AS w FROM t WHERE n <= 5 AND v > 0)"
weighted("t01_topn_weights", strategies.topn, f"{o.BASE}{_topn} SELECT date, ticker, round(w, 6) AS w FROM tn")
_inv = f"{o.DATES}, s AS (SELECT date, ticker, px, tradable, {o.roll('stddev_samp', 'ret', 63, 31)} * sqrt(252) AS vol FROM p), t AS (SELECT date, ticker, 1 / vol AS w, sum(1 / vol) OVER (PARTITION BY date) AS total FROM s WHERE tradable AND px IS NOT NULL AND vol > 0 AND date IN (SELECT date FROM d))"
weighted("t02_risk_parity", strategies.risk_parity, f"{o.BASE}{_inv} SELECT date, ticker, round(CASE WHEN total > 1 THEN w / total ELSE w END, 6) AS w FROM t")
weighted("t03_equal_risk", lambda p, d: strategies.risk_parity(p, d, method="erc"))
_z = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN stddev_pop({x}) OVER (PARTITION BY date) > 1e-12 THEN ({x} - avg({x}) OVER (PARTITION BY date)) / stddev_pop({x}) OVER (PARTITION BY date) ELSE 0 END"
_composite = f"""{o.DATES}, q AS (SELECT * FROM p WHERE tradable){o.pair_corr(120).replace("p x JOIN p y", "q x JOIN q y")},
u AS (SELECT date, ticker, avg(c) AS c FROM (SELECT date, a AS ticker, c FROM c UNION ALL SELECT date, b, c FROM c) GROUP BY 1, 2),
s AS (SELECT date, ticker, px, {o.momentum({252: 0.5, 126: 0.3, 63: 0.2})} AS mom, dollar_volume / nullif({o.roll('avg', 'dollar_volume', 20, 10)}, 0) AS dv, -({o.roll('stddev_samp', 'ret', 63, 31)} * sqrt(252)) AS nv, {o.change('px', 252)} AS am FROM q),
x AS (SELECT s.*, -u.c AS nc FROM s LEFT JOIN u ON s.date = u.date AND s.ticker = u.ticker WHERE s.date IN (SELECT date FROM d)),
z AS (SELECT date, ticker, px, am, 0.4e0 * ({_z('mom')}) + 0.2e0 * ({_z('dv')}) + 0.2e0 * ({_z('nv')}) + 0.2e0 * ({_z('nc')}) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS n FROM z WHERE px IS NOT NULL AND score IS NOT NULL AND am > 0),
k AS (SELECT date, ticker, CASE WHEN score > 0 THEN score END AS up, score FROM r WHERE n <= 8),
y AS (SELECT date, ticker, CASE WHEN sum(up) OVER (PARTITION BY date) > 0 THEN coalesce(up, 0) / sum(up) OVER (PARTITION BY date) ELSE 1.0e0 / count(*) OVER (PARTITION BY date) END AS w FROM k)"""
weighted("t04_composite", strategies.composite, f"{o.BASE}{_composite} SELECT date, ticker, round(w, 6) AS w FROM y WHERE w > 0")
weighted("t06_min_variance", strategies.min_variance)
_live = f"{o.DATES}, a AS (SELECT date, ticker, category FROM p WHERE tradable AND px IS NOT NULL AND date IN (SELECT date FROM d))"
_blocks = ", ".join(f"('{label}', '{c}', {w}e0)" for label, b in (("risk_on", BLOCK_ON), ("risk_off", BLOCK_OFF)) for c, w in b.items() if c != "cash")
_based = f"{_live}{o.REGIME}, k(block, category, share) AS (VALUES {_blocks}), rb AS (SELECT a.date, ticker, share / count(*) OVER (PARTITION BY a.date, a.category) AS w FROM a JOIN regime r ON a.date = r.date JOIN k ON k.category = a.category AND k.block = CASE WHEN regime = 'risk_on' THEN 'risk_on' ELSE 'risk_off' END)"
add("t05_regime_based", f"{o.BASE}{_based} SELECT date, ticker, round(w, 6) AS w FROM rb")(lambda s, sf: (lambda p: strategies.regime_based(p, dates(p), labels(s, sf), BLOCK_ON, BLOCK_OFF).select("date", "ticker", r6(F.col("w"), "w")))(panel(s, sf)))
_budget = "CASE regime WHEN 'risk_on' THEN 1.0e0 WHEN 'risk_off' THEN 0.3e0 ELSE 0.6e0 END"
for _name, _discrete, _expr in (("t07_regime_budget", True, _budget), ("t07_regime_budget_smooth", False, "least(1, greatest(0, 0.3e0 + 0.7e0 * (0.5e0 + 0.5e0 * tanh(score))))")):
    add(_name, f"{o.BASE}{_topn}{o.REGIME} SELECT tn.date, ticker, round(w * {_expr}, 6) AS w FROM tn JOIN regime r ON tn.date = r.date")(lambda s, sf, x=_discrete: (lambda p: strategies.budgeted(strategies.topn(p, dates(p)), labels(s, sf), x).select("date", "ticker", r6(F.col("w"), "w")))(panel(s, sf)))
weighted("t08_sixty_forty", lambda p, d: strategies.bench_6040(p, d, "NATION_0", "NATION_2"), f"{o.BASE}{_live} SELECT date, ticker, CASE ticker WHEN 'NATION_0' THEN 0.6e0 ELSE 0.4e0 END AS w FROM a WHERE ticker IN ('NATION_0', 'NATION_2')")
weighted("t09_equal_weight", strategies.bench_equal, f"{o.BASE}{_live} SELECT date, ticker, round(1.0e0 / count(*) OVER (PARTITION BY date), 6) AS w FROM a")
weighted("t10_buy_and_hold", lambda p, d: strategies.bench_bh(p, d, "NATION_0"), f"{o.BASE}{_live} SELECT date, ticker, 1.0e0 AS w FROM a WHERE ticker = 'NATION_0'")
weighted("k01_overlay_caps", lambda p, d: strategies.overlay(strategies.topn(p, d), 0.15, 0.5), f"{o.BASE}{_topn}, c AS (SELECT date, ticker, least(w, 0.15e0) AS w FROM tn), g AS (SELECT *, sum(w) OVER (PARTITION BY date) AS s FROM c) SELECT date, ticker, round(CASE WHEN s > 0.5 THEN w * 0.5e0 / s ELSE w END, 6) AS w FROM g")
weighted("k02_correlation_spike", lambda p, d: strategies.overlay(strategies.topn(p, d), market=correlation.rolling_avg_correlation(p, 60), threshold=0.0), f"{o.BASE}{_topn}{o.pair_corr(60)}, u AS (SELECT date, a AS ticker, c FROM c UNION ALL SELECT date, b, c FROM c), k AS (SELECT date, ticker, avg(c) AS v FROM u GROUP BY 1, 2), z AS (SELECT date, avg(v) AS v FROM k GROUP BY 1) SELECT tn.date, ticker, round(CASE WHEN v > 0 THEN w * 0.5e0 ELSE w END, 6) AS w FROM tn LEFT JOIN z ON tn.date = z.date")

# engine
SUITE = ("topn", "risk_parity", "bench_equal")


def paths(p: DataFrame, names: tuple[str, ...] = SUITE, freqs: tuple[str, ...] = ("monthly", "quarterly"), **window: str) -> DataFrame:
    return runner.suite(p, {n: runner.by_name(p, n) for n in names}, freqs, **window)


on_written("b01_backtest_paths", lambda p: paths(p).select("strategy", "freq", "date", r6(F.col("equity"), "equity"), r6(F.col("turnover"), "turnover"), r6(F.col("cash"), "cash"), "rebalanced"))
# one ticker bought on the first month end: later rebalances only spend what costs left in cash
on_written("b01_buy_and_hold_path", lambda p: runner.suite(p, {"bh": runner.by_name(p, "bench_bh", ticker="NATION_0")}, ("monthly",), cost=0.0).select("date", r6(F.col("equity"), "equity")), f"""{o.BASE}{o.DATES}, q AS (SELECT date, px FROM p WHERE ticker = 'NATION_0'), h AS (SELECT min_by(px, q.date) AS px0, min(q.date) AS bought FROM q JOIN d ON q.date = d.date WHERE px IS NOT NULL), z AS (SELECT min(date) AS first FROM d)
SELECT cal.date, round(CASE WHEN bought IS NULL OR cal.date <= bought THEN 100000.0e0 ELSE 100000 * px / px0 END, 6) AS equity FROM cal CROSS JOIN h CROSS JOIN z LEFT JOIN q ON q.date = cal.date WHERE cal.date >= first""")
on_written("b01_equal_weight_path", lambda p: runner.suite(p, {"eq": runner.by_name(p, "bench_equal")}, ("monthly",), cost=0.0).select("date", F.round("equity", 4).alias("equity")), f"""{o.BASE}{o.DATES}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS n, lead(date, 1, DATE '9999-12-31') OVER (ORDER BY date) AS until FROM d),
g AS (SELECT c.date, k.n, avg(q.px / s.px) AS grown FROM cal c JOIN k ON c.date > k.date AND c.date <= k.until JOIN p s ON s.date = k.date AND s.tradable AND s.px IS NOT NULL JOIN p q ON q.date = c.date AND q.ticker = s.ticker GROUP BY 1, 2),
t AS (SELECT g.n, g.grown FROM g JOIN k ON g.n = k.n AND g.date = k.until), m AS (SELECT k.n, 100000 * coalesce(exp(sum(ln(t.grown)) OVER (ORDER BY k.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS e FROM k LEFT JOIN t ON k.n = t.n)
SELECT date, round(e, 4) AS equity FROM (SELECT (SELECT min(date) FROM k) AS date, 100000.0e0 AS e UNION ALL SELECT g.date, m.e * g.grown FROM g JOIN m ON g.n = m.n)""")
# the same with costs: a fold over dates in SQL, holdings as a list; weights sum to one or none, and corrections end where cash pays the costs
_bought = "(v - 0.0015e0 * {})"
_traded = lambda t: f"list_sum(list_transform(list_zip(w, g), lambda z: abs(z[1] * {_bought.format(t)} - z[2])))"
_steps = "SELECT *, list_sum(list_transform(list_zip(w, g), lambda z: abs(z[1] * v - z[2]))) AS t1 FROM day"
for _k in range(1, 6):
    _steps = f"SELECT *, {_traded(f't{_k}')} AS t{_k + 1} FROM ({_steps})"
_ends = lambda which: "CASE WHEN v * (1 - list_sum(w)) - 0.0015e0 * t1 >= -1e-9 THEN " + which(0) + "".join(f" WHEN 0.0015e0 * (t{k} - t{k + 1}) >= -1e-9 THEN {which(k)}" for k in range(1, 5)) + f" ELSE {which(5)} END"
_steps = f"SELECT *, {_ends(lambda k: f't{k}' if k else '0.0e0')} AS due, {_ends(lambda k: f't{k + 1}')} AS paid FROM ({_steps})"
on_written("b01_equal_weight_costs", lambda p: runner.suite(p, {"eq": runner.by_name(p, "bench_equal")}, ("monthly",), cost=0.0015).select("date", F.round("equity", 4).alias("equity"), F.round("turnover", 6).alias("turnover")), f"""{o.BASE}{o.DATES},
x AS (SELECT date, list(coalesce(ret, 0) ORDER BY ticker) AS r, list(CASE WHEN tradable AND px IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END ORDER BY ticker) AS ok FROM p GROUP BY 1),
y AS (SELECT x.date, r, CASE WHEN d.date IS NOT NULL THEN list_transform(ok, lambda v: v / greatest(list_sum(ok), 1)) END AS w, row_number() OVER (ORDER BY x.date) AS n FROM x LEFT JOIN d ON x.date = d.date WHERE x.date >= (SELECT min(date) FROM d)),
e AS (SELECT 0 AS n, DATE '1900-01-01' AS date, list_transform(r, lambda v: 0.0e0) AS h, 100000.0e0 AS cash, 0.0e0 AS turnover FROM y WHERE n = 1
  UNION ALL SELECT n, date, CASE WHEN w IS NULL THEN g ELSE list_transform(w, lambda a: a * {_bought.format("due")}) END, CASE WHEN w IS NULL THEN cash ELSE v - list_sum(w) * {_bought.format("due")} - 0.0015e0 * paid END, CASE WHEN w IS NULL THEN 0 ELSE paid / v END
  FROM ({_steps.replace("FROM day", "FROM (SELECT *, list_sum(g) + cash AS v FROM (SELECT y.n, y.date, y.w, e.cash, list_transform(list_zip(e.h, y.r), lambda z: z[1] * (1 + z[2])) AS g FROM e JOIN y ON y.n = e.n + 1))")}))
SELECT date, round(list_sum(h) + cash, 4) AS equity, round(turnover, 6) AS turnover FROM e WHERE n > 0""")


def configured(s: SparkSession, sf: str) -> DataFrame:
    """A suite as YAML would set it up: capital, no costs, capped positions and the common start."""
    assets = [{"ticker": r.ticker, "category": r.category, "tradable": r.tradable} for r in bars.assets_of_tables(s, sf).orderBy("pos").collect()]
    settings = {"backtest": {"initial_capital": 1000}, "costs": {"commission": 0.0}, "rebalance": {"frequencies": ["monthly"]}, "risk_overlay": {"enabled": True, "max_single_weight": 0.04}}
    setup = runner.Setup(panel(s, sf), Config(assets, backtest=settings), ["bench_equal"], bars.vix_of_tables(s, sf))
    return setup.run()[0].select("date", F.round("equity", 5).alias("equity"))


add("b06_configured_suite", f"""{o.BASE}{o.DATES}, ag AS (SELECT date, sum(CASE WHEN available THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS age FROM p WHERE tradable),
r AS (SELECT date, sum(CASE WHEN age >= 1 THEN 1 ELSE 0 END) AS ready, row_number() OVER (ORDER BY date) - 1 AS n FROM ag GROUP BY 1), nd AS (SELECT greatest(3, least(8, count(DISTINCT ticker) // 2)) AS need FROM p WHERE tradable),
st AS (SELECT date FROM r WHERE n = (SELECT least(coalesce(min(n), 1) + 5, (SELECT count(*) FROM r) - 2) FROM r, nd WHERE ready >= need)),
k AS (SELECT date, row_number() OVER (ORDER BY date) AS n, lead(date, 1, DATE '9999-12-31') OVER (ORDER BY date) AS until FROM d WHERE date >= (SELECT date FROM st)),
w AS (SELECT k.n, q.ticker, q.px, least(1.0e0 / count(*) OVER (PARTITION BY k.n), 0.04e0) AS w FROM k JOIN p q ON q.date = k.date AND q.tradable AND q.px IS NOT NULL),
g AS (SELECT c.date, k.n, 1 + sum(w.w * (q.px / w.px - 1)) AS grown FROM cal c JOIN k ON c.date > k.date AND c.date <= k.until JOIN w ON w.n = k.n JOIN p q ON q.date = c.date AND q.ticker = w.ticker GROUP BY 1, 2),
t AS (SELECT g.n, g.grown FROM g JOIN k ON g.n = k.n AND g.date = k.until), m AS (SELECT k.n, 1000 * coalesce(exp(sum(ln(t.grown)) OVER (ORDER BY k.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS e FROM k LEFT JOIN t ON k.n = t.n)
SELECT date, round(e, 5) AS equity FROM (SELECT (SELECT min(date) FROM k) AS date, 1000.0e0 AS e UNION ALL SELECT g.date, m.e * g.grown FROM g JOIN m ON g.n = m.n)""")(configured)
on_panel("b04_benchmark_returns", lambda p: engine.benchmark_returns(p, dates(p), "NATION_0").select("date", r6(F.col("bench"), "bench")), f"{o.BASE}{o.DATES} SELECT d.date, round(ret, 6) AS bench FROM d LEFT JOIN p ON d.date = p.date AND ticker = 'NATION_0'")
on_panel("b05_common_start", engine.common_start, f"""{o.BASE}, s AS (SELECT date, sum(CASE WHEN available THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS age FROM p WHERE tradable),
r AS (SELECT date, sum(CASE WHEN age >= 252 THEN 1 ELSE 0 END) AS ready, row_number() OVER (ORDER BY date) - 1 AS n FROM s GROUP BY 1), k AS (SELECT greatest(3, least(8, count(DISTINCT ticker) // 2)) AS need FROM p WHERE tradable)
SELECT date FROM r WHERE n = (SELECT least(coalesce(min(n), 252) + 5, (SELECT count(*) FROM r) - 2) FROM r, k WHERE ready >= need)""")
_split = """, q AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n, count(*) OVER () AS size FROM cal), sp AS (SELECT date, n, CASE WHEN n < floor(size * 0.6e0) THEN 'train' WHEN n < floor(size * 0.6e0) + floor(size * 0.2e0) THEN 'valid' ELSE 'test' END AS split FROM q)"""
on_panel("b08_split", lambda p: metrics.split_summary(metrics.chronological_split(p)), f"{o.BASE}{_split} SELECT split, min(date) AS first, max(date) AS last, count(*) AS rows FROM sp GROUP BY 1")
on_panel("b09_walk_forward", lambda p: metrics.walk_forward_plan(p).withColumn("fold", F.col("fold").cast("long")), f"""{o.BASE}, q AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n, count(*) OVER () AS size FROM cal),
fd AS (SELECT k AS fold, size // 2 + k * ((size - size // 2) // 5) AS a, CASE WHEN k = 4 THEN size - 1 ELSE size // 2 + (k + 1) * ((size - size // 2) // 5) - 1 END AS b FROM (SELECT any_value(size) AS size FROM q), range(0, 5) t(k) WHERE size >= 10 AND (size - size // 2) // 5 > 2)
SELECT CAST(fold AS BIGINT) AS fold, e.date AS train_end, x.date AS test_start, y.date AS test_end FROM fd JOIN q e ON e.n = a - 2 JOIN q x ON x.n = a JOIN q y ON y.n = b""")
on_written("b07_out_of_sample", lambda p: runner.out_of_sample(p, {n: runner.by_name(p, n) for n in SUITE}, ("monthly",)).withColumns({"valid": F.round("valid", 6), "test": F.round("test", 6)}))
on_panel("b12_sweep", lambda p: runner.sweep(p).select("strategy", "n", "lookback", "filt", "n_periods", *(r6(F.col(c), c) for c in ("full_cagr", "full_sharpe", "full_max_drawdown", "full_calmar", "valid_sharpe", "test_sharpe", "test_max_drawdown", "js", "dsr"))))
_trials = {name: (o.momentum(w, skip), o.change("px", max(w))) for name, (w, skip) in runner.LOOKBACKS.items()}
_stack = " UNION ALL ".join(f"SELECT date, ticker, px, '{name}' AS lookback, {score} AS score, {long} AS long FROM p WHERE tradable" for name, (score, long) in _trials.items())
on_written("b12_sweep_weights", lambda p: runner.sweep_weights(p, dates(p)).withColumn("w", F.round("w", 6)), f"""{o.BASE}{o.DATES}, s AS ({_stack}), r AS (SELECT *, row_number() OVER (PARTITION BY date, lookback ORDER BY score DESC, ticker) AS k FROM s WHERE px IS NOT NULL AND score IS NOT NULL AND date IN (SELECT date FROM d)),
g AS (SELECT CAST(n AS INTEGER) AS n, filt FROM (VALUES (3), (5), (7), (10)) x(n), (VALUES ('on'), ('off')) y(filt))
SELECT n, lookback, filt, date, ticker, round(1.0e0 / count(*) OVER (PARTITION BY n, lookback, filt, date), 6) AS w FROM r JOIN g ON k <= n AND (filt = 'off' OR long > 0)""")
add("b13_hmm_comparison")(lambda s, sf: (lambda f: f.select("window", "strategy", *(r6(F.col(c), c) for c in f.columns[2:])))(runner.hmm_comparison(panel(s, sf), bars.vix_of_tables(s, sf), ON, OFF)))
on_panel("u03_shared_dates", lambda p: runner.shared_dates(p.filter("ticker = 'NATION_0' AND px IS NOT NULL"), p.filter("ticker = 'NATION_1' AND px IS NOT NULL")), f"{o.BASE} SELECT date FROM p WHERE ticker = 'NATION_0' AND px IS NOT NULL INTERSECT SELECT date FROM p WHERE ticker = 'NATION_1' AND px IS NOT NULL")
on_panel("u03_union_of_dates", lambda p: runner.union_of_dates(p.filter("ticker = 'NATION_0' AND px IS NOT NULL"), p.filter("ticker = 'NATION_1' AND px IS NOT NULL")), f"{o.BASE} SELECT DISTINCT date FROM p WHERE ticker IN ('NATION_0', 'NATION_1') AND px IS NOT NULL")
on_panel("a14_first_seen", lambda p: runner.first_seen(p.filter("px IS NOT NULL"), "ticker", "date"), f"{o.BASE} SELECT ticker, min(date) AS date FROM p WHERE px IS NOT NULL GROUP BY 1")

# metrics
_cols = ("total_return", "cagr", "ann_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "skew", "kurt")
on_panel("m13_metrics", lambda p: metrics.compute(curves(p), ["ticker"]).select("ticker", "n_periods", r6(F.col("final_equity"), "final_equity"), *(r6(F.col(c), c) for c in _cols)), f"{o.BASE}{o.METRICS} SELECT ticker, n AS n_periods, round(e1, 6) AS final_equity, round(total_return, 6) AS total_return, round(cagr, 6) AS cagr, round(ann_volatility, 6) AS ann_volatility, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(mdd, 6) AS max_drawdown, round(cagr / abs(mdd), 6) AS calmar, round(win, 6) AS win_rate, round(gain / loss, 6) AS profit_factor, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM m")
on_panel("m07_drawdown_details", lambda p: metrics.drawdown_details(curves(p), ["ticker"]).withColumn("max_drawdown", F.round("max_drawdown", 6)), f"""{o.BASE}{o.CURVE}, t AS (SELECT ticker, arg_min(date, dd) AS trough0, min(dd) AS mdd, max(date) AS fin FROM e GROUP BY 1), t2 AS (SELECT e.ticker, min(e.date) AS trough, any_value(mdd) AS mdd, any_value(fin) AS fin FROM e JOIN t ON e.ticker = t.ticker AND e.dd = t.mdd GROUP BY 1),
h AS (SELECT e.ticker, max(equity) AS pk FROM e JOIN t2 ON e.ticker = t2.ticker AND date <= trough GROUP BY 1), q AS (SELECT e.ticker, any_value(mdd) AS mdd, any_value(trough) AS trough, max(CASE WHEN date <= trough AND equity >= pk THEN date END) AS peak, coalesce(min(CASE WHEN date >= trough AND equity >= pk THEN date END), any_value(fin)) AS recovery FROM e JOIN t2 ON e.ticker = t2.ticker JOIN h ON e.ticker = h.ticker GROUP BY 1),
z AS (SELECT ticker, date, dd < -1e-12 AS f, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, dd < -1e-12 ORDER BY date) AS g FROM e), y AS (SELECT ticker, max(days) AS days FROM (SELECT ticker, g, max(date) - min(date) AS days FROM z WHERE f GROUP BY 1, 2) GROUP BY 1)
SELECT q.ticker, round(mdd, 6) AS max_drawdown, peak, trough, recovery, CAST(recovery - peak AS BIGINT) AS mdd_recovery_days, CAST(coalesce(days, 0) AS BIGINT) AS mdd_duration_days FROM q LEFT JOIN y ON q.ticker = y.ticker""")
on_panel("m12_alpha_beta", lambda p: metrics.alpha_beta(p.select("ticker", "date", "ret"), p.filter("ticker = 'NATION_0'").select("date", F.col("ret").alias("bench")), ["ticker"]).select("ticker", r6(F.col("beta"), "beta"), r6(F.col("alpha"), "alpha")), f"{o.BASE}, x AS (SELECT a.ticker, a.ret AS r, b.ret AS m FROM p a JOIN p b ON a.date = b.date AND b.ticker = 'NATION_0' WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL), g AS (SELECT ticker, covar_samp(r, m) / var_samp(m) AS beta, avg(r) AS r, avg(m) AS m FROM x GROUP BY 1) SELECT ticker, round(beta, 6) AS beta, round(((r - CAST({0.02 / 252!r} AS DOUBLE)) - beta * (m - CAST({0.02 / 252!r} AS DOUBLE))) * 252, 6) AS alpha FROM g")


def trials(p: DataFrame) -> DataFrame:
    return metrics.compute(curves(p), ["ticker"]).withColumnRenamed("ticker", "strategy").withColumn("freq", F.lit("daily"))


_js = "CASE WHEN k >= 3 AND ss > 0 THEN mn + greatest(0, least(1, 1 - (k - 2) * s2 / ss)) * (sharpe - mn) ELSE sharpe END"
on_panel("c06_corrections", lambda p: metrics.corrections(trials(p)).select("strategy", r6(F.col("sharpe"), "sharpe"), r6(F.col("js"), "js"), F.round("emax", 5).alias("emax"), F.round("dsr", 4).alias("dsr"), F.col("raw_rank").cast("long").alias("raw_rank"), F.col("js_rank").cast("long").alias("js_rank")), f"""{o.BASE}{o.METRICS}, a AS (SELECT count(sharpe) AS k, avg(sharpe) AS mn, avg((1 + sharpe * sharpe / 2) / n) AS s2, var_pop(sharpe) * count(sharpe) AS ss, var_pop(sharpe / sqrt(252)) AS v, CAST(count(*) AS DOUBLE) AS trials FROM m),
x AS (SELECT m.ticker, sharpe, sharpe / sqrt(252) AS sr, n, skew, kurt, {_js} AS js, {metrics.expected_max_sql('v', 'trials')} AS emax FROM m, a)
SELECT ticker AS strategy, round(sharpe, 6) AS sharpe, round(js, 6) AS js, round(emax, 5) AS emax, round({metrics.probabilistic_sql('sr', 'emax', 'n', 'skew', '(kurt + 3)')}, 4) AS dsr, CAST(rank() OVER (ORDER BY sharpe DESC) AS BIGINT) AS raw_rank, CAST(rank() OVER (ORDER BY js DESC) AS BIGINT) AS js_rank FROM x""")

# order and presentation
on_panel("o01_top_by_date", lambda p: signals.valued(p, F.round(signals.change("px", 63), 9)).filter("value IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "ticker"))).filter("n <= 3").select("date", "ticker", F.col("n").cast("long").alias("n")), f"{o.BASE}, s AS (SELECT date, ticker, round({o.change('px', 63)}, 9) AS v FROM p), t AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY v DESC, ticker) AS n FROM s WHERE v IS NOT NULL) SELECT * FROM t WHERE n <= 3")
on_panel("o04_comparison", lambda p: metrics.comparison_table(trials(p)).limit(10).select("strategy", r6(F.col("sharpe"), "sharpe")), f"{o.BASE}{o.METRICS} SELECT ticker AS strategy, round(sharpe, 6) AS sharpe FROM m ORDER BY m.sharpe DESC, ticker LIMIT 10")
on_panel("o06_momentum_ranking", lambda p: signals.as_of(signals.momentum_score(p.filter("tradable")), p.agg(F.max("date").alias("date"))).dropna().select("ticker", r6(F.col("value"), "value")).orderBy(F.desc("value"), "ticker").limit(10), f"{o.BASE}, s AS (SELECT date, ticker, tradable, {o.momentum({252: 0.5, 126: 0.3, 63: 0.2})} AS v FROM p) SELECT ticker, round(v, 6) AS value FROM s WHERE tradable AND date = (SELECT max(date) FROM cal) AND v IS NOT NULL ORDER BY round(v, 6) DESC, ticker LIMIT 10")
on_panel("x01_best_flags", lambda p: report.best_flags(trials(p), ["cagr", "ann_volatility"]).select("strategy", "best_cagr", "best_ann_volatility"), f"{o.BASE}{o.METRICS} SELECT ticker AS strategy, cagr = max(cagr) OVER () AS best_cagr, ann_volatility = min(ann_volatility) OVER () AS best_ann_volatility FROM m")
on_panel("x11_drawdown_frame", lambda p: report.drawdown_frame(curves(p).withColumnRenamed("ticker", "strategy").withColumn("freq", F.lit("d"))).select("strategy", "date", r6(F.col("drawdown"), "drawdown")), f"{o.BASE}{o.CURVE} SELECT ticker AS strategy, date, round(100 * dd, 6) AS drawdown FROM e")
on_panel("x16_observations", lambda p: report.observations(trials(p), "nation_0"), f"{o.BASE}{o.METRICS} SELECT max_by(ticker || '/daily', cagr) AS best_cagr, max_by(ticker || '/daily', sharpe) AS best_sharpe, max_by(ticker || '/daily', cagr / abs(mdd)) AS best_calmar, max_by(ticker || '/daily', mdd) AS best_max_drawdown, CAST(coalesce(sum(CASE WHEN cagr > (SELECT max(cagr) FROM m WHERE lower(ticker) LIKE '%nation_0%') THEN 1 END), 0) AS BIGINT) AS beat_buy_and_hold FROM m")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
