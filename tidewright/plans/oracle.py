"""DuckDB SQL pieces that the queries are checked against, written apart from the DataFrame code."""

from __future__ import annotations

BASE = """WITH RECURSIVE f AS (
  SELECT n_name AS ticker, r_name AS category, CAST(l_shipdate AS DATE) AS date, SUM(l_discount) / COUNT(l_discount) AS disc,
         MIN(l_discount) AS lo, MAX(l_discount) AS hi, SUM(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3),
b0 AS (SELECT *, round(100 * EXP(SUM(0.5 * (disc - 0.05)) OVER (PARTITION BY ticker ORDER BY date)), 8) AS close FROM f),
bars AS (SELECT ticker, category, date, close, close * EXP(0.5 * (hi - disc)) AS high, close * EXP(0.5 * (lo - disc)) AS low, volume FROM b0),
assets AS (SELECT n_name AS ticker, r_name AS category, CAST(n_nationkey AS INTEGER) AS pos, n_regionkey <> 4 AS tradable FROM nation JOIN region ON n_regionkey = r_regionkey),
vix AS (SELECT CAST(l_shipdate AS DATE) AS date, 500 * AVG(l_tax) AS vix FROM lineitem GROUP BY 1),
cal AS (SELECT DISTINCT date FROM bars),
grid AS (SELECT date, a.* FROM cal, assets a WHERE a.ticker IN (SELECT ticker FROM bars)),
p0 AS (SELECT g.date, g.ticker, g.category, g.tradable, g.pos,
         last_value(close IGNORE NULLS) OVER w AS close, last_value(high IGNORE NULLS) OVER w AS high,
         last_value(low IGNORE NULLS) OVER w AS low, last_value(volume IGNORE NULLS) OVER w AS volume
       FROM grid g LEFT JOIN bars b ON g.ticker = b.ticker AND g.date = b.date
       WINDOW w AS (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, close AS px, close * volume AS dollar_volume, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, close IS NOT NULL AS available FROM p0)
"""
T = "(PARTITION BY ticker ORDER BY date)"


def roll(agg: str, x: str, rows: int, least: int, by: str = "PARTITION BY ticker ") -> str:
    w = f"({by}ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {agg}({x}) OVER {w} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER {T}"


def change(x: str, k: int) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def value(expr: str, source: str = "p", more: str = "") -> str:
    return f"{BASE}{more} SELECT date, ticker, round({expr}, 6) AS value FROM {source}"


def momentum(weights: dict[int, float], skip: int = 0) -> str:
    total = sum(weights.values())
    now = lag("px", skip) if skip else "px"
    legs = [f"({now} / nullif({lag('px', k)}, 0) - 1)" for k in weights]
    return f"CASE WHEN coalesce({', '.join(legs)}) IS NOT NULL THEN {' + '.join(f'coalesce({leg}, 0) * CAST({w / total!r} AS DOUBLE)' for leg, w in zip(legs, weights.values(), strict=True))} END"


PAIRS = """, j AS (SELECT x.date, x.ticker AS a, y.ticker AS b, CASE WHEN y.ret IS NOT NULL THEN x.ret END AS x, CASE WHEN x.ret IS NOT NULL THEN y.ret END AS y
  FROM p x JOIN p y ON x.date = y.date AND x.ticker < y.ticker)"""


def pair_corr(rows: int) -> str:
    w = f"(PARTITION BY a, b ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return PAIRS + f""", c AS (SELECT date, a, b, CASE WHEN row_number() OVER (PARTITION BY a, b ORDER BY date) >= {rows}
  THEN covar_samp(x, y) OVER {w} / nullif(stddev_samp(x) OVER {w} * stddev_samp(y) OVER {w}, 0) END AS c FROM j)"""


ON, OFF = ("NATION_0", "NATION_1", "NATION_5", "NATION_6"), ("NATION_2", "NATION_7")


def names(x: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in x)


REGIME = f""", s0 AS (SELECT date, ticker, {roll('avg', 'ret', 63, 63)} AS m FROM p),
s1 AS (SELECT c.date, CASE WHEN count(CASE WHEN ticker IN ({names(ON)}) THEN 1 END) = 0 THEN 0 ELSE avg(CASE WHEN ticker IN ({names(ON)}) THEN m END) END AS s_on, CASE WHEN count(CASE WHEN ticker IN ({names(OFF)}) THEN 1 END) = 0 THEN 0 ELSE avg(CASE WHEN ticker IN ({names(OFF)}) THEN m END) END AS s_off FROM cal c LEFT JOIN s0 ON c.date = s0.date GROUP BY 1),
v1 AS (SELECT date, vix, coalesce((vix - {roll('avg', 'vix', 63, 63, '')}) / nullif({roll('stddev_samp', 'vix', 63, 63, '')}, 0), 0) AS dev FROM vix),
score AS (SELECT s1.date, coalesce(CASE WHEN s_on IS NULL AND s_off IS NULL THEN NULL ELSE coalesce(s_on, 0) - coalesce(s_off, 0) END, 0) - coalesce(dev, 0) AS score, vix FROM s1 LEFT JOIN v1 ON s1.date = v1.date),
regime AS (SELECT date, CASE WHEN score < 0 AND coalesce(vix > 20, false) THEN 'risk_off' WHEN score > 0 THEN 'risk_on' ELSE 'neutral' END AS regime, score FROM score)"""
DATES = ", d AS (SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date))"
CURVE = """, e AS (SELECT ticker, date, px AS equity, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r,
  px / max(px) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM p WHERE px IS NOT NULL)"""
METRICS = CURVE + f""", m0 AS (SELECT ticker, min_by(equity, date) AS e0, max_by(equity, date) AS e1, count(r) AS n, greatest((max(date) - min(date)) / 365.25e0, 1e-9) AS years,
  stddev_samp(r) AS sd, avg(r - CAST({0.02 / 252!r} AS DOUBLE)) AS ex, sqrt(avg(pow(least(r - CAST({0.02 / 252!r} AS DOUBLE), 0), 2))) AS down, min(dd) AS mdd, avg(CASE WHEN r > 0 THEN 1.0e0 WHEN r IS NOT NULL THEN 0.0e0 END) AS win,
  sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS gain, sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS loss, skewness(r) AS skew, kurtosis(r) AS kurt FROM e GROUP BY 1),
m AS (SELECT *, e1 / e0 - 1 AS total_return, pow(e1 / e0, 1 / years) - 1 AS cagr, sd * sqrt(252) AS ann_volatility, ex / sd * sqrt(252) AS sharpe, ex / down * sqrt(252) AS sortino FROM m0)"""
