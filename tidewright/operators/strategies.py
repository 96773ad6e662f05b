"""Strategies as set-based queries: ``date, ticker, w`` for all rebalance dates at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import by_date, normalized, rolling, scrub
from tidewright.operators import riskopt, signals
from tidewright.operators.correlation import rolling_avg_correlation

REGISTRY: dict[str, Callable[..., DataFrame]] = {}
ACTIVE = ("topn", "risk_parity", "momentum_score", "regime_based", "min_variance")
BENCHMARKS = ("bench_6040", "bench_equal", "bench_bh")


def register(name: str) -> Callable:
    """A plugin: a function of (panel, dates, params) that returns weights."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return keep


def get_strategy(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise KeyError(f"no strategy {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def parse_strategies(names: str | None) -> list[str]:
    chosen = [n.strip() for n in names.split(",")] if names else [*ACTIVE, *BENCHMARKS]
    for n in chosen:
        get_strategy(n)
    return chosen


def at(values: DataFrame, dates: DataFrame) -> DataFrame:
    """Values on rebalance dates, which are dates of the calendar, so the last row at or before is the row itself."""
    return values.join(dates.select("date").distinct(), "date", "left_semi")


def _weights(df: DataFrame) -> DataFrame:
    return df.select("date", "ticker", F.col("w").cast("double").alias("w")).filter("w > 0")


def available(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return at(panel, dates).filter("tradable AND px IS NOT NULL")


@register("topn")
def topn(panel: DataFrame, dates: DataFrame, n: int = 5, weights: dict[int, float] | None = None, skip: int = 0, absolute: bool = True, min_assets: int = 1, cash_slots: bool = False) -> DataFrame:
    """The n best tradables by momentum (ties by ticker); those of no positive return leave, the others share equally."""
    weights = weights or {252: 1.0}
    own = panel.filter("tradable")
    both = own.select("date", "ticker", "px", signals.momentum_value(weights, skip).alias("score"), signals.change("px", max(weights)).alias("long"))
    live = at(both, dates).filter("px IS NOT NULL AND score IS NOT NULL")
    best = live.withColumn("rank", F.row_number().over(by_date().orderBy(F.desc("score"), "ticker"))).filter(F.col("rank") <= n)
    kept = best.filter("long > 0") if absolute else best
    counted = kept.withColumn("k", F.count("*").over(by_date())).filter(F.col("k") >= min_assets)
    return _weights(counted.withColumn("w", 1.0 / (F.lit(n) if cash_slots else F.col("k"))))


@register("risk_parity")
def risk_parity(panel: DataFrame, dates: DataFrame, rows: int = 63, method: str = "inverse_vol", momentum: bool = False, momentum_rows: int = 126, shrinkage: str = "ledoit_wolf") -> DataFrame:
    own = panel.filter("tradable")
    vol = rolling(F.stddev_samp, "ret", rows, max(5, rows // 2)) * 252**0.5
    live = at(own.select("date", "ticker", "px", vol.alias("vol"), signals.change("px", momentum_rows).alias("mom")), dates).filter("px IS NOT NULL AND vol > 0")
    live = live.filter("mom > 0") if momentum else live
    inverse = _weights(live.withColumn("w", normalized(1 / F.col("vol"), by_date())))
    if method == "inverse_vol":
        return inverse

    def solve(block: np.ndarray, tickers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cov, kept = riskopt.trailing_cov(block, max(20, rows // 2), shrinkage)
        return (np.array([]), np.array([])) if cov is None else (tickers[kept], riskopt.equal_risk(cov))

    exact = _by_covariance(own, live, dates, rows, solve)
    alone = inverse.join(exact.select("date").distinct(), "date", "left_anti")
    return exact.unionByName(alone)


def _by_covariance(own: DataFrame, live: DataFrame, dates: DataFrame, rows: int, solve: Callable) -> DataFrame:
    """For each date the returns of the last ``rows`` rows go to one group: rows by tickers, bounded by the universe."""
    calendar = own.select("date").distinct().withColumn("n", F.row_number().over(signals.Window.orderBy("date")))  # one row a date
    asked = calendar.join(dates.select("date").distinct(), "date", "left_semi").select(F.col("date").alias("at"), F.col("n").alias("last"))
    spans = asked.select("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - rows + 1), F.col("last"))).alias("n")).join(calendar, "n").select("date", "at")
    block = own.select("date", "ticker", "ret").join(spans, "date").join(live.select(F.col("date").alias("at"), "ticker"), ["at", "ticker"])

    def run(x: pd.DataFrame) -> pd.DataFrame:
        wide = x.pivot(index="date", columns="ticker", values="ret")
        names, w = solve(wide.to_numpy(dtype=float), wide.columns.to_numpy())
        return pd.DataFrame({"date": pd.Series([x["at"].iloc[0]] * len(names), dtype=object), "ticker": pd.Series(list(names), dtype=object), "w": pd.Series(list(w), dtype=float)})

    return _weights(block.groupBy("at").applyInPandas(run, "date date, ticker string, w double"))


@register("min_variance")
def min_variance(panel: DataFrame, dates: DataFrame, rows: int = 120, floor: float = 0.0, momentum: bool = False, momentum_rows: int = 126, shrinkage: str = "ledoit_wolf") -> DataFrame:
    own = panel.filter("tradable").withColumn("mom", signals.change("px", momentum_rows))
    live = at(own, dates).filter("px IS NOT NULL" + (" AND mom > 0" if momentum else ""))
    least = max(20, rows // 2)

    def solve(block: np.ndarray, tickers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cov, kept = riskopt.trailing_cov(block, least, shrinkage)
        return (tickers[kept], np.ones(len(kept))) if cov is None else (tickers[kept], riskopt.min_variance(cov, floor))

    return _by_covariance(own.drop("mom"), live, dates, rows, solve)


@register("momentum_score")
def composite(panel: DataFrame, dates: DataFrame, n: int = 8, weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2), vol_rows: int = 63, corr_rows: int = 120, volume_rows: int = 20, absolute: bool = True, momentum: dict[int, float] | None = None, skip: int = 0) -> DataFrame:
    """z-scores of momentum, dollar-volume ratio, low volatility and low correlation; momentum filter before the top n."""
    own = panel.filter("tradable")
    parts = [signals.momentum_score(own, momentum, skip), signals.dollar_volume_ratio(own, volume_rows), signals.realized_vol(own, vol_rows), rolling_avg_correlation(own, corr_rows, dates)]
    total, joined = sum(map(abs, weights)), None
    for i, (part, sign) in enumerate(zip(parts, (1, 1, -1, -1), strict=True)):
        z = signals.zscore(at(part, dates).withColumn("value", sign * F.col("value"))).withColumnRenamed("value", f"z{i}")
        joined = z if joined is None else joined.join(z, ["date", "ticker"], "left")
    score = sum((F.col(f"z{i}") * w for i, w in enumerate(weights)), F.lit(0.0)) / total
    live = joined.withColumn("score", score).join(at(own.select("date", "ticker", "px", signals.change("px", 252).alias("mom")), dates), ["date", "ticker"]).filter("px IS NOT NULL AND score IS NOT NULL" + (" AND mom > 0" if absolute else ""))
    best = live.withColumn("rank", F.row_number().over(by_date().orderBy(F.desc("score"), "ticker"))).filter(F.col("rank") <= n)
    up = F.when(F.col("score") > 0, F.col("score"))
    mass = F.sum(up).over(by_date())
    return _weights(best.withColumn("w", F.when(mass > 0, F.coalesce(up, F.lit(0.0)) / mass).otherwise(1.0 / F.count("*").over(by_date()))))


@register("regime_based")
def regime_based(panel: DataFrame, dates: DataFrame, regimes: DataFrame, on: dict[str, float], off: dict[str, float]) -> DataFrame:
    """Category weights of the regime, split equally over available members; a category without members is cash."""
    rows = [(label, c, float(w)) for label, block in (("risk_on", on), ("risk_off", off)) for c, w in block.items() if c != "cash"]
    blocks = panel.sparkSession.createDataFrame(rows, "block string, category string, share double")
    labelled = at(regimes.select("date", "regime"), dates).withColumn("block", F.when(F.col("regime") == "risk_on", "risk_on").otherwise("risk_off"))
    live = available(panel, dates).join(labelled, "date").join(blocks, ["block", "category"])
    return _weights(live.withColumn("w", F.col("share") / F.count("*").over(signals.Window.partitionBy("date", "category"))))


def budgeted(base: DataFrame, regimes: DataFrame, discrete: bool = True, budgets: tuple[float, float, float] = (1.0, 0.6, 0.3), least: float = 0.0) -> DataFrame:
    """Base weights times a budget by label, or between the lowest and highest by the score's tanh; without a score the middle one."""
    on, mid, off = (F.lit(float(b)) for b in budgets)
    by_label = F.when(F.col("regime") == "risk_on", on).when(F.col("regime") == "risk_off", off).otherwise(mid)
    smooth = F.coalesce(F.greatest(F.lit(float(least)), scrub(off + (on - off) * (0.5 + 0.5 * F.tanh("score")))), mid)
    smooth = F.when(F.col("score").isNull(), mid).otherwise(smooth)
    budget = F.least(F.lit(1.0), F.greatest(F.lit(0.0), by_label if discrete else smooth))
    return _weights(base.join(regimes, "date", "left").withColumn("w", F.col("w") * budget))


@register("regime_budget")
def regime_budget(panel: DataFrame, dates: DataFrame, regimes: DataFrame, base: str = "topn", base_params: dict | None = None, discrete: bool = True, budgets: tuple[float, float, float] = (1.0, 0.6, 0.3), least: float = 0.0) -> DataFrame:
    """Another strategy's weights, as large as the regime allows; the rest is cash."""
    return budgeted(get_strategy(base)(panel, dates, **(base_params or {})), regimes, discrete, budgets, least)


def fixed(panel: DataFrame, dates: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Given shares of those available; what is missing is cash."""
    wanted = panel.sparkSession.createDataFrame([(t, float(w)) for t, w in shares.items()], "ticker string, share double")
    return _weights(available(panel, dates).join(wanted, "ticker").withColumn("w", normalized(F.col("share"), by_date())))


@register("bench_6040")
def bench_6040(panel: DataFrame, dates: DataFrame, equity: str | None = None, bonds: str | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    return fixed(panel, dates, shares or {t: w for t, w in ((equity, 0.6), (bonds, 0.4)) if t})


@register("bench_bh")
def bench_bh(panel: DataFrame, dates: DataFrame, ticker: str | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    return fixed(panel, dates, shares or {t: 1.0 for t in (ticker,) if t})


@register("bench_equal")
def bench_equal(panel: DataFrame, dates: DataFrame, members: tuple[str, ...] = ()) -> DataFrame:
    live = available(panel, dates)
    live = live.filter(F.col("ticker").isin(*members)) if members else live
    return _weights(live.withColumn("w", 1.0 / F.count("*").over(by_date())))


#: Rows of history that a strategy needs before its weights mean something, from its parameters.
WARM = {
    "topn": lambda p: max(p.get("weights") or {252: 1.0}) + p.get("skip", 0),
    "risk_parity": lambda p: max(p.get("rows", 63), p.get("momentum_rows", 126) if p.get("momentum") else 0),
    "momentum_score": lambda p: max(252, *(p.get("momentum") or {252: 1.0}), p.get("vol_rows", 63), p.get("corr_rows", 120), p.get("volume_rows", 20)),
    "min_variance": lambda p: max(p.get("rows", 120), p.get("momentum_rows", 126) if p.get("momentum") else 0),
    "regime_based": lambda p: 126,
    "regime_budget": lambda p: max(126, warm_up(p.get("base", "topn"), p.get("base_params") or {})),
    **{name: lambda p: 1 for name in BENCHMARKS},
}


def warm_up(name: str, params: dict) -> int:
    return WARM.get(name, lambda p: 252)(params)


def overlay(weights: DataFrame, max_single: float = 1.0, max_gross: float = 1.0, market: DataFrame | None = None, threshold: float = 0.85, budget: float = 0.5) -> DataFrame:
    """Caps on single and gross weights (nothing is redistributed), and a cut where mean correlation spikes."""
    w = F.least(F.col("w"), F.lit(max_single)) if max_single < 1 else F.col("w")
    capped = weights.withColumn("w", w)
    gross = F.sum("w").over(by_date())
    capped = capped.withColumn("w", F.when(gross > max_gross, F.col("w") * max_gross / gross).otherwise(F.col("w")))
    if market is not None:
        spike = market.groupBy("date").agg(F.avg("value").alias("_c"))
        capped = capped.join(spike, "date", "left").withColumn("w", F.when(F.col("_c") > threshold, F.col("w") * budget).otherwise(F.col("w")))
    return _weights(capped)
