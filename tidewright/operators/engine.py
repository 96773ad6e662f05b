"""Portfolio simulation: a fold over dates, one group for each trial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.signals import availability

PATH = "strategy string, freq string, date date, equity double, ret double, rebalanced boolean, turnover double, cash double, period_return double"


def trade(holdings: np.ndarray, cash: float, weights: np.ndarray, cost: float) -> tuple[np.ndarray, float, float]:
    """New holdings, cash and turnover for target weights.

    Where cash would not pay the costs, what is bought is brought down to the value less the costs of the trades just
    planned, up to eight times, as smaller trades cost less.
    """
    value = holdings.sum() + cash
    desired = weights * value
    for attempt in range(9):
        traded = np.abs(desired - holdings).sum()
        fee, invested = cost * traded, desired.sum()
        left = value - invested - fee
        if left >= -1e-9 or invested <= 0 or attempt == 8:
            return desired, left, traded / value if value > 0 else 0.0
        desired = desired * (max(value - fee, 0.0) / invested)
    raise AssertionError


def fold(returns: np.ndarray, targets: dict[int, np.ndarray], capital: float, cost: float, gated: bool = False, min_rows: int = 5, threshold: float = 0.10) -> pd.DataFrame:
    """Path of one trial. returns: dates by tickers (missing 0); targets: weights by date number on rebalance dates."""
    holdings, cash, started, last = np.zeros(returns.shape[1]), capital, False, -(10**9)
    rows = []
    for i in range(len(returns)):
        if started:
            holdings = holdings * (1 + returns[i])
        value, acted, turnover = holdings.sum() + cash, False, 0.0
        if i in targets:
            w = targets[i]
            drift = np.abs(w * value - holdings).sum() / value if value else 0.0
            if not (gated and started and (drift < threshold or i - last < min_rows)):
                holdings, cash, turnover = trade(holdings, cash, w, cost)
                started, acted, last = True, True, i
        if started:
            total = holdings.sum() + cash
            rows.append((i, total, acted, turnover, cash / total if total else 0.0))
    out = pd.DataFrame(rows, columns=["i", "equity", "rebalanced", "turnover", "cash"])
    out["ret"] = out["equity"].pct_change()
    marks = out.index[out["rebalanced"]].union(out.index[-1:])
    out["period_return"] = out.loc[marks, "equity"].pct_change()
    return out


def simulate(panel: DataFrame, weights: DataFrame, schedule: DataFrame, capital: float = 100_000.0, cost: float = 0.0015, start: str | None = None, end: str | None = None, min_rows: int = 5, threshold: float = 0.10) -> DataFrame:
    """Daily path of every (strategy, freq) of schedule (strategy, freq, date).

    weights: strategy, freq, date, ticker, w; a scheduled date without weights is all cash. Weights of a date's
    close earn from the next date. Returns and the calendar are copied to each trial: a trial is one group of
    dates by tickers, which the universe and history bound. freq ``signal`` trades only on a drift of ``threshold`` and
    after ``min_rows`` rows. A trial without a scheduled date in the window, or with fewer than two dates, has no path.
    """
    window = panel
    if start:
        window = window.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        window = window.filter(F.col("date") <= F.to_date(F.lit(end)))
    trials = schedule.select("strategy", "freq").distinct()
    data = window.select("date", "ticker", F.coalesce("ret", F.lit(0.0)).alias("x"), F.lit(0).alias("kind")).crossJoin(trials)
    marks = schedule.select("date", F.lit(None).cast("string").alias("ticker"), F.lit(0.0).alias("x"), F.lit(1).alias("kind"), "strategy", "freq")
    targets = weights.select("date", "ticker", F.col("w").alias("x"), F.lit(2).alias("kind"), "strategy", "freq")
    every = data.unionByName(marks).unionByName(targets)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        strategy, freq = x["strategy"].iloc[0], x["freq"].iloc[0]
        wide = x[x["kind"] == 0].pivot(index="date", columns="ticker", values="x").sort_index().fillna(0.0)
        place = {d: i for i, d in enumerate(wide.index)}
        column = {t: i for i, t in enumerate(wide.columns)}
        asked = {place[d]: np.zeros(len(column)) for d in x.loc[x["kind"] == 1, "date"] if d in place}
        for d, t, w in x.loc[x["kind"] == 2, ["date", "ticker", "x"]].itertuples(index=False):
            if place.get(d) in asked and t in column:
                asked[place[d]][column[t]] = w
        out = fold(wide.to_numpy(), asked if len(wide) > 1 else {}, capital, cost, freq == "signal", min_rows, threshold)
        dates = wide.index.to_numpy()
        return pd.DataFrame({"strategy": strategy, "freq": freq, "date": dates[out["i"].to_numpy(dtype=int)] if len(out) else [], "equity": out["equity"], "ret": out["ret"], "rebalanced": out["rebalanced"], "turnover": out["turnover"], "cash": out["cash"], "period_return": out["period_return"]})

    return every.groupBy("strategy", "freq").applyInPandas(run, PATH)


def common_start(panel: DataFrame, warm: int = 252, extra: int = 5, least: int | None = None) -> DataFrame:
    """The first date with enough tradables of full warm-up, or else the calendar's ``warm``-th; ``extra`` rows on, the second last at most."""
    names = panel.filter("tradable").select("ticker").distinct().count()
    need = max(3, min(8, names // 2)) if least is None else least
    ready = availability(panel, warm).withColumn("n", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    size = ready.count()
    first = ready.filter(F.col("ready") >= need).agg(F.min("n").alias("m"))
    at = F.least(F.coalesce("m", F.lit(warm)) + extra, F.lit(max(0, size - 2)))
    return ready.crossJoin(first).filter(F.col("n") == at).select("date")


def benchmark_returns(panel: DataFrame, path: DataFrame, ticker: str) -> DataFrame:
    own = panel.filter(F.col("ticker") == ticker).select("date", F.col("ret").alias("bench"))
    return path.join(own, "date", "left")
