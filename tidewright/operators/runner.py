"""Suites of strategies over schedules, windows and parameter grids."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import change
from tidewright.operators import engine, hmm, metrics, regime, signals
from tidewright.operators.correlation import rolling_avg_correlation
from tidewright.operators.strategies import at, get_strategy, overlay, warm_up
from tidewright.sources.bars import period_last
from tidewright.sources.scratch import stash

FREQS = ("weekly", "monthly", "quarterly", "signal")
KEYS = ["strategy", "freq"]
Trial = Callable[[DataFrame], DataFrame]


def between(calendar: DataFrame, start: str | None, end: str | None) -> DataFrame:
    dates = calendar.select("date").distinct()
    for bound, sign in ((start, ">="), (end, "<=")):
        if bound:
            dates = dates.filter(F.expr(f"date {sign} DATE'{bound}'"))
    return dates


def suite(panel: DataFrame, trials: dict[str, Trial], freqs: tuple[str, ...] = ("monthly",), start: str | None = None, end: str | None = None, cost: float = 0.0015, progress: Callable[[str, str], None] | None = None, errors: list[tuple[str, str, str]] | None = None, **engine_params) -> DataFrame:
    """Paths of all trials (name: dates -> weights) by all frequencies as one query; signals see the whole history.

    errors: a list that takes (strategy, freq, message) of trials that can't be planned, which then have no path; without
    it the first such trial raises.
    """
    inside = between(panel, start, end)
    weights = schedule = None
    for name, freq in itertools.product(trials, freqs):
        key = [F.lit(name).alias("strategy"), F.lit(freq).alias("freq")]
        try:
            dates = period_last(inside, freq)
            w = trials[name](dates).select("date", "ticker", "w", *key)
        except Exception as problem:
            if errors is None:
                raise
            errors.append((name, freq, f"{type(problem).__name__}: {problem}".splitlines()[0]))
            continue
        s = dates.select("date", *key)
        weights, schedule = (w, s) if weights is None else (weights.unionByName(w), schedule.unionByName(s))
        if progress:
            progress(name, freq)
    if weights is None:
        return panel.sparkSession.createDataFrame([], engine.PATH)
    return engine.simulate(panel, weights, schedule, cost=cost, start=start, end=end, **engine_params)


def by_name(panel: DataFrame, name: str, **params) -> Trial:
    return lambda dates: get_strategy(name)(panel, dates, **params)


def guarded(panel: DataFrame, trial: Trial, caps: dict) -> Trial:
    """A trial whose weights pass the risk overlay: caps, and a cut where the tradables' mean correlation spikes."""
    spike = caps.get("corr_spike") or {}
    limits = {"max_single": float(caps.get("max_single_weight", 1.0)), "max_gross": float(caps.get("max_gross", 1.0))}
    if not spike.get("enabled"):
        return lambda dates: overlay(trial(dates), **limits)
    market = lambda dates: rolling_avg_correlation(panel.filter("tradable"), int(spike.get("window", 120)), dates)
    return lambda dates: overlay(trial(dates), market=market(dates), threshold=float(spike.get("threshold", 0.85)), budget=float(spike.get("override_budget", 0.5)), **limits)


def first_date(panel: DataFrame, warm: int) -> str:
    """The date from which all trials of a suite run, whose longest warm-up this is."""
    return str(engine.common_start(panel, warm).first()[0])


class Setup:
    """Trials, window, costs and overlay as a configuration has them, over a panel that is written once."""

    def __init__(self, panel: DataFrame, config, names: list[str], vix: DataFrame | None = None):
        self.panel, self.config = stash(panel, "panel"), config
        if vix is None:
            vix = self.panel.filter(F.col("ticker").isin(config.role("vix"))).select("date", F.col("px").alias("vix"))
        self.vix = vix
        given = {name: self.params_of(name) for name in names}
        self.warm = max((warm_up(name, p) for name, p in given.items()), default=252)
        self.trials = {name: by_name(self.panel, name, **p) for name, p in given.items()}
        caps = config.backtest.get("risk_overlay") or {}
        if caps.get("enabled"):
            self.trials = {name: guarded(self.panel, t, caps) for name, t in self.trials.items()}

    def params_of(self, name: str, base: dict | None = None) -> dict:
        """A strategy's parameters from the configuration; ``base`` overrides what is configured."""
        found = self.config.strategy_args(name, base)
        if name == "regime_based":
            found["regimes"] = self.regimes("rule")
        if name == "regime_budget":
            found["regimes"] = self.regimes(found.pop("source", "rule"))
            found["base_params"] = self.params_of(found.get("base", "topn"), found.get("base_params"))
        return found

    def regimes(self, source: str) -> DataFrame:
        if source == "hmm":
            return hmm.classify_hmm(regime.market_features(self.panel, self.vix, self.config.role("risk_on")))
        return regime.classify(regime.risk_score(self.panel, self.vix, self.config.role("risk_on"), self.config.role("risk_off")))

    def run(self, freqs: tuple[str, ...] | None = None, window: tuple[str | None, str | None] = (None, None), progress: Callable[[str, str], None] | None = None) -> tuple[DataFrame, DataFrame]:
        """Paths, and ``strategy, freq, error`` of the trials without one. All begin at the common start, or later where the window does."""
        signal = self.config.backtest.get("rebalance", {}).get("signal", {})
        freqs = tuple(freqs or self.config.frequencies)
        start = max(x for x in (window[0], first_date(self.panel, self.warm)) if x)
        failed: list[tuple[str, str, str]] = []
        paths = suite(
            self.panel, self.trials, freqs, start, window[1], self.config.cost, progress, failed,
            capital=self.config.capital, min_rows=int(signal.get("min_interval_days", 5)), threshold=float(signal.get("turnover_threshold", 0.0)),
        )
        paths = stash(paths, "paths")
        spark = self.panel.sparkSession
        told = spark.createDataFrame(failed, "strategy string, freq string, error string")
        asked = spark.createDataFrame(list(itertools.product(self.trials, freqs)), "strategy string, freq string")
        silent = asked.join(paths.select(*KEYS).distinct(), KEYS, "left_anti").join(told, KEYS, "left_anti")
        return paths, told.unionByName(silent.withColumn("error", F.lit("no position in the window")))

    def measured(self, paths: DataFrame) -> DataFrame:
        """``measured`` with alpha and beta on the configured benchmark."""
        rf = self.config.risk_free
        bench = self.panel.filter(F.col("ticker") == self.config.benchmark).select("date", F.col("ret").alias("bench"))
        return measured(paths, rf).join(metrics.alpha_beta(paths, bench, KEYS, rf=rf), KEYS, "left")

    def out_of_sample(self, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), select: str = "sharpe", freqs: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
        """Validation and test side by side: every measure, and the pick by ``select`` on validation with what it does in test."""
        bounds = windows(self.panel, ratios)
        valid, test = (stash(self.measured(self.run(freqs, bounds[w])[0]), w) for w in ("valid", "test"))
        return metrics.side_by_side(valid, test), metrics.off_sample(valid, test, select)


def windows(panel: DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> dict[str, tuple[str, str]]:
    """First and last date of train, valid and test."""
    found = {r.split: (str(r["first"]), str(r["last"])) for r in metrics.split_summary(metrics.chronological_split(panel, ratios)).collect()}
    if "valid" not in found or "test" not in found:
        raise ValueError("not enough history for validation and test windows")
    return found


#: Momentum blends of the sweep: weights by lookback, and rows skipped before now.
LOOKBACKS: dict[str, tuple[dict[int, float], int]] = {
    "blend_12_6_3": ({252: 0.5, 126: 0.3, 63: 0.2}, 0),
    "mom_12m": ({252: 1.0}, 0),
    "mom_12_1": ({252: 1.0}, 21),
    "mom_6m": ({126: 1.0}, 0),
    "mom_3m": ({63: 1.0}, 0),
    "blend_12_6": ({252: 0.5, 126: 0.5}, 0),
}
SIZES = (3, 5, 7, 10)


def sweep_weights(panel: DataFrame, dates: DataFrame, sizes: tuple[int, ...] = SIZES, lookbacks: dict[str, tuple[dict[int, float], int]] | None = None, filters: tuple[bool, ...] = (True, False)) -> DataFrame:
    """``n, lookback, filt, date, ticker, w`` of a top-n grid in one plan: momentum once for each lookback, sizes and filters as rows."""
    lookbacks = lookbacks or LOOKBACKS
    own = panel.filter("tradable").select("date", "ticker", "px", *(F.struct(signals.momentum_value(w, skip).alias("score"), change("px", max(w)).alias("long"), F.lit(name).alias("lookback")).alias(name) for name, (w, skip) in lookbacks.items()))
    live = at(own, dates).filter("px IS NOT NULL").select("date", "ticker", F.explode(F.array(*lookbacks)).alias("x")).select("date", "ticker", "x.*").filter("score IS NOT NULL")
    order = signals.Window.partitionBy("date", "lookback").orderBy(F.desc("score"), "ticker")
    ranked = live.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(sizes))
    grid = F.array(*(F.struct(F.lit(n).alias("n"), F.lit("on" if f else "off").alias("filt")) for n, f in itertools.product(sizes, filters)))
    kept = ranked.withColumn("knobs", F.explode(grid)).select("*", "knobs.*").filter("rank <= n AND (filt = 'off' OR long > 0)")
    return kept.select("n", "lookback", "filt", "date", "ticker", (1.0 / F.count("*").over(signals.Window.partitionBy("date", "lookback", "n", "filt"))).alias("w"))


def sweep(panel: DataFrame, sizes: tuple[int, ...] = SIZES, lookbacks: dict[str, tuple[dict[int, float], int]] | None = None, filters: tuple[bool, ...] = (True, False), cost: float = 0.0015) -> DataFrame:
    """One row for each trial of the grid, monthly from the common start: the whole period, validation and test, shrunken and
    deflated Sharpe over all trials."""
    panel, lookbacks = stash(panel, "panel"), lookbacks or LOOKBACKS
    bounds, start = windows(panel), first_date(panel, max(next(iter(lookbacks.values()))[0]))
    spark, tables = panel.sparkSession, {}
    grid = spark.createDataFrame([(n, k, "on" if f else "off") for n, k, f in itertools.product(sizes, lookbacks, filters)], "n int, lookback string, filt string")
    key = [F.concat_ws("-", "n", "lookback", "filt").alias("strategy"), F.lit("monthly").alias("freq")]
    for window, (low, high) in {"full": (start, None), "valid": (max(bounds["valid"][0], start), bounds["valid"][1]), "test": (max(bounds["test"][0], start), bounds["test"][1])}.items():
        dates = period_last(between(panel, low, high), "monthly")
        schedule = dates.join(grid.hint("broadcast")).select("date", *key)  # as many rows as months and trials
        weights = sweep_weights(panel, dates, sizes, lookbacks, filters).select("date", "ticker", "w", *key)
        tables[window] = measured(engine.simulate(panel, weights, schedule, cost=cost, start=low, end=high))
    full = stash(tables["full"], "full")
    out = grid.select("*", *key)
    named = lambda df, window, *columns: df.select("strategy", *(F.col(c).alias(f"{window}_{c}") for c in columns))
    out = out.join(named(full, "full", "cagr", "sharpe", "max_drawdown", "calmar"), "strategy").join(full.select("strategy", "n_periods"), "strategy")
    out = out.join(named(tables["valid"], "valid", "sharpe"), "strategy", "left").join(named(tables["test"], "test", "sharpe", "max_drawdown"), "strategy", "left")
    return out.join(metrics.corrections(full).select("strategy", "js", "dsr"), "strategy", "left").drop("freq")


def marginal_means(table: DataFrame, by: tuple[str, ...] = ("full_sharpe", "valid_sharpe", "test_sharpe", "full_max_drawdown")) -> DataFrame:
    """Means of measures by each knob of a sweep in one pass."""
    knobs = table.select("n", "lookback", "filt", *by)
    return knobs.groupingSets([["n"], ["lookback"], ["filt"]], "n", "lookback", "filt").agg(*(F.avg(c).alias(c) for c in by))


def hmm_comparison(panel: DataFrame, vix: DataFrame, on: list[str], off: list[str], topn: dict | None = None, cost: float = 0.0015) -> DataFrame:
    """``window, strategy, ...``: the top-n strategy, the same without its filter, and that under budgets by the hidden Markov
    model's and by the rules' scores; the whole period, validation and test."""
    panel, topn = stash(panel, "panel"), topn or {}
    always = {**topn, "absolute": False}
    rules = stash(regime.classify(regime.risk_score(panel, vix, on, off)), "rules")
    model = stash(hmm.classify_hmm(regime.market_features(panel, vix, on)), "model")
    budget = lambda regimes: by_name(panel, "regime_budget", regimes=regimes, base="topn", base_params=always, discrete=False)
    trials = {"topn": by_name(panel, "topn", **topn), "topn_no_filter": by_name(panel, "topn", **always), "hmm_budget": budget(model), "rule_budget": budget(rules)}
    start, bounds, out = first_date(panel, max(126, warm_up("topn", topn))), windows(panel), None
    for window, (low, high) in {"full": (start, None), "valid": (max(bounds["valid"][0], start), bounds["valid"][1]), "test": (max(bounds["test"][0], start), bounds["test"][1])}.items():
        found = measured(suite(panel, trials, ("monthly",), low, high, cost)).select(F.lit(window).alias("window"), "strategy", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "final_equity")
        out = found if out is None else out.unionByName(found)
    return out


def measured(paths: DataFrame, rf: float = 0.02) -> DataFrame:
    """Metrics of each trial with what its rebalances tell."""
    base = metrics.compute(paths.select(*KEYS, "date", "equity"), KEYS, rf=rf).drop("win_rate", "profit_factor")
    gain, loss = F.sum(F.when(F.col("period_return") > 0, F.col("period_return"))), F.sum(F.when(F.col("period_return") < 0, -F.col("period_return")))
    more = paths.groupBy(*KEYS).agg(F.sum(F.col("rebalanced").cast("long")).alias("n_rebalances"), F.avg(F.when(F.col("rebalanced"), F.col("turnover"))).alias("avg_turnover"), F.sum("turnover").alias("total_turnover"), F.avg((F.col("period_return") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, float("inf")).alias("profit_factor"))
    return base.join(more, KEYS)


def out_of_sample(panel: DataFrame, trials: dict[str, Trial], freqs: tuple[str, ...] = ("monthly",), start: str | None = None, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), select: str = "sharpe") -> DataFrame:
    """Validation and test windows of one chronological split, and the validation's pick."""
    bounds = windows(panel, ratios)
    tables = [measured(suite(panel, trials, freqs, max(filter(None, (bounds[w][0], start))), bounds[w][1])) for w in ("valid", "test")]
    return metrics.off_sample(*tables, by=select)


def union_of_dates(*frames: DataFrame) -> DataFrame:
    """Dates of any of the frames."""
    out = frames[0].select("date")
    for f in frames[1:]:
        out = out.unionByName(f.select("date"))
    return out.distinct()


def shared_dates(*frames: DataFrame) -> DataFrame:
    """Dates of all of the frames."""
    out = frames[0].select("date").distinct()
    for f in frames[1:]:
        out = out.intersect(f.select("date"))
    return out


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they come first."""
    return rows.groupBy(column).agg(F.min(order).alias(order)).orderBy(order, column)
