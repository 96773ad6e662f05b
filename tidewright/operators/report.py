"""Exports, report text and the frames behind tables and charts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import money, percent, plain_ratio, scrub
from tidewright.operators import correlation, metrics as measures, regime, signals
from tidewright.operators.metrics import curve, islands

LOWER_IS_BETTER = ("ann_volatility", "avg_turnover", "total_turnover")


def export(metrics: DataFrame, paths: DataFrame, folder: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """Metrics as CSV and JSON, curves as CSV by strategy and frequency (whatever the formats); infinities are null."""
    clean = metrics.select(*(scrub(c).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))
    if "csv" in formats:
        clean.coalesce(1).write.mode("overwrite").csv(f"{folder}/metrics_csv", header=True)
    if "json" in formats:
        clean.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics_json")
    safe = paths.withColumn("strategy", F.translate("strategy", "/\\", "__"))
    safe.select("strategy", "freq", "date", "equity").repartition("strategy", "freq").sortWithinPartitions("date").write.mode("overwrite").partitionBy("strategy", "freq").csv(f"{folder}/equity", header=True)


def best_flags(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """For each measure whether a row holds the best value."""
    bounds = metrics.agg(*((F.min if c in LOWER_IS_BETTER else F.max)(c).alias(f"_{c}") for c in columns))
    return metrics.crossJoin(bounds).select("strategy", "freq", *columns, *(F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)).alias(f"best_{c}") for c in columns))


def formatted(metrics: DataFrame) -> DataFrame:
    """The columns that a reader compares, as text, in the order of the rows."""
    title = F.initcap(F.translate("strategy", "_", " "))
    shares = ("total_return", "cagr", "max_drawdown", "win_rate", "avg_turnover")
    as_text = {**{c: percent(F.col(c)) for c in shares}, **{c: plain_ratio(F.col(c)) for c in ("sharpe", "sortino", "calmar")}, "final_equity": money(F.col("final_equity"))}
    order = [c for c in ("total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "avg_turnover", "final_equity") if c in metrics.columns]
    return metrics.select(title.alias("strategy"), "freq", *(as_text[c].alias(c) for c in order))


def observations(metrics: DataFrame, hold: str = "bh") -> DataFrame:
    """Best trial by each measure, and how many beat the best growth of the trials whose name holds ``hold``."""
    best = [F.max_by(F.concat_ws("/", "strategy", "freq"), c).alias(f"best_{c}") for c in ("cagr", "sharpe", "calmar", "max_drawdown")]
    held = metrics.filter(F.lower("strategy").contains(hold.lower())).agg(F.max("cagr").alias("_h"))
    return metrics.crossJoin(held).agg(*best, F.sum(F.coalesce(F.col("cagr") > F.col("_h"), F.lit(False)).cast("long")).alias("beat_buy_and_hold"))


def vix_of(panel: DataFrame, config) -> DataFrame:
    return panel.filter(F.col("ticker").isin(config.role("vix"))).select("date", F.col("px").alias("vix"))


def momentum_table(panel: DataFrame, names: DataFrame, top: int | None = None, weights: dict[int, float] | None = None) -> DataFrame:
    """Tradables by momentum on the last date."""
    score = signals.as_of(signals.momentum_score(panel.filter("tradable"), weights), panel.agg(F.max("date").alias("date")))
    ranked = score.dropna(subset=["value"]).join(names, "ticker", "left").select("ticker", "name", F.col("value").alias("score")).orderBy(F.desc("score"), "ticker")
    return ranked.limit(top) if top else ranked


def snapshot(panel: DataFrame, config) -> dict[str, DataFrame]:
    """The market on the last date: regime, ten best by momentum, rotation, best and worst diversifiers, and principal components."""
    names = config.names_frame(panel.sparkSession)
    labels = regime.classify(regime.risk_score(panel, vix_of(panel, config), config.role("risk_on"), config.role("risk_off")))
    means = correlation.off_diagonal_mean(correlation.correlation_matrix(panel, 120)).join(names, "ticker", "left").filter("avg_corr IS NOT NULL")
    side = lambda order, what: means.orderBy(order, "ticker").limit(5).select(F.lit(what).alias("side"), "ticker", "name", plain_ratio(F.col("avg_corr")).alias("avg_corr"))
    return {
        "Regime": labels.orderBy(F.desc("date")).limit(1).select("date", "regime", plain_ratio(F.col("score")).alias("score")),
        "Momentum, ten best": momentum_table(panel, names, 10, config.strategy.get("momentum", {}).get("lookback_weights")).withColumn("score", F.round("score", 3)),
        "Rotation": regime.category_rotation(panel).select("category", percent(F.col("strength")).alias("strength"), F.round("flow", 3).alias("flow"), "status").orderBy("category"),
        "Mean correlation over 120 rows": side("avg_corr", "lowest").unionByName(side(F.desc("avg_corr"), "highest")),
        "Principal components over 252 rows": correlation.pca_explained(panel, 252).select("component", percent(F.col("ratio")).alias("share")).orderBy("component"),
    }


METHOD = """* Signals use rows up to a date only; weights of a date's close earn from the next date.
* Costs are one-way shares of what is traded at each rebalance, and cash earns nothing.
* All trials begin on one date, so that their curves compare.
* For study only: past results promise nothing, and the best of many trials is partly luck (see the deflated Sharpe)."""


def overview(setup, paths: DataFrame) -> DataFrame:
    """What was run, as two columns."""
    config, span = setup.config, paths.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("strategy", "freq").alias("n")).first()
    costs = config.backtest.get("costs", {})
    rows = [
        ("period", f"{span.a} to {span.b}"), ("assets", f"{len(config.tradable_tickers)} tradable of {len(config.tickers)}"), ("initial capital", f"${config.capital:,.0f}"),
        ("one-way costs", f"{100 * costs.get('commission', 0):.2f}% commission, {100 * costs.get('slippage', 0):.2f}% slippage"), ("risk-free rate", f"{100 * config.risk_free:.1f}%"),
        ("benchmark", str(config.benchmark)), ("frequencies", ", ".join(config.frequencies)), ("trials", str(span.n)),
    ]
    return paths.sparkSession.createDataFrame(rows, "item string, value string")


def whole_report(table: DataFrame, paths: DataFrame, setup, errors: DataFrame, made_at: str) -> str:
    """Overview, comparison, corrections, best schedules, observations, market snapshot, errors, charts and method; a section that fails says so."""
    by_growth = lambda df: formatted(measures.comparison_table(df, "cagr"))
    fixed = measures.corrections(table).orderBy(F.desc_nulls_last("js"))
    sections = {
        "Overview": lambda: markdown_table(overview(setup, paths)),
        "1. Comparison by growth": lambda: markdown_table(by_growth(table)),
        "1b. Sharpe ratios corrected for the number of trials": lambda: markdown_table(fixed.select("strategy", "freq", *(plain_ratio(F.col(c)).alias(c) for c in ("sharpe", "js", "dsr")))),
        "2. Best schedule of each strategy by Sharpe": lambda: markdown_table(by_growth(measures.best_per_strategy(table, "sharpe"))),
        "3. Observations": lambda: markdown_table(observations(table)),
        "4. Market snapshot": lambda: "\n\n".join(f"### {title}\n\n{markdown_table(df)}" for title, df in snapshot(setup.panel, setup.config).items()),
        "Trials without a result": lambda: markdown_table(errors),
        "5. Charts": lambda: "\n".join(f"* {name}: `{name}/` (CSV)" for name in CHARTS),
        "6. Method": lambda: METHOD,
    }
    out = [f"# Backtest report\n\nMade at {made_at}"]
    for title, text in sections.items():
        try:
            out.append(f"## {title}\n\n{text()}")
        except Exception as problem:
            out.append(f"## {title}\n\nfailed: {type(problem).__name__}: {str(problem).splitlines()[0]}")
    return "\n\n".join(out) + "\n"


CHARTS = ("equity", "drawdown", "regime", "monthly", "correlation", "rotation")


def regime_equity_frame(paths: DataFrame, regimes: DataFrame, freq: str | None = None) -> DataFrame:
    """Curves with a flag on dates of risk-off, for shading."""
    off = regimes.select("date", (F.col("regime") == "risk_off").alias("risk_off"))
    return equity_frame(paths, freq).join(off, "date", "left").select("strategy", "freq", "date", "equity", F.coalesce("risk_off", F.lit(False)).alias("risk_off"))


def chart_frame(what: str, paths: DataFrame | None, panel: DataFrame, config, freq: str | None = None, window: int = 120, lookback: int = 63) -> DataFrame:
    """The rows behind one chart of ``CHARTS``."""
    if what == "correlation":
        return heatmap(correlation.correlation_matrix(panel, window))
    if what == "rotation":
        return regime.category_rotation(panel, lookback).orderBy("category")
    if what == "equity":
        return equity_frame(paths, freq).orderBy("strategy", "date")
    if what == "drawdown":
        return drawdown_frame(equity_frame(paths, freq)).orderBy("strategy", "date")
    if what == "monthly":
        return measures.monthly_table(paths, ["strategy", "freq"]).orderBy("strategy", "freq", "year")
    labels = regime.classify(regime.risk_score(panel, vix_of(panel, config), config.role("risk_on"), config.role("risk_off")))
    return regime_equity_frame(paths, labels, freq).orderBy("strategy", "date")


def write_charts(paths: DataFrame | None, panel: DataFrame, config, folder: str, which: tuple[str, ...] = CHARTS, freq: str | None = None, window: int = 120, lookback: int = 63) -> None:
    """One CSV folder for each chart."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for what in which:
        chart_frame(what, paths, panel, config, freq, window, lookback).coalesce(1).write.mode("overwrite").csv(f"{folder}/{what}", header=True)


def equity_frame(paths: DataFrame, freq: str | None = None) -> DataFrame:
    """Curves to draw: the frequency asked for, else each strategy's first; positive values only."""
    rows = paths.filter("equity > 0")
    wanted = rows.filter(F.col("freq") == freq) if freq else rows.limit(0)
    first = rows.groupBy("strategy").agg(F.min("freq").alias("freq"))
    return wanted.unionByName(rows.join(wanted.select("strategy").distinct(), "strategy", "left_anti").join(first, ["strategy", "freq"], "left_semi").select(rows.columns)).select("strategy", "freq", "date", "equity")


def drawdown_frame(paths: DataFrame) -> DataFrame:
    return curve(paths, ["strategy", "freq"]).select("strategy", "freq", "date", (100 * F.col("dd")).alias("drawdown"))


def heatmap(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("ticker_a").pivot("ticker_b").agg(F.first("c")).orderBy("ticker_a")


def risk_off_spans(regimes: DataFrame) -> DataFrame:
    return islands(regimes.withColumn("_k", F.lit(1)), ["_k"], F.col("regime") == "risk_off").drop("_k")


def markdown_table(df: DataFrame) -> str:
    """A small frame as text."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("-" if x is None else str(x) for x in r) + " |" for r in rows])


def markdown_report(metrics: DataFrame, sections: dict[str, DataFrame], made_at: str) -> str:
    """A report with the time given from outside, so that equal inputs give equal text; a failing section says so."""
    parts = [f"# Backtest report\n\nMade at {made_at}", "## Results\n\n" + markdown_table(formatted(metrics)), "## Observations\n\n" + markdown_table(observations(metrics))]
    return "\n\n".join(parts + [f"## {title}\n\n{markdown_table(df)}" for title, df in sections.items()]) + "\n"
