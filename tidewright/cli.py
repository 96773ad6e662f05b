"""Command line: data, analyze, backtest and chart verbs over stored bars."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.config import Config
from tidewright.operators import correlation, metrics, regime, report, runner, signals
from tidewright.operators.strategies import parse_strategies
from tidewright.sources import bars


def load_panel(spark: SparkSession, config: Config, folder: str) -> DataFrame:
    stored = bars.read_bars(spark, folder, config.tickers)
    if stored.isEmpty():
        sys.exit("no bars are stored; run data update first")
    weekly = config.backtest.get("data", {}).get("freq") == "weekly"
    day = lambda key: str(config.setting(key, "")) or None
    return bars.build_panel(stored, config.frame(spark), day("start"), day("end"), config.backtest.get("data", {}).get("min_obs", 0), weekly)


def show(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, False)


def update(spark: SparkSession, args: argparse.Namespace) -> None:
    """Append new bars; ``--full`` replaces the stored bars of the tickers that come in, ``--asset`` takes one ticker only."""
    incoming = spark.read.schema(bars.BAR_SCHEMA).parquet(args.incoming)
    if args.asset:
        incoming = incoming.filter(F.col("ticker") == args.asset)
    stored = bars.read_bars(spark, args.bars) if Path(args.bars).exists() else spark.createDataFrame([], bars.BAR_SCHEMA)
    new = (incoming.dropDuplicates(["ticker", "date"]) if args.full else bars.append_bars(stored, incoming)).persist()
    show(bars.update_report(new))
    writer = new.write.partitionBy("ticker")
    if args.full:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(args.bars)
    else:
        writer.mode("append").parquet(args.bars)


def analyze(panel: DataFrame, config: Config, args: argparse.Namespace) -> None:
    names = config.names_frame(panel.sparkSession)
    labels = lambda: regime.classify(regime.risk_score(panel, report.vix_of(panel, config), config.role("risk_on"), config.role("risk_off")))
    if args.what in ("regime", "all"):
        show(labels().orderBy(F.desc("date")).limit(1))
    if args.what in ("momentum", "all"):
        show(report.momentum_table(panel, names, args.top, config.strategy.get("momentum", {}).get("lookback_weights")), len(config.assets) or 1000)
    if args.what in ("rotation", "all"):
        show(regime.category_rotation(panel, args.lookback))
    if args.what in ("correlation", "all"):
        matrix = correlation.correlation_matrix(panel, args.window)
        small = len(config.assets) <= 12
        show(report.heatmap(matrix) if small else correlation.off_diagonal_mean(matrix).join(names, "ticker", "left").orderBy("avg_corr"))
        show(correlation.pca_explained(panel, max(args.window, 252)))


def backtest(panel: DataFrame, config: Config, args: argparse.Namespace) -> None:
    setup = runner.Setup(panel, config, parse_strategies(args.strategy))
    freqs = (args.rebalance,) if args.rebalance else None
    if args.what == "oos":
        both, chosen = setup.out_of_sample((args.train, args.valid, args.test), args.select, freqs)
        show(both.orderBy(F.desc_nulls_last(f"valid_{args.select}")) if f"valid_{args.select}" in both.columns else both)
        show(chosen.orderBy(F.desc_nulls_last("valid")))
        return
    paths, errors = setup.run(freqs, progress=lambda name, freq: print(f"planned {name} / {freq}"))
    table = setup.measured(paths).persist()
    if not errors.isEmpty():
        show(errors)
    if args.what == "export":
        report.export(table, paths, args.out, ("csv", "json") if args.format == "both" else (args.format,))
    elif args.what == "report":
        report.export(table, paths, args.out)
        report.write_charts(paths, setup.panel, config, args.out)
        text = report.whole_report(table, paths, setup, errors, datetime.datetime.now().strftime("%Y-%m-%d %H:%M"))
        (Path(args.out) / "REPORT.md").write_text(text)
    else:
        show(report.formatted(metrics.comparison_table(table, args.sort)))
        if args.what == "compare":
            show(report.formatted(metrics.best_per_strategy(table, args.sort)))
            show(metrics.corrections(table).select("strategy", "freq", "sharpe", "js", "dsr", "raw_rank", "js_rank", "rank_change").orderBy(F.desc("js")))


def chart(panel: DataFrame, config: Config, args: argparse.Namespace) -> None:
    paths = None
    if args.what in ("equity", "drawdown", "regime", "monthly"):
        names = parse_strategies(args.strategy)
        paths = runner.Setup(panel, config, names).run((args.rebalance,) if args.rebalance else None)[0]
    report.write_charts(paths, panel, config, args.out, (args.what,), args.rebalance, args.window, args.lookback)


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="tidewright")
    whole.add_argument("--config", default="config")
    whole.add_argument("--bars", default="data/bars")
    verbs = whole.add_subparsers(dest="verb", required=True)
    data = verbs.add_parser("data")
    data.add_argument("what", choices=["update", "status"])
    data.add_argument("--incoming", help="folder of new bars as Parquet")
    data.add_argument("--asset", help="one ticker only")
    data.add_argument("--full", action="store_true", help="replace the stored bars of these tickers")
    look = verbs.add_parser("analyze")
    look.add_argument("what", choices=["correlation", "momentum", "regime", "rotation", "all"])
    look.add_argument("--top", type=int)
    test = verbs.add_parser("backtest")
    test.add_argument("what", choices=["run", "compare", "oos", "report", "export"])
    test.add_argument("--sort", default="sharpe")
    test.add_argument("--select", default="sharpe", help="metric that picks on validation")
    for part, share in (("train", 0.6), ("valid", 0.2), ("test", 0.2)):
        test.add_argument(f"--{part}", type=float, default=share)
    test.add_argument("--format", choices=["csv", "json", "both"], default="csv")
    draw = verbs.add_parser("chart")
    draw.add_argument("what", choices=list(report.CHARTS))
    for p in (test, draw):
        p.add_argument("--strategy", help="names with commas; all if left out")
        p.add_argument("--rebalance", help="one frequency; those configured if left out")
        p.add_argument("--out", default="output")
    for p in (look, draw):
        p.add_argument("--window", type=int, default=120)
        p.add_argument("--lookback", type=int, default=63)
    return whole


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    config = Config.load(args.config)
    if args.verb == "data":
        if args.what == "status":
            show(bars.data_status(config.frame(spark), bars.read_bars(spark, args.bars)))
        else:
            update(spark, args)
        return 0
    panel = load_panel(spark, config, args.bars)
    {"analyze": analyze, "backtest": backtest, "chart": chart}[args.verb](panel, config, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
