"""Market regimes by rule, category rotation and the features of the hidden Markov model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import add_filled, rolling
from tidewright.operators.correlation import market_correlation
from tidewright.operators.signals import inflow_outflow, relative_strength, wealth_drawdown

DEAD_BAND = 1e-3


def calendar_order():
    """For series of one row a date."""
    return Window.orderBy("date")


def sleeve(panel: DataFrame, tickers: list[str], rows: int) -> DataFrame:
    """Mean over tickers of the rolling mean return, full windows only; an empty sleeve is 0."""
    own = F.col("ticker").isin(tickers)
    means = panel.withColumns({"m": rolling(F.avg, "ret", rows, rows), "own": own})
    value = F.when(F.max("own"), F.avg(F.when(F.col("own"), F.col("m")))).otherwise(0.0)
    return means.groupBy("date").agg(value.alias("value"))


def vix_deviation(vix: DataFrame, rows: int) -> DataFrame:
    frame = calendar_order().rowsBetween(-(rows - 1), 0)
    full = F.count("vix").over(frame) >= rows
    z = F.try_divide(F.col("vix") - F.avg("vix").over(frame), F.stddev_samp("vix").over(frame))
    return vix.select("date", F.coalesce(F.when(full, z), F.lit(0.0)).alias("dev"), "vix")


def risk_score(panel: DataFrame, vix: DataFrame, on: list[str], off: list[str], rows: int = 63) -> DataFrame:
    """``date, score, vix``: risk-on less risk-off less volatility deviation, missing sides as zero."""
    dates = panel.select("date").distinct()
    joined = dates.join(sleeve(panel, on, rows).withColumnRenamed("value", "on"), "date", "left").join(sleeve(panel, off, rows).withColumnRenamed("value", "off"), "date", "left").join(vix_deviation(vix, rows), "date", "left")
    return joined.select("date", add_filled(add_filled(F.col("on"), F.col("off"), -1), F.coalesce("dev", F.lit(0.0)), -1).alias("score"), "vix")


def classify(scores: DataFrame, threshold: float = 20.0) -> DataFrame:
    """``date, regime, score``; a missing volatility index is not elevated."""
    label = F.when((F.col("score") < 0) & F.coalesce(F.col("vix") > threshold, F.lit(False)), "risk_off").when(F.col("score") > 0, "risk_on").otherwise("neutral")
    return scores.select("date", label.alias("regime"), "score")


def regime_at(regimes: DataFrame, dates: DataFrame) -> DataFrame:
    """The last regime at or before each date; neutral before the first."""
    both = regimes.select("date", "regime", F.lit(0).alias("ask")).unionByName(dates.select("date", F.lit(None).cast("string").alias("regime"), F.lit(1).alias("ask")))
    seen = F.last("regime", ignorenulls=True).over(Window.orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0))  # dates only
    return both.withColumn("regime", F.coalesce(seen, F.lit("neutral"))).filter("ask = 1").select("date", "regime")


def category_rotation(panel: DataFrame, rows: int = 63, until: str | None = None) -> DataFrame:
    """Relative strength and flow of each category's tradables on the last date, with a status.

    The baseline averages all tickers; categories without a tradable are left out.
    """
    if until:
        panel = panel.filter(F.col("date") <= F.to_date(F.lit(until)))
    last = panel.agg(F.max("date").alias("date"))
    both = relative_strength(panel, rows).withColumnRenamed("value", "rs").join(inflow_outflow(panel, rows).withColumnRenamed("value", "flow"), ["date", "ticker"]).join(last, "date")
    tradable = panel.filter("tradable").select("ticker", "category").distinct()
    found = both.join(tradable, "ticker").groupBy("category").agg(F.avg("rs").alias("strength"), F.avg("flow").alias("flow"))
    status = F.when((F.col("strength") > DEAD_BAND) & (F.col("flow") > 0), "inflow").when((F.col("strength") < -DEAD_BAND) & (F.col("flow") < 0), "outflow").otherwise("neutral")
    return found.withColumn("status", status)


def market_sleeve(panel: DataFrame, wanted: list[str], without: str = "crypto", least: int = 2, most: int = 6) -> list[str]:
    """The tickers that stand for the market: those wanted and present, one category left out as its history is short; with
    fewer than ``least`` of them the first ``most`` tradables instead."""
    known = panel.select("ticker", "category", "tradable", "pos").distinct().filter(F.col("category") != without).orderBy("pos", "ticker").collect()  # the universe
    own = [r.ticker for r in known if r.ticker in set(wanted)]
    return own if len(own) >= least else [r.ticker for r in known if r.tradable][:most]


def market_features(panel: DataFrame, vix: DataFrame, tickers: list[str], vol_rows: int = 20, dd_rows: int = 40) -> DataFrame:
    """Return, volatility, mean correlation, dispersion, drawdown and volatility index of ``market_sleeve``, by date."""
    own = panel.filter(F.col("ticker").isin(market_sleeve(panel, tickers)))
    series = own.groupBy("date").agg(F.avg("ret").alias("mkt_ret"), F.stddev_samp("ret").alias("disp"))
    frame = calendar_order().rowsBetween(-(vol_rows - 1), 0)
    series = series.withColumn("mkt_vol", F.when(F.count("mkt_ret").over(frame) >= max(5, vol_rows // 2), F.stddev_samp("mkt_ret").over(frame)) * 252**0.5)
    as_panel = series.select("date", F.lit("market").alias("ticker"), F.col("mkt_ret").alias("ret"))
    fall = wealth_drawdown(as_panel, dd_rows).select("date", F.col("value").alias("dd"))
    near = market_correlation(own, vol_rows).withColumnRenamed("value", "avg_corr")
    return series.join(near, "date", "left").join(fall, "date", "left").join(vix, "date", "left").select("date", "mkt_ret", "mkt_vol", "avg_corr", "disp", "dd", "vix")
