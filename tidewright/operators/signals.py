"""Signals of one ticker over time: each takes a panel and adds or returns a value by date and ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import by_date, by_ticker, so_far, change, ratio, rolling


def valued(panel: DataFrame, value: Column) -> DataFrame:
    return panel.select("date", "ticker", value.alias("value"))


def total_return(panel: DataFrame, rows: int = 252) -> DataFrame:
    return valued(panel, change("px", rows))


absolute_momentum = total_return


def momentum_value(weights: dict[int, float], skip: int = 0) -> Column:
    """Weighted returns over several lookbacks; a missing leg counts zero, null only if all miss."""
    weights = weights or {252: 1.0}
    total = sum(weights.values())
    now = F.lag("px", skip).over(by_ticker()) if skip else F.col("px")
    legs = [ratio(now, F.lag("px", k).over(by_ticker())) - 1 for k in weights]
    parts = [F.coalesce(leg, F.lit(0.0)) * (w / total if total else 0.0) for leg, w in zip(legs, weights.values(), strict=True)]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return F.when(F.coalesce(*legs).isNotNull(), score)


def momentum_score(panel: DataFrame, weights: dict[int, float] | None = None, skip: int = 0) -> DataFrame:
    return valued(panel, momentum_value(weights or {252: 0.5, 126: 0.3, 63: 0.2}, skip))


def ranked(values: DataFrame, ascending: bool = False) -> DataFrame:
    """Rank by date, equal values sharing the least rank; missing values have none."""
    order = F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()
    return values.withColumn("rank", F.when(F.col("value").isNotNull(), F.rank().over(by_date().orderBy(order))))


def dual_momentum(panel: DataFrame, rows: int = 252) -> DataFrame:
    """Ranks among all assets, kept where the return is positive."""
    return ranked(total_return(panel, rows)).select("date", "ticker", F.when(F.col("value") > 0, F.col("rank")).alias("rank"))


def volume_ratio(panel: DataFrame, rows: int = 20, column: str = "volume") -> DataFrame:
    return valued(panel, ratio(column, rolling(F.avg, column, rows, max(2, rows // 2))))


def dollar_volume_ratio(panel: DataFrame, rows: int = 20) -> DataFrame:
    return volume_ratio(panel, rows, "dollar_volume")


def volume_trend(panel: DataFrame, rows: int = 20) -> DataFrame:
    smooth = panel.withColumn("_m", rolling(F.avg, "volume", rows, max(2, rows // 2)))
    return valued(smooth, change("_m", 1))


def _sign() -> Column:
    return F.signum(F.col("close") - F.lag("close", 1).over(by_ticker()))


def obv(panel: DataFrame) -> DataFrame:
    """Cumulated volume by the price's direction; never null."""
    return valued(panel.withColumn("_s", F.coalesce(_sign() * F.col("volume"), F.lit(0.0))), F.sum("_s").over(so_far()))


def money_flow(panel: DataFrame, rows: int = 20, least: int | None = None) -> DataFrame:
    least = max(2, rows // 2) if least is None else least
    flows = panel.withColumns({"_d": F.col("close") * F.col("volume"), "_s": _sign() * F.col("close") * F.col("volume")})
    return valued(flows, ratio(rolling(F.sum, "_s", rows, least), rolling(F.sum, "_d", rows, least)))


def inflow_outflow(panel: DataFrame, rows: int = 20) -> DataFrame:
    return money_flow(panel, rows, 1)


def realized_vol(panel: DataFrame, rows: int = 21, ppy: int = 252) -> DataFrame:
    return valued(panel, rolling(F.stddev_samp, "ret", rows, max(5, rows // 2)) * (ppy**0.5))


def atr(panel: DataFrame, rows: int = 14) -> DataFrame:
    before = F.lag("close", 1).over(by_ticker())
    ranges = panel.withColumn("_t", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return ranges.select("date", "ticker", rolling(F.avg, "_t", rows, max(1, rows // 2)).alias("value"), "close")


def atr_pct(panel: DataFrame, rows: int = 14) -> DataFrame:
    return atr(panel, rows).select("date", "ticker", ratio("value", "close").alias("value"))


def relative_strength(panel: DataFrame, rows: int = 63, benchmark: str | None = None) -> DataFrame:
    """Return over ``rows`` less the benchmark's or the mean of all."""
    tr = total_return(panel, rows)
    base = F.max(F.when(F.col("ticker") == benchmark, F.col("value"))).over(by_date()) if benchmark else F.avg("value").over(by_date())
    return valued(tr, F.col("value") - base)


def wealth_drawdown(panel: DataFrame, rows: int = 40) -> DataFrame:
    """Cumulated return against its rolling maximum."""
    grown = panel.withColumn("_w", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(so_far())))
    return valued(grown, ratio("_w", rolling(F.max, "_w", rows, max(5, rows // 2))) - 1)


def drawdown(panel: DataFrame) -> DataFrame:
    return valued(panel, ratio("px", F.max("px").over(so_far())) - 1)


def availability(panel: DataFrame, warm: int) -> DataFrame:
    """How many tradables have at least ``warm`` available rows, by date."""
    aged = panel.filter("tradable").withColumn("_age", F.sum(F.col("available").cast("long")).over(so_far()))
    return aged.groupBy("date").agg(F.sum((F.col("_age") >= warm).cast("long")).alias("ready"))


def zscore(values: DataFrame) -> DataFrame:
    """Cross-sectional z-score by date (population deviation); no dispersion gives 0, missing stays missing."""
    mean, sd = F.avg("value").over(by_date()), F.stddev_pop("value").over(by_date())
    return valued(values, F.when(F.col("value").isNull(), None).when(sd > 1e-12, F.try_divide(F.col("value") - mean, sd)).otherwise(0.0))


def cross_section(values: DataFrame) -> DataFrame:
    return values.groupBy("date").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.stddev_pop("value").alias("sd_pop"), F.count("value").alias("n"))


def cycle_length(panel: DataFrame, rows: int = 252) -> DataFrame:
    """Twice the span over the sign changes of dispersion about its rolling mean; null without a change."""
    spread = panel.groupBy("date").agg(F.stddev_samp("ret").alias("x"))
    order = Window.orderBy("date")  # one row for each date of the calendar
    size = spread.agg(F.count("x")).first()[0]
    w = min(rows, size)
    frame = order.rowsBetween(-(max(w, 2) - 1), 0)
    off = spread.filter("x IS NOT NULL").withColumn("s", F.signum(F.col("x") - F.avg("x").over(frame)))
    flips = off.filter("s != 0").withColumn("f", (F.col("s") != F.lag("s").over(order)).cast("long")).agg(F.sum("f").alias("flips"))
    return flips.crossJoin(off.agg(F.count("*").alias("span"))).select(F.when(F.col("flips") > 0, 2.0 * F.col("span") / F.col("flips")).alias("cycle"), "flips", "span")


def trailing_rows(panel: DataFrame, rows: int, until: str | None = None) -> DataFrame:
    """The last ``rows`` dates at or before ``until``."""
    dates = panel.select("date").distinct()
    if until:
        dates = dates.filter(F.col("date") <= F.to_date(F.lit(until)))
    return panel.join(dates.orderBy(F.desc("date")).limit(rows), "date", "left_semi")


def as_of(values: DataFrame, dates: DataFrame) -> DataFrame:
    """The last row of each ticker at or before each date, even if its value is missing.

    Both sides meet in one sorted pass by ticker: asked dates are rows that carry the last row seen.
    """
    asked = dates.select("date").distinct().crossJoin(values.select("ticker").distinct()).select("ticker", "date", F.lit(None).cast("struct<v:double>").alias("x"), F.lit(1).alias("ask"))
    both = values.select("ticker", "date", F.struct(F.col("value").cast("double").alias("v")).alias("x"), F.lit(0).alias("ask")).unionByName(asked)
    seen = F.last("x", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("x", seen).filter("ask = 1").select("date", "ticker", F.col("x.v").alias("value"))


