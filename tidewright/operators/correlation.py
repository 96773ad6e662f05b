"""Correlation between tickers: pairs meet on the date, moments are windows over the pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.signals import trailing_rows


def pairs(panel: DataFrame, value: str = "ret") -> DataFrame:
    """``date, a, b, x, y`` for tickers a < b; both sides are null where one is."""
    left = panel.select("date", F.col("ticker").alias("a"), F.col(value).alias("u"))
    right = panel.select("date", F.col("ticker").alias("b"), F.col(value).alias("v"))
    both = F.col("u").isNotNull() & F.col("v").isNotNull()
    return left.join(right, "date").filter("a < b").select("date", "a", "b", F.when(both, F.col("u")).alias("x"), F.when(both, F.col("v")).alias("y"))


def corr(over=None) -> Column:
    """Pearson correlation of x and y; null without variance."""
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(w(F.covar_samp("x", "y")), w(F.stddev_samp("x")) * w(F.stddev_samp("y")))


def correlation_matrix(panel: DataFrame, rows: int | None = None, until: str | None = None) -> DataFrame:
    """``ticker_a, ticker_b, c`` over the last rows (None or <= 0: all), both directions and the diagonal."""
    if rows and rows > 0:
        panel = trailing_rows(panel, rows, until)
    elif until:
        panel = panel.filter(F.col("date") <= F.to_date(F.lit(until)))
    half = pairs(panel).groupBy("a", "b").agg(corr().alias("c"))
    own = panel.groupBy("ticker").agg(F.when(F.var_samp("ret") > 0, 1.0).alias("c")).select(F.col("ticker").alias("a"), F.col("ticker").alias("b"), "c")
    whole = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).unionByName(own)
    return whole.select(F.col("a").alias("ticker_a"), F.col("b").alias("ticker_b"), "c")


def off_diagonal_mean(matrix: DataFrame) -> DataFrame:
    return matrix.filter("ticker_a != ticker_b").groupBy(F.col("ticker_a").alias("ticker")).agg(F.avg("c").alias("avg_corr"))


#: Share of a window's squares below which what is left of its variance is rounding.
FLAT = 1e-12


def rolling_pairs(panel: DataFrame, rows: int, dates: DataFrame | None = None) -> DataFrame:
    """``date, a, b, c``: correlation over the last ``rows`` calendar rows, null before so many have passed; on ``dates`` only if given.

    Running sums of counts, values, squares and products: a window's moments are differences of two of them, so the cost is one
    pass whatever the window. Returns are small and near zero, which keeps the differences exact to some 14 digits.
    """
    order = Window.partitionBy("a", "b").orderBy("date")
    # a number of its own, as adaptive execution would merge the work of all pairs into one task
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = {"n": F.when(F.col("x").isNotNull(), 1.0).otherwise(0.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    running = pairs(panel).repartition(n, "a", "b").select("date", "a", "b", F.row_number().over(order).alias("row"), F.struct(*(F.sum(F.coalesce(t, F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, t in terms.items())).alias("s"))
    both = running.select("date", "a", "b", "row", "s", F.lag("s", rows).over(order).alias("before"))
    if dates is not None:
        both = both.join(dates.select("date").distinct(), "date", "left_semi")
    m = {k: F.col(f"s.{k}") - F.coalesce(F.col(f"before.{k}"), F.lit(0.0)) for k in terms}
    spread = lambda k: F.when(m[k + k] - m[k] * m[k] / m["n"] > FLAT * m[k + k], m[k + k] - m[k] * m[k] / m["n"])
    c = F.when((F.col("row") >= rows) & (m["n"] > 1), (m["xy"] - m["x"] * m["y"] / m["n"]) / F.sqrt(spread("x") * spread("y")))
    return both.select("date", "a", "b", c.alias("c"))


def both_ways(half: DataFrame) -> DataFrame:
    return half.select("date", F.explode(F.array("a", "b")).alias("ticker"), "c")


def rolling_avg_correlation(panel: DataFrame, rows: int = 120, dates: DataFrame | None = None) -> DataFrame:
    """By date and ticker the mean correlation to all others; on ``dates`` only if given."""
    return both_ways(rolling_pairs(panel, rows, dates)).groupBy("date", "ticker").agg(F.avg("c").alias("value"))


def correlation_change(panel: DataFrame, rows: int = 60) -> DataFrame:
    """Change of the mean over all pairs, by date."""
    means = rolling_pairs(panel, rows).groupBy("date").agg(F.avg("c").alias("mean"))
    return means.select("date", (F.col("mean") - F.lag("mean").over(Window.orderBy("date"))).alias("value"))  # one row a date


def market_correlation(panel: DataFrame, rows: int) -> DataFrame:
    """Mean pair correlation by date among tickers with enough values in the window."""
    own = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(rows - 1), 0)
    counted = panel.withColumn("_n", F.count("ret").over(own)).select("date", "ticker", "_n")
    half = rolling_pairs(panel, rows)
    for side in ("a", "b"):
        half = half.join(counted.select("date", F.col("ticker").alias(side), F.col("_n").alias(f"n_{side}")), ["date", side])
    least = max(3, rows // 2)
    return half.groupBy("date").agg(F.avg(F.when((F.col("n_a") >= least) & (F.col("n_b") >= least), F.col("c"))).alias("value"))


def lead_lag(panel: DataFrame, leader: str, follower: str, most: int = 10) -> DataFrame:
    """``lag, c`` of the leader's return ``lag`` rows before the follower's."""
    wide = panel.groupBy("date").agg(F.max(F.when(F.col("ticker") == leader, F.col("ret"))).alias("l"), F.max(F.when(F.col("ticker") == follower, F.col("ret"))).alias("f"))
    order = Window.orderBy("date")  # one row a date
    shifted = wide.select("f", *(F.lag("l", k).over(order).alias(f"k{k + most}") for k in range(-most, most + 1)))
    stacked = shifted.select("f", F.posexplode(F.array(*(f"k{i}" for i in range(2 * most + 1)))).alias("i", "l"))
    both = F.col("f").isNotNull() & F.col("l").isNotNull()
    return stacked.select((F.col("i") - most).alias("lag"), F.when(both, F.col("l")).alias("x"), F.when(both, F.col("f")).alias("y")).groupBy("lag").agg(corr().alias("c"))


def best_lag(lags: DataFrame) -> DataFrame:
    """The lag of greatest absolute correlation, the lowest on ties; 0 and null if there is none."""
    best = lags.filter("c IS NOT NULL").agg(F.max_by(F.struct("lag", "c"), F.struct(F.abs("c"), -F.col("lag"))).alias("x"))
    return best.select(F.coalesce("x.lag", F.lit(0)).alias("best_lag"), F.col("x.c").alias("c"))


def pca_explained(panel: DataFrame, rows: int = 252, n: int = 3, until: str | None = None) -> DataFrame:
    """``component, ratio``: shares of variance of standardised returns, missing ones as zero.

    The block is rows by tickers, whose number the universe bounds.
    """

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        x = block.pivot(index="date", columns="ticker", values="ret").dropna(axis=1, how="all").fillna(0.0).to_numpy()
        if len(x) < 2 or not x.shape[1]:
            return pd.DataFrame({"component": pd.Series([], dtype="int32"), "ratio": pd.Series([], dtype="float64")})
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
        values = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False, ddof=1).reshape(x.shape[1], -1)))[::-1]
        k = min(n, len(values), len(x))
        return pd.DataFrame({"component": np.arange(1, k + 1, dtype="int32"), "ratio": values[:k] / values.sum()})

    return trailing_rows(panel, rows, until).select("date", "ticker", "ret", F.lit(1).alias("block")).groupBy("block").applyInPandas(solve, "component int, ratio double")
