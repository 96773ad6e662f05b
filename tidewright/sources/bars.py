"""Bars, panels and dimensions: readers, builders, status and synthetic data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import by_ticker, so_far, change

BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
#: Bounds that a volatility index is compared with: of labels, and of the regime.
VIX_BOUNDS = (15, 20, 25, 35)


def bars_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars over the star schema: a nation is a ticker, its region the category, discounts make the price."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = read("lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_quantity")
    # counts first by supplier and day: what is shuffled is one row for each, not each line
    daily = lines.groupBy("l_suppkey", "date").agg(F.sum("l_discount").alias("d"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.sum("l_quantity").alias("q"), F.count("l_discount").alias("n"))
    joined = daily.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("category"), "date")
    made = joined.agg((F.sum("d") / F.sum("n")).alias("disc"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("q").alias("volume"))
    # rounded, so that equal prices are equal in any order of addition
    close = F.round(100 * F.exp(F.sum(0.5 * (F.col("disc") - 0.05)).over(so_far())), 8)
    return made.withColumn("close", close).select("ticker", "category", "date", "close", (F.col("close") * F.exp(0.5 * (F.col("hi") - F.col("disc")))).alias("high"), (F.col("close") * F.exp(0.5 * (F.col("lo") - F.col("disc")))).alias("low"), "volume")


def vix_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volatility index by date.

    The last bits of a sum of doubles hang on its order, and where the mean lies on a bound of a label (``VIX_BOUNDS``) they decide the
    label. Such dates, few in a large table, are summed again in the table's row order, so that no split of the files shows.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("date"), "l_tax", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    means = lines.groupBy("date").agg((500 * F.avg("l_tax")).alias("mean"))
    close = means.filter(" OR ".join(f"abs(mean - {b}) < 1e-6" for b in VIX_BOUNDS)).select("date")
    own = lines.filter("l_tax IS NOT NULL").join(F.broadcast(close), "date").groupBy("date").agg(F.array_sort(F.collect_list(F.struct("place", "l_tax"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["l_tax"])
    again = own.select("date", (500 * (total / F.size("x"))).alias("again"))
    return means.join(again, "date", "left").select("date", F.coalesce("again", "mean").alias("vix"))


def assets_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, category, pos, tradable``: REGION_4 is not tradable, as indices and currencies are not."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("category"), F.col("n_nationkey").cast("int").alias("pos"), (F.col("n_regionkey") != 4).alias("tradable"))


def read_bars(spark: SparkSession, folder: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars stored as Parquet partitioned by ticker; the tickers asked for prune partitions."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(folder)
    return bars.filter(F.col("ticker").isin(tickers)) if tickers else bars


def append_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` that are not stored yet, by ticker and date."""
    return incoming.dropDuplicates(["ticker", "date"]).join(stored.select("ticker", "date"), ["ticker", "date"], "left_anti")


def update_report(added: DataFrame) -> DataFrame:
    return added.groupBy("ticker").agg(F.count("*").alias("added"), F.min("date").alias("first"), F.max("date").alias("last"))


def build_panel(bars: DataFrame, assets: DataFrame, start: str | None = None, end: str | None = None, min_obs: int = 0, weekly: bool = False) -> DataFrame:
    """One row for each date of the calendar and ticker, prices carried forward from the first bar on and never back.

    The calendar is the union of the bars' dates (weekly: the last date of each Monday-to-Sunday week). Tickers
    with fewer than ``min_obs`` bars are left out. An upper bound on dates is applied to the bars themselves, which
    is right as no value depends on later rows; a lower bound only to the finished panel.
    """
    if end:
        bars = bars.filter(F.col("date") <= F.to_date(F.lit(end)))
    if weekly:
        week = Window.partitionBy("ticker", F.date_trunc("week", "date")).orderBy(F.desc("date"))
        bars = bars.withColumn("_n", F.row_number().over(week)).filter("_n = 1").drop("_n")
        friday = F.date_add(F.date_trunc("week", "date").cast("date"), 4)
        bars = bars.withColumn("date", friday)
    if min_obs:
        bars = bars.join(bars.groupBy("ticker").agg(F.count("close").alias("_n")).filter(F.col("_n") >= min_obs), "ticker", "left_semi")
    calendar = bars.select("date").distinct()
    present = assets.join(bars.select("ticker").distinct(), "ticker", "left_semi")
    grid = calendar.crossJoin(present)
    raw = bars.select("ticker", "date", "close", "high", "low", "volume")
    filled = grid.join(raw, ["ticker", "date"], "left").select("date", "ticker", "category", "tradable", "pos", *(F.last(c, ignorenulls=True).over(so_far()).alias(c) for c in ("close", "high", "low", "volume")))
    panel = filled.withColumn("px", F.col("close")).withColumns({"dollar_volume": F.col("close") * F.col("volume"), "ret": change("px", 1), "available": F.col("px").isNotNull()})
    return panel.filter(F.col("date") >= F.to_date(F.lit(start))) if start else panel


def data_status(assets: DataFrame, bars: DataFrame) -> DataFrame:
    """For each asset: first and last date, bars and the share of them without a close."""
    joined = assets.join(bars.select("ticker", "date", "close"), "ticker", "left").groupBy("ticker", "pos")
    found = joined.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("date").alias("obs"), F.avg(F.when(F.col("date").isNotNull(), F.col("close").isNull().cast("double"))).alias("missing"))
    return found.select("ticker", "first", "last", "obs", "missing")


def ohlc_of_ticks(events: DataFrame) -> DataFrame:
    """Hourly bars of a tick table (event_type, ts, value)."""
    return events.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("hour")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))


def synthetic_bars(spark: SparkSession, days: int = 900, tickers: int = 8, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeded random-walk bars with staggered first dates, assets, and a sinusoid volatility index; for tests."""
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2015-01-01", periods=days).date
    rows, categories = [], ["equity", "bonds", "metals", "abroad"]
    for i in range(tickers):
        first = int(rng.integers(0, days // 6)) if i else 0
        drift, sd = ((0.0004, 0.012), (0.0001, 0.004), (0.0003, 0.012), (0.001, 0.03))[i % 4]
        px = (50 + 5 * i) * np.exp(np.cumsum(rng.normal(drift, sd, days - first)))
        rows += [(f"T{i}", d, float(p), float(p * 1.005), float(p * 0.995), float(p), float(p), float(rng.integers(1_000_000, 8_000_000))) for d, p in zip(dates[first:], px, strict=True)]
    bars = spark.createDataFrame([(t, d, o, h, lo, c, a, v) for t, d, o, h, lo, c, a, v in rows], BAR_SCHEMA)
    assets = spark.createDataFrame([(f"T{i}", categories[i % 4], i, i != tickers - 1) for i in range(tickers)], "ticker string, category string, pos int, tradable boolean")
    level = np.clip(20 + 10 * np.sin(np.linspace(0, 12, days)) + rng.normal(0, 2, days), 9, 80)
    return bars, assets, spark.createDataFrame([(d, float(v)) for d, v in zip(dates, level, strict=True)], "date date, vix double")


def period_last(calendar: DataFrame, freq: str) -> DataFrame:
    """Rebalance dates: the last date of each week, month or quarter (signal: weekly candidates)."""
    unit = {"weekly": "week", "signal": "week", "monthly": "month", "quarterly": "quarter"}.get(freq)
    if unit is None:
        raise ValueError(f"no such frequency: {freq}")
    return calendar.select("date").distinct().groupBy(F.date_trunc(unit, "date").alias("_p")).agg(F.max("date").alias("date")).select("date")


def lagged(x: str, rows: int):
    return F.lag(x, rows).over(by_ticker())
