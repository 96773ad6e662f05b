"""Performance metrics of equity curves and corrections for many trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.columns import phi_inv_sql, phi_sql, ratio

GAMMA = 0.5772156649015329


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("date")


def curve(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Equity with return and drawdown."""
    w = _order(keys)
    top = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return equity.select(*keys, "date", "equity", (ratio("equity", F.lag("equity").over(w)) - 1).alias("ret"), (ratio("equity", top) - 1).alias("dd"))


def compute(equity: DataFrame, keys: list[str], ppy: int = 252, rf: float = 0.02) -> DataFrame:
    """Return, growth, risk and drawdown measures of each curve in one aggregation."""
    c = curve(equity, keys)
    excess = F.col("ret") - rf / ppy
    years = F.greatest(F.datediff("last", "first") / 365.25, F.lit(1e-9))
    g = c.groupBy(*keys).agg(
        F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("equity").alias("n_points"), F.count("ret").alias("n_periods"),
        F.stddev_samp("ret").alias("sd"), F.avg(excess).alias("ex"), F.stddev_samp(excess).alias("ex_sd"), F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2))).alias("down"), F.min("dd").alias("max_drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)).alias("loss"),
        F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"),
    )
    growth = F.try_divide("e1", "e0")
    n = F.col("n_periods")
    g = g.withColumns({
        "total_return": F.when((F.col("n_points") > 1) & (F.col("e0") != 0), growth - 1),
        "cagr": F.when((F.col("n_points") > 1) & (F.col("e0") > 0) & (growth > 0), F.pow(growth, 1 / years) - 1),
        "ann_volatility": F.col("sd") * ppy**0.5,
        "sharpe": F.when(F.col("ex_sd") > 1e-12, F.try_divide("ex", "ex_sd") * ppy**0.5),
        "sortino": F.when(F.col("down") > 1e-12, F.try_divide("ex", "down") * ppy**0.5),
        "profit_factor": F.when(F.col("loss") > 0, F.try_divide("gain", "loss")).when(F.col("gain") > 0, float("inf")),
        "skew": F.when(n > 2, F.col("g1") * F.try_divide(F.sqrt(n * (n - 1)), (n - 2))),
        "kurt": F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)),
    })
    g = g.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.try_divide("cagr", F.abs("max_drawdown"))))
    return g.select(*keys, F.col("e1").alias("final_equity"), "n_periods", "total_return", "cagr", "ann_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "skew", "kurt")


def drawdown_details(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Peak, trough and recovery of the deepest drawdown, and the longest time under water in calendar days."""
    c = curve(equity, keys)
    deepest = c.groupBy(*keys).agg(F.min_by(F.struct("date", "dd", "equity"), F.struct("dd", "date")).alias("t"), F.max("date").alias("end"))
    high = c.join(deepest, keys).filter(F.col("date") <= F.col("t.date")).groupBy(*keys).agg(F.max("equity").alias("peak_value"))
    around = c.join(deepest, keys).join(high, keys)
    peak = F.max(F.when((F.col("date") <= F.col("t.date")) & (F.col("equity") >= F.col("peak_value")), F.col("date")))
    back = F.min(F.when((F.col("date") >= F.col("t.date")) & (F.col("equity") >= F.col("peak_value")), F.col("date")))
    found = around.groupBy(*keys).agg(F.first("t.date").alias("trough"), F.first("t.dd").alias("max_drawdown"), peak.alias("peak"), F.coalesce(back, F.max("end")).alias("recovery"))
    spells = under_water(c, keys).groupBy(*keys).agg(F.max("days").alias("mdd_duration_days"))
    return found.join(spells, keys, "left").select(*keys, "max_drawdown", "peak", "trough", "recovery", F.datediff("recovery", "peak").cast("long").alias("mdd_recovery_days"), F.coalesce("mdd_duration_days", F.lit(0)).cast("long").alias("mdd_duration_days"))


def islands(rows: DataFrame, keys: list[str], flag) -> DataFrame:
    """Maximal runs of dates on which ``flag`` holds: first, last, calendar days and rows."""
    w = _order(keys)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    new = (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("long")
    runs = marked.withColumn("_r", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_f")
    return runs.groupBy(*keys, "_r").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows")).select(*keys, "first", "last", F.datediff("last", "first").cast("long").alias("days"), "rows")


def under_water(c: DataFrame, keys: list[str]) -> DataFrame:
    return islands(c, keys, F.col("dd") < -1e-12)


def monthly_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Compounded return by month; months without dates inside the range are 0."""
    c = curve(equity, keys).filter("ret IS NOT NULL").withColumn("month", F.trunc("date", "MM"))
    got = c.groupBy(*keys, "month").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    every = c.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return every.join(got, [*keys, "month"], "left").select(*keys, "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_table(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Years by twelve months, and the year's product with missing months as zero."""
    m = monthly_returns(equity, keys).withColumns({"year": F.year("month"), "m": F.month("month")})
    wide = m.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    year = F.lit(1.0)
    for i in range(1, 13):
        year = year * (1 + F.coalesce(F.col(f"`{i}`"), F.lit(0.0)))
    return wide.select(*keys, "year", *(F.col(f"`{i}`").alias(f"m{i}") for i in range(1, 13)), (year - 1).alias("year_return"))


def annual_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    return curve(equity, keys).filter("ret IS NOT NULL").groupBy(*keys, F.year("date").cast("long").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def alpha_beta(returns: DataFrame, bench: DataFrame, keys: list[str], ppy: int = 252, rf: float = 0.02) -> DataFrame:
    """Slope and annual intercept on the benchmark's excess return; null with fewer than three rows or no variance."""
    x = returns.join(bench.select("date", "bench"), "date").dropna(subset=["ret", "bench"])
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp("ret", "bench").alias("c"), F.var_samp("bench").alias("v"), F.avg(F.col("ret") - rf / ppy).alias("y"), F.avg(F.col("bench") - rf / ppy).alias("b"))
    beta = F.when((F.col("n") >= 3) & (F.col("v") > 1e-18), F.try_divide("c", "v"))
    return g.withColumn("beta", beta).select(*keys, "beta", ((F.col("y") - F.col("beta") * F.col("b")) * ppy).alias("alpha"))


def comparison_table(metrics: DataFrame, by: str = "sharpe", ascending: bool = False) -> DataFrame:
    if by not in metrics.columns:
        return metrics
    return metrics.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), "strategy", "freq")


def best_per_strategy(metrics: DataFrame, by: str = "sharpe") -> DataFrame:
    order = F.col(by).desc_nulls_last() if by in metrics.columns else F.col("freq")
    return metrics.withColumn("_n", F.row_number().over(Window.partitionBy("strategy").orderBy(order, "freq"))).filter("_n = 1").drop("_n")


def james_stein(trials: DataFrame, value: str = "sharpe", variance: str = "var") -> DataFrame:
    """Shrinks each value to the mean of all; unchanged with fewer than three values or no spread."""
    s = trials.agg(F.count(value).alias("k"), F.avg(value).alias("m"), F.avg(variance).alias("s2"), (F.var_pop(value) * F.count(value)).alias("ss"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide((F.col("k") - 2) * F.col("s2"), F.col("ss"))))
    return trials.crossJoin(s).withColumn("js", F.when((F.col("k") >= 3) & (F.col("ss") > 0), F.col("m") + c * (F.col(value) - F.col("m"))).otherwise(F.col(value))).drop("k", "m", "s2", "ss")


def expected_max_sql(variance: str, n: str) -> str:
    """Expected greatest Sharpe of n trials; 0 with fewer than two or no variance."""
    two = f"({phi_inv_sql(f'(1 - 1.0e0 / {n})')} * {1 - GAMMA} + {GAMMA} * {phi_inv_sql(f'(1 - 1.0e0 / ({n} * exp(1.0e0)))')})"
    return f"(CASE WHEN {n} < 2 OR coalesce({variance}, 0) <= 0 THEN 0 ELSE sqrt({variance}) * {two} END)"


def probabilistic_sql(sr: str, benchmark: str, n: str, skew: str, kurt: str) -> str:
    """P(true Sharpe > benchmark); all Sharpes per period; kurt is not in excess."""
    spread = f"(1 - {skew} * {sr} + ({kurt} - 1) / 4.0e0 * {sr} * {sr})"
    return phi_sql(f"(({sr} - {benchmark}) * sqrt({n} - 1.0e0) / sqrt(greatest({spread}, 1e-12)))")


def corrections(metrics: DataFrame, ppy: int = 252) -> DataFrame:
    """Raw, shrunken and deflated Sharpe of each trial with ranks; fewer than eight returns give no deflated one."""
    rows = metrics.filter("sharpe IS NOT NULL").withColumn("var", F.try_divide(1 + F.col("sharpe") * F.col("sharpe") / 2, F.col("n_periods"))).withColumn("sr", F.col("sharpe") / ppy**0.5)
    s = rows.agg(F.var_pop("sr").alias("v"), F.count("*").cast("double").alias("trials"))
    rows = james_stein(rows).crossJoin(s).withColumn("emax", F.expr(expected_max_sql("v", "trials")))
    rows = rows.withColumn("dsr", F.when((F.col("n_periods") >= 8), F.expr(probabilistic_sql("sr", "emax", "n_periods", "skew", "(kurt + 3)"))))
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_last()))  # noqa: E731  one row a trial
    return rows.withColumns({"raw_rank": rank("sharpe"), "js_rank": rank("js")}).withColumn("rank_change", F.col("raw_rank") - F.col("js_rank"))


def side_by_side(valid: DataFrame, test: DataFrame, columns: tuple[str, ...] = ("cagr", "sharpe", "sortino", "max_drawdown", "calmar")) -> DataFrame:
    """Every trial's measures in both windows, prefixed."""
    named = lambda df, prefix: df.select("strategy", "freq", *(F.col(c).alias(f"{prefix}_{c}") for c in columns))
    return named(valid, "valid").join(named(test, "test"), ["strategy", "freq"], "outer")


def off_sample(valid: DataFrame, test: DataFrame, by: str = "sharpe") -> DataFrame:
    """Validation and test metrics side by side, the pick on validation flagged, fragile where test falls 0.3 behind."""
    both = valid.select("strategy", "freq", F.col(by).alias("valid")).join(test.select("strategy", "freq", F.col(by).alias("test")), ["strategy", "freq"], "outer")
    best = valid.filter(F.col(by).isNotNull()).agg(F.max_by(F.struct("strategy", "freq"), by).alias("b"))
    chosen = (F.col("strategy") == F.col("b.strategy")) & (F.col("freq") == F.col("b.freq"))
    return both.crossJoin(best).select("strategy", "freq", "valid", "test", F.coalesce(chosen, F.lit(False)).alias("selected"), (F.col("test") < F.col("valid") - 0.3).alias("fragile"))


def numbered(calendar: DataFrame) -> DataFrame:
    """``date, n, size``: distinct dates with their place, from 0, and their number."""
    rows = calendar.select("date").distinct()
    return rows.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("n"), F.count("*").over(Window.partitionBy()).alias("size"))  # one row a date


def chronological_split(calendar: DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """``date, n, split``: train, valid and test, whose sizes are rounded down each; the rest goes to test, which has a date at least."""
    total = sum(ratios)
    if total <= 0:
        raise ValueError("ratios must sum to more than 0")
    size, n = F.col("size"), F.col("n")
    train = F.greatest(F.lit(1), F.floor(size * F.lit(ratios[0]) / F.lit(total)))
    both = F.least(train + F.floor(size * F.lit(ratios[1]) / F.lit(total)), F.greatest(train, size - 1))
    return numbered(calendar).select("date", "n", F.when(n < train, "train").when(n < both, "valid").otherwise("test").alias("split"))


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"))


def walk_forward(n: int, folds: int = 5, first: float = 0.5, embargo: int = 1) -> list[tuple[range, range]]:
    """Training and test rows of each fold over n rows: tests are equal segments, the last one takes the rest, and
    training ends ``embargo`` rows before its test; none for short histories."""
    begin = max(1, int(n * first))
    size = (n - begin) // folds if n >= 10 and folds > 0 else 0
    if size <= embargo + 1:
        return []
    tests = [range(begin + k * size, n if k == folds - 1 else begin + (k + 1) * size) for k in range(folds)]
    return [(range(test.start - embargo), test) for test in tests if test.start - embargo > 1]


def walk_forward_plan(calendar: DataFrame, folds: int = 5, first: float = 0.5, embargo: int = 1) -> DataFrame:
    """``fold, train_end, test_start, test_end``: ``walk_forward`` over the calendar's own dates, in one plan."""
    rows = numbered(calendar)
    begin = f"greatest(1, cast(floor(size * double({first})) AS bigint))"
    sized = rows.withColumn("segment", F.expr(f"(size - {begin}) div {folds}")).filter(f"size >= 10 AND segment > {embargo + 1}")
    k = F.when(F.expr(f"n >= {begin}"), F.least(F.expr(f"(n - {begin}) div segment"), F.lit(folds - 1)))
    tests = sized.withColumn("fold", k).filter("fold IS NOT NULL").groupBy("fold").agg(F.min("n").alias("from"), F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    ends = rows.select(F.col("date").alias("train_end"), (F.col("n") + 1 + embargo).alias("from"))
    return tests.join(ends.filter(F.col("from") > embargo + 1), "from").select("fold", "train_end", "test_start", "test_end")
