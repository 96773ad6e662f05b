"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


# Windows are made when asked for: Python workers import these modules without a session.
def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def so_far():
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def by_date():
    return Window.partitionBy("date")


def trailing(rows: int):
    """The last ``rows`` rows of a ticker."""
    return by_ticker().rowsBetween(-(rows - 1), 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(how: Callable[[Column], Column], x: Column | str, rows: int, least: int) -> Column:
    """An aggregate over the last rows, null with fewer than ``least`` values."""
    return F.when(F.count(col(x)).over(trailing(rows)) >= least, how(col(x)).over(trailing(rows)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null instead of an error or infinity."""
    return F.try_divide(col(a), col(b))


def change(x: Column | str, rows: int) -> Column:
    return ratio(x, F.lag(col(x), rows).over(by_ticker())) - 1


def add_filled(a: Column, b: Column, sign: int = 1) -> Column:
    """a + sign * b in which one missing side counts as zero; null if both miss."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + sign * F.coalesce(b, F.lit(0.0)))


def finite(x: Column | str) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) < float("inf"))


def scrub(x: Column | str) -> Column:
    return F.when(finite(x), col(x))


#: Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
#: Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def horner(coefficients: tuple[float, ...], x: str, last: str = "") -> str:
    """SQL text of a polynomial, highest power first."""
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return f"({out} * {x} + {last})" if last else out


def phi_sql(x: str) -> str:
    """SQL text, the same for any engine, of the normal distribution function (absolute error about 1e-7)."""
    t = f"(1 / (1 + CAST({ERF_P} AS DOUBLE) * abs(({x}) / sqrt(CAST(2 AS DOUBLE)))))"
    tail = f"({horner(tuple(reversed(ERF)), t)} * {t} * exp(-({x}) * ({x}) / 2)) / 2"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def phi_inv_sql(p: str) -> str:
    """SQL text of the inverse normal distribution function, p clamped to [1e-12, 1 - 1e-12]."""
    p = f"greatest(CAST(1e-12 AS DOUBLE), least(CAST(1 - 1e-12 AS DOUBLE), {p}))"
    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"({q} * {q})"
    tail = lambda x: f"({horner(ACKLAM_C, x)} / {horner(ACKLAM_D, x, 'CAST(1 AS DOUBLE)')})"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"(CASE WHEN {p} < {ACKLAM_LOW} THEN {tail(low)} WHEN {p} > {1 - ACKLAM_LOW} THEN -{tail(high)} ELSE {horner(ACKLAM_A, r)} * {q} / {horner(ACKLAM_B, r, 'CAST(1 AS DOUBLE)')} END)"


def vix_regime(v: Column, bins: tuple[float, float, float] = (15.0, 25.0, 35.0)) -> Column:
    """low, normal, high or extreme; null stays null."""
    return F.when(v < bins[0], "low").when(v < bins[1], "normal").when(v < bins[2], "high").when(v.isNotNull(), "extreme")


def vol_regime_label(v: Column, bins: tuple[float, float, float] = (15.0, 25.0, 35.0)) -> Column:
    """As ``vix_regime``, but a missing level is normal."""
    return F.coalesce(vix_regime(v, bins), F.lit("normal"))


def normalized(w: Column, by, cap: float = 1.0) -> Column:
    """Positive weights, scaled down where they sum to more than ``cap``; never scaled up."""
    good = F.when(w > 0, w)
    total = F.sum(good).over(by)
    return F.when(total > cap, good * cap / total).otherwise(good)


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(finite(x), F.format_string(f"%.{digits}f%%", x * 100)).otherwise("-")


def plain_ratio(x: Column, digits: int = 2) -> Column:
    return F.when(finite(x), F.format_string(f"%.{digits}f", x)).otherwise("-")


def money(x: Column) -> Column:
    return F.when(finite(x), F.concat(F.lit("$"), F.format_number(x, 0))).otherwise("-")
