"""Column builders over rolling frames: per symbol in order of date, counted in rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec, functions as F

MIN_PERIODS = 10


def ordered(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def frame(w: int, skip: int = 0, key: str = "symbol", order: str = "date") -> WindowSpec:
    """The last ``w`` rows, the current one included, without the ``skip`` oldest."""
    return ordered(key, order).rowsBetween(-(w - 1 - skip), 0)


def centred(w: int, key: str = "symbol", order: str = "date") -> WindowSpec:
    """A frame of ``w`` rows around the current one; an even frame has one more row before it than after."""
    after = (w - 1) // 2
    return ordered(key, order).rowsBetween(-(w - 1 - after), after)


def gated(value: Column, count: Column, w: int, min_periods: int | str = MIN_PERIODS) -> Column:
    """``value`` where the frame holds enough values; ``min_periods="full"`` asks for all of them."""
    least = w if min_periods == "full" else min(int(min_periods), w)
    return F.when(count >= least, value)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def rolling(fn: Callable[[Column], Column], x: Column, over: WindowSpec) -> Column:
    return fn(x).over(over)


def rolling_mean(x: Column, over: WindowSpec) -> Column:
    return F.avg(x).over(over)


def rolling_std(x: Column, over: WindowSpec) -> Column:
    return F.stddev_samp(x).over(over)


def rolling_var(x: Column, over: WindowSpec) -> Column:
    return F.var_samp(x).over(over)


def rolling_cov(a: Column, b: Column, over: WindowSpec) -> Column:
    return F.covar_samp(*_pair(a, b)).over(over)


def rolling_corr(a: Column, b: Column, over: WindowSpec) -> Column:
    """Correlation that is NULL where a side is constant, and never outside [-1, 1]."""
    a, b = _pair(a, b)
    spread = F.stddev_samp(a).over(over) * F.stddev_samp(b).over(over)
    return clamp(safe_div(F.covar_samp(a, b).over(over), spread), -1, 1)


def rolling_autocorr(x: Column, w: int, lag: int = 1) -> Column:
    """Correlation of a frame's values with those ``lag`` rows earlier, both inside the frame of ``w`` rows."""
    return rolling_corr(x, F.lag(x, lag).over(ordered()), frame(w, lag))


def moments(x: Column, over: WindowSpec) -> tuple[Column, Column, Column, Column]:
    """n and the central moments 2 to 4 from sums of powers (much cheaper than the built-in kurtosis)."""
    n = F.count(x).over(over)
    s1, s2, s3, s4 = (F.sum(F.pow(x, F.lit(k))).over(over) for k in range(1, 5))
    m = safe_div(s1, n)
    e2, e3, e4 = safe_div(s2, n), safe_div(s3, n), safe_div(s4, n)
    m2 = e2 - m * m
    # what is left of a constant series is rounding noise
    m2 = F.when(m2 > 1e-14 * e2, m2)
    return n, m2, e3 - 3 * m * e2 + 2 * m * m * m, e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m


def rolling_skew(x: Column, over: WindowSpec) -> Column:
    """Bias-corrected skewness, from three values on."""
    n, m2, m3, _ = moments(x, over)
    return F.when(n >= 3, safe_div(F.sqrt(n * (n - 1.0)), n - 2.0) * safe_div(m3, F.pow(m2, F.lit(1.5))))


def rolling_kurt(x: Column, over: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis, from four values on."""
    n, m2, _, m4 = moments(x, over)
    g2 = safe_div(m4, m2 * m2) - 3
    return F.when(n >= 4, safe_div(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6))


def rolling_r2(y: Column, x: Column, over: WindowSpec) -> Column:
    """R squared of a line through the frame, NULL where a side is constant."""
    y, x = _pair(y, x)
    return F.when((F.var_samp(y).over(over) > 0) & (F.var_samp(x).over(over) > 0), F.regr_r2(y, x).over(over))
