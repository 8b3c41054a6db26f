"""Cross-sectional normalisation: each feature across symbols, per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions.windows import clamp, safe_div
from marlstone.operators.panel import fill

KEYS = ("symbol", "date")



def feature_columns(features: DataFrame, keys: tuple[str, ...] = KEYS) -> list[str]:
    return [c for c in features.columns if c not in keys]


def average_rank(x: Column, *by: str) -> Column:
    """Rank from 1, ties averaged; NULL for NULL."""
    over = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(over) + F.count(x).over(over)) / 2)


def percentile(x: Column, *by: str) -> Column:
    """Average rank divided by the number of values."""
    return safe_div(average_rank(x, *by), F.count(x).over(Window.partitionBy(*by)))


def rank_normalize(features: DataFrame, columns: list[str] | None = None, percentile_range: tuple[float, float] = (0, 100), prefix: str = "") -> DataFrame:
    low, high = percentile_range
    scaled = (lambda p: p) if (low, high) == (0, 100) else (lambda p: low + (high - low) * p)
    columns = columns or feature_columns(features)
    return features.withColumns({prefix + c: scaled(percentile(F.col(c), "date")) for c in columns})


def _z(x: Column, clip: float | None) -> Column:
    z = safe_div(x - F.avg(x).over(Window.partitionBy("date")), F.stddev_samp(x).over(Window.partitionBy("date")))
    return clamp(z, -clip, clip) if clip else z


def zscore_normalize(features: DataFrame, columns: list[str] | None = None, clip: float | None = 3.0, prefix: str = "") -> DataFrame:
    return features.withColumns({prefix + c: _z(F.col(c), clip) for c in columns or feature_columns(features)})


def minmax_normalize(features: DataFrame, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    def scaled(x: Column) -> Column:
        low = F.min(x).over(Window.partitionBy("date"))
        return safe_div(x - low, F.max(x).over(Window.partitionBy("date")) - low)

    return features.withColumns({prefix + c: scaled(F.col(c)) for c in columns or feature_columns(features)})


def combined_normalize(features: DataFrame, columns: list[str] | None = None, clip: float | None = 3.0) -> DataFrame:
    """raw_, rank_ and zscore_ columns in one pass over the dates."""
    columns = columns or feature_columns(features)
    out = {f"raw_{c}": F.col(c) for c in columns}
    out |= {f"rank_{c}": percentile(F.col(c), "date") for c in columns}
    out |= {f"zscore_{c}": _z(F.col(c), clip) for c in columns}
    return features.select(*[c for c in features.columns if c not in columns], *[v.alias(k) for k, v in out.items()])


def long_ranks(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(symbol, date, feature, percentile): for many features, sorted per date and feature instead of once a feature."""
    columns = columns or feature_columns(features)
    long = features.select("symbol", "date", *columns).unpivot(list(KEYS), columns, "feature", "value")
    return long.select("symbol", "date", "feature", percentile(F.col("value"), "date", "feature").alias("percentile"))


def handle_missing(features: DataFrame, how: str = "drop", columns: list[str] | None = None) -> DataFrame:
    """``drop`` rows with gaps, ``fill`` them within each symbol (past, then future), or ``ignore``."""
    columns = columns or feature_columns(features)
    if how == "drop":
        return features.dropna(subset=columns)
    if how == "fill":
        return fill(fill(features, "ffill", columns), "bfill", columns)
    if how == "ignore":
        return features
    raise ValueError(f"unknown handling of missing values: {how}")


METHODS = {"rank": rank_normalize, "zscore": zscore_normalize, "minmax": minmax_normalize, "combined": combined_normalize}


def normalize(features: DataFrame, method: str = "rank", missing: str = "ignore", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown normalisation: {method}")
    return METHODS[method](handle_missing(features, missing, options.get("columns")), **options)
