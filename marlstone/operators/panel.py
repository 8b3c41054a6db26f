"""The (symbol, date) panel: returns, alignment, filling, validation."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window, functions as F

from marlstone.functions import scan
from marlstone.functions.windows import ordered, safe_div
from marlstone.sources.bars import MEASURES

COLUMNS = (*MEASURES, "log_return", "forward_return", "simple_return", "forward_simple_return", "typical_price", "dollar_volume")
CRITICAL = ("close", "volume", "log_return", "forward_return")


def add_returns(bars: DataFrame, horizon: int = 1, chunk_rows: int | None = None) -> DataFrame:
    """Log and simple returns, and the one-day returns ``horizon`` rows ahead; prices and turnover.

    Where a symbol has more rows than a task should hold (or with ``chunk_rows``), in chunks of its rows, with the same results.
    """
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if scan.is_long(bars) else 0
    if chunk_rows:
        return scan.in_chunks(bars, lambda b: add_returns(b, horizon, 0), 1, horizon, chunk_rows)
    w, bars = ordered(), scan.by_key(bars)
    ratio = safe_div(F.col("close"), F.lag("close").over(w))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return (
        bars.withColumn("log_return", F.when(ratio > 0, F.log(ratio)))
        .withColumn("simple_return", ratio - 1)
        .withColumn("forward_return", F.lead("log_return", horizon).over(w))
        .withColumn("forward_simple_return", F.lead("simple_return", horizon).over(w))
        .withColumn("typical_price", typical)
        .withColumn("dollar_volume", F.col("volume") * typical)
    )


def preprocess(bars: DataFrame, horizon: int = 1, drop: bool = True) -> DataFrame:
    """Returns for all symbols in one plan; rows without a return or a forward return go."""
    out = add_returns(bars, horizon)
    return out.dropna(subset=["log_return", "forward_return"]) if drop else out


def history(bars: DataFrame, min_periods: int = 252) -> DataFrame:
    """(symbol, n_rows, is_short): which histories are shorter than ``min_periods``."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("is_short", F.col("n_rows") < min_periods)


def common_dates(bars: DataFrame) -> DataFrame:
    """The dates on which every symbol has a row."""
    total = bars.agg(F.countDistinct("symbol").alias("_n"))
    by_date = bars.groupBy("date").agg(F.countDistinct("symbol").alias("_have"))
    return by_date.join(F.broadcast(total), F.col("_have") == F.col("_n")).select("date")  # one row is broadcast


def align(bars: DataFrame) -> DataFrame:
    """Rows of the common dates only."""
    return bars.join(common_dates(bars), "date", "left_semi")


def union_assets(*assets: DataFrame) -> DataFrame:
    """Rows of several sources with the key and the panel's columns; a column that one of them lacks is NULL there."""
    out = None
    for a in assets:
        a = a.select("symbol", "date", *[c for c in COLUMNS if c in a.columns])
        out = a if out is None else out.unionByName(a, allowMissingColumns=True)
    return out


def missing_fraction(panel: DataFrame) -> DataFrame:
    """One row: the share of missing values over all measures."""
    columns = [c for c in panel.columns if c in COLUMNS]
    missing = sum(F.sum(F.col(c).isNull().cast("long")) for c in columns)
    return panel.agg(safe_div(missing, F.count(F.lit(1)) * len(columns)).alias("missing_fraction"))


def fill(panel: DataFrame, method: str | None = "ffill", columns: list[str] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Fill gaps within each symbol, from the past (``ffill``) or the future (``bfill``); a long symbol's values are carried from piece to piece."""
    if method is None or method == "none":
        return panel
    if method not in ("ffill", "bfill"):
        raise ValueError(f"unknown fill method: {method}")
    pick, over = (F.last, ordered().rowsBetween(Window.unboundedPreceding, 0)) if method == "ffill" else (F.first, ordered().rowsBetween(0, Window.unboundedFollowing))
    columns = columns or [c for c in panel.columns if c in COLUMNS]
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if scan.is_long(panel) else 0
    if chunk_rows:
        kind = "last" if method == "ffill" else "next"
        return scan.running(panel, [scan.Running(c, kind, F.col(c)) for c in columns]).select(panel.columns)
    return panel.withColumns({c: pick(c, ignorenulls=True).over(over) for c in columns})


def drop_incomplete(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=[c for c in CRITICAL if c in panel.columns])


def validate(panel: DataFrame) -> DataFrame:
    """One row (is_valid, message): not empty, all critical columns there and complete, one row a key."""
    absent = [c for c in ("symbol", "date", *CRITICAL) if c not in panel.columns]
    if absent:
        return panel.sparkSession.createDataFrame([(False, f"missing columns: {', '.join(absent)}")], "is_valid boolean, message string")
    keys = panel.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in CRITICAL])
    totals = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most"), *[F.sum(c).alias(c) for c in CRITICAL])
    message = F.when(F.col("n") == 0, "empty panel").when(F.col("most") > 1, "repeated keys")
    for c in CRITICAL:
        message = message.when(F.col(c) > 0, f"missing values: {c}")
    return totals.select((message.otherwise("ok") == "ok").alias("is_valid"), message.otherwise("ok").alias("message"))


def stats(panel: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of counts, date range and moments; ``approximate`` counts distinct values by sketch."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return panel.agg(
        distinct("symbol").alias("n_assets"), distinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"),
        F.datediff(F.max("date"), F.min("date")).alias("range_days"),
        F.avg("forward_return").alias("mean_return"), F.stddev_samp("forward_return").alias("std_return"),
        F.min("forward_return").alias("min_return"), F.max("forward_return").alias("max_return"),
        F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("std_volume"),
    )


def create_panel(bars: DataFrame, horizon: int = 1, fill_method: str | None = "ffill", max_missing_fraction: float = 0.1) -> DataFrame:
    """Returns, filling, dropping and validation; raises when the panel is not valid.

    Gaps are always filled; a share of missing values over ``max_missing_fraction`` only warns.
    """
    panel = union_assets(preprocess(bars, horizon))
    share = missing_fraction(panel).first()[0]
    if share is not None and share > max_missing_fraction:
        warnings.warn(f"{share:.1%} of the panel's values are missing", stacklevel=2)
    panel = drop_incomplete(fill(panel, fill_method))
    verdict = validate(panel).first()
    if not verdict["is_valid"]:
        raise ValueError(verdict["message"])
    return panel
