"""Backtests of a signal, and comparison of runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from marlstone.functions import scan
from marlstone.functions.windows import safe_div
from marlstone.operators import policy
from marlstone.operators.metrics import ID, evaluate, information_coefficient
from marlstone.operators.split import SWEEP as RATIOS, ratio_sweep

YEAR = 252


def portfolio(values: DataFrame, quantiles: int = 5) -> DataFrame:
    """Weights 1/k for the top and -1/k for the bottom quantile, not normalised."""
    return policy.quintile(values.dropna(subset=["alpha"]), quantiles, normalize=False)


def daily_returns(values: DataFrame, start: str | None = None, end: str | None = None, quantiles: int = 5) -> DataFrame:
    """(date, p, value): return per date and the curve of one unit, over an optional range of dates."""
    rows = values.dropna(subset=["alpha", "forward_return"])
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return curve(portfolio(rows, quantiles).groupBy("date").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("p")))


def curve(daily: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Returns per date with ``value``, the curve of one unit; in pieces where there are very many dates."""
    if _in_pieces(daily, chunk_rows):
        return scan.running(daily.withColumn("_all", F.lit(0)), [scan.Running("value", "product", 1 + F.col("p"))], "_all").drop("_all")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    return daily.withColumn("value", F.product(1 + F.col("p")).over(so_far))


def _in_pieces(daily: DataFrame, chunk_rows: int | None) -> bool:
    if chunk_rows is not None:
        return chunk_rows > 0
    return scan.is_long(daily.withColumn("_all", F.lit(0)), "_all")


def summary(daily: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """One row: total and annual return, volatility, Sharpe ratio (annual return over volatility), deepest loss."""
    if _in_pieces(daily, chunk_rows):
        curve = scan.running(daily.withColumn("_all", F.lit(0)), [scan.Running("_peak", "max", F.col("value"))], "_all")
    else:
        so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
        curve = daily.withColumn("_peak", F.max("value").over(so_far))
    total, n = F.max_by("value", "date") - 1, F.count(F.lit(1))
    annual = F.when(1 + total > 0, F.pow(1 + total, safe_div(F.lit(float(YEAR)), n))) - 1
    volatility = F.stddev_samp("p") * math.sqrt(YEAR)
    return curve.agg(
        n.alias("n_dates"), total.alias("total_return"), annual.alias("annual_return"), volatility.alias("volatility"),
        F.coalesce(F.when(volatility > 0, safe_div(annual, volatility)), F.lit(0.0)).alias("sharpe"), F.min(safe_div(F.col("value") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"),
    )


def trading_rule(values: DataFrame, passed: DataFrame, name: str = "quintile", **options) -> DataFrame:
    """Weights of the candidates that passed validation; the others get none."""
    allowed = passed.where("passed").select(ID)
    rows = values.join(allowed, ID, "left_semi")
    return policy.POLICIES[name](rows, by=(ID, "date"), **options)


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """One row over (run_id, candidate_id, ic, passed): runs, candidates, passing ones, best correlation and whose it is."""
    per_run = runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.max("ic").alias("ic"), F.max_by(F.struct("run_id", ID), F.struct("ic", "run_id", ID)).alias("best")
    )
    return per_run.agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_candidates"), F.sum("n_passed").alias("n_passed"), F.avg("n_passed").alias("mean_passed"), F.max("ic").alias("best_ic"),
        F.max_by("best", F.struct("ic", "best")).alias("best"),
    ).select("n_runs", "n_candidates", "n_passed", "mean_passed", "best_ic", F.col("best.run_id").alias("best_run"), F.col(f"best.{ID}").alias("best_candidate"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """One row a run, best correlation first."""
    return (
        runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.max("ic").alias("best_ic"), F.avg("ic").alias("mean_ic"))
        .orderBy(F.desc("best_ic"), "run_id")
    )


#: Groups of features that a sweep over runs takes in every so many runs.
SWEEP = {"wavelet": 2, "hilbert": 3, "spectral": 4}


def feature_set(run: int) -> list[str]:
    """The features of a run in a sweep over feature groups."""
    from marlstone.operators.features import select_features

    return [f.name for f in select_features(exclude_tags=tuple(tag for tag, every in SWEEP.items() if run % every))]


def sweep(values: DataFrame, runs: DataFrame, ratios: tuple = RATIOS, **options) -> DataFrame:
    """(run_id, split_id, candidate_id, and all metrics): every run of ``runs`` (run_id, candidate_id) on the test dates of every split of ``ratios``.

    Runs share candidates, so each candidate is scored once a split, all of them in one plan over the long values; runs
    are then a join with the scores, one row a candidate and split.
    """
    width = 1 << 20
    tested = ratio_sweep(values, ratios).where("split = 'test'")
    scored = evaluate(tested.withColumn(ID, (F.col("split_id") * width + F.col(ID)).cast("long")).select(ID, "date", "symbol", "alpha", "forward_return"), **options)
    scored = scored.withColumn("split_id", F.floor(F.col(ID) / width).cast("int")).withColumn(ID, (F.col(ID) % width).cast("int"))
    return runs.join(scored, ID).select("run_id", "split_id", ID, *[c for c in scored.columns if c not in (ID, "split_id")])


def recovery(values: DataFrame, least: float = 0.7, least_ic: float = 0.05) -> DataFrame:
    """Whether a signal (alpha) is found again: its correlation with a known one (``forward_return``) and the verdicts."""
    pearson = information_coefficient(values, "pearson").select(ID, F.col("ic").alias("correlation"))
    ranks = information_coefficient(values).select(ID, "ic")
    return pearson.join(ranks, ID).withColumns({"is_recovered": F.abs("correlation") > least, "has_signal": F.col("ic") > least_ic})
