"""Scoring of candidate signals on forward returns.

Input rows: (candidate_id, date, symbol, alpha, forward_return). Rows without
alpha or return are dropped first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions import scan
from marlstone.functions.expressions import PARSIMONY, complexity, parse, to_column, within_limits
from marlstone.functions.windows import clamp, safe_div
from marlstone.operators.normalize import average_rank
from marlstone.operators.split import TimeSplit, in_part
from marlstone.storage import materialize

ID = "candidate_id"
YEAR = 252
#: A candidate passes above (turnover and complexity: below) these.
THRESHOLDS = {"ic": 0.015, "ic_stability": 0.55, "sharpe": 0.3, "turnover": 0.6, "complexity": 20}


def candidate_values(features: DataFrame, expressions: dict[int, str], target: str = "forward_return") -> DataFrame:
    """(candidate_id, date, symbol, alpha, forward_return) of each expression, in one pass over the features used."""
    columns = {f"c{k}": to_column(parse(e), features.columns).cast("double") for k, e in expressions.items()}
    wide = features.select("date", "symbol", F.col(target).alias("forward_return"), *[v.alias(k) for k, v in columns.items()])
    long = wide.unpivot(["date", "symbol", "forward_return"], list(columns), "c", "alpha")
    return long.select(F.substring("c", 2, 9).cast("int").alias(ID), "date", "symbol", "alpha", "forward_return")


def complete(values: DataFrame) -> DataFrame:
    return values.dropna(subset=["alpha", "forward_return"])


def align(alpha: DataFrame, target: DataFrame) -> DataFrame:
    """Alpha and target of the same key, rows with gaps dropped."""
    return complete(alpha.join(target, ["symbol", "date"]))


def safe_corr(a: Column, b: Column) -> Column:
    """Correlation as an aggregate, NULL where a side is constant; both sides must be complete."""
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))  # exact, where a variance may be rounding noise
    return F.when(varies, clamp(safe_div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)), -1, 1))


def rank_corr(a: Column, b: Column) -> Column:
    """Correlation of ranks as an aggregate, from sums that are exact for ranks, so that none is 0 but for rounding."""
    n, sa, sb = F.count(F.lit(1)), F.sum(a), F.sum(b)
    spread = F.sqrt(n * F.sum(a * a) - sa * sa) * F.sqrt(n * F.sum(b * b) - sb * sb)
    return clamp(safe_div(n * F.sum(a * b) - sa * sb, spread), -1, 1)


#: Values that lie in several pieces are broadcast with their ranks up to this number.
MAX_BROADCAST_TIES = 100_000


def pooled_rank(df: DataFrame, column: str, by: str | None = None, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact average rank over all rows (or all rows of ``by``), whatever share of them one value has.

    Rows are range-partitioned by value and then by a hash of the row, so that a frequent value spreads over
    several pieces. Within a piece a rank is the place there plus the rows of earlier pieces. Only the first and
    the last value of a piece can lie in others too: these few are counted over all pieces, and meet their rows in a broadcast.
    """
    keys, spark = [by] if by else [], df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, *keys, column, F.xxhash64(*[F.col(c) for c in df.columns])).withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = cut.where(F.col(column).isNotNull()).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_t"), F.min(column).alias("_low"), F.max(column).alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0))), "rank-pieces")
    ends = sizes.select(*keys, "_p", F.explode(F.array_distinct(F.array("_low", "_high"))).alias(column))
    several = materialize(ends.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_pieces")).where("_pieces > 1").drop("_pieces"), "rank-ties")
    many = several.count()
    out = cut.withColumn("_own", average_rank(F.col(column), *keys, "_p")).join(sizes.select(*keys, "_p", "_before"), [*keys, "_p"], "left")
    rank = F.col("_before") + F.col("_own")
    if not many:
        return out.withColumn(name, rank).drop("_p", "_own", "_before")
    few = F.broadcast if many <= MAX_BROADCAST_TIES else (lambda x: x)
    counts = cut.join(few(several), [*keys, column]).groupBy(*keys, column, "_p").agg(F.count(F.lit(1)).alias("_n"))
    # in the first of its pieces such a value comes last
    first = counts.join(sizes.select(*keys, "_p", (F.col("_before") + F.col("_t")).alias("_end")), [*keys, "_p"])
    ties = first.groupBy(*keys, column).agg((F.min_by(F.col("_end") - F.col("_n"), "_p") + (F.sum("_n") + 1) / 2).alias("_tied"))
    ties = materialize(ties, "tied-ranks")
    return out.join(few(ties), [*keys, column], "left").withColumn(name, F.coalesce("_tied", rank)).select(*df.columns, name)


def t_p_value(r: float | None, n: int | None) -> float:
    """Two-sided p-value of a correlation of n pairs, by the continued fraction of the incomplete beta function."""
    if r is None or n is None or n < 3 or r == 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5  # df / (df + t^2)

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return min(1.0, front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b)


def information_coefficient(values: DataFrame, method: str = "spearman") -> DataFrame:
    """(candidate_id, ic, n): pooled correlation; 0 where there are fewer than two rows or a side is constant."""
    rows = complete(values)
    x, y = "alpha", "forward_return"
    if method == "spearman":
        rows = pooled_rank(pooled_rank(rows, "alpha", ID, "_ra"), "forward_return", ID, "_ry")
        x, y = "_ra", "_ry"
    elif method != "pearson":
        raise ValueError(f"unknown correlation: {method}")
    return rows.groupBy(ID).agg(F.coalesce(safe_corr(F.col(x), F.col(y)), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n"))


def daily_ic(values: DataFrame) -> DataFrame:
    """(candidate_id, date, ic) by Spearman, for dates with two symbols or more and a defined correlation."""
    rows = complete(values)
    ranked = rows.select(ID, "date", average_rank(F.col("alpha"), ID, "date").alias("a"), average_rank(F.col("forward_return"), ID, "date").alias("y"))
    return ranked.groupBy(ID, "date").agg(rank_corr(F.col("a"), F.col("y")).alias("ic")).where("ic IS NOT NULL")


def ic_stability(values: DataFrame) -> DataFrame:
    """(candidate_id, ic_stability): the share of dates whose correlation is positive."""
    return daily_ic(values).groupBy(ID).agg(F.avg((F.col("ic") > 0).cast("double")).alias("ic_stability"))


def long_short(values: DataFrame, quantiles: int = 5) -> DataFrame:
    """(candidate_id, date, p): mean return of the top fifth less that of the bottom fifth; ties go by symbol."""
    rows = complete(values)
    by = Window.partitionBy(ID, "date")
    rows = rows.withColumn("_rn", F.row_number().over(by.orderBy("alpha", "symbol"))).withColumn("_n", F.count(F.lit(1)).over(by))
    k = F.floor(F.col("_n") / quantiles)
    top, bottom = F.avg(F.when(F.col("_rn") > F.col("_n") - k, F.col("forward_return"))), F.avg(F.when(F.col("_rn") <= k, F.col("forward_return")))
    return rows.where(F.col("_n") >= quantiles).groupBy(ID, "date").agg((top - bottom).alias("p"))


def performance(returns: DataFrame, by: tuple[str, ...] = (ID,), chunk_rows: int | None = None) -> DataFrame:
    """(candidate_id, sharpe, annual_return, annual_volatility, max_drawdown, win_rate, n_dates) of daily returns; the curve of a long series is carried from piece to piece."""
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if len(by) == 1 and scan.is_long(returns, by[0]) else 0
    if chunk_rows:
        key = F.struct(*by).alias("_by") if len(by) > 1 else F.col(by[0]).alias("_by")
        ran = scan.running(returns.select("*", key), [scan.Running("_c", "product", 1 + F.col("p")), scan.Running("_top", "peak", 1 + F.col("p"))], "_by")
        curve = ran.withColumn("_dd", safe_div(F.col("_c") - F.col("_top"), F.col("_top")))
    else:
        so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        curve = returns.withColumn("_c", F.product(1 + F.col("p")).over(so_far))
        curve = curve.withColumn("_dd", safe_div(F.col("_c") - F.max("_c").over(so_far), F.max("_c").over(so_far)))
    mean, std = F.avg("p"), F.stddev_samp("p")
    return curve.groupBy(*by).agg(
        F.coalesce(F.when(std > 0, safe_div(mean * YEAR, std * math.sqrt(YEAR))), F.lit(0.0)).alias("sharpe"), (mean * YEAR).alias("annual_return"),
        F.coalesce(std * math.sqrt(YEAR), F.lit(0.0)).alias("annual_volatility"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("p") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("n_dates"),
    )


def turnover(values: DataFrame, quantiles: int = 5) -> DataFrame:
    """(candidate_id, turnover): mean share of names that leave the top and the bottom from one date to the next.

    Both dates' groups have the size of the earlier date's; date pairs where that is 0 do not count.
    """
    rows = complete(values)
    by = Window.partitionBy(ID, "date")
    rows = rows.select(
        ID, "date", "symbol", F.row_number().over(by.orderBy("alpha", "symbol")).alias("_low"), F.row_number().over(by.orderBy(F.desc("alpha"), "symbol")).alias("_high"), F.count(F.lit(1)).over(by).alias("_n")
    )
    dates = rows.groupBy(ID, "date").agg(F.floor(F.max("_n") / quantiles).alias("_k"))
    order = Window.partitionBy(ID).orderBy("date")
    dates = dates.select(ID, "date", "_k", F.lead("date").over(order).alias("_next"), F.lag("_k").over(order).alias("_k_before"))
    rows = rows.join(dates, [ID, "date"])
    side = F.explode(F.array(F.struct(F.lit("long").alias("side"), F.col("_high").alias("at")), F.struct(F.lit("short").alias("side"), F.col("_low").alias("at")))).alias("x")
    sides = rows.select(ID, "date", "symbol", "_k", "_next", "_k_before", side).select("*", "x.side", "x.at").drop("x")
    held = sides.where((F.col("at") <= F.col("_k")) & F.col("_next").isNotNull() & (F.col("_k") > 0)).select(ID, F.col("_next").alias("date"), "side", "symbol", "_k")
    now = sides.where(F.col("at") <= F.col("_k_before")).select(ID, "date", "side", "symbol")
    left = held.join(now, [ID, "date", "side", "symbol"], "left_anti").groupBy(ID, "date", "side").agg(F.count(F.lit(1)).alias("_left"))
    sizes = held.groupBy(ID, "date", "side").agg(F.max("_k").alias("_k"))
    share = sizes.join(left, [ID, "date", "side"], "left").withColumn("_s", F.coalesce("_left", F.lit(0)) / F.col("_k"))
    return share.groupBy(ID, "date").agg(F.avg("_s").alias("_s")).groupBy(ID).agg(F.avg("_s").alias("turnover"))


def evaluate(values: DataFrame, complexities: dict[int, int] | None = None, method: str = "spearman") -> DataFrame:
    """All metrics, one row a candidate; daily returns are computed once."""
    values = materialize(complete(values), "values")
    daily = materialize(long_short(values), "daily")
    spark = values.sparkSession
    out = information_coefficient(values, method).join(ic_stability(values), ID, "left").join(performance(daily), ID, "left").join(turnover(values), ID, "left")
    out = out.withColumnRenamed("n", "n_observations")
    if complexities:
        out = out.join(spark.createDataFrame(list(complexities.items()), f"{ID} int, complexity int"), ID, "left")
    zero = ("ic_stability", "sharpe", "annual_return", "annual_volatility", "max_drawdown", "win_rate", "turnover")
    return out.fillna(0.0, list(zero))


def with_p_value(metrics: DataFrame) -> DataFrame:
    """Adds ic_p_value; a small table, one row a candidate."""
    p = F.pandas_udf(lambda ic, n: ic.combine(n, t_p_value), "double")
    return metrics.withColumn("ic_p_value", p("ic", "n_observations"))


def passes(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Five flags and ``passed``, best correlation first."""
    t = THRESHOLDS | (thresholds or {})
    flags = {
        "ic_ok": F.col("ic") > t["ic"], "stability_ok": F.col("ic_stability") > t["ic_stability"], "sharpe_ok": F.col("sharpe") > t["sharpe"],
        "turnover_ok": F.col("turnover") < t["turnover"], "complexity_ok": F.col("complexity") < t["complexity"],
    }
    out = metrics.withColumns(flags)
    return out.withColumn("passed", F.col("ic_ok") & F.col("stability_ok") & F.col("sharpe_ok") & F.col("turnover_ok") & F.col("complexity_ok")).orderBy(F.desc("ic"), ID)


def evaluate_test(values: DataFrame, split: TimeSplit, complexities: dict[int, int], thresholds: dict[str, float] | None = None) -> DataFrame:
    """The candidates' metrics and flags on the dates of the test part alone."""
    return passes(evaluate(in_part(values, split, "test"), complexities), thresholds)


def out_of_sample(passed: DataFrame) -> DataFrame:
    """One row, of what ``evaluate_test`` gives: candidates, passing ones, promoted ones (positive correlation), best correlation and Sharpe ratio."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return passed.agg(
        F.count(F.lit(1)).alias("n_candidates"), count(F.col("passed")).alias("n_passed"), count(F.col("ic") > 0).alias("n_promoted"), F.max("ic").alias("best_ic"), F.max("sharpe").alias("best_sharpe")
    )


def single_series(values: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """Metrics without a cross-section, one row a candidate (and series, by the columns named): the sign of the correlation as stability, scaled correlation as Sharpe ratio, and the target's own return and risk."""
    by = (ID, *series)
    rows = complete(values).withColumnRenamed("forward_return", "p")
    perf = performance(rows.select(*by, "date", "p"), by).drop("sharpe")
    ic = rows.groupBy(*by).agg(F.coalesce(safe_corr(F.col("alpha"), F.col("p")), F.lit(0.0)).alias("ic"))
    return ic.join(perf, list(by)).withColumn("ic_stability", (F.col("ic") > 0).cast("double")).withColumn("sharpe", F.col("ic") * math.sqrt(YEAR))


def losses(features: DataFrame, expressions: dict[int, str], target: str = "forward_return", kind: str = "l1", batch: int = 100) -> DataFrame:
    """(candidate_id, expression, loss, complexity, score): all candidates of a batch in one scan."""
    if kind not in ("l1", "l2"):
        raise ValueError(f"unknown loss: {kind}")
    too_large = [e for e in expressions.values() if not within_limits(parse(e))]
    if too_large:
        raise ValueError(f"beyond the limits of size and depth: {too_large[0]}")
    out, items = None, list(expressions.items())
    spark = features.sparkSession
    for k in range(0, len(items), batch):
        part = items[k : k + batch]
        errors = {f"c{i}": to_column(parse(e), features.columns) - F.col(target) for i, e in part}
        row = features.agg(*[F.avg(F.abs(e) if kind == "l1" else e * e).alias(c) for c, e in errors.items()])
        long = row.unpivot([], list(errors), "c", "loss").select(F.substring("c", 2, 9).cast("int").alias(ID), "loss")
        out = long if out is None else out.union(long)
    table = spark.createDataFrame([(i, e, complexity(parse(e))) for i, e in items], f"{ID} int, expression string, complexity int")
    return out.join(table, ID).withColumn("score", F.col("loss") + PARSIMONY * F.col("complexity")).select(ID, "expression", "loss", "complexity", "score")


def losses_of_grammar(features: DataFrame, table: DataFrame, names: list[str], target: str = "forward_return", kind: str = "l1") -> DataFrame:
    """(expression, complexity, level, loss, score) of every row of a ``grammar`` of ``names``, in one scan of the features.

    What the last operators are applied to (the levels below the last) is computed once a row; the last level is array work over
    pairs of these columns, and sums and counts add up in Spark. The table of operands and operators is held to the grammar's limit.
    """
    if kind not in ("l1", "l2"):
        raise ValueError(f"unknown loss: {kind}")
    rows = table.select("expression", "complexity", "level", "operator", "left", "right").toArrow().to_pylist()
    operands = list(dict.fromkeys([*names, *(x for r in rows for x in (r["left"], r["right"]) if x is not None)]))
    place = {x: k for k, x in enumerate(operands)}
    made: dict[str, list[tuple[int, int, int]]] = {}
    for k, r in enumerate(rows):
        made.setdefault(r["operator"] or "", []).append((k, place[r["left"] or r["expression"]], place[r["right"] or r["left"] or r["expression"]]))
    pairs = {op: np.array(x).T for op, x in made.items()}
    inputs = features.select(F.col(target).cast("double").alias("_y"), *[to_column(parse(x), features.columns).cast("double").alias(f"o{k}") for x, k in place.items()]).where("_y IS NOT NULL")

    def run(batches):
        total, count = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for batch in batches:
            y, *columns = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            values = np.stack(columns)
            for op, (which, left, right) in pairs.items():
                for k in range(0, len(which), max(1, 4_000_000 // max(1, len(y)))):
                    part = slice(k, k + max(1, 4_000_000 // max(1, len(y))))
                    a, b = values[left[part]], values[right[part]]
                    with np.errstate(all="ignore"):
                        x = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else np.where(b == 0, np.nan, a / b) if op == "/" else -a if op == "neg" else np.abs(a) if op == "abs" else a
                        error = np.abs(x - y) if kind == "l1" else (x - y) ** 2
                    good = ~np.isnan(error)
                    total[which[part]] += np.where(good, error, 0).sum(1)
                    count[which[part]] += good.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total), pa.array(count)], names=["k", "total", "n"])

    sums = inputs.mapInArrow(run, "k long, total double, n long").groupBy("k").agg(safe_div(F.sum("total"), F.sum("n")).alias("loss"))
    names_of = features.sparkSession.createDataFrame(pa.table({"k": list(range(len(rows))), **{c: [r[c] for r in rows] for c in ("expression", "complexity", "level")}}))
    return sums.join(names_of, "k").select("expression", F.col("complexity").cast("int").alias("complexity"), F.col("level").cast("int").alias("level"), "loss", (F.col("loss") + PARSIMONY * F.col("complexity")).alias("score"))


def best(scored: DataFrame, n: int = 100) -> DataFrame:
    """The n candidates of least loss, with their rank."""
    top = scored.orderBy(F.col("loss").asc_nulls_last(), ID).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("loss").asc_nulls_last(), ID)))  # n rows


def pareto_front(scored: DataFrame) -> DataFrame:
    """Candidates that no simpler or equally simple one beats: strict improvements of loss by complexity.

    Losses are computed once and stored: computed a second time they may differ in the last digit (sums add up in another order) and equal no least loss.
    """
    scored = materialize(scored, "scored")
    least = scored.groupBy("complexity").agg(F.min("loss").alias("loss"))
    earlier = F.min("loss").over(Window.orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1))  # one row a complexity
    front = least.withColumn("_before", earlier).where(F.col("_before").isNull() | (F.col("loss") < F.col("_before"))).drop("_before")
    return scored.join(front, ["complexity", "loss"], "left_semi")
