"""Policies: a signal becomes portfolio weights, per date; grids of parameters and their tuning.

Input rows hold (date, symbol, alpha), and ``by`` names the columns that form
one cross-section (the date, and a parameter set where there are several).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marlstone.functions.windows import clamp, safe_div
from marlstone.operators.normalize import average_rank
from marlstone.operators.split import TimeSplit, in_part

BY = ("date",)


def _over(by: tuple[str, ...]):
    return Window.partitionBy(*by)


def _unit(w: Column, by: tuple[str, ...]) -> Column:
    """Weights of gross exposure 1; all zero stays zero."""
    return F.coalesce(safe_div(w, F.sum(F.abs(w)).over(_over(by))), F.lit(0.0))


def _sides(w: Column, by: tuple[str, ...]) -> Column:
    """Each side by its own sum; where both sides exist, then by the gross sum that they had before."""
    over = _over(by)
    long, short = F.coalesce(F.sum(F.when(w > 0, w)).over(over), F.lit(0.0)), F.coalesce(F.sum(F.when(w < 0, -w)).over(over), F.lit(0.0))
    own = F.when(w > 0, safe_div(w, long)).when(w < 0, safe_div(w, short)).otherwise(0.0)
    return F.when((long > 0) & (short > 0), safe_div(own, long + short)).otherwise(own)


def quintile(rows: DataFrame, quantiles: int | Column = 5, proportional: bool = False, normalize: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """Long the top quantile, short the bottom one, by average rank; equal weights or in proportion to alpha."""
    q = quantiles if isinstance(quantiles, Column) else F.lit(quantiles)
    rank, n = average_rank(F.col("alpha"), *by), F.count("alpha").over(_over(by))
    k = F.floor(n / q)
    top, bottom = (rank >= n - k) & (k > 0), (rank <= k) & (k > 0)
    # the short side is set last
    one = F.abs(F.col("alpha")) if proportional else safe_div(F.lit(1.0), k.cast("double"))
    w = F.when(bottom, -one).when(top, one).otherwise(0.0)
    return rows.withColumn("weight", _unit(w, by) if normalize else w)


def decile(rows: DataFrame, **options) -> DataFrame:
    return quintile(rows, 10, **options)


def tertile(rows: DataFrame, **options) -> DataFrame:
    return quintile(rows, 3, **options)


def threshold(rows: DataFrame, long_threshold=0.5, short_threshold=-0.5, long_size=1.0, short_size=1.0, normalize: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """Long above one threshold, short below another (which wins where both hold)."""
    a = F.col("alpha")
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    w = F.when(a < col(short_threshold), -col(short_size)).when(a > col(long_threshold), col(long_size)).otherwise(0.0)
    return rows.withColumn("weight", _sides(w, by) if normalize else w)


def zscore(rows: DataFrame, clip: float | Column = 2.0, normalize: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """Weights in proportion to the clipped z-score of alpha."""
    z = safe_div(F.col("alpha") - F.avg("alpha").over(_over(by)), F.stddev_samp("alpha").over(_over(by)))
    bound = clip if isinstance(clip, Column) else F.lit(float(clip))
    w = F.coalesce(F.when(z.isNotNull(), F.greatest(-bound, F.least(bound, z))), F.lit(0.0))
    return rows.withColumn("weight", _unit(w, by) if normalize else w)


def sign(rows: DataFrame, normalize: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    w = F.when(F.col("alpha") > 0, 1.0).when(F.col("alpha") < 0, -1.0).otherwise(0.0)
    return rows.withColumn("weight", _sides(w, by) if normalize else w)


def kelly(rows: DataFrame, fraction=1.0, low=0.0, high=1.0, variance_of: str = "alpha", normalize: bool = True, by: tuple[str, ...] = BY) -> DataFrame:
    """fraction x alpha / variance, held between ``low`` and ``high``; a variance of 0 or none counts as 1."""
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    v = F.var_samp(variance_of).over(_over(by))
    raw = col(fraction) * F.col("alpha") / F.when(v > 0, v).otherwise(1.0)
    w = F.coalesce(F.when(raw.isNotNull(), F.greatest(col(low), F.least(col(high), raw))), F.lit(0.0))
    return rows.withColumn("weight", _sides(w, by) if normalize else w)


def half_kelly(rows: DataFrame, **options) -> DataFrame:
    return kelly(rows, 0.5, **options)


def quarter_kelly(rows: DataFrame, **options) -> DataFrame:
    return kelly(rows, 0.25, **options)


def apply_capital(weights: DataFrame, capital: float = 1.0, by: tuple[str, ...] = BY) -> DataFrame:
    """Weights by the size of their net sum (where it is not zero), times the capital."""
    net = F.sum("weight").over(_over(by))
    return weights.withColumn("position", F.when(net != 0, F.col("weight") / F.abs(net)).otherwise(F.col("weight")) * capital)


POLICIES = {
    "quintile": quintile, "decile": decile, "tertile": tertile, "threshold": threshold, "zscore": zscore, "sign": sign, "kelly": kelly, "half_kelly": half_kelly, "quarter_kelly": quarter_kelly,
}


def register(name: str, policy) -> None:
    """Add a policy of one's own: rows with alpha in, rows with ``weight`` out."""
    POLICIES[name] = policy


def grid(spark: SparkSession, policy: str) -> DataFrame:
    """The parameter sets of a policy, one row each."""
    from itertools import product

    if policy == "threshold":
        sets = [(a, b, c, d) for a, b, c, d in product(THRESHOLD_GRID["long"], THRESHOLD_GRID["short"], THRESHOLD_GRID["size"], THRESHOLD_GRID["size"]) if a >= b]
        schema = "params_id int, long_threshold double, short_threshold double, long_size double, short_size double"
    elif policy == "zscore":
        sets, schema = list(product(ZSCORE_GRID["clip"], ZSCORE_GRID["normalize"])), "params_id int, clip double, normalize boolean"
    elif policy == "kelly":
        sets, schema = list(product(KELLY_GRID["fraction"], KELLY_GRID["low"], KELLY_GRID["high"])), "params_id int, fraction double, low double, high double"
    elif policy == "quintile":
        sets, schema = [(q,) for q in (3, 5, 10)], "params_id int, quantiles int"
    else:
        raise ValueError(f"no grid for policy: {policy}")
    return spark.createDataFrame([(k, *s) for k, s in enumerate(sets)], schema)


#: What the parameters of each policy are tried at.
THRESHOLD_GRID = {"long": (-1.0, -0.5, 0.0, 0.5, 1.0), "short": (-1.0, -0.5, 0.0, 0.5, 1.0), "size": (0.5, 1.0, 1.5, 2.0)}
ZSCORE_GRID = {"clip": (1.0, 1.5, 2.0, 2.5, 3.0), "normalize": (True, False)}
KELLY_GRID = {"fraction": (0.1, 0.25, 0.5, 0.75, 1.0), "low": (0.0, 0.1, 0.2), "high": (0.5, 1.0, 1.5, 2.0)}


def _grid_rows(sets: DataFrame) -> list[dict]:
    return [r.asDict() for r in sets.orderBy("params_id").collect()]  # the grid: a few hundred rows at most


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def grid_returns(values: DataFrame, policy: str) -> DataFrame:
    """(params_id, date, p): portfolio return of each parameter set on each date.

    No parameter set sees the panel's rows (date, symbol, alpha, forward_return): one aggregation by date
    makes the sums that its distinct bounds need (counts and returns beyond each threshold, products with alpha clipped at
    each bound), and each set's return is put together from them, on one row a date. What is shuffled does not grow with the grid.
    """
    sets = _grid_rows(grid(values.sparkSession, policy))
    rows = values.dropna(subset=["alpha", "forward_return"])
    a, r, over = F.col("alpha"), F.col("forward_return"), _over(BY)
    sums: dict[str, list[Column]] = {}  # arrays of sums, and for each set the places in them
    places: list[dict[str, int | float | bool]] = []
    if policy == "threshold":
        longs, shorts = sorted({s["long_threshold"] for s in sets}), sorted({s["short_threshold"] for s in sets})
        sums = {"up": [_sum((a > b).cast("double")) for b in longs], "up_r": [_sum(F.when(a > b, r)) for b in longs], "down": [_sum((a < b).cast("double")) for b in shorts], "down_r": [_sum(F.when(a < b, r)) for b in shorts]}
        places = [{"i": longs.index(s["long_threshold"]), "j": shorts.index(s["short_threshold"]), "long_size": s["long_size"], "short_size": s["short_size"]} for s in sets]
        # a long bound is never below the short one, so that no row is on both sides
        up, down = F.col("up")[F.col("s.i")], F.col("down")[F.col("s.j")]
        gain = F.coalesce(safe_div(F.col("up_r")[F.col("s.i")], up), F.lit(0.0)) - F.coalesce(safe_div(F.col("down_r")[F.col("s.j")], down), F.lit(0.0))
        p = F.when((up > 0) & (down > 0), gain / (up * F.col("s.long_size") + down * F.col("s.short_size"))).otherwise(gain)
    else:
        if policy == "zscore":
            z = safe_div(a - F.avg(a).over(over), F.stddev_samp(a).over(over))
            rows, clips = rows.select("date", r, z.alias("_z")), sorted({s["clip"] for s in sets})
            weights = [F.coalesce(clamp(F.col("_z"), -c, c), F.lit(0.0)) for c in clips]
            places = [{"i": clips.index(s["clip"]), "unit": s["normalize"]} for s in sets]
        elif policy == "kelly":
            v = F.var_samp(a).over(over)
            rows = rows.select("date", r, (a / F.when(v > 0, v).otherwise(1.0)).alias("_raw"))
            # bounds are not negative, so there is a long side only
            weights = [F.coalesce(clamp(F.col("_raw") * s["fraction"], s["low"], s["high"]), F.lit(0.0)) for s in sets]
            places = [{"i": k, "unit": True} for k in range(len(sets))]
        else:
            rows = rows.select("date", r, average_rank(a, *BY).alias("_rank"), F.count(F.lit(1)).over(over).alias("_n"))
            weights = []
            for s in sets:
                k = F.floor(F.col("_n") / s["quantiles"])
                bottom, top = (F.col("_rank") <= k) & (k > 0), (F.col("_rank") >= F.col("_n") - k) & (k > 0)
                weights.append(F.when(bottom, -1.0).when(top, 1.0).otherwise(0.0))
            places = [{"i": k, "unit": True} for k in range(len(sets))]
        sums = {"r": [_sum(w * r) for w in weights], "w": [_sum(F.abs(w)) for w in weights]}
        whole = F.col("r")[F.col("s.i")]
        p = F.when(F.col("s.unit"), F.coalesce(safe_div(whole, F.col("w")[F.col("s.i")]), F.lit(0.0))).otherwise(whole)
    names = {c: [f"{c}{k}" for k in range(len(x))] for c, x in sums.items()}
    by_date = rows.groupBy("date").agg(*[x.alias(n) for c, xs in sums.items() for n, x in zip(names[c], xs)]).select("date", *[F.array(*ns).alias(c) for c, ns in names.items()])
    each = F.array(*[F.struct(F.lit(s["params_id"]).alias("params_id"), *[F.lit(x).alias(c) for c, x in place.items()]) for s, place in zip(sets, places)])
    return by_date.withColumn("s", F.explode(each)).select("s.params_id", "date", p.alias("p"))


OBJECTIVES = ("growth", "sharpe", "mean", "win_rate")


def objectives(returns: DataFrame) -> DataFrame:
    """(params_id, growth, sharpe, mean, win_rate); a return of -1 or less leaves growth undefined for that date."""
    std = F.stddev_samp("p")
    return returns.groupBy("params_id").agg(
        (F.avg(F.when(1 + F.col("p") > 0, F.log(1 + F.col("p")))) * 252).alias("growth"), F.coalesce(F.when(std > 0, safe_div(F.avg("p") * 252, std * 252**0.5)), F.lit(0.0)).alias("sharpe"),
        F.avg("p").alias("mean"), F.avg((F.col("p") > 0).cast("double")).alias("win_rate"),
    )


def tune(values: DataFrame, policy: str, objective: str = "growth", split: TimeSplit | None = None, part: str = "validation") -> DataFrame:
    """The history of all parameter sets, best first, with ``is_best``.

    With a ``split`` only the dates of one ``part`` count, those of validation by default, so that test dates stay unseen.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    if split is not None:
        values = in_part(values, split, part)
    scored = objectives(grid_returns(values, policy)).join(grid(values.sparkSession, policy), "params_id")
    place = F.row_number().over(Window.orderBy(F.col(objective).desc_nulls_last(), "params_id"))  # one row a parameter set
    return scored.withColumn("is_best", place == 1).orderBy(F.col(objective).desc_nulls_last(), "params_id")
