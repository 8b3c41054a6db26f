"""Long series in pieces give what one task gives; as-of placement, pooled ranks, tuning sums, file reports."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window, functions as F

from marlstone.functions import scan
from marlstone.operators import backtest, features, kernels, metrics, panel, policy
from marlstone.operators.asof import as_of
from marlstone.sources import bars

DAY = dt.date(2000, 1, 1)


def walk(spark, n=700, symbols=("a", "b"), seed=2):
    """Bars of random prices with gaps, one long symbol and one short."""
    rng, rows = random.Random(seed), []
    for k, s in enumerate(symbols):
        price = 100.0
        for d in range(n if k == 0 else 40):
            price *= math.exp(rng.gauss(0, 0.02))
            gap = rng.random() < 0.03
            rows.append((s, DAY + dt.timedelta(d), price, price * 1.01, price * 0.99, None if gap else price, float(rng.randint(1, 9))))
    return spark.createDataFrame(rows, bars.SCHEMA)


def table(df, columns):
    return {(r["symbol"], r["date"]): [r[c] for c in columns] for r in df.collect()}


def same(a, b, columns, tol=1e-7):
    one, two = table(a, columns), table(b, columns)
    assert one.keys() == two.keys()
    for k, row in one.items():
        for c, x, y in zip(columns, row, two[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= tol * max(1, abs(x))), (k, c, x, y)


@pytest.fixture(scope="module")
def prices(spark):
    df = panel.add_returns(walk(spark)).withColumn("typical_price", F.col("close"))
    path = scan.pieces(df).drop("_piece")
    return path


def test_all_features_in_chunks(spark, prices):
    whole = features.compute_features(prices, windows=(5, 20), chunk_rows=0)
    cut = features.compute_features(prices, windows=(5, 20), chunk_rows=90)
    fresh = [c for c in whole.columns if c not in prices.columns]
    assert len(fresh) > 80 and set(cut.columns) == set(whole.columns)
    same(whole, cut, fresh, 1e-6)


def test_causal_ranges_in_chunks(spark, prices):
    one, two = (kernels.kernel_features(prices, ["market_efficiency"], (20,), chunk_rows=n, causal=True) for n in (0, 70))
    same(one, two, ["market_efficiency_w20"])


def test_no_window_over_a_whole_symbol(spark, prices):
    cut = features.compute_features(prices, [f.name for f in features.REGISTRY.values() if f.build and f.fact < 12], (5, 20), chunk_rows=90)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "windowspecdefinition" in line]
    names = plan.split("\n")
    assert windows and "hashpartitioning(_piece" not in plan
    # chunks have keys of their own; only the summaries of pieces are scanned by symbol
    assert any("concat_ws(:" in line for line in names)
    long_symbol = scan.in_chunks(prices, lambda p: p.withColumn("_task", F.spark_partition_id()).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))), 20, 5, 90)
    sizes = [r["n"] for r in long_symbol.where("symbol = 'a'").select("n").distinct().collect()]
    assert max(sizes) <= 90 + 25


def test_returns_and_fill_in_pieces(spark):
    df = walk(spark)
    columns = ["log_return", "forward_return", "simple_return", "forward_simple_return"]
    same(panel.add_returns(df, 3, chunk_rows=0), panel.add_returns(df, 3, chunk_rows=50), columns)
    for method in ("ffill", "bfill"):
        same(panel.fill(df, method, chunk_rows=0), panel.fill(df, method, chunk_rows=50), ["open", "close"])


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_values(spark, partitions):
    rng = random.Random(4)
    rows = [(k % 2, d, None if rng.random() < 0.2 else rng.gauss(0, 1)) for k in range(2) for d in range(60 if k else 7)] + [(2, d, None) for d in range(5)]
    df = spark.createDataFrame(rows, "symbol int, date int, x double")
    x, p, over = F.col("x"), 1 + F.col("x"), Window.partitionBy("symbol").orderBy("date")
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": x, "count": x, "min": x, "max": x, "product": p, "last": x, "next": x, "peak": p}
    got = scan.running(df, [scan.Running(k, k, v) for k, v in kinds.items()], partitions=partitions)
    want = df.withColumns({k: getattr(F, k)(kinds[k]).over(so_far) for k in ("sum", "count", "min", "max", "product")}).withColumns({
        "last": F.last(x, True).over(so_far), "next": F.first(x, True).over(over.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("peak", F.max("product").over(so_far))
    same(got, want, list(kinds), 1e-9)


def test_ewm_carries_its_whole_state(spark):
    """A piece knows all rows before it, not a halo of some half-lives: also after a gap longer than a piece."""
    rng = random.Random(8)
    xs = [rng.gauss(5, 0.02) for _ in range(60)] + [None] * 90 + [rng.gauss(5, 0.5) for _ in range(30)]
    df = spark.createDataFrame([("a", DAY + dt.timedelta(k), x) for k, x in enumerate(xs)], "symbol string, date date, log_return double").repartition(3)
    names = [f"ewm_volatility_h{h}" for h in kernels.HALF_LIVES]
    same(kernels.kernel_features(df, ["ewm_volatility"], (5,), chunk_rows=0), kernels.ewm_in_pieces(df), names, 1e-9)


def test_drawdown_and_curve_in_pieces(spark):
    rng = random.Random(1)
    rows = [(c, DAY + dt.timedelta(d), rng.gauss(0, 0.05)) for c in (1, 2) for d in range(150)]
    df = spark.createDataFrame(rows, "candidate_id int, date date, p double")
    one, two = ({r["candidate_id"]: r for r in metrics.performance(df, chunk_rows=n).collect()} for n in (0, 20))
    assert all(abs(one[c]["max_drawdown"] - two[c]["max_drawdown"]) < 1e-12 and one[c]["n_dates"] == two[c]["n_dates"] for c in one)
    daily = df.where("candidate_id = 1").select("date", "p")
    whole, cut = (backtest.summary(backtest.curve(daily, chunk_rows=n), chunk_rows=n).first() for n in (0, 20))
    assert all(abs(whole[c] - cut[c]) < 1e-9 for c in whole.asDict())


def test_autocorrelations_against_loops():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, 200)
    x[40:60] = 0.01  # constant frames have no correlation
    x[90:93] = np.nan
    for lag in (1, 2, 7):
        sums = kernels.LagSums(x, lag)
        for w in (5, 10, 40):
            got = sums.corr(w)
            for t in range(200):
                pairs = [(x[k], x[k - lag]) for k in range(max(lag, t - w + 1 + lag), t + 1) if not (np.isnan(x[k]) or np.isnan(x[k - lag]))]
                a, b = np.array(pairs).reshape(-1, 2).T
                want = np.corrcoef(a, b)[0, 1] if len(a) >= 2 and a.min() < a.max() and b.min() < b.max() else np.nan
                assert (np.isnan(got[t]) and np.isnan(want)) or abs(got[t] - want) < 1e-7, (lag, w, t, got[t], want)


def test_kernel_of_columns(spark):
    import numpy as np

    kernels.register_kernel("mean_product", lambda a, b: (a * b).mean(1), ("log_return", "volume"), centred=True)
    rows = [("a", DAY + dt.timedelta(k), float(k), None if k == 4 else float(k * k)) for k in range(9)]
    df = spark.createDataFrame(rows, "symbol string, date date, log_return double, volume double")
    got = [r[0] for r in kernels.kernel_features(df, ["mean_product"], (4,), min_periods=2).orderBy("date").select("mean_product_w4").collect()]
    for k in range(9):
        inside = [j for j in range(max(0, k - 2), min(9, k + 2)) if j != 4]
        assert abs(got[k] - np.mean([j * j * j for j in inside])) < 1e-9
    with pytest.raises(KeyError):
        kernels.kernel_features(df, ["nothing"], (4,))


def test_as_of(spark):
    left = spark.createDataFrame([("a", DAY + dt.timedelta(k), k) for k in range(20)] + [("b", DAY, 0), ("a", None, 99)], "symbol string, date date, k int")
    news = spark.createDataFrame([("a", DAY + dt.timedelta(k), float(k)) for k in (3, 3, 9)] + [("a", DAY + dt.timedelta(9), None), ("c", DAY, 1.0)], "symbol string, date date, v double")
    for strict in (False, True):
        for chunk in (0, 5):
            got = {(r["symbol"], r["k"]): (r["v"], r["as_of"]) for r in as_of(left, news, tolerance_days=4, strict=strict, chunk_rows=chunk).collect()}
            assert len(got) == 22
            for k in range(20):
                seen = [j for j in (3, 9) if (j < k if strict else j <= k)]
                want = (float(seen[-1]), DAY + dt.timedelta(seen[-1])) if seen and k - seen[-1] <= 4 else (None, None)
                assert got["a", k] == want, (strict, chunk, k, got["a", k], want)
            assert got["b", 0] == (None, None) and got["a", 99] == (None, None)


@pytest.mark.parametrize("partitions", [1, 7])
def test_pooled_rank_with_a_hot_value(spark, partitions):
    rng = random.Random(5)
    rows = [(c, k, 0.5 if k % 2 else rng.choice([None, rng.random(), float(rng.randint(0, 3))])) for c in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "candidate_id int, k int, x double").repartition(3)
    got = {(r["candidate_id"], r["k"]): r["rank"] for r in metrics.pooled_rank(df, "x", "candidate_id", partitions=partitions).collect()}
    assert len(got) == 600
    for c in (1, 2):
        xs = [x for g, _, x in rows if g == c and x is not None]
        for g, k, x in rows:
            if g == c:
                want = None if x is None else sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2
                assert got[c, k] == want
    cut = metrics.pooled_rank(df, "x", "candidate_id", partitions=7)
    assert metrics.pooled_rank(df.limit(0), "x").count() == 0 and cut.columns == [*df.columns, "rank"]


@pytest.mark.parametrize("name", ["threshold", "zscore", "kelly", "quintile"])
def test_tuning_sums(spark, name):
    """Sums by date give what each policy gives with each parameter set, row by row."""
    rng = random.Random(9)
    rows = [(DAY + dt.timedelta(d), f"s{k}", rng.choice([0.0, rng.gauss(0, 1), 0.5]) if d else 1.0, rng.gauss(0, 0.02)) for d in range(6) for k in range(3 if d == 5 else 12)]
    values = spark.createDataFrame(rows, "date date, symbol string, alpha double, forward_return double")
    got = {(r["params_id"], r["date"]): r["p"] for r in policy.grid_returns(values, name).collect()}
    sets = [r.asDict() for r in policy.grid(spark, name).collect()]
    assert len(got) == len(sets) * 6
    for s in sets[:: max(1, len(sets) // 12)]:
        args = {k: v for k, v in s.items() if k != "params_id"}
        weights = getattr(policy, name)(values, **args)
        want = {r["date"]: r["p"] for r in weights.groupBy("date").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("p")).collect()}
        assert all(abs(got[s["params_id"], d] - p) < 1e-12 for d, p in want.items()), s
    plan = policy.grid_returns(values, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan  # no copy of the panel a parameter set


def test_file_report(spark, tmp_path):
    head = "symbol,date,open,high,low,close,volume\n"
    (tmp_path / "good.csv").write_text(head + "a,2020-01-01,1,1,1,1,1\na,2020-01-02,1,1,1,2,1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text(head)
    (tmp_path / "broken.csv").write_text(head + "a,2020-01-01\n")
    (tmp_path / "partial.csv").write_text(head + "a,2020-01-01,1,1,1,1,1\nnothing\n")
    (tmp_path / "short.csv").write_text("Symbol,Date,Open,High,Low\na,2020-01-01,1,1,1\n")
    (tmp_path / "other.txt").write_text("x")
    got = {r["file"]: (r["n_rows"], r["n_bad"], r["missing"], r["status"]) for r in bars.file_report(spark, str(tmp_path)).collect()}
    assert got == {
        "good.csv": (2, 0, "", "ok"), "empty.csv": (0, 0, "", "empty"), "bare.csv": (0, 0, "", "no rows"), "broken.csv": (1, 1, "", "no rows"),
        "partial.csv": (2, 1, "", "partial"), "short.csv": (1, 0, "close, volume", "refused"),
    }
    with pytest.raises(ValueError, match="close, volume"):
        bars.read_csv(spark, str(tmp_path / "short.csv"))
    spark.createDataFrame([("a", 1.0)], "symbol string, open double").coalesce(1).write.parquet(str(tmp_path / "p"))
    (row,) = bars.file_report(spark, str(tmp_path / "p"), "*.parquet", "parquet").collect()
    assert row["status"] == "refused" and row["missing"] == "date, high, low, close, volume"
    with pytest.raises(ValueError):
        bars.read_parquet(spark, str(tmp_path / "p"))


def test_hurst_methods(spark, prices):
    out = features.hurst_exponent(prices, (20,), "dfa")
    same(out.withColumnRenamed("hurst_exponent_w20", "h"), features.compute_features(prices, ["hurst_dfa"], (20,)).withColumnRenamed("hurst_dfa_w20", "h"), ["h"])
    with pytest.raises(ValueError):
        features.hurst_exponent(prices, (20,), "other")
