"""Edge cases and properties of the signal-research operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import expressions as ex
from marlstone.functions import windows as win
from marlstone.operators import backtest, features, kernels, metrics, normalize, panel, policy, split
from marlstone.sources import bars

DAY = dt.date(2020, 1, 1)


def series(spark, **symbols):
    """Rows (symbol, date, log_return, ...) from lists of returns."""
    rows = [(s, DAY + dt.timedelta(k), None if r is None else float(r)) for s, xs in symbols.items() for k, r in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, log_return double").withColumn("volume", F.lit(1.0)).withColumn("close", F.lit(1.0))


def column(df, c, symbol="a"):
    return [r[c] for r in df.where(F.col("symbol") == symbol).orderBy("date").collect()]


def close(a, b, tol=1e-9):
    return (a is None or a != a) and (b is None or b != b) or a is not None and b is not None and abs(a - b) <= tol * max(1, abs(b))


def bar_frame(spark, closes, symbol="a"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(k), c, c, c, c, 1.0) for k, c in enumerate(closes)], bars.SCHEMA)


# ---- panel ----


def test_returns_of_gaps_and_bad_prices(spark):
    out = panel.add_returns(bar_frame(spark, [1.0, 2.0, None, 4.0, 0.0, 1.0]), 2)
    assert [x if x is None else round(x, 9) for x in column(out, "log_return")] == [None, round(math.log(2), 9), None, None, None, None]
    assert column(out, "simple_return")[1] == 1.0
    assert column(panel.preprocess(bar_frame(spark, [1.0, 2.0, 4.0, 8.0])), "close") == [2.0, 4.0]


def test_fill_stays_within_a_symbol(spark):
    df = bar_frame(spark, [1.0, None], "a").union(bar_frame(spark, [None, 5.0], "b"))
    forward, backward = panel.fill(df, "ffill"), panel.fill(df, "bfill")
    assert column(forward, "close") == [1.0, 1.0] and column(forward, "close", "b") == [None, 5.0]
    assert column(backward, "close") == [1.0, None] and column(backward, "close", "b") == [5.0, 5.0]
    with pytest.raises(ValueError):
        panel.fill(df, "spline")


def test_validation(spark):
    good = panel.preprocess(bar_frame(spark, [1.0, 2.0, 3.0, 4.0]))
    assert panel.validate(good).first()["is_valid"]
    assert panel.validate(good.union(good)).first()["message"] == "repeated keys"
    assert panel.validate(good.limit(0)).first()["message"] == "empty panel"
    assert "missing columns" in panel.validate(good.drop("close")).first()["message"]
    with pytest.raises(ValueError):
        panel.create_panel(bar_frame(spark, [1.0]))


def test_panel_gaps_are_always_filled(spark):
    """One missing volume of many is filled too; a large share only warns."""
    rows = bar_frame(spark, [float(k + 1) for k in range(12)])
    few = rows.withColumn("volume", F.when(F.dayofmonth("date") != 6, F.col("volume")))
    assert panel.create_panel(few).count() == panel.create_panel(rows).count() == 10
    many = rows.withColumn("volume", F.when(F.dayofmonth("date") == 2, F.col("volume")))
    with pytest.warns(UserWarning):
        assert panel.create_panel(many).count() == 10
    assert panel.create_panel(few, fill_method=None).count() == 9


def test_bad_lines(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,1,2,10\n2020-01-02,1,2\n2020-01-03,x,2,1,2,10\n")
    df = bars.read_directory(spark, str(tmp_path))
    assert [tuple(r) for r in bars.bad_lines(df).collect()] == [("AAA", 3, 1, 2)]
    assert df.where("open IS NULL AND close IS NOT NULL").count() == 1 and dict(df.dtypes)["date"] == "date"


def test_readers(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,1,2,10\n2020-01-02,2,3,2,NaN,20\n")
    (tmp_path / "BBB.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,1,2,10\n")
    df = bars.read_directory(spark, str(tmp_path))
    assert {(r["symbol"], r["close"]) for r in df.collect()} == {("AAA", 2.0), ("AAA", None), ("BBB", 2.0)}
    assert {r["symbol"] for r in bars.read_csv(spark, str(tmp_path / "AAA.csv"), "X").collect()} == {"X"}
    assert bars.check_columns(df) == [] and bars.check_columns(df.drop("open")) == ["open"]
    df.write.parquet(str(tmp_path / "p"))
    assert bars.read_parquet(spark, str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError):
        bars.read_directory(spark, str(tmp_path), file_type="xml")
    with pytest.raises(Exception):
        bars.read_directory(spark, str(tmp_path / "nothing"))
    bars.save_results(df.select("close"), str(tmp_path / "runs"), "r1", "json")
    bars.save_results(df.select("close"), str(tmp_path / "runs"), "r2", "json")
    assert {r["run_id"] for r in bars.load_results(spark, str(tmp_path / "runs"), "json").collect()} == {"r1", "r2"}


# ---- rolling windows and kernels ----


def test_constant_series_gives_null(spark):
    df = series(spark, a=[0.01] * 30)
    names = ["rolling_kurtosis", "rolling_skewness", "rolling_autocorr", "trend_strength", "normalized_deviation", "hurst_rs", "extreme_ratio", "ar1_rsquared"]
    out = features.compute_features(df, names, (10,))
    for n in names:
        assert column(out, f"{n}_w10")[-1] is None, n


def test_gate_and_full(spark):
    df = series(spark, a=[0.01 * (-1) ** k * k for k in range(30)])
    out = features.compute_features(df, ["rolling_volatility", "rolling_return"], (5, 20))
    assert [x is None for x in column(out, "rolling_volatility_w20")] == [k < 9 for k in range(30)]
    assert [x is None for x in column(out, "rolling_volatility_w5")] == [k < 4 for k in range(30)]
    assert [x is None for x in column(out, "rolling_return_w20")] == [k < 19 for k in range(30)]


def test_centred_frame(spark):
    out = series(spark, a=range(10)).withColumn("m", win.rolling_mean(F.col("log_return"), win.centred(4)))
    assert column(out, "m")[4] == (2 + 3 + 4 + 5) / 4


def plain(name, x):
    """One window, from the definitions."""
    x = np.array(x, float)
    n = len(x)
    if name == "hill_estimator":
        t = np.sort(np.abs(x))[::-1][: max(10, int(n * 0.05))]
        return 1 / np.mean(np.log(t / t[-1]))
    if name == "extreme_ratio":
        return sum(abs(v) > 2 * x.std() for v in x) / (n * 0.04550026389635842)
    if name == "hurst_rs":
        z = np.cumsum(x - x.mean())
        return min(1, max(0, math.log((z.max() - z.min()) / x.std()) / math.log(n) + 0.5))
    if name == "hurst_dfa":
        lo, hi = max(4, int(0.1 * n)), min(int(0.5 * n), 100)
        sizes = list(range(lo, hi, max(1, (hi - lo) // 5))) if hi > lo else []
        if len(sizes) < 2:
            return None
        y, f = np.cumsum(x - x.mean()), []
        for s in sizes:
            rms = []
            for k in range(n // s):
                seg = y[k * s : (k + 1) * s]
                fit = np.polyval(np.polyfit(np.arange(s), seg, 1), np.arange(s))
                rms.append(math.sqrt(np.mean((seg - fit) ** 2)))
            f.append(math.log(np.mean(rms)))
        return min(1, max(0, np.polyfit(np.log(sizes), f, 1)[0]))
    if name == "up_down_run_ratio":
        s, runs = np.sign(x), []
        for v in s:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        pairs = [(b[0], a[1]) for a, b in zip(runs, runs[1:])]
        up, down = [k for g, k in pairs if g > 0], [k for g, k in pairs if g < 0]
        return np.mean(up) / np.mean(down) if up and down else None
    if name == "zero_crossing_rate":
        s = np.sign(x - x.mean())
        return sum(a != b for a, b in zip(s, s[1:])) / (n - 1)
    if name.startswith("hilbert"):
        y = x - x.mean()
        size = 1 << math.ceil(math.log2(n))
        p = np.pad(y, (0, size - n), mode="reflect")
        h = np.full(size, 2.0)
        h[0] = h[size // 2] = 1
        z = np.fft.ifft(np.fft.fft(p) * h)[n - 1].real
        return math.hypot(y[-1], z) if name.endswith("amplitude") else math.atan2(z, y[-1])
    if name.startswith("wavelet_energy"):
        size = 1 << math.ceil(math.log2(n))
        a, details = list(np.pad(x, (0, size - n), mode="symmetric")), []
        for _ in range(3):
            m = len(a)
            at = lambda i: a[(lambda q: q if q < m else 2 * m - 1 - q)(i % (2 * m))]  # noqa: B023, E731
            cut = lambda f: [sum(f[j] * at(2 * k + 1 - j) for j in range(8)) for k in range((m + 7) // 2)]  # noqa: B023, E731
            details.append(np.var(cut(kernels.HIGH_PASS)))
            a = cut(kernels.LOW_PASS)
        return details[::-1][int(name[-1]) - 1]
    if name == "spectral_power_ratio":
        p = np.abs(np.fft.fft(x, 256)) ** 2
        return p[:64].sum() / p[64:].sum()
    if name == "spectral_entropy":
        p = np.abs(np.fft.fft(x, 256)) ** 2
        p = p[p > 0] / p.sum()
        return -(p * np.log(p)).sum()
    if name == "optimal_taylor_exponent":
        best = (-2, 1.0)
        for d in np.linspace(0.1, 2, 20):
            c = np.corrcoef(np.abs(x[:-1]) ** d, np.abs(x[1:]) ** d)[0, 1]
            if c > best[0]:
                best = (c, d)
        return best[1]
    raise KeyError(name)


def test_kernels_match_plain_loops(spark):
    rng = random.Random(5)
    xs = [rng.gauss(0, 0.02) for _ in range(45)]
    names = ["hill_estimator", "extreme_ratio", "hurst_rs", "hurst_dfa", "up_down_run_ratio", "zero_crossing_rate", "hilbert_amplitude", "hilbert_phase", "wavelet_energy_1", "wavelet_energy_3", "spectral_power_ratio", "spectral_entropy", "optimal_taylor_exponent"]
    whole = kernels.kernel_features(series(spark, a=xs), names, (20,))
    # overlapping chunks change nothing
    cut = kernels.kernel_features(series(spark, a=xs), names, (20,), chunk_rows=25)
    for n in names:
        got, again = column(whole, f"{n}_w20"), column(cut, f"{n}_w20")
        for k in range(45):
            want = plain(n, xs[max(0, k - 19) : k + 1]) if k >= 9 else None
            assert close(got[k], want, 1e-6), (n, k, got[k], want)
            assert close(again[k], got[k]), (n, k)


def test_kernels_skip_gaps(spark):
    """A frame with gaps gives what its values alone give."""
    rng = random.Random(15)
    xs = [None if k % 11 == 4 else rng.gauss(0, 0.02) for k in range(60)]
    names = ["hurst_rs", "up_down_run_ratio", "wavelet_energy_2", "zero_crossing_rate"]
    out = kernels.kernel_features(series(spark, a=xs), names, (20,))
    for n in names:
        got = column(out, f"{n}_w20")
        for k in range(60):
            have = [x for x in xs[max(0, k - 19) : k + 1] if x is not None]
            assert close(got[k], plain(n, have) if len(have) >= 10 else None, 1e-6), (n, k)


def test_ewm(spark):
    rng = random.Random(6)
    xs = [rng.gauss(0, 0.02) for _ in range(40)]
    got = column(kernels.kernel_features(series(spark, a=xs), ["ewm_volatility"], (5,)), "ewm_volatility_h10")
    decay = 2 ** (-1 / 10)
    for k in range(40):
        w = np.array([decay ** (k - j) for j in range(k + 1)])
        x = np.array(xs[: k + 1])
        m = (w * x).sum() / w.sum()
        var = (w * (x - m) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum()) if k else None
        assert close(got[k], math.sqrt(var) if k >= 9 else None, 1e-9)


def test_composed_kernels(spark):
    rng = random.Random(7)
    df = series(spark, a=[rng.gauss(0, 0.02) for _ in range(40)])
    out = features.compute_features(df, ["market_efficiency", "adaptive_market_hypothesis", "mean_reversion_signal"], (20,))
    assert [c for c in out.columns if c.startswith("_")] == []
    assert all(0 <= x <= 2 for x in column(out, "market_efficiency_w20") if x is not None)
    causal = kernels.kernel_features(df, ["market_efficiency"], (20,), causal=True)
    shorter = kernels.kernel_features(series(spark, a=[r["log_return"] for r in df.orderBy("date").collect()][:30]), ["market_efficiency"], (20,), causal=True)
    assert all(close(a, b) for a, b in zip(column(causal, "market_efficiency_w20"), column(shorter, "market_efficiency_w20")))  # no look ahead


def test_feature_registry(spark):
    assert len(features.REGISTRY) >= 53
    assert not any("wavelet" in f.tags for f in features.select_features(exclude_tags=("wavelet",)))
    assert {f.name for f in features.select_features(fact=7)} == {"rolling_skewness", "downside_frequency"}
    assert features.feature_summary(spark).count() == 15
    with pytest.raises(KeyError):
        features.select_features(["nothing"])
    features.register(features.Feature("range_of_returns", 1, lambda w: F.max("log_return").over(win.frame(w)) - F.min("log_return").over(win.frame(w))))
    assert column(features.compute_features(series(spark, a=range(12)), ["range_of_returns"], (5,)), "range_of_returns_w5")[-1] == 4.0
    del features.REGISTRY["range_of_returns"]


# ---- normalisation ----


def cross(spark, rows):
    return spark.createDataFrame([(s, DAY + dt.timedelta(d), x) for s, d, x in rows], "symbol string, date date, x double")


def test_normalisation_ties_nulls_and_constants(spark):
    df = cross(spark, [("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 3.0), ("d", 0, None), ("a", 1, 5.0), ("a", 2, 2.0), ("b", 2, 2.0)])
    ranks = {(r["symbol"], r["date"]): r["x"] for r in normalize.normalize(df, "rank").collect()}
    assert ranks["a", DAY] == ranks["b", DAY] == 0.5 and ranks["c", DAY] == 1.0 and ranks["d", DAY] is None
    z = {(r["symbol"], r["date"]): r["x"] for r in normalize.normalize(df, "zscore").collect()}
    assert z["a", DAY + dt.timedelta(2)] is None and z["a", DAY + dt.timedelta(1)] is None and abs(z["a", DAY] + z["b", DAY] + z["c", DAY]) < 1e-12
    assert {r["x"] for r in normalize.normalize(df, "minmax").where(F.col("date") == DAY).collect()} == {0.0, 1.0, None}
    assert set(normalize.normalize(df, "combined").columns) == {"symbol", "date", "raw_x", "rank_x", "zscore_x"}
    assert normalize.handle_missing(df, "drop").count() == 6 and normalize.handle_missing(df, "fill").where("x IS NULL").count() == 1
    with pytest.raises(ValueError):
        normalize.normalize(df, "softmax")


# ---- splits ----


def test_splits_do_not_overlap(spark):
    df = series(spark, a=[0.0] * 400, b=[0.0] * 400)
    s = split.split_by_ratio(df)
    assert (s.validation_start - s.train_end).days == 1 and (s.train_end - s.train_start).days == 239
    labelled = split.label(df, s)
    assert labelled.where("split IS NULL").count() == 0 and labelled.groupBy("date").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert sum(f.count() for f in split.split_frames(df, s)) == 800
    with pytest.raises(ValueError):
        split.TimeSplit(DAY, DAY, DAY, DAY, DAY, DAY)
    assert split.train_test(df, 0.25).where("is_train").count() == 600


# ---- expressions ----


def test_expressions(spark):
    for text in ("x0 + x1", "x0 / x1", "abs(x0)", "neg(x0)", "(x0 + x1) / (x2 - x3)", "-x0 * 2.5e-1"):
        assert ex.is_valid(text), text
    for text in ("", "  ", "x0 ** 2", "exp(x0)", "log(x0)", "sin(x0)", "x0 / 0", "(x0", "x0 x1", "x0 +", "__import__('os')"):
        assert not ex.is_valid(text), text
    df = spark.createDataFrame([(1.0, 2.0, -3.0, 0.0)], "x0 double, x1 double, x2 double, x10 double")
    assert ex.predict(df, "x0 + x1 * abs(x2)").first()["alpha"] == 7.0
    assert ex.predict(df, "x0 / x10").first()["alpha"] is None
    assert ex.predict(df, "8 - 2 - 1").first()["alpha"] == 5.0
    t = ex.parse("x0 / x10 + x0")
    assert ex.used_features(t) == ["x0", "x10"] and ex.complexity(t) == 6 and ex.operator_counts(t) == {"+": 1, "/": 1} and ex.within_limits(t)
    with pytest.raises(ex.ExpressionError):
        ex.to_column(ex.parse("nope"), ["x0"])
    too_large = " + ".join(["x0"] * 12)
    table = {r["expression"]: r for r in ex.candidate_table(spark, ["x0", too_large, "x0 ^ x1"]).collect()}
    assert table["x0"]["within_limits"] and not table[too_large]["within_limits"] and not table["x0 ^ x1"]["is_valid"]
    with pytest.raises(ValueError):
        metrics.losses(df.withColumn("forward_return", F.lit(0.0)), {0: too_large})
    two = ex.enumerate_expressions(["a", "b"], levels=2)
    assert len(two) == len(set(two)) and "(a + b) / (a - b)" in two and all(ex.within_limits(ex.parse(x)) for x in two)
    with pytest.raises(ValueError):
        ex.enumerate_expressions(["a", "b"], levels=2, limit=100)
    assert len(ex.enumerate_expressions(["a", "b"])) == len(set(ex.enumerate_expressions(["a", "b"])))


# ---- metrics ----


def scored(spark, rows):
    return spark.createDataFrame([(0, DAY + dt.timedelta(d), s, a, y) for d, s, a, y in rows], "candidate_id int, date date, symbol string, alpha double, forward_return double")


def random_values(spark, days=20, n=10, seed=1):
    rng = random.Random(seed)
    return scored(spark, [(d, f"s{k}", rng.gauss(0, 1), rng.gauss(0, 0.02)) for d in range(days) for k in range(n)])


def test_ic_of_monotone_targets(spark):
    v = random_values(spark)
    up = metrics.information_coefficient(v.withColumn("forward_return", 2 * F.col("alpha") + 0.1)).first()
    down = metrics.information_coefficient(v.withColumn("forward_return", -F.col("alpha"))).first()
    assert up["ic"] > 0.999 and down["ic"] < -0.999 and up["n"] == 200
    assert metrics.information_coefficient(v.limit(1)).first()["ic"] == 0.0
    assert metrics.information_coefficient(v.withColumn("alpha", F.lit(1.0))).first()["ic"] == 0.0


def test_pooled_rank_with_ties(spark):
    rng = random.Random(2)
    xs = [float(rng.randint(0, 30)) for _ in range(500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    order = sorted(xs)
    for r in metrics.pooled_rank(df, "x", partitions=7).collect():
        low, high = order.index(r["x"]), len(order) - order[::-1].index(r["x"])
        assert r["rank"] == (low + 1 + high) / 2


def test_p_value():
    assert metrics.t_p_value(0.0, 100) == 1.0 and metrics.t_p_value(1.0, 10) == 0.0 and metrics.t_p_value(0.3, 2) == 1.0
    for r, n in ((0.5, 12), (0.2, 100), (-0.9, 6), (0.05, 1000)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        x = np.linspace(0, t, 200_001)
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert metrics.t_p_value(r, n) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)


def test_small_cross_sections_and_nulls(spark):
    v = scored(spark, [(0, f"s{k}", float(k), 0.01 * k) for k in range(4)] + [(1, f"s{k}", float(k), 0.01 * k) for k in range(5)] + [(1, "s9", None, 9.0), (1, "s8", 9.0, None)])
    daily = metrics.long_short(v).collect()
    assert len(daily) == 1 and daily[0]["p"] == pytest.approx(0.04)
    assert metrics.performance(metrics.long_short(v)).first()["sharpe"] == 0.0
    assert metrics.ic_stability(v).first()["ic_stability"] == 1.0


def test_turnover(spark):
    names = [f"s{k}" for k in range(5)]
    stay = [(d, n, float(k), 0.0) for d in range(3) for k, n in enumerate(names)]
    turn = [(d, n, float(k if d % 2 == 0 else 4 - k), 0.0) for d in range(3) for k, n in enumerate(names)]
    assert metrics.turnover(scored(spark, stay)).first()["turnover"] == 0.0
    assert metrics.turnover(scored(spark, turn)).first()["turnover"] == 1.0


def test_perfect_signal(spark):
    v = random_values(spark).withColumn("forward_return", F.col("alpha") / 50)
    out = metrics.passes(metrics.evaluate(v, {0: 1}), {"turnover": 2}).first()
    assert out["passed"] and out["sharpe"] > 3 and out["win_rate"] == 1.0


# ---- policies and backtest ----


def test_policy_sides(spark):
    v = scored(spark, [(0, f"s{k}", float(k - 4), 0.01) for k in range(10)] + [(1, f"s{k}", 1.0 + k, 0.01) for k in range(5)])
    for name in ("quintile", "zscore"):
        gross = policy.POLICIES[name](v).groupBy("date").agg(F.sum(F.abs("weight")).alias("g")).collect()
        assert all(r["g"] == pytest.approx(1.0) for r in gross)
    q = {r["symbol"]: r["weight"] for r in policy.quintile(v).where(F.col("date") == DAY).collect()}
    assert sum(w > 0 for w in q.values()) == 3 and sum(w < 0 for w in q.values()) == 2
    one_sided = policy.sign(v).where(F.col("date") > DAY).agg(F.sum("weight")).first()[0]
    assert one_sided == pytest.approx(1.0)
    assert policy.kelly(v).where("weight < 0").count() == 0
    assert policy.apply_capital(policy.sign(v), 100.0).where(F.col("date") > DAY).agg(F.sum("position")).first()[0] == pytest.approx(100.0)


def test_grids_and_tuning(spark):
    assert policy.grid(spark, "threshold").count() == 240 and policy.grid(spark, "zscore").count() == 10 and policy.grid(spark, "kelly").count() == 60
    v = random_values(spark).drop("candidate_id")
    out = policy.tune(v, "quintile").collect()
    assert len(out) == 3 and [r["is_best"] for r in out] == [True, False, False]
    with pytest.raises(ValueError):
        policy.tune(v, "quintile", "fame")
    with pytest.raises(ValueError):
        policy.grid(spark, "sign")


def test_tuning_and_testing_see_their_own_part(spark):
    """Weights are tuned on validation dates, candidates judged on test dates; what happens elsewhere changes nothing."""
    v = random_values(spark, days=300, n=6)
    parts = split.split_by_ratio(v, min_samples=20)
    spoiled = lambda part: v.withColumn("forward_return", F.when(F.col("date").between(F.lit(getattr(parts, part + "_start")), F.lit(getattr(parts, part + "_end"))), -F.col("forward_return")).otherwise(F.col("forward_return")))
    tuned = lambda x: [tuple(r) for r in policy.tune(x.drop("candidate_id"), "quintile", split=parts).collect()]
    assert tuned(v) == tuned(spoiled("test")) != tuned(spoiled("validation"))
    tested = lambda x: [tuple(r) for r in metrics.evaluate_test(x, parts, {0: 1}).collect()]
    assert tested(v) == tested(spoiled("train")) != tested(spoiled("test"))
    assert metrics.evaluate_test(v, parts, {0: 1}).first()["n_observations"] == 360


def test_backtest_ruin_and_range(spark):
    v = scored(spark, [(d, f"s{k}", float(k), -2.0 if k == 4 else 0.0) for d in range(3) for k in range(5)]).drop("candidate_id")
    daily = backtest.daily_returns(v, "2020-01-02")
    assert daily.count() == 2
    assert backtest.summary(daily).first()["n_dates"] == 2


def test_exchanges_of_the_feature_store(spark):
    df = series(spark, a=[0.01, -0.02] * 10, b=[0.02, 0.01] * 10)
    names = [f.name for f in features.REGISTRY.values() if f.build and not f.needs and f.fact < 10]
    plan = features.compute_features(df, names, (5,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_front_of_losses_that_add_up_anew(spark):
    """Losses whose last digits differ each time that they are computed: the front holds the best candidate of every complexity all the same."""
    noise = F.udf(lambda k: 1e-12 * random.random(), "double").asNondeterministic()
    scored = spark.range(40).select(F.col("id").cast("int").alias("candidate_id"), (F.col("id") % 4).cast("int").alias("complexity"), (100 - F.col("id") + noise("id")).alias("loss"))
    front = metrics.pareto_front(scored).collect()
    assert sorted((r["candidate_id"], r["complexity"]) for r in front) == [(36, 0), (37, 1), (38, 2), (39, 3)]
