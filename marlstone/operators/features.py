"""Rolling features per symbol: a registry of built-in column expressions and of array kernels.

Each feature is named ``{name}_w{window}`` (``{name}`` where the window has no
influence). All windows count rows. A feature is NULL until its frame holds
``min_periods`` returns (or as many as the window has), unless it asks for a full frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.functions import scan
from marlstone.functions.windows import (
    MIN_PERIODS, clamp, frame, gated, ordered, rolling_corr, rolling_cov, rolling_kurt, rolling_mean, rolling_r2, rolling_skew, rolling_std, rolling_var, safe_div,
)

WINDOWS = (5, 10, 20, 60)
R = "log_return"


@dataclass(frozen=True)
class Feature:
    name: str
    fact: int
    build: Callable[[int], Column] | None  # None: an array kernel of the same name
    full: bool = False  # needs a full frame
    windowed: bool = True  # the window has an influence
    count: int | None = None  # rows of the frame that gates it, if not the window
    needs: tuple[str, ...] = ()  # input columns beside the return
    tags: tuple[str, ...] = ()
    steps: tuple[tuple[str, Callable[[int], Column]], ...] = ()  # columns that it is built on, each over the ones before


def _r() -> Column:
    return F.col(R)


def _up() -> Column:
    return F.when(_r().isNotNull(), F.greatest(_r(), F.lit(0.0)))


def _down() -> Column:
    return F.when(_r().isNotNull(), F.least(_r(), F.lit(0.0)))


def _variance_ratio(k: int = 2) -> Callable[[int], Column]:
    """Variance of every k-th return, counted from the frame's first row, to k times the variance of all."""

    def build(w: int) -> Column:
        row = F.row_number().over(ordered())
        picked = None
        for c in range(k):
            v = F.var_samp(F.when(F.pmod(row, F.lit(k)) == c, _r())).over(frame(w))
            hit = F.pmod(row - w + 1, F.lit(k)) == c
            picked = F.when(hit, v) if picked is None else picked.when(hit, v)
        return safe_div(picked, k * rolling_var(_r(), frame(w)))

    return build


def _permutation_entropy(w: int) -> Column:
    """Entropy of the order patterns of three consecutive returns, over ln 3!; equal values rank by position."""
    import math

    x, y, z = F.lag(R, 2).over(ordered()), F.lag(R, 1).over(ordered()), _r()
    code = F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), (x <= y).cast("int") * 4 + (y <= z).cast("int") * 2 + (x <= z).cast("int"))
    inner = frame(w, 2)
    total = F.count(code).over(inner)
    out = F.lit(0.0)
    for c in range(8):
        p = safe_div(F.count(F.when(code == c, 1)).over(inner).cast("double"), total)
        out = out - F.when(p > 0, p * F.log(p)).otherwise(0.0)
    return F.when(total > 0, out / math.log(6))


def _product(w: int) -> Column:
    return F.product(1 + _r()).over(frame(w)) - 1


def _full(x: Column, w: int) -> Column:
    return F.when(F.count(R).over(frame(w)) == w, x)


def _build(name: str, fact: int, build, **options) -> Feature:
    return Feature(name, fact, build, **options)


_STD20 = (("_std20", lambda w: gated(rolling_std(_r(), frame(20)), F.count(R).over(frame(20)), 20)),)
_MARKET = ("market_return", "market_lag")

_BUILT = [
    _build("rolling_kurtosis", 1, lambda w: rolling_kurt(_r(), frame(w))),
    Feature("hill_estimator", 1, None),
    Feature("extreme_ratio", 1, None),
    _build("rolling_volatility", 2, lambda w: rolling_std(_r(), frame(w))),
    Feature("volatility_clustering", 2, None),
    _build("volatility_ratio", 2, lambda w: safe_div(gated(rolling_std(_r(), frame(5)), F.count(R).over(frame(5)), 5), rolling_std(_r(), frame(60))), windowed=False, count=60),
    Feature("ewm_volatility", 2, None),
    _build("volatility_of_volatility", 2, lambda w: gated(rolling_std(F.col("_std20"), frame(60)), F.count("_std20").over(frame(60)), 60), windowed=False, count=1, steps=_STD20),
    _build("downside_upside_vol_ratio", 3, lambda w: safe_div(rolling_std(F.abs(_down()), frame(w)), rolling_std(_up(), frame(w)))),
    _build("leverage_correlation", 3, lambda w: rolling_corr(_r(), F.col("_dstd20"), frame(w)), steps=(*_STD20, ("_dstd20", lambda w: F.col("_std20") - F.lag("_std20").over(ordered())))),
    _build("gjr_asymmetry", 3, lambda w: safe_div(rolling_mean(_down() * _down(), frame(w)), rolling_mean(_up() * _up(), frame(w)))),
    _build("volume_volatility_corr", 4, lambda w: rolling_corr(F.abs(_r()), F.col("volume"), frame(w)), needs=("volume",)),
    _build("relative_volume", 4, lambda w: safe_div(F.col("volume"), rolling_mean(F.col("volume"), frame(w))), needs=("volume",)),
    _build("volume_surprise", 4, lambda w: safe_div(F.col("volume"), F.max("volume").over(frame(w))), needs=("volume",)),
    _build("volume_weighted_volatility", 4, lambda w: rolling_std(_r() * F.col("volume"), frame(w)), needs=("volume",)),
    _build("dollar_volume", 4, lambda w: F.col("volume") * F.coalesce("typical_price", "close"), windowed=False, count=0, needs=("volume", "typical_price", "close")),
    Feature("rolling_autocorr", 5, None),
    _build("variance_ratio", 5, _variance_ratio(), full=True),
    Feature("hurst_exponent", 6, None),
    Feature("hurst_rs", 6, None),
    Feature("hurst_dfa", 6, None),
    Feature("autocorr_decay", 6, None, full=True),
    Feature("acf_decay_ratio", 6, None),
    _build("rolling_skewness", 7, lambda w: rolling_skew(_r(), frame(w))),
    _build("downside_frequency", 7, lambda w: safe_div(F.count(F.when(_r() < -0.01, 1)).over(frame(w)).cast("double"), F.count(F.when(_r() > 0.01, 1)).over(frame(w)))),
    _build(
        "kurtosis_ratio", 8,
        lambda w: safe_div(gated(rolling_kurt(_r(), frame(20)), F.count(R).over(frame(20)), 20), gated(rolling_kurt(F.col("_prod5"), frame(100)), F.count("_prod5").over(frame(100)), 100)),
        windowed=False, count=1, steps=(("_prod5", lambda w: _full(_product(5), 5)),),
    ),
    Feature("up_down_run_ratio", 9, None),
    _build("conditional_mean_ratio", 9, lambda w: safe_div(rolling_mean(_up(), frame(w)), F.abs(rolling_mean(_down(), frame(w))))),
    _build("gain_loss_asymmetry", 9, lambda w: (rolling_skew(_r(), frame(w)) + (1 - safe_div(rolling_mean(_up(), frame(w)), F.abs(rolling_mean(_down(), frame(w)))))) / 2),
    _build("hodrick_prescott_cycle", 10, lambda w: _r() - rolling_mean(_r(), frame(w))),
    Feature("hilbert_amplitude", 10, None, tags=("hilbert",)),
    Feature("hilbert_phase", 10, None, tags=("hilbert",)),
    Feature("zero_crossing_rate", 10, None),
    _build("normalized_deviation", 10, lambda w: safe_div(_r() - rolling_mean(_r(), frame(w)), rolling_std(_r(), frame(w)))),
    Feature("mean_reversion_signal", 10, None),
    _build("rolling_return", 11, _product, full=True),
    *[_build(f"cumulative_return_{n}", 11, lambda w, n=n: _full(_product(n), n), windowed=False, count=1) for n in (20, 60, 120, 252)],
    _build("trend_strength", 11, lambda w: safe_div(rolling_mean(_r(), frame(w)), rolling_std(_r(), frame(w))) * (252 / w) ** 0.5),
    _build("trend_linearity", 11, lambda w: rolling_r2(F.col("_total"), F.col("_row"), frame(w)), steps=(
        ("_total", lambda w: F.sum(R).over(ordered().rowsBetween(Window.unboundedPreceding, 0))), ("_row", lambda w: F.row_number().over(ordered()).cast("double")),
    )),
    _build("jegadeesh_titman_momentum", 11, lambda w: _full(_product(252), 252) - _full(_product(20), 20), windowed=False, count=1),
    _build("rolling_beta", 12, lambda w: safe_div(rolling_cov(_r(), F.col("market_return"), frame(w)), rolling_var(F.when(_r().isNotNull(), F.col("market_return")), frame(w))), needs=_MARKET),
    _build("hou_moskowitz_delay", 12, lambda w: F.when(rolling_var(_r(), frame(w)) > 0, rolling_r2(_r(), F.col("market_lag"), frame(w)) - rolling_r2(_r(), F.col("market_return"), frame(w))), needs=_MARKET),
    _build(
        "lead_lag_effect", 12,
        lambda w: safe_div(rolling_cov(_r(), F.col("market_return"), frame(w)), rolling_var(F.when(_r().isNotNull(), F.col("market_return")), frame(w))) - rolling_corr(_r(), F.col("market_lag"), frame(w)), needs=_MARKET,
    ),
    *[Feature(f"wavelet_energy_{k}", 13, None, tags=("wavelet",)) for k in (1, 2, 3)],
    Feature("wavelet_noise_to_signal", 13, None, tags=("wavelet",)),
    Feature("spectral_power_ratio", 13, None, tags=("spectral",)),
    Feature("taylor_ratio", 14, None),
    Feature("optimal_taylor_exponent", 14, None),
    Feature("spectral_entropy", 15, None, tags=("spectral",)),
    _build("permutation_entropy", 15, _permutation_entropy),
    Feature("ar1_rsquared", 15, None),
    Feature("market_efficiency", 15, None, tags=("spectral",)),
    Feature("adaptive_market_hypothesis", 15, None, tags=("spectral",)),
]
REGISTRY: dict[str, Feature] = {f.name: f for f in _BUILT}


def _variance_ratio_documented(k: int = 2) -> Callable[[int], Column]:
    """Variance of k-row sums to k times the variance of single returns."""

    def build(w: int) -> Column:
        sums = sum(F.lag(R, j).over(ordered()) for j in range(1, k)) + _r()
        return safe_div(F.var_samp(sums).over(frame(w, k - 1)), k * rolling_var(_r(), frame(w)))

    return build


#: Features by their documented definition, where what is computed by default differs from it.
VARIANTS: dict[str, Feature] = {
    f.name: f
    for f in (
        Feature("variance_ratio_documented", 5, _variance_ratio_documented(), full=True),
        Feature("up_down_run_ratio_documented", 9, None),
        Feature("hilbert_amplitude_documented", 10, None, tags=("hilbert",)),
        Feature("hilbert_phase_documented", 10, None, tags=("hilbert",)),
        *[Feature(f"wavelet_energy_{k}_documented", 13, None, tags=("wavelet",)) for k in (1, 2, 3)],
        Feature("wavelet_noise_to_signal_documented", 13, None, tags=("wavelet",)),
    )
}

#: The facts that the features measure.
FACTS = {
    1: "heavy tails", 2: "volatility clustering", 3: "leverage effect", 4: "volume and volatility", 5: "linear autocorrelation", 6: "long memory", 7: "skewness", 8: "aggregational gaussianity",
    9: "gain and loss asymmetry", 10: "mean reversion", 11: "momentum", 12: "lead and lag", 13: "scaling", 14: "taylor effect", 15: "efficiency",
}


def register(feature: Feature) -> None:
    """Add a feature of one's own: ``build(w)`` gives a column over the panel."""
    REGISTRY[feature.name] = feature


def select_features(names: list[str] | None = None, fact: int | None = None, exclude_tags: tuple[str, ...] = ()) -> list[Feature]:
    """Features by name or by fact, without those that carry an excluded tag; unknown names raise."""
    known = REGISTRY | VARIANTS
    unknown = [n for n in names or () if n not in known]
    if unknown:
        raise KeyError(", ".join(unknown))
    picked = [known[n] for n in names] if names else list(REGISTRY.values())
    return [f for f in picked if (fact is None or f.fact == fact) and not set(f.tags) & set(exclude_tags)]


def feature_summary(spark) -> DataFrame:
    """(fact, fact_name, n_features, features)."""
    rows = [(k, name, len(own), ", ".join(f.name for f in own)) for k, name in FACTS.items() for own in [[f for f in REGISTRY.values() if f.fact == k]]]
    return spark.createDataFrame(rows, "fact int, fact_name string, n_features int, features string")


def add_market(panel: DataFrame) -> DataFrame:
    """Equal-weighted market return per date, and the one of the market's previous date (one row a date)."""
    market = panel.groupBy("date").agg(F.avg(R).alias("market_return"))
    market = market.withColumn("market_lag", F.lag("market_return").over(Window.orderBy("date")))
    # one row a date, and no symbols: its size is bounded by the calendar, but the join is left to the optimiser
    return panel.join(market, "date")


def column_name(feature: Feature, w: int) -> str:
    return f"{feature.name}_w{w}" if feature.windowed else feature.name


#: Steps that depend on all rows so far: a kind of running value, and the value it is taken of.
_RUNNING = {"_total": ("sum", R), "_row": ("count", None)}
#: Rows before a frame's own that built-in features look at: the longest fixed frame and the steps below it.
_LOOK_BACK = 260


def with_market(panel: DataFrame, features: list[Feature]) -> DataFrame:
    needed = any(set(f.needs) & set(_MARKET) for f in features) and "market_return" not in panel.columns
    return add_market(panel) if needed else panel


def builtin_features(panel: DataFrame, features: list[Feature], windows: tuple[int, ...] = WINDOWS, min_periods: int | str = MIN_PERIODS) -> DataFrame:
    """The panel with a column for each built-in feature and window; one exchange by symbol for all of them."""
    panel = with_market(panel, features)
    keep = panel.columns
    steps = {name: build for f in features for name, build in f.steps if name not in keep}
    for name, build in steps.items():
        panel = panel.withColumn(name, build(0))
    out: dict[str, Column] = {}
    for f in features:
        for w in windows if f.windowed else (0,):
            value = f.build(w)
            if f.full:
                value = _full(value, w)
            elif f.windowed or f.count:
                size = w if f.windowed else f.count
                value = gated(value, F.count(R).over(frame(size)), size, min_periods)
            out[column_name(f, w)] = value
    return panel.withColumns(out).select(*keep, *[c for c in out if c not in keep]) if out else panel


def compute_features(panel: DataFrame, names: list[str] | None = None, windows: tuple[int, ...] = WINDOWS, min_periods: int | str = MIN_PERIODS, exclude_tags: tuple[str, ...] = (), chunk_rows: int | None = None) -> DataFrame:
    """All asked features: built-in ones in one select, array kernels in one grouped pass, both behind one exchange by symbol.

    Where a symbol has more rows than a task should hold (or with ``chunk_rows``), both run in overlapping
    chunks of its rows, and running values by carries (``functions.scan``); the results are the same.
    """
    from marlstone.operators.kernels import kernel_features

    picked = select_features(names, exclude_tags=exclude_tags)
    if "typical_price" not in panel.columns:
        panel = panel.withColumn("typical_price", F.lit(None).cast("double"))
    built, kernels = [f for f in picked if f.build], [f.name for f in picked if not f.build]
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if scan.is_long(panel) else 0
    if not chunk_rows:
        out = builtin_features(scan.by_key(with_market(panel, built)), built, windows, min_periods)
        return kernel_features(out, kernels, windows, min_periods, 0) if kernels else out
    out = with_market(panel, built)
    keep = out.columns
    if built:
        used = [n for n in _RUNNING if any(n == step for f in built for step, _ in f.steps)]
        if used:
            out = scan.running(out, [scan.Running(n, kind, F.col(of) if of else F.lit(1)) for n in used for kind, of in [_RUNNING[n]]])
        out = scan.in_chunks(out, lambda p: builtin_features(scan.by_key(p), built, windows, min_periods), _LOOK_BACK + max(windows), 0, chunk_rows)
        out = out.select(*keep, *[c for c in out.columns if c not in keep and c not in used])
    return kernel_features(out, kernels, windows, min_periods, chunk_rows) if kernels else out


def hurst_exponent(panel: DataFrame, windows: tuple[int, ...] = WINDOWS, method: str = "rs", min_periods: int | str = MIN_PERIODS) -> DataFrame:
    """The panel with ``hurst_exponent_w{window}``, by rescaled range (``rs``) or by detrended fluctuations (``dfa``)."""
    if method not in ("rs", "dfa"):
        raise ValueError(f"unknown method: {method}")
    wide = compute_features(panel, [f"hurst_{method}"], windows, min_periods)
    return wide.select(*panel.columns, *[F.col(f"hurst_{method}_w{w}").alias(f"hurst_exponent_w{w}") for w in windows])


def wavelet_decomposition(panel: DataFrame, w: int = 20, levels: int = 3) -> DataFrame:
    """The panel with ``wavelet_decomposition``, an array of the first ``levels`` detail energies."""
    wide = compute_features(panel, [f"wavelet_energy_{k}" for k in range(1, levels + 1)], (w,))
    return wide.select(*panel.columns, F.array(*[f"wavelet_energy_{k}_w{w}" for k in range(1, levels + 1)]).alias("wavelet_decomposition"))


def hilbert_transform(panel: DataFrame, w: int = 20) -> DataFrame:
    """The panel with ``hilbert_transform``, a struct of amplitude and phase."""
    wide = compute_features(panel, ["hilbert_amplitude", "hilbert_phase"], (w,))
    pair = F.struct(F.col(f"hilbert_amplitude_w{w}").alias("amplitude"), F.col(f"hilbert_phase_w{w}").alias("phase"))
    return wide.select(*panel.columns, pair.alias("hilbert_transform"))
