"""Window statistics that Spark has no function for, as array kernels over whole series.

A kernel gets a matrix with one window a row (one for each of its columns) and
returns one number a row; autocorrelations come from running sums over the
whole series. All kernels run in one grouped pass; a long series is cut into
chunks that overlap by the longest window, so that no task holds more than a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from marlstone.functions import scan
from marlstone.functions.windows import MIN_PERIODS, frame, gated, ordered, rolling_mean, rolling_std, safe_div
from marlstone.storage import materialize

HALF_LIVES = (10, 30, 90)
#: The low-pass filter of the Daubechies wavelet with four vanishing moments.
LOW_PASS = np.array([
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
])
HIGH_PASS = np.array([(-1) ** (k + 1) * LOW_PASS[7 - k] for k in range(8)])
TWO_SIGMA_TAIL = 0.04550026389635842  # the share of a normal distribution beyond two standard deviations


def _divide(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def hill_estimator(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    k = max(10, int(n * 0.05))
    top = -np.sort(-np.abs(x), axis=1)[:, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(top / top[:, -1:])
        total = logs.sum(1)
        return np.where((total > 0) & (top[:, -1] > 0) & (min(k, n) >= 2), top.shape[1] / total, np.nan)


def _std(x: np.ndarray) -> np.ndarray:
    """Standard deviation of all values; exactly 0 for a constant window, whatever its rounding."""
    return np.where(x.max(1) > x.min(1), x.std(axis=1), 0.0)


def extreme_ratio(x: np.ndarray) -> np.ndarray:
    std = _std(x)
    return np.where(std > 0, (np.abs(x) > 2 * std[:, None]).sum(1) / (x.shape[1] * TWO_SIGMA_TAIL), np.nan)


def hurst_rs(x: np.ndarray) -> np.ndarray:
    z = np.cumsum(x - x.mean(1, keepdims=True), axis=1)
    spread, std = z.max(1) - z.min(1), _std(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.log(spread / std) / np.log(x.shape[1]) + 0.5
    return np.where((std > 0) & (spread > 0), np.clip(h, 0, 1), np.nan)


def hurst_dfa(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    low, high = max(4, int(n * 0.1)), min(int(n * 0.5), 100)
    sizes = list(range(low, high, max(1, (high - low) // 5))) if high > low else []
    if len(sizes) < 2:
        return np.full(len(x), np.nan)
    y = np.cumsum(x - x.mean(1, keepdims=True), axis=1)
    logs = []
    for s in sizes:
        part = y[:, : n // s * s].reshape(len(x), -1, s)
        t = np.arange(s) - (s - 1) / 2
        centred = part - part.mean(2, keepdims=True)
        slope = (centred * t).sum(2) / (t * t).sum()
        rms = np.sqrt(((centred - slope[:, :, None] * t) ** 2).mean(2))
        with np.errstate(divide="ignore"):
            logs.append(np.log(rms.mean(1)))
    a, b = np.log(np.array(sizes, float)), np.stack(logs, 1)
    a = a - a.mean()
    with np.errstate(invalid="ignore"):
        slope = ((b - b.mean(1, keepdims=True)) * a).sum(1) / (a * a).sum()
    return np.where(np.isfinite(slope) & (_std(x) > 0), np.clip(slope, 0, 1), np.nan)


def run_ratio(shifted: bool) -> Callable[[np.ndarray], np.ndarray]:
    """Mean length of runs of gains over that of runs of losses.

    ``shifted`` pairs each run's sign with the length of the run before it, and leaves the first run out.
    """

    def kernel(x: np.ndarray) -> np.ndarray:
        m, n = x.shape
        sign = np.sign(x)
        # a run ends where the sign changes and at the end of a window
        ends = np.flatnonzero(np.column_stack((sign[:, 1:] != sign[:, :-1], np.ones(m, bool))))
        lengths, signs, row = np.diff(ends, prepend=-1), sign.ravel()[ends], ends // n
        if shifted:
            same = row[1:] == row[:-1]
            lengths, signs, row = lengths[:-1][same], signs[1:][same], row[1:][same]
        mean = lambda side: _divide(np.bincount(row[side], lengths[side], m), np.bincount(row[side], minlength=m))
        return mean(signs > 0) / mean(signs < 0)

    return kernel


def _reflect(x: np.ndarray, mode: str) -> np.ndarray:
    n = x.shape[1]
    size = 1 << max(0, math.ceil(math.log2(n)))
    return np.pad(x, ((0, 0), (0, size - n)), mode=mode) if size > n and n > 1 else x


def hilbert_last(x: np.ndarray, documented: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude and phase of the analytic signal at the window's last point."""
    n = x.shape[1]
    x = x - x.mean(1, keepdims=True)
    padded = _reflect(x, "reflect")
    size = padded.shape[1]
    last = x[:, -1]
    if documented:
        h = np.zeros(size)
        h[0] = 1
        h[1 : (size + 1) // 2] = 2
        if size % 2 == 0:
            h[size // 2] = 1
        y = np.fft.ifft(np.fft.fft(padded) * h).imag[:, n - 1]
    else:
        # all frequencies but the constant and the fastest are doubled
        sign = (-1.0) ** np.arange(size)
        y = 2 * last - padded.mean(1) - sign[n - 1] * (padded * sign).mean(1)
    return np.sqrt(last**2 + y**2), np.arctan2(y, last)


def zero_crossing_rate(x: np.ndarray) -> np.ndarray:
    s = np.sign(x - x.mean(1, keepdims=True))
    return (s[:, 1:] != s[:, :-1]).sum(1) / (x.shape[1] - 1) if x.shape[1] > 1 else np.full(len(x), np.nan)


def wavelet_energies(x: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    """Variances of the wavelet details, from the coarsest level to the finest."""
    a = _reflect(x, "symmetric")
    out = []
    for _ in range(levels):
        n = a.shape[1]
        padded = np.pad(a, ((0, 0), (7, 7)), mode="symmetric")
        at = 2 * np.arange((n + 7) // 2)[:, None] + 1 - np.arange(8)[None, :] + 7
        windows = padded[:, at]
        out.append((windows @ HIGH_PASS).var(axis=1))
        a = windows @ LOW_PASS
    return out[::-1]


def _power(x: np.ndarray, n: int) -> np.ndarray:
    return np.abs(np.fft.fft(x, n)) ** 2


def spectral_power_ratio(x: np.ndarray, n: int = 256) -> np.ndarray:
    p = _power(x, n)
    return _divide(p[:, : n // 4].sum(1), p[:, n // 4 :].sum(1))


def spectral_entropy(x: np.ndarray, n: int | None = 256) -> np.ndarray:
    p = _power(x, n or x.shape[1])
    total = p.sum(1, keepdims=True)
    p = _divide(p, np.where(total > 0, total, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total[:, 0] > 0, -np.where(p > 0, p * np.log(p), 0).sum(1), np.nan)


def taylor_exponent(x: np.ndarray, points: int = 20, low: float = 0.1, high: float = 2.0) -> np.ndarray:
    """The exponent d whose |x|**d has the largest first autocorrelation; the first of equals, 1.0 if none is defined."""
    best, out = np.full(len(x), -np.inf), np.ones(len(x))
    for d in np.linspace(low, high, points):
        p = np.abs(x) ** d
        a, b = p[:, :-1], p[:, 1:]
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(spread > 1e-300, (a * b).sum(1) / spread, -np.inf)
        better = c > best
        best[better], out[better] = c[better], d
    return out


def ewm_state(x: np.ndarray, half_life: float) -> list[np.ndarray]:
    """At each row: number of values so far, their weights, squared weights, weighted mean, and weighted squares around it; gaps keep their place in time."""
    decay = 2.0 ** (-1.0 / half_life)
    have = ~np.isnan(x)
    # a series far from zero would lose its variance to rounding
    base = x[have.argmax()] if have.any() else 0.0
    v = np.where(have, x - base, 0.0)
    s0, s1, s2 = (_decayed_sums(y, decay, half_life) for y in (have.astype(float), v, v * v))
    s00 = _decayed_sums(have.astype(float), decay * decay, half_life)
    mean = np.divide(s1, s0, out=np.zeros(len(x)), where=s0 > 0)
    return [np.cumsum(have).astype(float), s0, s00, mean + base, np.maximum(0.0, s2 - s0 * mean * mean)]


def merge_states(own: list[np.ndarray], carried, decay: float, age: np.ndarray) -> list[np.ndarray]:
    """States of rows that are ``age`` rows behind the end of a state ``carried`` from before."""
    n, w, w2, mean, square = own
    fade = decay**age
    cw, cw2, csquare = carried[1] * fade, carried[2] * fade * fade, carried[4] * fade
    total = w + cw
    share = np.divide(cw, total, out=np.zeros(len(w)), where=total > 0)
    apart = carried[3] - mean
    return [n + carried[0], total, w2 + cw2, np.where(w > 0, mean + share * apart, carried[3]), square + csquare + np.where(w > 0, w * share * apart * apart, 0.0)]


def state_std(state: list[np.ndarray], least: int = 10) -> np.ndarray:
    n, w, w2, _, square = state
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n >= least) & (w * w > w2), np.sqrt(square * w / (w * w - w2)), np.nan)


def ewm_std(x: np.ndarray, half_life: float, least: int = 10) -> np.ndarray:
    """Exponentially weighted, bias-corrected standard deviation of a whole series."""
    return state_std(ewm_state(x, half_life), least)


def _decayed_sums(y: np.ndarray, decay: float, half_life: float) -> np.ndarray:
    """Sums of all values so far, each times ``decay`` to the power of its age; block by block, so that powers stay in range."""
    size = max(16, int(8 * half_life))
    power, out, carry = decay ** np.arange(size + 1), np.empty(len(y)), 0.0
    for k in range(0, len(y), size):
        part = y[k : k + size]
        out[k : k + size] = power[: len(part)] * (carry * decay + np.cumsum(part / power[: len(part)]))
        carry = out[k + len(part) - 1]
    return out


class _Once:
    """A transform that several kernels share: computed once for the matrix that they are all given."""

    def __init__(self, fn):
        self.fn, self.seen, self.value = fn, None, None

    def __call__(self, x: np.ndarray):
        if x is not self.seen:
            self.seen, self.value = x, self.fn(x)
        return self.value


_hilbert, _hilbert_documented, _energies = _Once(lambda x: hilbert_last(x)), _Once(lambda x: hilbert_last(x, True)), _Once(lambda x: wavelet_energies(x))

#: Column suffix and kernel of each feature that works on single windows.
KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "hill_estimator": hill_estimator,
    "extreme_ratio": extreme_ratio,
    "hurst_exponent": hurst_rs,
    "hurst_rs": hurst_rs,
    "hurst_dfa": hurst_dfa,
    "up_down_run_ratio": run_ratio(True),
    "up_down_run_ratio_documented": run_ratio(False),
    "hilbert_amplitude": lambda x: _hilbert(x)[0],
    "hilbert_phase": lambda x: _hilbert(x)[1],
    "hilbert_amplitude_documented": lambda x: _hilbert_documented(x)[0],
    "hilbert_phase_documented": lambda x: _hilbert_documented(x)[1],
    "zero_crossing_rate": zero_crossing_rate,
    **{f"wavelet_energy_{k}": lambda x, k=k: _energies(x)[k - 1] for k in (1, 2, 3)},
    **{f"wavelet_energy_{k}_documented": lambda x, k=k: _energies(x)[3 - k] for k in (1, 2, 3)},
    "wavelet_noise_to_signal": lambda x: _divide(_energies(x)[0], _energies(x)[2]),
    "wavelet_noise_to_signal_documented": lambda x: _divide(_energies(x)[2], _energies(x)[0]),
    "spectral_power_ratio": spectral_power_ratio,
    "spectral_entropy": spectral_entropy,
    "optimal_taylor_exponent": taylor_exponent,
    "_window_entropy": lambda x: spectral_entropy(x, None),
}
#: Kernels that composed features are built on, and their parts that are scaled by their range.
_INPUTS = {"mean_reversion_signal": ("zero_crossing_rate",), "market_efficiency": ("_window_entropy", "ar1_rsquared"), "adaptive_market_hypothesis": ("_window_entropy", "ar1_rsquared")}
_SCALED = {"market_efficiency": ("_window_entropy", "_order"), "adaptive_market_hypothesis": ("_window_entropy", "_spread")}


class LagSums:
    """Sums of a series' values, squares and products with those ``lag`` rows earlier, as running totals.

    Each frame of any window is a difference of two totals, so that all windows cost one pass. Values are
    taken from their mean and added in extended precision; a side that is constant over a frame is told
    by the place of its last change, exactly.
    """

    def __init__(self, x: np.ndarray, lag: int):
        self.lag, self.rows = lag, len(x)
        middle = np.nanmean(x) if (~np.isnan(x)).any() else 0.0
        x = (x - middle).astype(np.longdouble)
        later, earlier = x[lag:], x[: max(0, len(x) - lag)]
        have = ~(np.isnan(later) | np.isnan(earlier))
        a, b = later[have], earlier[have]
        zero = np.zeros(1, np.longdouble)
        self.totals = [np.concatenate([zero, np.cumsum(v)]) for v in (a, b, a * a, b * b, a * b)]
        self.changes = [np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64) for v in (a, b)]
        # pairs whose later row is before each row
        self.before = np.concatenate([np.zeros(min(lag, len(x)) + 1, np.int64), np.cumsum(have)])

    def corr(self, w: int) -> np.ndarray:
        """Correlation of both sides over the last ``w`` rows of each position, pairs inside the frame only; NaN where it has no meaning."""
        at = np.arange(self.rows)
        high, low = self.before[at + 1], self.before[np.maximum(0, at - w + 1 + self.lag).clip(max=self.rows)]
        low = np.minimum(low, high)
        n = high - low
        sa, sb, saa, sbb, sab = (t[high] - t[low] for t in self.totals)
        varies = n >= 2
        for changed in self.changes:
            varies &= np.concatenate([changed, [0]])[high - 1] > low if len(changed) else False
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (sab - sa * sb / n) / np.sqrt((saa - sa * sa / n) * (sbb - sb * sb / n))
        return np.where(varies, np.clip(c, -1, 1), np.nan).astype(float)


class Lags:
    """The autocorrelations of one series, its absolute values and its squares; each lag's sums are made once for all windows."""

    def __init__(self, x: np.ndarray):
        self.of, self.sums = {"plain": x, "absolute": np.abs(x), "square": x * x}, {}

    def corr(self, of: str, lag: int, w: int) -> np.ndarray:
        if (of, lag) not in self.sums:
            self.sums[of, lag] = LagSums(self.of[of], lag)
        return self.sums[of, lag].corr(w)


def _acf_decay(lags: Lags, w: int, max_lag: int = 10) -> np.ndarray:
    """Minus the slope of ln(|acf| + 1e-10) of absolute returns on ln(lag)."""
    last = min(max_lag, w - 1)
    x = np.log(np.arange(1, last + 1))
    x = x - x.mean() if last else x
    if not (x * x).sum():
        return np.full(len(lags.of["plain"]), np.nan)
    return -sum(x[k - 1] / (x * x).sum() * np.log(np.abs(lags.corr("absolute", k, w)) + 1e-10) for k in range(1, last + 1))


def _acf_ratio(lags: Lags, w: int) -> np.ndarray:
    return _divide(lags.corr("absolute", 10, w), lags.corr("absolute", 1, w)) if w >= 11 else np.full(len(lags.of["plain"]), np.nan)


#: Kernels over a whole series: its autocorrelations and the window.
SERIES: dict[str, Callable[[Lags, int], np.ndarray]] = {
    "rolling_autocorr": lambda s, w: s.corr("plain", 1, w),
    "volatility_clustering": lambda s, w: s.corr("absolute", 1, w),
    "autocorr_decay": _acf_decay,
    "acf_decay_ratio": _acf_ratio,
    "taylor_ratio": lambda s, w: _divide(s.corr("absolute", 1, w), s.corr("square", 1, w)),
    "ar1_rsquared": lambda s, w: s.corr("plain", 1, w) ** 2,
}
#: Returns that a frame must hold, where that is not the general rule.
_LEAST = {"autocorr_decay": lambda w: w, "acf_decay_ratio": lambda w: 11}


@dataclass(frozen=True)
class Kernel:
    """A function of windows: one matrix for each of ``columns``, a window a row, without the rows where any of them is missing."""

    fn: Callable[..., np.ndarray]
    columns: tuple[str, ...] = ("log_return",)
    centred: bool = False


def register_kernel(name: str, kernel: Callable[..., np.ndarray], columns: tuple[str, ...] = ("log_return",), centred: bool = False) -> None:
    """Add a kernel of one's own, over any numeric columns of the panel; ``centred`` frames lie around each row."""
    KERNELS[name] = Kernel(kernel, tuple(columns), centred)


def over_windows(x: np.ndarray | list[np.ndarray], w: int, kernels: dict[str, Callable[..., np.ndarray]], least: int, batch: int = 1 << 20, centred: bool = False) -> dict[str, np.ndarray]:
    """Each kernel over the last ``w`` values of each position (of one series, or of several that are missing together); frames with gaps, or at the ends, count the values that they have.

    Frames with the same number of values go to the kernels together, as one matrix a series.
    """
    series = [x] if isinstance(x, np.ndarray) else list(x)
    gone = np.isnan(series).any(0)
    rows_in, after = len(gone), (w - 1) // 2 if centred else 0
    ends = (np.full(w - 1 - after, np.nan), np.full(after, np.nan))
    out = {name: np.full(rows_in, np.nan) for name in kernels}
    if not rows_in:
        return out
    windows = [np.lib.stride_tricks.sliding_window_view(np.concatenate([ends[0], np.where(gone, np.nan, s), ends[1]]), w) for s in series]
    total = np.concatenate([[0], np.cumsum(~gone)])
    at = np.arange(rows_in)
    have = total[np.minimum(rows_in, at + after + 1)] - total[np.maximum(0, at - (w - 1 - after))]
    order = np.argsort(have, kind="stable")
    cuts = np.flatnonzero(np.diff(have[order])) + 1
    for rows in np.split(order, cuts):
        n = int(have[rows[0]])
        if n < max(1, least):
            continue
        for k in range(0, len(rows), max(1, batch // w)):
            some = rows[k : k + max(1, batch // w)]
            parts = [v[some] for v in windows]
            if n < w:
                parts = [p[~np.isnan(p)].reshape(len(some), n) for p in parts]
            for name, kernel in kernels.items():
                out[name][some] = kernel(*parts)
    return out


def _window_least(w: int, min_periods: int | str) -> int:
    return w if min_periods == "full" else min(int(min_periods), w)


def _base_names(names: list[str]) -> list[str]:
    """The kernels that ``names`` need; unknown ones raise."""
    base = list(dict.fromkeys(b for n in names for b in _INPUTS.get(n, (n,))))
    unknown = [n for n in base if n not in KERNELS and n not in SERIES and n != "ewm_volatility"]
    if unknown:
        raise KeyError(", ".join(unknown))
    return base


def _grouped(panel: DataFrame, base: list[str], windows: tuple[int, ...], min_periods: int | str, ewm: bool) -> DataFrame:
    """The panel with the columns of all kernels, in one grouped pass by ``symbol``."""
    single = {n: k if isinstance(k, Kernel) else Kernel(k) for n, k in KERNELS.items() if n in base}
    whole = [n for n in base if n in SERIES]
    fresh = [f"{n}_w{w}" for n in [*single, *whole] for w in windows] + ([f"ewm_volatility_h{h}" for h in HALF_LIVES] if ewm else [])
    keep = panel.columns
    schema = T.StructType([*panel.schema.fields, *[T.StructField(c, T.DoubleType()) for c in fresh]])
    kinds = {(k.columns, k.centred): {n: o.fn for n, o in single.items() if (o.columns, o.centred) == (k.columns, k.centred)} for k in single.values()}
    series, least_of = {n: SERIES[n] for n in whole}, {n: _LEAST[n] for n in whole if n in _LEAST}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        x = rows["log_return"].to_numpy(float)
        values, lags, total = {}, Lags(x) if series else None, np.concatenate([[0], np.cumsum(~np.isnan(x))])
        for w in windows:
            for (columns, centred), kernels in kinds.items():
                inputs = [rows[c].to_numpy(float) for c in columns]
                values |= {f"{n}_w{w}": v for n, v in over_windows(inputs, w, kernels, _window_least(w, min_periods), centred=centred).items()}
            have = total[1:] - total[np.maximum(0, np.arange(len(x)) - w + 1)]
            for n, kernel in series.items():
                least = max(_window_least(w, min_periods), least_of[n](w) if n in least_of else 0)
                values[f"{n}_w{w}"] = np.where(have >= least, kernel(lags, w), np.nan)
        if ewm:
            values |= {f"ewm_volatility_h{h}": ewm_std(x, h) for h in HALF_LIVES}
        return pd.concat([rows[keep], pd.DataFrame({c: values[c] for c in fresh}, index=rows.index)], axis=1)

    out = panel.groupBy("symbol").applyInPandas(run, schema)
    # NaN is the kernels' missing value, NULL is the panel's
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fresh})


def kernel_features(panel: DataFrame, names: list[str], windows: tuple[int, ...], min_periods: int | str = MIN_PERIODS, chunk_rows: int | None = None, causal: bool = False) -> DataFrame:
    """The panel with the kernel features; ``causal`` scales entropies by their range so far, not over the whole history.

    A symbol is one task, unless ``chunk_rows`` is given (0: never) or a symbol has more rows than a task should hold:
    then windows run in overlapping chunks, running values by carries (``functions.scan``), with the same results.
    """
    base = _base_names(names)
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if scan.is_long(panel) else 0
    if not chunk_rows:
        out = windowed_parts(_grouped(panel, base, windows, min_periods, "ewm_volatility" in base), names, windows, min_periods)
    else:
        look = max(windows) + 4
        body = lambda p: windowed_parts(_grouped(p, base, windows, min_periods, False), names, windows, min_periods)
        out = scan.in_chunks(panel, body, look, max(windows) // 2, chunk_rows)
        if "ewm_volatility" in base:
            out = ewm_in_pieces(out)
    return finish(out, panel.columns, names, windows, causal, chunk_rows > 0)


def ewm_in_pieces(panel: DataFrame, half_lives: tuple[int, ...] = HALF_LIVES, least: int = 10) -> DataFrame:
    """The panel with ``ewm_volatility_h{half-life}`` for series of any length: each piece's state at its end, the states of all pieces before it put together, and each piece once more from there."""
    cut, keep = scan.pieces(panel), panel.columns
    decays = {h: 2.0 ** (-1.0 / h) for h in half_lives}
    state = "symbol string, _piece int, _state array<double>"
    width = 5 * len(half_lives) + 1

    def ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("date", kind="stable")["log_return"].to_numpy(float)
        last = [float(v[-1]) for h in half_lives for v in ewm_state(x, h)]
        return pd.DataFrame({"symbol": [key[0]], "_piece": [key[1]], "_state": [[float(len(x)), *last]]})

    def carries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_piece")
        carried, out = np.zeros(width), []
        for own in rows["_state"]:
            out.append(carried.tolist())
            own, following = np.asarray(own), np.zeros(width)
            for k, h in enumerate(half_lives):
                at = slice(1 + 5 * k, 6 + 5 * k)
                following[at] = [v[0] for v in merge_states([np.array([v]) for v in own[at]], carried[at], decays[h], np.array([own[0]]))]
            carried = following
        return pd.DataFrame({"symbol": key[0], "_piece": rows["_piece"], "_state": out})

    def values(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        x, carried = rows["log_return"].to_numpy(float), np.asarray(rows["_state"].iloc[0])
        out = rows[keep].copy()
        for k, h in enumerate(half_lives):
            merged = merge_states(ewm_state(x, h), carried[1 + 5 * k : 6 + 5 * k], decays[h], np.arange(1, len(x) + 1))
            out[f"ewm_volatility_h{h}"] = state_std(merged, least)
        return out

    small = cut.select("symbol", "_piece", "date", "log_return")
    before = small.groupBy("symbol", "_piece").applyInPandas(ends, state).groupBy("symbol").applyInPandas(carries, state)
    fresh = [f"ewm_volatility_h{h}" for h in half_lives]
    schema = T.StructType([*panel.schema.fields, *[T.StructField(c, T.DoubleType()) for c in fresh]])
    out = cut.join(materialize(before, "states"), ["symbol", "_piece"]).groupBy("symbol", "_piece").applyInPandas(values, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fresh})


def windowed_parts(out: DataFrame, names: list[str], windows: tuple[int, ...], min_periods: int | str) -> DataFrame:
    """Adds what composed features take from built-in expressions, frame by frame."""
    from marlstone.operators.features import _permutation_entropy

    r, fresh = F.col("log_return"), {}
    for w in windows:
        n = F.count("log_return").over(frame(w))
        if "mean_reversion_signal" in names:
            fresh[f"_deviation_w{w}"] = gated(safe_div(r - rolling_mean(r, frame(w)), rolling_std(r, frame(w))), n, w, min_periods)
        if "market_efficiency" in names:
            fresh[f"_order_w{w}"] = gated(_permutation_entropy(w), n, w, min_periods)
        if "adaptive_market_hypothesis" in names:
            fresh[f"_spread_w{w}"] = gated(rolling_std(r, frame(w)), n, w, min_periods)
    return out.withColumns(fresh) if fresh else out


def finish(out: DataFrame, keep: list[str], names: list[str], windows: tuple[int, ...], causal: bool, long: bool) -> DataFrame:
    """Adds the composed features and drops what they are made of; columns that need a range are scaled by the symbol's own (so far, if ``causal``)."""
    wanted = [c for w in windows for n, cs in _SCALED.items() if n in names for c in (f"{x}_w{w}" for x in cs)]
    wanted = list(dict.fromkeys(wanted))
    if wanted and not long:
        history = ordered().rowsBetween(Window.unboundedPreceding, 0) if causal else Window.partitionBy("symbol")
        out = out.withColumns({f"_low{c}": F.min(c).over(history) for c in wanted} | {f"_high{c}": F.max(c).over(history) for c in wanted})
    elif wanted and causal:
        out = scan.running(out, [scan.Running(f"_{side}{c}", kind, F.col(c)) for c in wanted for side, kind in (("low", "min"), ("high", "max"))])
    elif wanted:
        ranges = out.groupBy("symbol").agg(*[fn(c).alias(f"_{side}{c}") for c in wanted for side, fn in (("low", F.min), ("high", F.max))])
        out = out.join(materialize(ranges, "ranges"), "symbol", "left")
    scaled = lambda c: safe_div(F.col(c) - F.col(f"_low{c}"), F.col(f"_high{c}") - F.col(f"_low{c}"))
    fresh = {}
    for w in windows:
        if "mean_reversion_signal" in names:
            fresh[f"mean_reversion_signal_w{w}"] = (F.col(f"_deviation_w{w}") + F.col(f"zero_crossing_rate_w{w}")) / 2
        if "market_efficiency" in names:
            fresh[f"market_efficiency_w{w}"] = ((1 - scaled(f"_window_entropy_w{w}")) + (1 - scaled(f"_order_w{w}")) + F.col(f"ar1_rsquared_w{w}")) / 3
        if "adaptive_market_hypothesis" in names:
            fresh[f"adaptive_market_hypothesis_w{w}"] = ((1 - scaled(f"_window_entropy_w{w}")) + F.col(f"ar1_rsquared_w{w}") + scaled(f"_spread_w{w}")) / 3
    out = out.withColumns(fresh) if fresh else out
    asked = [c for c in out.columns if c not in keep and c.rsplit("_", 1)[0] in names]
    return out.select(*keep, *asked)
