"""DuckDB statements of the queries: written from the definitions, not derived from the Spark code."""

from __future__ import annotations

_PRICE = """100 + l_extendedprice::DOUBLE / 10000 AS px, l_quantity::DOUBLE AS qty,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"""
TICKS = {
    "daily_brand": f"SELECT p_brand AS symbol, l_shipdate::DATE AS date, {_PRICE} JOIN part ON l_partkey = p_partkey",
    "weekly_nation": f"SELECT n_name AS symbol, date_trunc('week', l_shipdate)::DATE AS date, {_PRICE} JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
}


def bars(source: str = "daily_brand") -> str:
    return f"""ticks AS ({TICKS[source]}),
bars AS (SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL)"""


def returns(source: str = "daily_brand") -> str:
    return bars(source) + RETURNS


RETURNS = """,
prev AS (SELECT *, close / lag(close) OVER s AS ratio FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
ret AS (SELECT * EXCLUDE (ratio), CASE WHEN ratio > 0 THEN ln(ratio) END AS log_return, ratio - 1 AS simple_return,
  (high + low + close) / 3 AS typical_price, volume * ((high + low + close) / 3) AS dollar_volume FROM prev),
full_panel AS (SELECT *, lead(log_return) OVER s AS forward_return, lead(simple_return) OVER s AS forward_simple_return FROM ret WINDOW s AS (PARTITION BY symbol ORDER BY date)),
panel AS (SELECT * FROM full_panel WHERE log_return IS NOT NULL AND forward_return IS NOT NULL)"""


def out(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def rows(w: int, skip: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {w - 1 - skip} PRECEDING AND CURRENT ROW)"


def corr(a: str, b: str, f: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    c = f"covar_samp({x}, {y}) OVER {f} / nullif(stddev_samp({x}) OVER {f} * stddev_samp({y}) OVER {f}, 0)"
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(-1, least(1, {c})) END"


def acf(x: str, w: int, k: int = 1) -> str:
    return corr(x, f"{x}_{k}", rows(w, k))


def r2(y: str, x: str, f: str) -> str:
    ok = f"CASE WHEN {x} IS NOT NULL THEN {y} END", f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    return f"CASE WHEN var_samp({ok[0]}) OVER {f} > 0 AND var_samp({ok[1]}) OVER {f} > 0 THEN power(covar_samp({ok[0]}, {ok[1]}) OVER {f}, 2) / (var_samp({ok[0]}) OVER {f} * var_samp({ok[1]}) OVER {f}) END"


def gate(x: str, w: int, count: str = "r", least: int = 10) -> str:
    return f"CASE WHEN count({count}) OVER {rows(w)} >= {min(least, w)} THEN {x} END"


def beta(w: int) -> str:
    return f"covar_samp(r, m) OVER {rows(w)} / nullif(var_samp(m) OVER {rows(w)}, 0)"


def product(w: int) -> str:
    return f"CASE WHEN count(r) OVER {rows(w)} = {w} THEN product(1 + r) OVER {rows(w)} - 1 END"


BASE = """base0 AS (
  SELECT symbol, date, log_return AS r, close, volume, typical_price, forward_return AS y, abs(log_return) AS a, log_return * log_return AS q,
    greatest(log_return, 0) AS up, least(log_return, 0) AS dn, row_number() OVER s AS rn, sum(log_return) OVER s AS total,
    """ + ", ".join(f"lag(log_return, {k}) OVER s AS r_{k}" for k in (1, 2)) + ", " + ", ".join(f"lag(abs(log_return), {k}) OVER s AS a_{k}" for k in range(1, 11)) + """,
    lag(log_return * log_return) OVER s AS q_1 FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY date)
), market AS (SELECT date, avg(r) AS m FROM base0 GROUP BY date),
market2 AS (SELECT *, lag(m) OVER (ORDER BY date) AS ml FROM market),
base1 AS (SELECT base0.*, m, ml, """ + gate(f"stddev_samp(r) OVER {rows(20)}", 20) + " AS std20, " + product(5) + """ AS prod5 FROM base0 JOIN market2 USING (date)),
base AS (SELECT *, std20 - lag(std20) OVER (PARTITION BY symbol ORDER BY date) AS dstd20 FROM base1)"""


def _variance_ratio(w: int) -> str:
    even, odd = (f"var_samp(CASE WHEN rn % 2 = {c} THEN r END) OVER {rows(w)}" for c in (0, 1))
    return f"CASE WHEN count(r) OVER {rows(w)} = {w} THEN (CASE WHEN (rn - {w} + 1) % 2 = 0 THEN {even} ELSE {odd} END) / nullif(2 * var_samp(r) OVER {rows(w)}, 0) END"


def _acf_decay(w: int) -> str:
    import math

    last = min(10, w - 1)
    xs = [math.log(k) for k in range(1, last + 1)]
    mean, spread = sum(xs) / last, sum((x - sum(xs) / last) ** 2 for x in xs)
    return f"CASE WHEN count(r) OVER {rows(w)} = {w} THEN -(" + " + ".join(f"({(x - mean) / spread!r}) * ln(abs({acf('a', w, k)}) + 1e-10)" for k, x in enumerate(xs, 1)) + ") END"


def _permutation(w: int) -> str:
    f = rows(w, 2)
    code = "CASE WHEN r_2 IS NOT NULL THEN (r_2 <= r_1)::INT * 4 + (r_1 <= r)::INT * 2 + (r_2 <= r)::INT END"
    p = [f"nullif(count(CASE WHEN {code} = {c} THEN 1 END) OVER {f}, 0) / nullif(count({code}) OVER {f}, 0)::DOUBLE" for c in range(8)]
    return f"CASE WHEN count({code}) OVER {f} > 0 THEN -(" + " + ".join(f"coalesce({x} * ln({x}), 0)" for x in p) + ") / ln(6) END"


def _taylor(w: int) -> str:
    return "[" + ", ".join(corr(f"power(a, {k / 10})", f"power(a_1, {k / 10})", rows(w, 1)) for k in range(1, 21)) + "]"


#: Feature: (expression by window, digits).
FEATURES = {
    "rolling_kurtosis": (lambda w: f"CASE WHEN count(r) OVER {rows(w)} >= 4 THEN kurtosis(r) OVER {rows(w)} END", 4),
    "rolling_volatility": (lambda w: f"stddev_samp(r) OVER {rows(w)}", 6),
    "volatility_clustering": (lambda w: acf("a", w), 6),
    "volatility_ratio": (lambda w: gate(f"({gate(f'stddev_samp(r) OVER {rows(5)}', 5)}) / nullif(stddev_samp(r) OVER {rows(60)}, 0)", 60), 5),
    "volatility_of_volatility": (lambda w: gate(f"stddev_samp(std20) OVER {rows(60)}", 60, "std20"), 6),
    "downside_upside_vol_ratio": (lambda w: f"stddev_samp(-dn) OVER {rows(w)} / nullif(stddev_samp(up) OVER {rows(w)}, 0)", 4),
    "leverage_correlation": (lambda w: corr("r", "dstd20", rows(w)), 5),
    "gjr_asymmetry": (lambda w: f"avg(dn * dn) OVER {rows(w)} / nullif(avg(up * up) OVER {rows(w)}, 0)", 4),
    "volume_volatility_corr": (lambda w: corr("a", "volume", rows(w)), 6),
    "relative_volume": (lambda w: f"volume / nullif(avg(volume) OVER {rows(w)}, 0)", 6),
    "volume_surprise": (lambda w: f"volume / nullif(max(volume) OVER {rows(w)}, 0)", 6),
    "volume_weighted_volatility": (lambda w: f"stddev_samp(r * volume) OVER {rows(w)}", 5),
    "dollar_volume": (lambda w: "volume * coalesce(typical_price, close)", 2),
    "rolling_autocorr": (lambda w: acf("r", w), 6),
    "variance_ratio": (_variance_ratio, 5),
    "autocorr_decay": (_acf_decay, 4),
    "acf_decay_ratio": (lambda w: f"CASE WHEN count(r) OVER {rows(w)} >= 11 THEN {acf('a', w, 10)} / nullif({acf('a', w)}, 0) END" if w >= 11 else "NULL::DOUBLE", 3),
    "rolling_skewness": (lambda w: f"CASE WHEN count(r) OVER {rows(w)} >= 3 THEN skewness(r) OVER {rows(w)} END", 5),
    "downside_frequency": (lambda w: f"count(CASE WHEN r < -0.01 THEN 1 END) OVER {rows(w)} / nullif(count(CASE WHEN r > 0.01 THEN 1 END) OVER {rows(w)}, 0)::DOUBLE", 6),
    "kurtosis_ratio": (lambda w: f"({gate(f'kurtosis(r) OVER {rows(20)}', 20)}) / nullif({gate(f'kurtosis(prod5) OVER {rows(100)}', 100, 'prod5')}, 0)", 2),
    "conditional_mean_ratio": (lambda w: f"avg(up) OVER {rows(w)} / nullif(abs(avg(dn) OVER {rows(w)}), 0)", 4),
    "gain_loss_asymmetry": (lambda w: f"(skewness(r) OVER {rows(w)} + 1 - avg(up) OVER {rows(w)} / nullif(abs(avg(dn) OVER {rows(w)}), 0)) / 2", 4),
    "hodrick_prescott_cycle": (lambda w: f"r - avg(r) OVER {rows(w)}", 6),
    "normalized_deviation": (lambda w: f"(r - avg(r) OVER {rows(w)}) / nullif(stddev_samp(r) OVER {rows(w)}, 0)", 6),
    "rolling_return": (product, 6),
    **{f"cumulative_return_{n}": (lambda w, n=n: product(n), 6) for n in (20, 60, 120, 252)},
    "trend_strength": (lambda w: f"avg(r) OVER {rows(w)} / nullif(stddev_samp(r) OVER {rows(w)}, 0) * sqrt(252.0 / {w})", 5),
    "trend_linearity": (lambda w: r2("total", "rn::DOUBLE", rows(w)), 5),
    "jegadeesh_titman_momentum": (lambda w: f"({product(252)}) - ({product(20)})", 6),
    "rolling_beta": (beta, 5),
    "hou_moskowitz_delay": (lambda w: f"({r2('r', 'ml', rows(w))}) - ({r2('r', 'm', rows(w))})", 5),
    "lead_lag_effect": (lambda w: f"{beta(w)} - {corr('r', 'ml', rows(w))}", 5),
    "taylor_ratio": (lambda w: f"{acf('a', w)} / nullif({acf('q', w)}, 0)", 3),
    "permutation_entropy": (_permutation, 6),
    "ar1_rsquared": (lambda w: f"power({acf('r', w)}, 2)", 6),
    # array kernels that SQL can state
    "extreme_ratio": (lambda w: f"CASE WHEN stddev_pop(r) OVER {rows(w)} > 0 THEN len(list_filter(list(r) OVER {rows(w)}, lambda x: abs(x) > 2 * (stddev_pop(r) OVER {rows(w)}))) / (count(r) OVER {rows(w)} * 0.04550026389635842) END", 5),
    "optimal_taylor_exponent": (lambda w: "coalesce(0.1 * list_position(" + _taylor(w) + ", list_max(" + _taylor(w) + ")), 1.0)", 6),
    "hill_estimator": (None, 4),
    "zero_crossing_rate": (None, 6),
    "mean_reversion_signal": (None, 5),
    "hurst_rs": (None, 5),
    "hurst_exponent": (None, 5),
    "hilbert_amplitude": (None, 6),
    "hilbert_phase": (None, 4),
    "spectral_entropy": (None, 5),
    "spectral_power_ratio": (None, 4),
    "ewm_volatility": (None, 6),
    "market_efficiency": (None, 4),
    "adaptive_market_hypothesis": (None, 4),
    "hurst_dfa": (None, 5),
    "up_down_run_ratio": (None, 6),
    **{f"wavelet_energy_{k}": (None, 8) for k in (1, 2, 3)},
    "wavelet_noise_to_signal": (None, 4),
}
UNGATED = ("dollar_volume", "volatility_of_volatility", "kurtosis_ratio", "volatility_ratio", "cumulative_return_20", "cumulative_return_60", "cumulative_return_120", "cumulative_return_252", "jegadeesh_titman_momentum")
#: Features that need what a window function gives inside a list function: stated in two steps.
_ZERO_CROSSINGS = "len(list_filter(range(2, n + 1), lambda i: sign(l[i] - mean) <> sign(l[i - 1] - mean))) / (n - 1)::DOUBLE"
_CUMULATED = "list_transform(range(1, n + 1), lambda i: list_sum(d[1:i]))"
_RS = f"CASE WHEN stddev > 0 THEN greatest(0, least(1, ln((list_max({_CUMULATED}) - list_min({_CUMULATED})) / stddev) / ln(n) + 0.5)) END"
_LAST_Y = """2 * d[n] - (list_sum(d) + coalesce(list_sum(d[2 * n - size:n - 1]), 0)) / size
  - power(-1, n - 1) * (list_sum(list_transform(range(1, n + 1), lambda i: power(-1, i - 1) * d[i])) + coalesce(list_sum(list_transform(range(1, size - n + 1), lambda i: power(-1, n - 1 + i) * d[n - i])), 0)) / size"""


def _power(bins: str) -> str:
    return f"list_transform(range(0, {bins}), lambda k: power(list_sum(list_transform(range(1, n + 1), lambda j: l[j] * cos(2 * pi() * (j - 1) * k / {bins}))), 2) + power(list_sum(list_transform(range(1, n + 1), lambda j: l[j] * sin(2 * pi() * (j - 1) * k / {bins}))), 2))"


#: Mean length of the runs before those of one side: runs begin at ``st``.
_RUNS = "list_avg(list_transform(list_filter(range(2, len(st) + 1), lambda k: {side}), lambda k: st[k] - st[k - 1]))"
def dfa(w: int, value: str = "v") -> str:
    """(symbol, date, value): the slope of the logs over the box sizes, from one row a frame, size and box."""
    ts = "(i - (s + 1) / 2.0)"
    return f"""SELECT symbol, date, CASE WHEN any_value(varies) AND count(*) >= 2 AND bool_and(f > 0) THEN greatest(0, least(1, regr_slope(ln(CASE WHEN f > 0 THEN f END), ln(s)))) END AS {value} FROM (
  SELECT symbol, date, s, any_value(varies) AS varies, avg(sqrt(greatest(0, (syy - slope * slope * stt) / s))) AS f FROM (
    SELECT symbol, date, s, k, any_value(varies) AS varies, sum(p * {ts}) / sum({ts} * {ts}) AS slope, sum({ts} * {ts}) AS stt, sum((p - mp) * (p - mp)) AS syy FROM (
      SELECT symbol, date, varies, s, k, i, y[k * s + i] AS p, avg(y[k * s + i]) OVER (PARTITION BY symbol, date, s, k) AS mp FROM (
        SELECT symbol, date, n, varies, {_CUMULATED} AS y, unnest(range(low, high, greatest(1, (high - low) // 5))) AS s FROM (
          SELECT *, list_transform(l, lambda x: x - mean) AS d, greatest(4, floor(n * 0.1::DOUBLE)::INT) AS low, least(floor(n * 0.5::DOUBLE)::INT, 100) AS high, list_max(l) > list_min(l) AS varies
          FROM (SELECT symbol, date, list(r) OVER f AS l, count(r) OVER f AS n, avg(r) OVER f AS mean FROM base WINDOW f AS {rows(w)}) WHERE n >= {min(10, w)})
      ), range(0, 64) b(k), range(1, 101) t(i) WHERE k < n // s AND i <= s)
    GROUP BY symbol, date, s, k) GROUP BY symbol, date, s) GROUP BY symbol, date"""


#: The low-pass filter of the Daubechies wavelet with four vanishing moments, and its high-pass mirror.
_LOW = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)
_HIGH = tuple((-1) ** (k + 1) * _LOW[7 - k] for k in range(8))


def _filtered(a: str, taps: tuple[float, ...]) -> str:
    """Every second value of a list's convolution, the list mirrored at both ends."""
    place = "2 * k + 1 - {j}"
    value = lambda j: f"{a}[CASE WHEN {place.format(j=j)} < 0 THEN -({place.format(j=j)}) WHEN {place.format(j=j)} >= len({a}) THEN 2 * len({a}) - ({place.format(j=j)}) ELSE {place.format(j=j)} + 1 END]"
    return f"list_transform(range(0, (len({a}) + 7) // 2), lambda k: {' + '.join(f'({t!r}) * {value(j)}' for j, t in enumerate(taps))})"


def wavelet(name: str, w: int, value: str = "v") -> str:
    """(symbol, date, value): variances of three levels of details, the coarsest first."""
    last = {"wavelet_energy_1": "e3", "wavelet_energy_2": "e2", "wavelet_energy_3": "e1", "wavelet_noise_to_signal": "e3 / nullif(e1, 0)"}[name]
    energy = lambda a: f"list_var_pop({_filtered(a, _HIGH)})"
    return f"""SELECT symbol, date, {last} AS {value} FROM (SELECT *, {energy('a2')} AS e3 FROM (SELECT *, {energy('a1')} AS e2, {_filtered('a1', _LOW)} AS a2 FROM (SELECT *, {energy('a0')} AS e1, {_filtered('a0', _LOW)} AS a1 FROM (
  SELECT symbol, date, list_concat(l, list_reverse(l)[1:power(2, ceil(log2(len(l))))::INT - len(l)]) AS a0 FROM (SELECT symbol, date, list(r) OVER f AS l FROM base WINDOW f AS {rows(w)}) WHERE len(l) >= {min(10, w)}))))"""


LISTS = {
    "up_down_run_ratio": f"{_RUNS.format(side='l[st[k]] > 0')} / nullif({_RUNS.format(side='l[st[k]] < 0')}, 0)",
    "hurst_dfa": None, "wavelet_energy_1": None, "wavelet_energy_2": None, "wavelet_energy_3": None, "wavelet_noise_to_signal": None,
    "extreme_ratio": "CASE WHEN stddev > 0 THEN len(list_filter(l, lambda x: abs(x) > 2 * stddev)) / (n * 0.04550026389635842) END",
    "hill_estimator": "CASE WHEN n >= 2 AND t[k] > 0 AND list_sum(list_transform(t[1:k], lambda x: ln(x / t[k]))) > 0 THEN k / list_sum(list_transform(t[1:k], lambda x: ln(x / t[k]))) END",
    "zero_crossing_rate": _ZERO_CROSSINGS,
    "mean_reversion_signal": f"(d[n] / nullif(sd, 0) + {_ZERO_CROSSINGS}) / 2",
    "hurst_rs": _RS,
    "hurst_exponent": _RS,
    "hilbert_amplitude": f"sqrt(power(d[n], 2) + power({_LAST_Y}, 2))",
    "hilbert_phase": f"atan2({_LAST_Y}, d[n])",
    "spectral_entropy": "-list_sum(list_transform(pw, lambda x: CASE WHEN x > 0 THEN x / list_sum(pw) * ln(x / list_sum(pw)) ELSE 0 END))",
    "spectral_power_ratio": "list_sum(pw[1:64]) / list_sum(pw[65:256])",
    "_window_entropy": "-list_sum(list_transform(pw, lambda x: CASE WHEN x > 0 THEN x / list_sum(pw) * ln(x / list_sum(pw)) ELSE 0 END))",
}
_BINS = {"spectral_entropy": "256", "spectral_power_ratio": "256", "_window_entropy": "n"}


def list_feature(name: str, w: int, value: str = "v") -> str:
    """(symbol, date, value) of a feature over the list of a frame's returns."""
    if name == "hurst_dfa":
        return dfa(w, value)
    if name.startswith("wavelet"):
        return wavelet(name, w, value)
    power = f", {_power(_BINS[name])} AS pw" if name in _BINS else ", list_filter(range(1, n + 1), lambda i: i = 1 OR sign(l[i]) <> sign(l[i - 1])) AS st" if name == "up_down_run_ratio" else ""
    return f"""SELECT symbol, date, {LISTS[name]} AS {value} FROM (SELECT *{power} FROM (
  SELECT *, len(l) AS n, least({max(10, int(w * 0.05))}, len(l)) AS k, list_transform(l, lambda x: x - mean) AS d, power(2, ceil(log2(len(l))))::INT AS size
  FROM (SELECT symbol, date, list(r) OVER f AS l, list_reverse_sort(list(a) OVER f) AS t, stddev_pop(r) OVER f AS stddev, stddev_samp(r) OVER f AS sd, avg(r) OVER f AS mean FROM base WINDOW f AS {rows(w)})
) WHERE n >= {min(10, w)})"""


def ewm(half_lives: tuple[int, ...]) -> str:
    """Each row against all rows before it, weighted by age."""
    sums = ", ".join(f"sum(power({2 ** (-1 / h)!r}, b.rn - j.rn)) AS w{h}, sum(power({2 ** (-1 / h)!r}, 2 * (b.rn - j.rn))) AS ww{h}, sum(power({2 ** (-1 / h)!r}, b.rn - j.rn) * j.r) AS x{h}, sum(power({2 ** (-1 / h)!r}, b.rn - j.rn) * j.r * j.r) AS xx{h}" for h in half_lives)
    values = ", ".join(f"{out(f'CASE WHEN c >= 10 THEN sqrt(greatest(0, xx{h} / w{h} - power(x{h} / w{h}, 2)) * w{h} * w{h} / (w{h} * w{h} - ww{h})) END')} AS ewm_volatility_h{h}" for h in half_lives)
    return f"WITH {returns()}, {BASE}, s AS (SELECT b.symbol, b.date, count(*) AS c, {sums} FROM base b JOIN base j ON b.symbol = j.symbol AND j.rn <= b.rn GROUP BY ALL) SELECT symbol, date::VARCHAR AS date, {values} FROM s"


def efficiency(name: str, windows: tuple[int, ...]) -> str:
    """Features that scale entropies by their range over the whole history."""
    scale = lambda x: f"(({x}) - min({x}) OVER (PARTITION BY symbol)) / nullif(max({x}) OVER (PARTITION BY symbol) - min({x}) OVER (PARTITION BY symbol), 0)"
    steps, columns = [], []
    for w in windows:
        steps.append(f"e{w} AS ({list_feature('_window_entropy', w, 'se')})")
        steps.append(f"f{w} AS (SELECT base.symbol, base.date, se, {gate(_permutation(w), w)} AS pe, {gate(f'power({acf(chr(114), w)}, 2)', w)} AS ar, {gate(f'stddev_samp(r) OVER {rows(w)}', w)} AS sd FROM base LEFT JOIN e{w} ON base.symbol = e{w}.symbol AND base.date = e{w}.date)".replace("PARTITION BY symbol ORDER BY date", "PARTITION BY base.symbol ORDER BY base.date"))
        formula = f"(1 - {scale('se')} + 1 - {scale('pe')} + ar) / 3" if name == "market_efficiency" else f"(1 - {scale('se')} + ar + {scale('sd')}) / 3"
        steps.append(f"g{w} AS (SELECT symbol, date, {out(formula, FEATURES[name][1])} AS v FROM f{w})")
        columns.append(f"g{w}.v AS {name}_w{w}")
    first, rest = windows[0], windows[1:]
    joins = " ".join(f"JOIN g{w} ON g{first}.symbol = g{w}.symbol AND g{first}.date = g{w}.date" for w in rest)
    return f"WITH {returns()}, {BASE}, {', '.join(steps)} SELECT g{first}.symbol, g{first}.date::VARCHAR AS date, {', '.join(columns)} FROM g{first} {joins}"


def feature(name: str, windows: tuple[int, ...], windowed: bool) -> str:
    head = f"WITH {returns()}, {BASE}"
    _, digits = FEATURES[name]
    if name == "ewm_volatility":
        return ewm((10, 30, 90))
    if name in ("market_efficiency", "adaptive_market_hypothesis"):
        return efficiency(name, windows)
    if name in LISTS:
        parts = [f"(SELECT symbol, date, {out('v', digits)} AS v FROM ({list_feature(name, w)}))" for w in windows]
        joins = " ".join(f"LEFT JOIN {p} x{k} ON b.symbol = x{k}.symbol AND b.date = x{k}.date" for k, p in enumerate(parts))
        return f"{head} SELECT b.symbol, b.date::VARCHAR AS date, {', '.join(f'x{k}.v AS {name}_w{w}' for k, w in enumerate(windows))} FROM base b {joins}"
    build = FEATURES[name][0]
    columns = []
    for w in windows if windowed else (0,):
        x = build(w)
        x = x if name in UNGATED else gate(x, w)
        columns.append(f"{out(x, digits)} AS {name}_w{w}" if windowed else f"{out(x, digits)} AS {name}")
    return f"{head} SELECT symbol, date::VARCHAR AS date, {', '.join(columns)} FROM base"


def signals() -> str:
    """base columns and four features: nd20, vol20, mom20, relvol5."""
    g = lambda n, w: gate(FEATURES[n][0](w), w)
    return f"""WITH {returns()}, {BASE},
sig AS (SELECT symbol, date, y, {g('normalized_deviation', 20)} AS nd20, {g('rolling_volatility', 20)} AS vol20, {g('rolling_return', 20)} AS mom20, {g('relative_volume', 5)} AS relvol5 FROM base)"""


def relative(x: str, digits: int = 7) -> str:
    """Rounded to significant digits."""
    size = f"power(10, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / {size}, {digits}) * {size} END"


#: What every operator costs, written out: a feature 1, neg and abs 1 more, + - * 1 more than both sides, / 2 more.
SCORED = (
    ("nd20", "nd20", 1), ("mom20", "mom20", 1), ("relvol5", "relvol5", 1),
    ("neg(nd20)", "-nd20", 2), ("neg(mom20)", "-mom20", 2), ("neg(relvol5)", "-relvol5", 2),
    ("abs(nd20)", "abs(nd20)", 2), ("abs(mom20)", "abs(mom20)", 2), ("abs(relvol5)", "abs(relvol5)", 2),
    ("nd20 + mom20", "nd20 + mom20", 3), ("nd20 + relvol5", "nd20 + relvol5", 3), ("mom20 + relvol5", "mom20 + relvol5", 3),
    ("nd20 - mom20", "nd20 - mom20", 3), ("nd20 - relvol5", "nd20 - relvol5", 3), ("mom20 - nd20", "mom20 - nd20", 3),
    ("mom20 - relvol5", "mom20 - relvol5", 3), ("relvol5 - nd20", "relvol5 - nd20", 3), ("relvol5 - mom20", "relvol5 - mom20", 3),
    ("nd20 * nd20", "nd20 * nd20", 3), ("nd20 * mom20", "nd20 * mom20", 3), ("nd20 * relvol5", "nd20 * relvol5", 3),
    ("mom20 * mom20", "mom20 * mom20", 3), ("mom20 * relvol5", "mom20 * relvol5", 3), ("relvol5 * relvol5", "relvol5 * relvol5", 3),
    ("nd20 / mom20", "nd20 / nullif(mom20, 0)", 4), ("nd20 / relvol5", "nd20 / nullif(relvol5, 0)", 4), ("mom20 / nd20", "mom20 / nullif(nd20, 0)", 4),
    ("mom20 / relvol5", "mom20 / nullif(relvol5, 0)", 4), ("relvol5 / nd20", "relvol5 / nullif(nd20, 0)", 4), ("relvol5 / mom20", "relvol5 / nullif(mom20, 0)", 4),
)


def scored(loss: str = "avg(abs(%s - y))") -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS candidate_id, '{text}' AS expression, {loss % f'({x})'} AS loss, {cost} AS complexity FROM sig" for k, (text, x, cost) in enumerate(SCORED))
    return f"{signals()}, scored AS ({rows})"


#: Candidates of the check: text, is_valid, within_limits, complexity, depth, features, operators, value.
CHECKED = (
    ("nd20 + mom20 * abs(relvol5)", True, True, 6, 4, 3, 3, "nd20 + mom20 * abs(relvol5)"),
    ("(nd20 - vol20) / (mom20 + relvol5)", True, True, 8, 3, 4, 3, "(nd20 - vol20) / nullif(mom20 + relvol5, 0)"),
    ("-nd20 * 0.5", True, True, 4, 3, 1, 2, "-nd20 * 0.5::DOUBLE"),
    ("neg(abs(neg(abs(neg(nd20)))))", True, False, 6, 6, 1, 5, None),
    ("nd20 + nd20 + nd20 + nd20 + nd20", True, True, 9, 5, 1, 4, "5 * nd20"),
    ("nd20 ** 2", False, False, None, None, None, None, None), ("exp(nd20)", False, False, None, None, None, None, None), ("nd20 / 0", False, False, None, None, None, None, None),
    ("(nd20", False, False, None, None, None, None, None), ("", False, False, None, None, None, None, None),
)
#: Candidates of the metrics: their features and what they cost.
COMPARED = {0: (["nd20"], 2), 1: (["mom20", "vol20"], 4), 2: (["nd20", "relvol5"], 3), 3: (["mom20", "nd20"], 4)}
ALPHAS = {0: "-nd20", 1: "mom20 / nullif(vol20, 0)", 2: "relvol5 - nd20", 3: "abs(nd20) * mom20"}


def values(raw: str = "raw") -> str:
    """The candidates' rows; with another name for them, ``v`` is left to the caller."""
    union = " UNION ALL ".join(f"SELECT {k} AS c, date, symbol, {e} AS alpha, y FROM sig" for k, e in ALPHAS.items())
    complete = ",\nv AS (SELECT * FROM raw WHERE alpha IS NOT NULL AND y IS NOT NULL)" if raw == "raw" else ""
    return f"{signals()},\n{raw} AS ({union}){complete}"


def avg_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def agg_corr(a: str, b: str) -> str:
    c = f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(-1, least(1, {c})) END"


def rank_corr(a: str, b: str) -> str:
    c = f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b})) / nullif(sqrt(count(*) * sum({a} * {a}) - sum({a}) * sum({a})) * sqrt(count(*) * sum({b} * {b}) - sum({b}) * sum({b})), 0)"
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(-1, least(1, {c})) END"


#: Two-sided p-value of a correlation r of n pairs: Simpson's rule over the density of Student's t.
P_VALUE = """CASE WHEN n < 3 OR r = 0 THEN 1.0 ELSE greatest(0, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * t / 6000 *
  list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(t * k / 2000, 2) / (n - 2), -(n - 1) / 2.0)))) END"""

METRIC_PARTS = f"""
pooled AS (SELECT c, {avg_rank('alpha', 'c')} AS ra, {avg_rank('y', 'c')} AS ry, alpha, y FROM v),
ic AS (SELECT c, coalesce({agg_corr('ra', 'ry')}, 0) AS ic, coalesce({agg_corr('alpha', 'y')}, 0) AS pearson, count(*) AS n FROM pooled GROUP BY c),
dr AS (SELECT c, date, {avg_rank('alpha', 'c, date')} AS ra, {avg_rank('y', 'c, date')} AS ry FROM v),
dic AS (SELECT c, date, {rank_corr('ra', 'ry')} AS ic FROM dr GROUP BY c, date),
stab AS (SELECT c, avg((ic > 0)::INT) AS ic_stability FROM dic WHERE ic IS NOT NULL GROUP BY c),
rk AS (SELECT *, row_number() OVER (PARTITION BY c, date ORDER BY alpha, symbol) AS lo, row_number() OVER (PARTITION BY c, date ORDER BY alpha DESC, symbol) AS hi, count(*) OVER (PARTITION BY c, date) AS n FROM v),
daily AS (SELECT c, date, avg(CASE WHEN lo > n - n // 5 THEN y END) - avg(CASE WHEN lo <= n // 5 THEN y END) AS p FROM rk WHERE n >= 5 GROUP BY c, date),
curve AS (SELECT *, product(1 + p) OVER s AS cum FROM daily WINDOW s AS (PARTITION BY c ORDER BY date)),
dd AS (SELECT *, cum / max(cum) OVER (PARTITION BY c ORDER BY date) - 1 AS dd FROM curve),
perf AS (SELECT c, coalesce(CASE WHEN stddev_samp(p) > 0 THEN avg(p) * 252 / (stddev_samp(p) * sqrt(252)) END, 0) AS sharpe, avg(p) * 252 AS annual_return, coalesce(stddev_samp(p) * sqrt(252), 0) AS annual_volatility,
  min(dd) AS max_drawdown, avg((p > 0)::INT) AS win_rate, count(*) AS n_dates FROM dd GROUP BY c),
dts AS (SELECT c, date, max(n) // 5 AS k, lead(date) OVER (PARTITION BY c ORDER BY date) AS nxt FROM rk GROUP BY c, date),
held AS (SELECT rk.c, nxt AS date, 'l' AS side, symbol, k FROM rk JOIN dts USING (c, date) WHERE hi <= k AND nxt IS NOT NULL UNION ALL SELECT rk.c, nxt, 's', symbol, k FROM rk JOIN dts USING (c, date) WHERE lo <= k AND nxt IS NOT NULL),
gone AS (SELECT held.c, held.date, side, avg((rk.symbol IS NULL OR CASE WHEN side = 'l' THEN hi ELSE lo END > k)::INT) AS s FROM held LEFT JOIN rk ON held.c = rk.c AND held.date = rk.date AND held.symbol = rk.symbol GROUP BY ALL),
turn AS (SELECT c, avg(s) AS turnover FROM (SELECT c, date, avg(s) AS s FROM gone GROUP BY c, date) GROUP BY c)"""


def metrics() -> str:
    return values() + "," + METRIC_PARTS
