"""The registered queries of the signal-research library, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.functions import expressions
from marlstone.functions.windows import centred, frame, gated, ordered, rolling_mean, rolling_std
from marlstone.operators import backtest, kernels, metrics, normalize, panel, policy, split
from marlstone.operators.asof import as_of
from marlstone.operators.features import FACTS, REGISTRY, WINDOWS, add_market, column_name, compute_features, feature_summary, hilbert_transform, hurst_exponent, select_features, wavelet_decomposition
from marlstone.operators.kernels import HALF_LIVES
from marlstone.plans import oracle
from marlstone.sources import bars
from marlstone.storage import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def day(df: DataFrame, name: str = "date") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("string"))


def relative(c: str, digits: int = 7) -> Column:
    """Rounded to significant digits."""
    x = F.col(c)
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x / size, digits) * size)


def base_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.preprocess(bars.daily_brand(spark, sf_dir))


SIGNALS = {"nd20": ("normalized_deviation", 20), "vol20": ("rolling_volatility", 20), "mom20": ("rolling_return", 20), "relvol5": ("relative_volume", 5)}
EXPRESSIONS = {0: "neg(nd20)", 1: "mom20 / vol20", 2: "relvol5 - nd20", 3: "abs(nd20) * mom20"}


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [n for n, _ in SIGNALS.values()]
    wide = compute_features(base_panel(spark, sf_dir), names, (5, 20))
    return wide.select("symbol", "date", "forward_return", *[F.col(f"{n}_w{w}").alias(k) for k, (n, w) in SIGNALS.items()])


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.candidate_values(signals(spark, sf_dir), EXPRESSIONS)


# ---- sources and panel ----

for _source in ("daily_brand", "weekly_nation"):
    @_query(f"bars_{_source}", f"WITH {oracle.bars(_source)} SELECT symbol, date::VARCHAR AS date, {', '.join(f'{oracle.out(c)} AS {c}' for c in bars.MEASURES)} FROM bars")
    def _bars(spark, sf_dir, source=_source):
        return day(getattr(bars, source)(spark, sf_dir)).select("symbol", "date", *[rounded(c).alias(c) for c in bars.MEASURES])


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


_BAR_COLUMNS = ", ".join(f"{oracle.out(c)} AS {c}" for c in bars.MEASURES)


@_query("source_csv", f"WITH {oracle.bars()} SELECT symbol, date::VARCHAR AS date, {_BAR_COLUMNS} FROM bars")
def source_csv(spark, sf_dir):
    """Bars written as CSV files and read back with lower-cased names."""
    path = _scratch(spark, "csv")
    raw = bars.daily_brand(spark, sf_dir)
    raw.toDF(*[c.upper() for c in raw.columns]).write.option("header", True).csv(path)
    return day(bars.read_csv(spark, path)).select("symbol", "date", *[rounded(c).alias(c) for c in bars.MEASURES])


@_query("source_directory", f"WITH {oracle.bars()} SELECT symbol, date::VARCHAR AS date, {_BAR_COLUMNS} FROM bars")
def source_directory(spark, sf_dir):
    """Bars written as Parquet files and read back as a folder."""
    path = _scratch(spark, "parquet")
    bars.daily_brand(spark, sf_dir).write.parquet(path)
    return day(bars.read_directory(spark, path, "*.parquet", "parquet")).select("symbol", "date", *[rounded(c).alias(c) for c in bars.MEASURES])


for _type in ("parquet", "json"):
    @_query("sink_results" if _type == "parquet" else f"sink_results_{_type}", f"WITH {oracle.bars()} SELECT run_id, symbol, count(*) AS n FROM bars, (VALUES ('r1'), ('r2')) r(run_id) GROUP BY ALL")
    def _sink(spark, sf_dir, file_type=_type):
        """Results of two runs, kept side by side and loaded together."""
        path, one = _scratch(spark, "runs"), bars.daily_brand(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
        for run in ("r1", "r2"):
            bars.save_results(one, path, run, file_type)
        return bars.load_results(spark, path, file_type).select("run_id", "symbol", "n")


@_query("source_file_stem", f"WITH {oracle.bars()} SELECT 'part' AS symbol, date::VARCHAR AS date, {_BAR_COLUMNS} FROM bars")
def source_file_stem(spark, sf_dir):
    """Bars whose files name the symbol: of each file's name the first word."""
    path = _scratch(spark, "stems")
    bars.daily_brand(spark, sf_dir).drop("symbol").write.parquet(path)
    read = bars.read_directory(spark, path, "*.parquet", "parquet")
    return day(read).select(F.element_at(F.split("symbol", "-"), 1).alias("symbol"), "date", *[rounded(c).alias(c) for c in bars.MEASURES])


@_query("source_file_report", f"""WITH {oracle.bars()} SELECT 'ok' AS status, '' AS missing, count(*) AS n_rows, 0::BIGINT AS n_bad FROM bars UNION ALL SELECT 'refused', 'close', count(*), 0 FROM bars
UNION ALL SELECT 'no rows', '', 0, 0 UNION ALL SELECT 'partial', '', 2 * count(*), count(*) FROM bars""")
def source_file_report(spark, sf_dir):
    """A folder with whole files, files that lack a column, files with broken lines and a file without rows; totals by what became of them."""
    path, raw = _scratch(spark, "mixed"), bars.daily_brand(spark, sf_dir)
    raw.write.option("header", True).csv(path)
    raw.drop("close").write.mode("append").option("header", True).csv(path)
    raw.where("false").coalesce(1).write.mode("append").option("header", True).csv(path)
    # each line once whole and once without its last two fields
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns]
    lines = raw.repartition(4).select(F.explode(F.array(F.concat_ws(",", *fields), F.concat_ws(",", *fields[:-2]))).alias("value"))
    head = lines.mapInPandas(_with_header(",".join(raw.columns)), "value string")
    head.write.mode("append").text(path)
    report = bars.file_report(spark, path, "part-*")
    return report.groupBy("status", "missing").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))


def _with_header(line: str):
    def run(batches):
        first = True
        for batch in batches:
            if first and len(batch):
                yield pd.DataFrame({"value": [line]})
                first = False
            yield batch

    return run


_RETURNS = ("log_return", "forward_return", "simple_return", "forward_simple_return", "typical_price", "dollar_volume")


@_query("panel_returns", f"WITH {oracle.returns('daily_brand')} SELECT symbol, date::VARCHAR AS date, {', '.join(f'{oracle.out(c)} AS {c}' for c in _RETURNS)} FROM panel")
def panel_returns(spark, sf_dir):
    return day(panel.preprocess(bars.daily_brand(spark, sf_dir))).select("symbol", "date", *[rounded(c).alias(c) for c in _RETURNS])


@_query("panel_history", f"WITH {oracle.bars()} SELECT symbol, count(*) AS n_rows, count(*) < 252 AS is_short FROM bars GROUP BY symbol")
def panel_history(spark, sf_dir):
    return panel.history(bars.daily_brand(spark, sf_dir))


@_query("panel_common_dates", f"WITH {oracle.bars('weekly_nation')} SELECT date::VARCHAR AS date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)")
def panel_common_dates(spark, sf_dir):
    return day(panel.common_dates(bars.weekly_nation(spark, sf_dir)))


@_query(
    "panel_align",
    f"WITH {oracle.bars('weekly_nation')} SELECT symbol, date::VARCHAR AS date, {oracle.out('close')} AS close FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))",
)
def panel_align(spark, sf_dir):
    return day(panel.align(bars.weekly_nation(spark, sf_dir))).select("symbol", "date", rounded("close").alias("close"))


@_query("panel_union", f"WITH {oracle.returns()}, u AS (SELECT symbol, date, close, volume FROM panel UNION ALL SELECT 'D ' || symbol, date, close, NULL FROM panel) SELECT symbol, date::VARCHAR AS date, {oracle.out('close')} AS close, {oracle.out('volume')} AS volume FROM u")
def panel_union(spark, sf_dir):
    p = base_panel(spark, sf_dir)
    both = panel.union_assets(p, p.drop("volume").withColumn("symbol", F.concat(F.lit("D "), "symbol")))
    return day(both).select("symbol", "date", rounded("close").alias("close"), rounded("volume").alias("volume"))


def gappy(spark, sf_dir) -> DataFrame:
    """Bars with every row whose volume is a multiple of three blanked."""
    blank = lambda c: F.when(F.col("volume") % 3 != 0, F.col(c)).alias(c)
    return bars.daily_brand(spark, sf_dir).select("symbol", "date", *[blank(c) for c in bars.MEASURES])


_GAPPY = f"WITH {oracle.bars()}, gappy AS (SELECT symbol, date, {', '.join(f'CASE WHEN volume % 3 <> 0 THEN {c} END AS {c}' for c in bars.MEASURES)} FROM bars)"


@_query("panel_missing_fraction", f"{_GAPPY} SELECT {oracle.out('(5 * count(*) - count(open) - count(high) - count(low) - count(close) - count(volume)) / (5.0 * count(*))')} AS missing_fraction FROM gappy")
def panel_missing_fraction(spark, sf_dir):
    return panel.missing_fraction(gappy(spark, sf_dir)).select(rounded("missing_fraction").alias("missing_fraction"))


for _method, _fn, _frame in (("ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
    @_query(f"panel_fill_{_method}", f"{_GAPPY} SELECT symbol, date::VARCHAR AS date, {', '.join(f'round({_fn}({c} IGNORE NULLS) OVER f, 6) + 0.0 AS {c}' for c in bars.MEASURES)} FROM gappy WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {_frame})")
    def _fill(spark, sf_dir, method=_method):
        return day(panel.fill(gappy(spark, sf_dir), method)).select("symbol", "date", *[rounded(c).alias(c) for c in bars.MEASURES])


@_query("panel_drop_incomplete", f"{_GAPPY} SELECT symbol, date::VARCHAR AS date, {oracle.out('close')} AS close FROM gappy WHERE close IS NOT NULL AND volume IS NOT NULL")
def panel_drop_incomplete(spark, sf_dir):
    return day(panel.drop_incomplete(gappy(spark, sf_dir))).select("symbol", "date", rounded("close").alias("close"))


@_query("panel_validate", f"WITH {oracle.returns()} SELECT count(*) > 0 AND count(*) = count(DISTINCT (symbol, date)) AS is_valid, CASE WHEN count(*) > 0 AND count(*) = count(DISTINCT (symbol, date)) THEN 'ok' END AS message FROM panel WHERE close IS NOT NULL AND volume IS NOT NULL")
def panel_validate(spark, sf_dir):
    return panel.validate(base_panel(spark, sf_dir))


_STATS = ("mean_return", "std_return", "min_return", "max_return", "mean_volume", "std_volume")


@_query("panel_stats", f"""WITH {oracle.returns()} SELECT count(DISTINCT symbol) AS n_assets, count(DISTINCT date) AS n_dates, count(*) AS n_rows, (max(date) - min(date))::INT AS range_days,
  {oracle.out('avg(forward_return)')} AS mean_return, {oracle.out('stddev_samp(forward_return)')} AS std_return, {oracle.out('min(forward_return)')} AS min_return, {oracle.out('max(forward_return)')} AS max_return,
  {oracle.out('avg(volume)')} AS mean_volume, {oracle.out('stddev_samp(volume)')} AS std_volume FROM panel""")
def panel_stats(spark, sf_dir):
    return panel.stats(base_panel(spark, sf_dir)).withColumns({c: rounded(c) for c in _STATS})


@_query("panel_create", f"""WITH {oracle.bars().replace('bars AS', 'all_bars AS')}, bars AS (SELECT symbol, date, open, high, low, close, CASE WHEN volume % 7 <> 0 THEN volume END AS volume FROM all_bars){oracle.RETURNS},
filled AS (SELECT symbol, date, log_return, last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS volume FROM panel)
SELECT symbol, date::VARCHAR AS date, {oracle.out('log_return')} AS log_return, {oracle.out('volume')} AS volume FROM filled WHERE volume IS NOT NULL""")
def panel_create(spark, sf_dir):
    """A volume that is a multiple of seven counts as missing: filled from the past, however few there are."""
    gaps = bars.daily_brand(spark, sf_dir).withColumn("volume", F.when(F.col("volume") % 7 != 0, F.col("volume")))
    return day(panel.create_panel(gaps)).select("symbol", "date", rounded("log_return").alias("log_return"), rounded("volume").alias("volume"))


# ---- features ----


def _feature_query(name: str) -> Query:
    f = REGISTRY[name]
    digits = oracle.FEATURES[name][1] if name in oracle.FEATURES else 4

    def run(spark, sf_dir):
        wide = compute_features(base_panel(spark, sf_dir), [name], WINDOWS)
        if f.build is None:
            names = [c for c in wide.columns if c.startswith(name + "_")]
        else:
            names = [column_name(f, w) for w in WINDOWS] if f.windowed else [name]
        return day(wide).select("symbol", "date", *[rounded(F.col(c).cast("double"), digits).alias(c) for c in names])

    return run


for _name, _f in REGISTRY.items():
    _query(f"feature_{_name}", oracle.feature(_name, WINDOWS, _f.windowed) if _name in oracle.FEATURES else None)(_feature_query(_name))


def _store_columns(wide: DataFrame) -> list[tuple[str, int]]:
    """Feature columns and the digits to which each is stated."""
    return [(c, oracle.FEATURES[n][1]) for n, f in REGISTRY.items() for c in ([column_name(f, w) for w in (WINDOWS if f.windowed else (0,))] if f.name != "ewm_volatility" else [f"ewm_volatility_h{h}" for h in HALF_LIVES]) if c in wide.columns]


@_query("feature_store", "SELECT * FROM " + " JOIN ".join(f"({oracle.feature(n, WINDOWS, f.windowed)}) s{k}" + (" USING (symbol, date)" if k else "") for k, (n, f) in enumerate(REGISTRY.items())))
def feature_store(spark, sf_dir):
    """All features over all windows, in one table, of daily bars."""
    wide = compute_features(base_panel(spark, sf_dir))
    return day(wide).select("symbol", "date", *[rounded(F.col(c).cast("double"), digits).alias(c) for c, digits in _store_columns(wide)])


_WEEKLY_BARS = "w0 AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY symbol, date_trunc('week', date)), w1 AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM w0), w2 AS (SELECT symbol, date, CASE WHEN count(r) OVER f >= 5 THEN stddev_samp(r) OVER f END AS weekly_volatility FROM w1 WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))"


@_query("feature_asof_weekly", f"""WITH {oracle.returns()}, {_WEEKLY_BARS}
SELECT d.symbol, d.date::VARCHAR AS date, CASE WHEN d.date - w.date <= 10 THEN {oracle.out('w.weekly_volatility')} END AS weekly_volatility, CASE WHEN d.date - w.date <= 10 THEN w.date::VARCHAR END AS as_of FROM panel d ASOF LEFT JOIN w2 w ON d.symbol = w.symbol AND d.date > w.date""")
def feature_asof_weekly(spark, sf_dir):
    """A feature of weekly bars on daily rows: what the last week that was over told, no older than ten days."""
    raw = bars.daily_brand(spark, sf_dir)
    weekly = raw.groupBy("symbol", F.date_trunc("week", "date").alias("week")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    change = weekly.withColumn("log_return", F.log(F.col("close") / F.lag("close").over(ordered())))
    told = change.select("symbol", "date", gated(rolling_std(F.col("log_return"), frame(5)), F.count("log_return").over(frame(5)), 5, "full").alias("weekly_volatility"))
    placed = as_of(base_panel(spark, sf_dir).select("symbol", "date"), told, tolerance_days=10, strict=True)
    return day(placed).select("symbol", "date", rounded("weekly_volatility").alias("weekly_volatility"), F.col("as_of").cast("string").alias("as_of"))


@_query("feature_hurst_exponent_dfa", oracle.feature("hurst_dfa", WINDOWS, True).replace("hurst_dfa_w", "hurst_exponent_w"))
def feature_hurst_exponent_dfa(spark, sf_dir):
    """The Hurst exponent by detrended fluctuations instead of the rescaled range."""
    wide = hurst_exponent(base_panel(spark, sf_dir), WINDOWS, "dfa")
    return day(wide).select("symbol", "date", *[rounded(f"hurst_exponent_w{w}", 5).alias(f"hurst_exponent_w{w}") for w in WINDOWS])


def _corr_of_columns(r, volume):
    a, b = abs(r), volume
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


@_query("kernel_of_columns", f"WITH {oracle.returns()}, {oracle.BASE} SELECT symbol, date::VARCHAR AS date, " + ", ".join(
    f"{oracle.out(oracle.gate(oracle.FEATURES['volume_volatility_corr'][0](w), w))} AS corr_of_columns_w{w}" for w in WINDOWS) + ", CASE WHEN count(r) OVER c >= 10 THEN round(stddev_pop(r) OVER c, 6) + 0.0 END AS centred_spread_w20 FROM base WINDOW c AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)")
def kernel_of_columns(spark, sf_dir):
    """Kernels of one's own: one over two columns, one over centred frames."""
    kernels.register_kernel("corr_of_columns", _corr_of_columns, ("log_return", "volume"))
    kernels.register_kernel("centred_spread", lambda x: x.std(axis=1), centred=True)
    p = base_panel(spark, sf_dir)
    wide = kernels.kernel_features(kernels.kernel_features(p, ["corr_of_columns"], WINDOWS), ["centred_spread"], (20,))
    names = [*[f"corr_of_columns_w{w}" for w in WINDOWS], "centred_spread_w20"]
    return day(wide).select("symbol", "date", *[rounded(c).alias(c) for c in names])


@_query("features_of_fact", f"WITH {oracle.returns()}, {oracle.BASE} SELECT symbol, date::VARCHAR AS date, " + ", ".join(
    f"{oracle.out(oracle.gate(oracle.FEATURES[n][0](w), w), oracle.FEATURES[n][1])} AS {n}_w{w}" for n in ("downside_upside_vol_ratio", "leverage_correlation", "gjr_asymmetry") for w in WINDOWS
) + " FROM base")
def features_of_fact(spark, sf_dir):
    """The features of one fact, the leverage effect."""
    names = [f.name for f in select_features(fact=3)]
    wide = compute_features(base_panel(spark, sf_dir), names)
    return day(wide).select("symbol", "date", *[rounded(f"{n}_w{w}", oracle.FEATURES[n][1]).alias(f"{n}_w{w}") for n in names for w in WINDOWS])


@_query("features_without_group", f"""WITH {oracle.returns()}, {oracle.BASE} SELECT b.symbol, b.date::VARCHAR AS date, {', '.join(f'{oracle.out(oracle.gate(oracle.FEATURES[n][0](20), 20))} AS {n}_w20' for n in ('hodrick_prescott_cycle', 'normalized_deviation')).replace('PARTITION BY symbol ORDER BY date', 'PARTITION BY b.symbol ORDER BY b.date')},
{oracle.out('z.v')} AS zero_crossing_rate_w20 FROM base b LEFT JOIN ({oracle.list_feature('zero_crossing_rate', 20)}) z ON b.symbol = z.symbol AND b.date = z.date""")
def features_without_group(spark, sf_dir):
    """The features of mean reversion, without those that need a Hilbert transform."""
    names = [f.name for f in select_features(fact=10) if f.name != "mean_reversion_signal"]
    wide = compute_features(base_panel(spark, sf_dir), names, (20,), exclude_tags=("hilbert",))
    return day(wide).select("symbol", "date", *[rounded(c).alias(c) for c in wide.columns if c.endswith("_w20")])


_REPORTED = {3: "leverage effect", 4: "volume and volatility", 7: "skewness"}
_REPORTED_SQL = {3: ("downside_upside_vol_ratio", "leverage_correlation", "gjr_asymmetry"), 4: ("volume_volatility_corr", "relative_volume", "volume_surprise", "volume_weighted_volatility", "dollar_volume"), 7: ("rolling_skewness", "downside_frequency")}


@_query("feature_report", f"WITH {oracle.returns()}, {oracle.BASE}, v AS (SELECT symbol, date, " + ", ".join(
    f"{x if n in oracle.UNGATED else oracle.gate(x, 20)} AS {n}" for k, names in _REPORTED_SQL.items() for n in names for x in [oracle.FEATURES[n][0](20)]
) + " FROM base) " + " UNION ALL ".join(f"SELECT {k} AS fact, '{_REPORTED[k]}' AS fact_name, '{n}' AS feature, count({n}) AS n_values, count(*) AS n_rows FROM v" for k, names in _REPORTED_SQL.items() for n in names))
def feature_report(spark, sf_dir):
    """How many values each feature of three facts has on the panel."""
    picked = [f for k in _REPORTED for f in select_features(fact=k)]
    wide = compute_features(base_panel(spark, sf_dir), [f.name for f in picked], (20,))
    counts = wide.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(column_name(f, 20)).alias(f.name) for f in picked])
    long = counts.unpivot(["n_rows"], [f.name for f in picked], "feature", "n_values")
    facts = spark.createDataFrame([(f.name, f.fact, FACTS[f.fact]) for f in picked], "feature string, fact int, fact_name string")
    return long.join(facts, "feature").select("fact", "fact_name", "feature", "n_values", "n_rows")


@_query("feature_summary", f"WITH {oracle.returns()}, {oracle.BASE}, v AS (SELECT " + ", ".join(
    f"{x if n in oracle.UNGATED else oracle.gate(x, 20)} AS {n}" for k, names in _REPORTED_SQL.items() for n in names for x in [oracle.FEATURES[n][0](20)]
) + " FROM base) " + " UNION ALL ".join(f"SELECT {k} AS fact, '{_REPORTED[k]}' AS fact_name, {len(names)} AS n_features, '{', '.join(names)}' AS features, {' + '.join(f'count({n})' for n in names)} AS n_values FROM v" for k, names in _REPORTED_SQL.items()))
def feature_facts(spark, sf_dir):
    """Of three facts: which features measure them, and how many values these have on the panel."""
    picked = [f for k in _REPORTED for f in select_features(fact=k)]
    wide = compute_features(base_panel(spark, sf_dir), [f.name for f in picked], (20,))
    counts = wide.agg(*[sum(F.count(column_name(f, 20)) for f in picked if f.fact == k).alias(str(k)) for k in _REPORTED])
    return feature_summary(spark).join(counts.unpivot([], [str(k) for k in _REPORTED], "k", "n_values"), F.col("fact") == F.col("k").cast("int")).drop("k")


@_query("feature_market_return", f"WITH {oracle.returns()}, {oracle.BASE} SELECT DISTINCT date::VARCHAR AS date, {oracle.out('m')} AS market_return, {oracle.out('ml')} AS market_lag FROM base")
def feature_market_return(spark, sf_dir):
    return day(add_market(base_panel(spark, sf_dir))).select("date", rounded("market_return").alias("market_return"), rounded("market_lag").alias("market_lag")).distinct()


@_query("rolling_centred_mean", f"WITH {oracle.returns()} SELECT symbol, date::VARCHAR AS date, round(avg(log_return) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS mean FROM panel")
def rolling_centred_mean(spark, sf_dir):
    return day(base_panel(spark, sf_dir)).select("symbol", "date", rounded(rolling_mean(F.col("log_return"), centred(6))).alias("mean"))


@_query("feature_hilbert_transform", f"WITH {oracle.returns()}, {oracle.BASE} SELECT a.symbol, a.date::VARCHAR AS date, {oracle.out('b.v1')} AS amplitude, {oracle.out('c.v2', 4)} AS phase FROM base a LEFT JOIN ({oracle.list_feature('hilbert_amplitude', 20, 'v1')}) b ON a.symbol = b.symbol AND a.date = b.date LEFT JOIN ({oracle.list_feature('hilbert_phase', 20, 'v2')}) c ON a.symbol = c.symbol AND a.date = c.date")
def feature_hilbert_transform(spark, sf_dir):
    out = day(hilbert_transform(base_panel(spark, sf_dir)))
    return out.select("symbol", "date", rounded("hilbert_transform.amplitude").alias("amplitude"), rounded("hilbert_transform.phase", 4).alias("phase"))


@_query("feature_wavelet_decomposition", "SELECT symbol, date, wavelet_energy_1_w20 AS level_1, wavelet_energy_2_w20 AS level_2, wavelet_energy_3_w20 AS level_3 FROM " + " JOIN ".join(f"({oracle.feature(f'wavelet_energy_{k}', (20,), True)}) s{k}" + (" USING (symbol, date)" if k > 1 else "") for k in (1, 2, 3)))
def feature_wavelet_decomposition(spark, sf_dir):
    out = day(wavelet_decomposition(base_panel(spark, sf_dir)))
    return out.select("symbol", "date", *[rounded(F.col("wavelet_decomposition")[k], 8).alias(f"level_{k + 1}") for k in range(3)])


@_query("feature_variance_ratio_documented", f"WITH {oracle.returns()}, {oracle.BASE}, s AS (SELECT *, r + r_1 AS two FROM base) SELECT symbol, date::VARCHAR AS date, " + ", ".join(f"round(CASE WHEN count(r) OVER {oracle.rows(w)} = {w} THEN var_samp(two) OVER {oracle.rows(w, 1)} / nullif(2 * var_samp(r) OVER {oracle.rows(w)}, 0) END, 5) + 0.0 AS variance_ratio_documented_w{w}" for w in WINDOWS) + " FROM s")
def feature_variance_ratio_documented(spark, sf_dir):
    wide = compute_features(base_panel(spark, sf_dir), ["variance_ratio_documented"], WINDOWS)
    return day(wide).select("symbol", "date", *[rounded(f"variance_ratio_documented_w{w}", 5).alias(f"variance_ratio_documented_w{w}") for w in WINDOWS])


# ---- normalisation ----

_FEATURES4 = tuple(SIGNALS)
_SQL_RANK = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / nullif(count({c}) OVER (PARTITION BY date), 0) END"
_SQL_Z = lambda c: f"CASE WHEN {c} IS NOT NULL AND stddev_samp({c}) OVER (PARTITION BY date) > 0 THEN greatest(-3, least(3, ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_samp({c}) OVER (PARTITION BY date))) END"
_SQL_MM = lambda c: f"({c} - min({c}) OVER (PARTITION BY date)) / nullif(max({c}) OVER (PARTITION BY date) - min({c}) OVER (PARTITION BY date), 0)"

for _method, _sql in (("rank", _SQL_RANK), ("zscore", _SQL_Z), ("minmax", _SQL_MM)):
    @_query(f"normalize_{_method}", f"{oracle.signals()} SELECT symbol, date::VARCHAR AS date, {', '.join(f'{oracle.out(_sql(c))} AS {c}' for c in _FEATURES4)} FROM sig")
    def _normalize(spark, sf_dir, method=_method):
        frame = signals(spark, sf_dir).drop("forward_return")
        return day(normalize.normalize(frame, method)).select("symbol", "date", *[rounded(c).alias(c) for c in _FEATURES4])


@_query("normalize_combined", f"{oracle.signals()} SELECT symbol, date::VARCHAR AS date, " + ", ".join(f"{oracle.out(f(c))} AS {p}_{c}" for c in _FEATURES4 for p, f in (("raw", lambda c: c), ("rank", _SQL_RANK), ("zscore", _SQL_Z))) + " FROM sig")
def normalize_combined(spark, sf_dir):
    out = day(normalize.normalize(signals(spark, sf_dir).drop("forward_return"), "combined"))
    return out.select("symbol", "date", *[rounded(c).alias(c) for c in out.columns if c not in ("symbol", "date")])


@_query("normalize_long_ranks", f"{oracle.signals()} " + " UNION ALL ".join(f"SELECT symbol, date::VARCHAR AS date, '{c}' AS feature, {oracle.out(_SQL_RANK(c))} AS percentile FROM sig" for c in _FEATURES4))
def normalize_long_ranks(spark, sf_dir):
    return day(normalize.long_ranks(signals(spark, sf_dir).drop("forward_return"))).withColumn("percentile", rounded("percentile"))


@_query("normalize_scaled_rank", f"{oracle.signals()} SELECT symbol, date::VARCHAR AS date, {oracle.out('-1 + 2 * (' + _SQL_RANK('nd20') + ')')} AS nd20 FROM sig WHERE nd20 IS NOT NULL")
def normalize_scaled_rank(spark, sf_dir):
    out = normalize.normalize(signals(spark, sf_dir).select("symbol", "date", "nd20"), "rank", "drop", percentile_range=(-1, 1))
    return day(out).withColumn("nd20", rounded("nd20"))


@_query("normalize_fill_missing", _GAPPY + """, f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM gappy)
SELECT symbol, date::VARCHAR AS date, round(first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS close FROM f""")
def normalize_fill_missing(spark, sf_dir):
    return day(normalize.handle_missing(gappy(spark, sf_dir).select("symbol", "date", "close"), "fill")).withColumn("close", rounded("close"))


# ---- splits ----

_POINTS = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM panel)), n AS (SELECT count(*) AS n FROM d),
ratios(split_id, train, validation) AS (VALUES %s),
c1 AS (SELECT split_id, n, greatest(floor(n * train)::INT, 100) AS i, floor(n * (train + validation))::INT AS j0 FROM ratios, n), c2 AS (SELECT split_id, n, i, least(greatest(j0, i + 100), n - 100) AS j FROM c1),
parts AS (SELECT split_id, 'train' AS split, 0 AS a, i - 1 AS b FROM c2 UNION ALL SELECT split_id, 'validation', i, j - 1 FROM c2 UNION ALL SELECT split_id, 'test', j, n - 1 FROM c2)"""


@_query("split_label", f"WITH {oracle.returns()}, {_POINTS % '(0, 0.6::DOUBLE, 0.2::DOUBLE)'} SELECT symbol, panel.date::VARCHAR AS date, split FROM panel JOIN d USING (date) JOIN parts ON k BETWEEN a AND b")
def split_label(spark, sf_dir):
    p = base_panel(spark, sf_dir)
    return day(split.label(p, split.split_by_ratio(p))).select("symbol", "date", "split")


@_query("split_frames", f"WITH {oracle.returns()}, {_POINTS % '(0, 0.6::DOUBLE, 0.2::DOUBLE)'} SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM panel JOIN d USING (date) JOIN parts ON k BETWEEN a AND b GROUP BY split")
def split_frames(spark, sf_dir):
    p = base_panel(spark, sf_dir)
    parts = split.split_frames(p, split.split_by_ratio(p))
    frames = [f.withColumn("split", F.lit(n)) for n, f in zip(("train", "validation", "test"), parts)]
    return frames[0].union(frames[1]).union(frames[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_dates"))


@_query("split_by_dates", f"""WITH {oracle.returns()}, e AS (SELECT min(date) FILTER (date >= DATE '1996-03-02') AS a, min(date) FILTER (date >= DATE '1997-05-03') AS b FROM panel)
SELECT CASE WHEN date <= a THEN 'train' WHEN date <= b THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date FROM panel, e GROUP BY 1""")
def split_by_dates(spark, sf_dir):
    p = base_panel(spark, sf_dir)
    labelled = split.label(p, split.split_by_dates(p, "1996-03-02", "1997-05-03"))
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


@_query("split_train_test", f"WITH {oracle.returns()} SELECT symbol, date::VARCHAR AS date, row_number() OVER (ORDER BY date, symbol) <= floor((SELECT count(*) FROM panel) * (1 - 0.2::DOUBLE)) AS is_train FROM panel")
def split_train_test(spark, sf_dir):
    return day(split.train_test(base_panel(spark, sf_dir))).select("symbol", "date", "is_train")


@_query("split_sweep", f"WITH {oracle.returns()}, {_POINTS % ', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b, _) in enumerate(split.SWEEP))} SELECT split_id, split, count(*) AS n_rows, {oracle.out('sum(log_return)')} AS total FROM panel JOIN d USING (date) JOIN parts ON k BETWEEN a AND b GROUP BY ALL")
def split_sweep(spark, sf_dir):
    return split.ratio_sweep(base_panel(spark, sf_dir)).groupBy("split_id", "split").agg(F.count(F.lit(1)).alias("n_rows"), rounded(F.sum("log_return")).alias("total"))


# ---- expressions ----


@_query("expression_predict", f"{oracle.values()} SELECT c AS candidate_id, symbol, date::VARCHAR AS date, {oracle.out('alpha')} AS alpha FROM raw")
def expression_predict(spark, sf_dir):
    return day(values(spark, sf_dir)).select("candidate_id", "symbol", "date", rounded("alpha").alias("alpha"))


ENUMERATED = expressions.enumerate_expressions(["nd20", "mom20", "relvol5"])


def scores(spark, sf_dir) -> DataFrame:
    return metrics.losses(signals(spark, sf_dir), dict(enumerate(ENUMERATED)))


@_query("expression_losses", f"{oracle.scored()} SELECT candidate_id, expression, {oracle.relative('loss')} AS loss, complexity, {oracle.relative('(loss + 0.012 * complexity)')} AS score FROM scored")
def expression_losses(spark, sf_dir):
    return scores(spark, sf_dir).withColumns({"loss": relative("loss"), "score": relative("score")})


@_query("expression_losses_l2", f"{oracle.scored('avg(power(%s - y, 2))')} SELECT candidate_id, {oracle.relative('loss')} AS loss FROM scored")
def expression_losses_l2(spark, sf_dir):
    return metrics.losses(signals(spark, sf_dir), dict(enumerate(ENUMERATED)), kind="l2").select("candidate_id", relative("loss").alias("loss"))


_NULL = lambda x: "NULL" if x is None else str(x)


@_query("expression_check", oracle.signals() + " " + " UNION ALL ".join(
    f"SELECT {k} AS candidate_id, '{text}' AS expression, {valid} AS is_valid, {within} AS within_limits, {_NULL(cost)}::INT AS complexity, {_NULL(deep)}::INT AS depth, {_NULL(names)}::INT AS n_features, {_NULL(ops)}::INT AS n_operators, "
    + (oracle.relative(f"avg(abs({value} - y))") + " AS loss FROM sig" if value else "NULL::DOUBLE AS loss") for k, (text, valid, within, cost, deep, names, ops, value) in enumerate(oracle.CHECKED)
))
def expression_check(spark, sf_dir):
    """Texts of all kinds: which are expressions, within the limits, what they cost, and the loss of those that may be scored."""
    table = expressions.candidate_table(spark, [c[0] for c in oracle.CHECKED])
    fit = {r["candidate_id"]: r["expression"] for r in table.where("within_limits").collect()}  # a list of ten texts
    scored = metrics.losses(signals(spark, sf_dir), fit).select("candidate_id", relative("loss").alias("loss"))
    return table.drop("features").join(scored, "candidate_id", "left")


@_query("expression_best", f"{oracle.scored()} SELECT candidate_id, expression, row_number() OVER (ORDER BY loss, candidate_id)::INT AS rank FROM scored ORDER BY loss, candidate_id LIMIT 5")
def expression_best(spark, sf_dir):
    return metrics.best(scores(spark, sf_dir), 5).select("candidate_id", "expression", "rank")


@_query("expression_pareto", f"{oracle.scored()}, m AS (SELECT complexity, min(loss) AS loss FROM scored GROUP BY complexity), f AS (SELECT *, min(loss) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM m) SELECT candidate_id, expression, complexity FROM scored JOIN f USING (complexity, loss) WHERE earlier IS NULL OR loss < earlier")
def expression_pareto(spark, sf_dir):
    return metrics.pareto_front(scores(spark, sf_dir)).select("candidate_id", "expression", "complexity")


@_query("expression_compare", oracle.signals() + ", s AS (" + " UNION ALL ".join(
    f"SELECT {k} AS id, '{EXPRESSIONS[k]}' AS expression, {names!r} AS features, {cost} AS complexity, avg(abs({oracle.ALPHAS[k]} - y)) AS loss FROM sig" for k, (names, cost) in oracle.COMPARED.items()
) + f""") SELECT l.id AS left_id, r.id AS right_id, l.expression = r.expression AS same_text, l.features = r.features AS same_features, l.complexity - r.complexity AS complexity_diff, {oracle.relative('(l.loss - r.loss)')} AS loss_diff FROM s l JOIN s r ON l.id < r.id""")
def expression_compare(spark, sf_dir):
    table = expressions.candidate_table(spark, list(EXPRESSIONS.values()))
    scored = metrics.losses(signals(spark, sf_dir), EXPRESSIONS).select("candidate_id", "loss")
    return expressions.compare(table.join(scored, "candidate_id")).withColumn("loss_diff", relative("loss_diff"))


GRAMMAR = {"nd20": ("normalized_deviation", 20), "nd5": ("normalized_deviation", 5), "vol20": ("rolling_volatility", 20), "mom5": ("rolling_return", 5), "mom20": ("rolling_return", 20), "relvol5": ("relative_volume", 5)}
_TWO = lambda a, b: " UNION ALL ".join(f"SELECT '{op}[' || x.c || '|' || y.c || ']' AS c, x.k + y.k + {cost} AS k FROM {a} x JOIN {b} y ON {rule}" for op, cost, rule in (("+", 1, "x.c < y.c"), ("*", 1, "x.c <= y.c"), ("-", 1, "x.c <> y.c"), ("/", 2, "x.c <> y.c")))


@_query("expression_grammar", f"""WITH e0(c, k, l) AS (VALUES {', '.join(f"('{c}', 1, 0)" for c in GRAMMAR)}), b1 AS ({_TWO('e0', 'e0')}),
e1 AS (SELECT c, k, 1 AS l FROM b1 UNION ALL SELECT op || '(' || c || ')', k + 1, 1 FROM e0, (VALUES ('neg'), ('abs')) u(op)), h AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1),
b2 AS (SELECT * FROM ({_TWO('h', 'h').replace(' ON ', ' ON greatest(x.l, y.l) = 1 AND ')})),
u2 AS (SELECT 'neg(' || c || ')' AS c, k + 1 AS k FROM e1 WHERE c NOT LIKE 'neg(%' AND c NOT LIKE '-[%' UNION ALL
  SELECT DISTINCT CASE WHEN c LIKE '-[%' THEN 'abs(-[' || array_to_string(list_sort(string_split(c[3:-2], '|')), '|') || '])' ELSE 'abs(' || c || ')' END, k + 1 FROM e1 WHERE c NOT LIKE 'neg(%' AND c NOT LIKE 'abs(%'),
a AS (SELECT k, l FROM h UNION ALL SELECT k, 2 FROM b2 UNION ALL SELECT k, 2 FROM u2) SELECT l AS level, k::INT AS complexity, count(*) AS n_expressions, count(*) AS n_scored FROM a GROUP BY ALL""")
def expression_grammar(spark, sf_dir):
    """Two levels of the grammar over six features, each expression once, all of them scored in one scan; how many there are of each level and cost."""
    wide = compute_features(base_panel(spark, sf_dir), sorted({n for n, _ in GRAMMAR.values()}), (5, 20))
    named = wide.select("forward_return", *[F.col(f"{n}_w{w}").alias(c) for c, (n, w) in GRAMMAR.items()])
    scored = metrics.losses_of_grammar(named, expressions.grammar(spark, list(GRAMMAR)), list(GRAMMAR))
    return scored.groupBy("level", "complexity").agg(F.count(F.lit(1)).alias("n_expressions"), F.count("loss").alias("n_scored"))


# ---- metrics ----

for _method, _column in (("spearman", "ic"), ("pearson", "pearson")):
    @_query(f"metric_ic_{_method}", f"{oracle.metrics()} SELECT c AS candidate_id, {oracle.out(_column)} AS ic, n FROM ic")
    def _ic(spark, sf_dir, method=_method):
        return metrics.information_coefficient(values(spark, sf_dir), method).withColumn("ic", rounded("ic"))


@_query("metric_daily_ic", f"{oracle.metrics()} SELECT c AS candidate_id, date::VARCHAR AS date, {oracle.out('ic')} AS ic FROM dic WHERE ic IS NOT NULL")
def metric_daily_ic(spark, sf_dir):
    return day(metrics.daily_ic(values(spark, sf_dir))).withColumn("ic", rounded("ic"))


@_query("metric_ic_stability", f"{oracle.metrics()} SELECT c AS candidate_id, {oracle.out('ic_stability')} AS ic_stability FROM stab")
def metric_ic_stability(spark, sf_dir):
    return metrics.ic_stability(values(spark, sf_dir)).withColumn("ic_stability", rounded("ic_stability"))


@_query("metric_long_short", f"{oracle.metrics()} SELECT c AS candidate_id, date::VARCHAR AS date, {oracle.out('p')} AS p FROM daily")
def metric_long_short(spark, sf_dir):
    return day(metrics.long_short(values(spark, sf_dir))).withColumn("p", rounded("p"))


_PERFORMANCE = ("sharpe", "annual_return", "annual_volatility", "max_drawdown", "win_rate")


@_query("metric_performance", f"{oracle.metrics()} SELECT c AS candidate_id, {', '.join(f'{oracle.out(x)} AS {x}' for x in _PERFORMANCE)}, n_dates FROM perf")
def metric_performance(spark, sf_dir):
    return metrics.performance(metrics.long_short(values(spark, sf_dir))).withColumns({c: rounded(c) for c in _PERFORMANCE})


@_query("metric_turnover", f"{oracle.metrics()} SELECT c AS candidate_id, {oracle.out('turnover')} AS turnover FROM turn")
def metric_turnover(spark, sf_dir):
    return metrics.turnover(values(spark, sf_dir)).withColumn("turnover", rounded("turnover"))


_COMPLEXITY = {k: expressions.complexity(expressions.parse(e)) for k, e in EXPRESSIONS.items()}
_CX = f"cx(c, complexity) AS (VALUES {', '.join(f'({k}, {cost})' for k, (_, cost) in oracle.COMPARED.items())})"
_ALL = f"{oracle.metrics()}, {_CX}, a AS (SELECT * FROM ic JOIN stab USING (c) JOIN perf USING (c) JOIN turn USING (c) JOIN cx USING (c))"
_MEASURES = ("ic", "ic_stability", *_PERFORMANCE, "turnover")


def evaluated(spark, sf_dir) -> DataFrame:
    return metrics.evaluate(values(spark, sf_dir), _COMPLEXITY)


@_query("metric_all", f"{_ALL} SELECT c AS candidate_id, {', '.join(f'{oracle.out(x)} AS {x}' for x in _MEASURES)}, n AS n_observations, n_dates, complexity FROM a")
def metric_all(spark, sf_dir):
    return evaluated(spark, sf_dir).withColumns({c: rounded(c) for c in _MEASURES})


_PASS = "ic > 0.015 AS ic_ok, ic_stability > 0.55 AS stability_ok, sharpe > 0.3 AS sharpe_ok, turnover < 0.6 AS turnover_ok, complexity < 20 AS complexity_ok"


@_query("metric_filter", f"{_ALL} SELECT c AS candidate_id, {_PASS}, ic > 0.015 AND ic_stability > 0.55 AND sharpe > 0.3 AND turnover < 0.6 AND complexity < 20 AS passed FROM a")
def metric_filter(spark, sf_dir):
    flags = ("ic_ok", "stability_ok", "sharpe_ok", "turnover_ok", "complexity_ok", "passed")
    return metrics.passes(evaluated(spark, sf_dir)).select("candidate_id", *flags)


_RATIOS = "(0, 0.6::DOUBLE, 0.2::DOUBLE)"


_TEST_VALUES = f"{oracle.values('raw0')}, {_POINTS % _RATIOS}, raw AS (SELECT raw0.* FROM raw0 JOIN d USING (date) JOIN parts ON k BETWEEN a AND b WHERE split = 'test'), v AS (SELECT * FROM raw WHERE alpha IS NOT NULL AND y IS NOT NULL)"
#: Thresholds that some of the candidates meet and others don't.
_LENIENT = {"ic_stability": 0.5, "turnover": 0.975}


@_query("metric_out_of_sample", f"""{_TEST_VALUES}, {oracle.METRIC_PARTS}, {_CX}, a AS (SELECT * FROM ic JOIN stab USING (c) JOIN perf USING (c) JOIN turn USING (c) JOIN cx USING (c))
SELECT count(*) AS n_candidates, sum((ic > 0.015 AND ic_stability > 0.5 AND sharpe > 0.3 AND turnover < 0.975 AND complexity < 20)::INT)::BIGINT AS n_passed, sum((ic > 0)::INT)::BIGINT AS n_promoted, {oracle.out('max(ic)')} AS best_ic, {oracle.out('max(sharpe)')} AS best_sharpe FROM a""")
def metric_out_of_sample(spark, sf_dir):
    """The candidates on the test dates alone, which nothing before has seen."""
    wide = signals(spark, sf_dir)
    tested = metrics.evaluate_test(metrics.candidate_values(wide, EXPRESSIONS), split.split_by_ratio(wide), _COMPLEXITY, _LENIENT)
    return metrics.out_of_sample(tested).withColumns({"best_ic": rounded("best_ic"), "best_sharpe": rounded("best_sharpe")})


@_query("metric_align", f"{oracle.signals()} SELECT symbol, date::VARCHAR AS date, {oracle.out('nd20')} AS alpha, {oracle.out('y')} AS forward_return FROM sig WHERE nd20 IS NOT NULL AND y IS NOT NULL AND date >= DATE '1994-01-01'")
def metric_align(spark, sf_dir):
    """A signal and a target from different tables, on the keys that both have."""
    alpha = signals(spark, sf_dir).select("symbol", "date", F.col("nd20").alias("alpha"))
    target = base_panel(spark, sf_dir).where("date >= DATE '1994-01-01'").select("symbol", "date", "forward_return")
    return day(metrics.align(alpha, target)).select("symbol", "date", rounded("alpha").alias("alpha"), rounded("forward_return").alias("forward_return"))


@_query("metric_p_value", f"{oracle.metrics()}, p AS (SELECT c, n, ic AS r, abs(ic) * sqrt((n - 2) / (1 - ic * ic)) AS t FROM ic) SELECT c AS candidate_id, n AS n_observations, {oracle.out('r')} AS ic, {oracle.out(oracle.P_VALUE)} AS ic_p_value FROM p")
def metric_p_value(spark, sf_dir):
    ic = metrics.information_coefficient(values(spark, sf_dir)).withColumnRenamed("n", "n_observations")
    return metrics.with_p_value(ic).select("candidate_id", "n_observations", rounded("ic").alias("ic"), rounded("ic_p_value").alias("ic_p_value"))


@_query("metric_single_series", f"""{oracle.values()}, s AS (SELECT *, product(1 + y) OVER (PARTITION BY c, symbol ORDER BY date) AS cum FROM v), d AS (SELECT *, cum / max(cum) OVER (PARTITION BY c, symbol ORDER BY date) - 1 AS dd FROM s),
g AS (SELECT c, symbol, coalesce({oracle.agg_corr('alpha', 'y')}, 0) AS ic, avg(y) * 252 AS annual_return, stddev_samp(y) * sqrt(252) AS annual_volatility, min(dd) AS max_drawdown, avg((y > 0)::INT) AS win_rate, count(*) AS n_dates FROM d GROUP BY c, symbol)
SELECT c AS candidate_id, symbol, {oracle.out('ic')} AS ic, (ic > 0)::INT::DOUBLE AS ic_stability, {oracle.out('ic * sqrt(252)')} AS sharpe, {', '.join(f'{oracle.out(x)} AS {x}' for x in _PERFORMANCE[1:])}, n_dates FROM g""")
def metric_single_series(spark, sf_dir):
    return metrics.single_series(values(spark, sf_dir), ("symbol",)).withColumns({c: rounded(c) for c in ("ic", *_PERFORMANCE)})


# ---- policies ----

_CAND = f"{oracle.values()}, s0 AS (SELECT date, symbol, alpha, y, {oracle.avg_rank('alpha', 'date')} AS rho, count(*) OVER (PARTITION BY date) AS n FROM v WHERE c = 0)"


def candidate(spark, sf_dir) -> DataFrame:
    one = metrics.candidate_values(signals(spark, sf_dir), {0: EXPRESSIONS[0]})
    return metrics.complete(one).select("date", "symbol", "alpha", "forward_return")


def _quintile_sql(q: int, size: str) -> str:
    return f"CASE WHEN rho >= n - n // {q} AND n // {q} > 0 THEN {size} WHEN rho <= n // {q} AND n // {q} > 0 THEN -({size}) ELSE 0 END".replace("%k", f"(n // {q})")


_UNIT = "coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY date), 0), 0)"
_L, _S = "coalesce(sum(CASE WHEN w > 0 THEN w END) OVER (PARTITION BY date), 0)", "coalesce(sum(CASE WHEN w < 0 THEN -w END) OVER (PARTITION BY date), 0)"
_SIDES = f"CASE WHEN w > 0 THEN w / {_L} WHEN w < 0 THEN w / {_S} ELSE 0 END / CASE WHEN {_L} > 0 AND {_S} > 0 THEN {_L} + {_S} ELSE 1 END"
_Z = "coalesce(greatest(-2, least(2, (alpha - avg(alpha) OVER (PARTITION BY date)) / nullif(stddev_samp(alpha) OVER (PARTITION BY date), 0))), 0) * (count(*) OVER (PARTITION BY date) > 1)::INT"
_VAR = "CASE WHEN var_samp(alpha) OVER (PARTITION BY date) > 0 THEN var_samp(alpha) OVER (PARTITION BY date) ELSE 1 END"
_KELLY = lambda f: f"greatest(0, least(1, {f} * alpha / {_VAR}))"

POLICY_SQL = {
    "quintile": (_quintile_sql(5, "1.0 / %k"), _UNIT), "decile": (_quintile_sql(10, "1.0 / %k"), _UNIT), "tertile": (_quintile_sql(3, "1.0 / %k"), _UNIT),
    "threshold": ("CASE WHEN alpha < -0.5 THEN -1 WHEN alpha > 0.5 THEN 1 ELSE 0 END", _SIDES), "zscore": (_Z, _UNIT), "sign": ("sign(alpha)", _SIDES),
    "kelly": (_KELLY("1.0"), _SIDES), "half_kelly": (_KELLY("0.5"), _SIDES), "quarter_kelly": (_KELLY("0.25"), _SIDES),
}
for _name, (_w, _norm) in POLICY_SQL.items():
    @_query(f"policy_{_name}", f"{_CAND}, w0 AS (SELECT *, {_w} AS w FROM s0) SELECT symbol, date::VARCHAR AS date, {oracle.out(_norm)} AS weight FROM w0")
    def _policy(spark, sf_dir, name=_name):
        return day(policy.POLICIES[name](candidate(spark, sf_dir))).select("symbol", "date", rounded("weight").alias("weight"))


_PROP = _quintile_sql(5, "abs(alpha)")


@_query("policy_quintile_proportional", f"{_CAND}, w0 AS (SELECT *, {_PROP} AS w FROM s0) SELECT symbol, date::VARCHAR AS date, {oracle.out(_UNIT)} AS weight FROM w0")
def policy_quintile_proportional(spark, sf_dir):
    return day(policy.quintile(candidate(spark, sf_dir), proportional=True)).select("symbol", "date", rounded("weight").alias("weight"))


@_query("policy_capital", f"{_CAND}, w0 AS (SELECT *, {_KELLY('1.0')} AS w FROM s0), w1 AS (SELECT symbol, date, {_SIDES} AS x FROM w0) SELECT symbol, date::VARCHAR AS date, round(1000 * x / CASE WHEN sum(x) OVER (PARTITION BY date) <> 0 THEN abs(sum(x) OVER (PARTITION BY date)) ELSE 1 END, 4) + 0.0 AS position FROM w1")
def policy_capital(spark, sf_dir):
    return day(policy.apply_capital(policy.kelly(candidate(spark, sf_dir)), 1000.0)).select("symbol", "date", rounded("position", 4).alias("position"))


_GRIDS = {
    "quintile": ("VALUES (3), (5), (10)", "q", "CASE WHEN rho >= n - n // q AND n // q > 0 THEN 1.0 / (n // q) WHEN rho <= n // q AND n // q > 0 THEN -1.0 / (n // q) ELSE 0 END", _UNIT),
    "zscore": (
        "SELECT * FROM (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) a(clip), (VALUES (true), (false)) b(norm)", "clip, norm", _Z.replace("-2", "-clip").replace("(2,", "(clip,"), f"CASE WHEN norm THEN {_UNIT} ELSE w END",
    ),
    "threshold": (
        "SELECT lt, st, ls, ss FROM (VALUES (-1.0), (-0.5), (0.0), (0.5), (1.0)) a(lt), (VALUES (-1.0), (-0.5), (0.0), (0.5), (1.0)) b(st), (VALUES (0.5), (1.0), (1.5), (2.0)) c(ls), (VALUES (0.5), (1.0), (1.5), (2.0)) d(ss) WHERE lt >= st",
        "lt, st, ls, ss", "CASE WHEN alpha < st THEN -ss WHEN alpha > lt THEN ls ELSE 0 END::DOUBLE", _SIDES,
    ),
    "kelly": (
        "SELECT f, lo, hi FROM (VALUES (0.1), (0.25), (0.5), (0.75), (1.0)) a(f), (VALUES (0.0), (0.1), (0.2)) b(lo), (VALUES (0.5), (1.0), (1.5), (2.0)) c(hi)", "f, lo, hi",
        f"greatest(lo, least(hi, f * alpha / {_VAR}))::DOUBLE", _SIDES,
    ),
}
_NAMES = {
    "quintile": ("quantiles",), "zscore": ("clip", "normalize"), "threshold": ("long_threshold", "short_threshold", "long_size", "short_size"), "kelly": ("fraction", "low", "high"),
}


_VALIDATED = _CAND.replace("v WHERE c = 0", "v JOIN d USING (date) JOIN parts ON k BETWEEN a AND b WHERE c = 0 AND split = 'validation'").replace(", s0 AS", f", {_POINTS % _RATIOS}, s0 AS")


def _tuned_sql(name: str) -> str:
    rows, columns, w, norm = _GRIDS[name]
    own = columns.split(", ")
    part = "PARTITION BY " + columns + ", date"
    over = lambda s: s.replace("PARTITION BY date", part)
    names = ", ".join(f"{a}{'' if b == 'normalize' else '::INT' if b == 'quantiles' else '::DOUBLE'} AS {b}" for a, b in zip(own, _NAMES[name]))
    return f"""{_VALIDATED}, grid({columns}) AS ({rows}), g0 AS (SELECT s0.*, {columns}, {over(w)} AS w FROM s0, grid), g1 AS (SELECT {columns}, date, y, {over(norm)} AS weight FROM g0), g2 AS (SELECT {columns}, date, sum(weight * y) AS p FROM g1 GROUP BY {columns}, date)
SELECT {names}, {oracle.out('avg(CASE WHEN 1 + p > 0 THEN ln(1 + p) END) * 252', 5)} AS growth, {oracle.out('coalesce(CASE WHEN stddev_samp(p) > 0 THEN avg(p) * 252 / (stddev_samp(p) * sqrt(252)) END, 0)', 5)} AS sharpe, {oracle.out('avg(p)')} AS mean, {oracle.out('avg((p > 0)::INT)')} AS win_rate FROM g2 GROUP BY {columns}"""


for _name in _GRIDS:
    @_query(f"tune_{_name}", _tuned_sql(_name))
    def _tune(spark, sf_dir, name=_name):
        rows = candidate(spark, sf_dir)
        out = policy.tune(rows, name, split=split.split_by_ratio(base_panel(spark, sf_dir)))
        return out.select(*_NAMES[name], rounded("growth", 5).alias("growth"), rounded("sharpe", 5).alias("sharpe"), rounded("mean").alias("mean"), rounded("win_rate").alias("win_rate"))


# ---- backtest and runs ----

_BACK = f"{_CAND}, w0 AS (SELECT *, {_quintile_sql(5, '1.0 / %k').replace('WHEN rho >=', 'WHEN rho <= n // 5 AND n // 5 > 0 THEN -1.0 / (n // 5) WHEN rho >=')} AS w FROM s0), b AS (SELECT date, sum(w * y) AS p FROM w0 GROUP BY date), bc AS (SELECT *, product(1 + p) OVER (ORDER BY date) AS value FROM b), bd AS (SELECT *, value / max(value) OVER (ORDER BY date) - 1 AS dd FROM bc)"


@_query("backtest_returns", f"{_BACK} SELECT date::VARCHAR AS date, {oracle.out('p')} AS p, {oracle.out('log10(value)')} AS log_value FROM bc")
def backtest_returns(spark, sf_dir):
    return day(backtest.daily_returns(candidate(spark, sf_dir))).select("date", rounded("p").alias("p"), rounded(F.log10("value")).alias("log_value"))


_SUMMARY = ("total_return", "annual_return", "volatility", "sharpe", "max_drawdown")
_SUMMARY_SQL = f"""t AS (SELECT count(*) AS n_dates, arg_max(value, date) - 1 AS total_return, stddev_samp(p) * sqrt(252) AS volatility, min(dd) AS max_drawdown FROM bd), u AS (SELECT *, power(1 + total_return, 252.0 / n_dates) - 1 AS annual_return FROM t)
SELECT n_dates, {', '.join(f'{oracle.relative(x, 6)} AS {x}' for x in _SUMMARY if x != 'sharpe')}, {oracle.relative('(annual_return / volatility)', 6)} AS sharpe FROM u"""


@_query("backtest_summary", f"{_BACK}, {_SUMMARY_SQL}")
def backtest_summary(spark, sf_dir):
    return backtest.summary(backtest.daily_returns(candidate(spark, sf_dir))).withColumns({c: relative(c, 6) for c in _SUMMARY})


@_query("backtest_range", f"{_BACK.replace('WHERE c = 0', chr(87) + 'HERE c = 0 AND date BETWEEN DATE ' + repr('1994-06-01') + ' AND DATE ' + repr('1996-02-29'))}, {_SUMMARY_SQL}")
def backtest_range(spark, sf_dir):
    """A backtest over some of the dates."""
    return backtest.summary(backtest.daily_returns(candidate(spark, sf_dir), "1994-06-01", "1996-02-29")).withColumns({c: relative(c, 6) for c in _SUMMARY})


@_query("trading_rule", f"""{_ALL}, s1 AS (SELECT v.c, date, symbol, {oracle.avg_rank('alpha', 'v.c, date')} AS rho, count(*) OVER (PARTITION BY v.c, date) AS n FROM v JOIN a USING (c) WHERE ic > 0.015 AND ic_stability > 0.5 AND sharpe > 0.3 AND turnover < 0.975 AND complexity < 20),
w1 AS (SELECT *, {_quintile_sql(5, '1.0 / %k')} AS w FROM s1) SELECT c AS candidate_id, symbol, date::VARCHAR AS date, {oracle.out(_UNIT.replace('PARTITION BY date', 'PARTITION BY c, date'))} AS weight FROM w1""")
def trading_rule(spark, sf_dir):
    """Weights of the candidates that pass, none of those that don't."""
    v = metrics.complete(values(spark, sf_dir))
    passed = metrics.passes(metrics.evaluate(v, _COMPLEXITY), _LENIENT)
    return day(backtest.trading_rule(v, passed)).select("candidate_id", "symbol", "date", rounded("weight").alias("weight"))


def runs(spark, sf_dir) -> DataFrame:
    """One run a split of the sweep: correlations of the candidates on the test dates."""
    tested = split.ratio_sweep(values(spark, sf_dir)).where("split = 'test'").withColumn("candidate_id", F.col("split_id") * 100 + F.col("candidate_id"))
    ic = metrics.information_coefficient(tested, "pearson")
    return ic.select(F.concat(F.lit("run"), F.floor(F.col("candidate_id") / 100).cast("string")).alias("run_id"), (F.col("candidate_id") % 100).alias("candidate_id"), "ic", (F.col("ic") > 0.015).alias("passed"))


_RUNS = f"{oracle.values()}, {_POINTS.replace('FROM panel', 'FROM raw') % ', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b, _) in enumerate(split.SWEEP))}, r AS (SELECT 'run' || split_id AS run_id, c AS candidate_id, coalesce({oracle.agg_corr('alpha', 'y')}, 0) AS ic FROM v JOIN d USING (date) JOIN parts ON k BETWEEN a AND b WHERE split = 'test' GROUP BY ALL)"


@_query("runs_aggregate", f"{_RUNS}, p AS (SELECT run_id, count(*) AS n, sum((ic > 0.015)::INT) AS np FROM r GROUP BY run_id) SELECT (SELECT count(*) FROM p) AS n_runs, count(*) AS n_candidates, (SELECT sum(np) FROM p)::BIGINT AS n_passed, (SELECT round(avg(np), 6) FROM p) AS mean_passed, {oracle.out('max(ic)')} AS best_ic, arg_max(run_id, row(ic, run_id, candidate_id)) AS best_run, arg_max(candidate_id, row(ic, run_id, candidate_id)) AS best_candidate FROM r")
def runs_aggregate(spark, sf_dir):
    return backtest.aggregate_runs(runs(spark, sf_dir)).withColumns({"mean_passed": rounded("mean_passed"), "best_ic": rounded("best_ic")})


@_query("runs_compare", f"{_RUNS} SELECT run_id, count(*) AS n_candidates, sum((ic > 0.015)::INT)::BIGINT AS n_passed, {oracle.out('max(ic)')} AS best_ic, {oracle.out('avg(ic)')} AS mean_ic FROM r GROUP BY run_id")
def runs_compare(spark, sf_dir):
    return backtest.compare_runs(runs(spark, sf_dir)).withColumns({"best_ic": rounded("best_ic"), "mean_ic": rounded("mean_ic")})


@_query("recovery", f"{oracle.values()}, k AS (SELECT a.c, a.alpha, b.alpha AS y FROM v a JOIN v b USING (date, symbol) WHERE a.c > 0 AND b.c = 0), p AS (SELECT c, {oracle.avg_rank('alpha', 'c')} AS ra, {oracle.avg_rank('y', 'c')} AS ry, alpha, y FROM k), q AS (SELECT c, {oracle.agg_corr('alpha', 'y')} AS correlation, {oracle.agg_corr('ra', 'ry')} AS ic FROM p GROUP BY c) SELECT c AS candidate_id, {oracle.out('correlation')} AS correlation, {oracle.out('ic')} AS ic, abs(correlation) > 0.7 AS is_recovered, ic > 0.05 AS has_signal FROM q")
def recovery(spark, sf_dir):
    v = metrics.complete(values(spark, sf_dir))
    known = v.where("candidate_id = 0").select("date", "symbol", F.col("alpha").alias("known"))
    both = v.where("candidate_id > 0").drop("forward_return").join(known, ["date", "symbol"]).withColumnRenamed("known", "forward_return")
    return backtest.recovery(both).withColumns({"correlation": rounded("correlation"), "ic": rounded("ic")})


def _swept() -> list[tuple[str, str, int]]:
    """Features of all sets of the sweep: name, column and digits."""
    names = [f.name for f in REGISTRY.values() if f.name in {n for run in _SETS for n in backtest.feature_set(run)} and f.name in oracle.FEATURES]
    return [(n, "ewm_volatility_h10" if n == "ewm_volatility" else column_name(REGISTRY[n], 20), oracle.FEATURES[n][1]) for n in names]


_SETS = (1, 2, 3, 4)
_SWEPT = _swept()
_SWEEP_COLUMNS = ("ic", "ic_stability", *_PERFORMANCE, "turnover")


@_query("feature_set_sweep", "WITH wide AS MATERIALIZED (SELECT * FROM " + " JOIN ".join(f"({oracle.feature(n, (20,), REGISTRY[n].windowed)}) s{k}" + (" USING (symbol, date)" if k else "") for k, (n, _, _) in enumerate(_SWEPT)) + f""" JOIN (WITH {oracle.returns()} SELECT symbol, date::VARCHAR AS date, forward_return AS y FROM panel) USING (symbol, date)),
{_POINTS.replace('FROM panel', 'FROM wide') % ', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b, _) in enumerate(split.SWEEP))},
long AS (""" + " UNION ALL ".join(f"SELECT {k} AS f, date, symbol, {c} AS alpha, y FROM wide" for k, (_, c, _) in enumerate(_SWEPT)) + f"""),
v AS (SELECT split_id * 1000 + f AS c, date, symbol, alpha, y FROM long JOIN d USING (date) JOIN parts ON k BETWEEN a AND b WHERE split = 'test' AND alpha IS NOT NULL AND y IS NOT NULL), {oracle.METRIC_PARTS},
names(f, feature) AS (VALUES {', '.join(f"({k}, '{c}')" for k, (_, c, _) in enumerate(_SWEPT))}),
sets(run_id, f) AS (VALUES {', '.join(f"('run{run}', {k})" for run in _SETS for k, (n, _, _) in enumerate(_SWEPT) if n in backtest.feature_set(run))})
SELECT run_id, c // 1000 AS split_id, feature, {', '.join(f'round(coalesce({x}, 0), 5) + 0.0 AS {x}' for x in _SWEEP_COLUMNS)}, n AS n_observations
FROM ic LEFT JOIN stab USING (c) LEFT JOIN perf USING (c) LEFT JOIN turn USING (c) JOIN names ON f = c % 1000 JOIN sets USING (f)""")
def feature_set_sweep(spark, sf_dir):
    """Four feature sets on five splits: each feature, rounded, as a signal of its own on the test dates."""
    wide = compute_features(base_panel(spark, sf_dir), [n for n, _, _ in _SWEPT], (20,))
    values_of = wide.select("symbol", "date", "forward_return", *[rounded(F.col(c).cast("double"), digits).alias(c) for _, c, digits in _SWEPT])
    v = materialize(metrics.candidate_values(values_of, {k: c for k, (_, c, _) in enumerate(_SWEPT)}), "swept")
    sets = [(f"run{run}", k, c) for run in _SETS for k, (n, c, _) in enumerate(_SWEPT) if n in backtest.feature_set(run)]
    runs_of = spark.createDataFrame(sets, "run_id string, candidate_id int, feature string")
    scored = backtest.sweep(v, runs_of.select("run_id", "candidate_id"))
    names = runs_of.select("candidate_id", "feature").distinct()
    return scored.join(names, "candidate_id").select("run_id", "split_id", "feature", *[rounded(c, 5).alias(c) for c in _SWEEP_COLUMNS], "n_observations")


# ---- whole workloads ----


@_query("reversal_question", f"""WITH {oracle.returns('weekly_nation')}, {oracle.BASE}, s AS (SELECT symbol, date, y, {oracle.gate(oracle.FEATURES['normalized_deviation'][0](20), 20)} AS x FROM base), rr AS (SELECT symbol, date, y, -({_SQL_RANK('x')}) AS alpha FROM s),
raw AS (SELECT 0 AS c, * FROM rr), v AS (SELECT * FROM raw WHERE alpha IS NOT NULL AND y IS NOT NULL), {oracle.METRIC_PARTS}
SELECT c AS candidate_id, {oracle.out('ic_stability')} AS ic_stability, {', '.join(f'{oracle.out(x)} AS {x}' for x in _PERFORMANCE)}, n_dates FROM stab JOIN perf USING (c)""")
def reversal_question(spark, sf_dir):
    """Does a fall over 20 rows foretell a rise? Bars, returns, one feature, ranks per date, an expression, and its metrics."""
    wide = compute_features(panel.preprocess(bars.weekly_nation(spark, sf_dir)), ["normalized_deviation"], (20,))
    ranked = normalize.rank_normalize(wide.select("symbol", "date", "forward_return", "normalized_deviation_w20"), ["normalized_deviation_w20"], prefix="rank_")
    v = metrics.candidate_values(ranked, {0: "neg(rank_normalized_deviation_w20)"})
    daily = metrics.performance(metrics.long_short(v))
    return metrics.ic_stability(v).join(daily, "candidate_id").withColumns({c: rounded(c) for c in ("ic_stability", *_PERFORMANCE)})
