"""Readers of OHLCV bars, bars from ticks, and the store for run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

MEASURES = ("open", "high", "low", "close", "volume")
SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in MEASURES]
)


def check_columns(df: DataFrame, required: tuple[str, ...] = MEASURES) -> list[str]:
    """The required columns that are missing, whatever the case of the names."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c not in have]


def _standard(df: DataFrame, symbol: str | None) -> DataFrame:
    """Lower-case names, a symbol from the argument, the column or the file name, NULL for NaN."""
    df = df.toDF(*[c.lower() for c in df.columns])
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]+)?$", 1)
    choices = [F.lit(symbol)] if symbol is not None else []
    if "symbol" in df.columns:
        choices.append(F.col("symbol"))
    df = df.withColumn("symbol", F.coalesce(*choices, stem))
    for c in (c for c in MEASURES if c in df.columns):
        x = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(~F.isnan(x), x))
    return df.withColumn("date", F.col("date").try_cast("date")) if dict(df.dtypes).get("date") == "string" else df


#: Holds a CSV line that has too few or too many fields; NULL for good lines.
CORRUPT = "_corrupt_record"


def _csv(reader: DataFrameReader, path: str) -> DataFrame:
    """Text columns by the header's names (the first lines alone are read for them), and CORRUPT."""
    names = reader.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, CORRUPT)])
    return reader.schema(schema).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)


#: Columns without which a file is refused.
REQUIRED = ("date", *MEASURES)


def _refuse(df: DataFrame, path: str) -> DataFrame:
    missing = check_columns(df, REQUIRED)
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of a CSV file, or of all files of a folder with the same header, in one read; what is no number or date becomes NULL, and a file without a required column is refused."""
    return _standard(_refuse(_csv(spark.read, path), path), symbol)


def read_parquet(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """As ``read_csv``, of Parquet files."""
    return _standard(_refuse(spark.read.parquet(path), path), symbol)


def read_directory(spark: SparkSession, path: str, pattern: str = "*.csv", file_type: str = "csv") -> DataFrame:
    """All files of a folder that match, in one read; unreadable files are skipped, a missing folder or unknown type raises.

    Bad lines of CSV files stay, with their text in CORRUPT; ``bad_lines`` reports them by file.
    """
    if file_type not in ("csv", "parquet"):
        raise ValueError(f"unknown file type: {file_type}")
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    return _standard(_refuse(_csv(reader, path) if file_type == "csv" else reader.parquet(path), path), None)


def _listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, n_bytes) of a folder's files, empty ones included, which no reader gives; a list as Spark's own, made on the driver."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in found if f.isFile()], "file string, n_bytes long")


def file_report(spark: SparkSession, path: str, pattern: str = "*.csv", file_type: str = "csv", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(file, n_bytes, n_rows, n_bad, missing, status) of every file of a folder that matches.

    Files are listed with their sizes alone, and compared with the files that rows were read from. ``status`` is ``ok``,
    ``partial`` (some lines could not be read), ``no rows`` (not one could), ``empty``, or ``refused`` (``missing`` names the
    required columns that it lacks; for CSV files by each file's own first line, for Parquet files by the values that it gave).
    """
    listed = _listing(spark, path, pattern)
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    if file_type == "csv":
        # each file's own header, whatever the others' are; a line is good if it has as many fields
        lines = reader.text(path).where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value")
        fields = F.size(F.split("value", ","))
        heads = lines.groupBy("file").agg(F.min_by("value", F.struct("at", "k")).alias("head"), F.count(F.lit(1)).alias("n"))
        counts = lines.groupBy("file", fields.alias("width")).agg(F.count(F.lit(1)).alias("n_width"))
        good = heads.join(counts, (heads["file"] == counts["file"]) & (F.size(F.split("head", ",")) == counts["width"]), "left").select(heads["file"], "head", (F.col("n") - 1).alias("n_rows"), (F.col("n") - F.coalesce("n_width", F.lit(0))).alias("n_bad"))
        have = F.transform(F.split(F.lower("head"), ","), lambda x: F.regexp_replace(F.trim(x), '"', ""))
        found = good.select("file", "n_rows", "n_bad", F.array_join(F.array_except(F.array(*[F.lit(c) for c in required]), have), ", ").alias("missing"))
    elif file_type == "parquet":
        df = reader.option("mergeSchema", True).parquet(path)
        df = df.select(*[F.col(c).alias(c.lower()) for c in df.columns], F.col("_metadata.file_name").alias("_file"))
        lacking = [F.when((F.count(c) if c in df.columns else F.lit(0)) == 0, F.lit(c)) for c in required]
        found = df.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("long").alias("n_bad"), F.array_join(F.array_compact(F.array(*lacking)), ", ").alias("missing"))
    else:
        raise ValueError(f"unknown file type: {file_type}")
    n_rows, n_bad = F.coalesce("n_rows", F.lit(0).cast("long")), F.coalesce("n_bad", F.lit(0).cast("long"))
    status = (
        F.when(F.col("n_bytes") == 0, "empty").when(F.coalesce(F.length("missing") > 0, F.lit(False)), "refused").when(n_rows == n_bad, "no rows").when(n_bad > 0, "partial").otherwise("ok")
    )
    return listed.join(found, "file", "left").select("file", "n_bytes", n_rows.alias("n_rows"), n_bad.alias("n_bad"), F.coalesce("missing", F.lit("")).alias("missing"), status.alias("status"))


def bad_lines(bars: DataFrame) -> DataFrame:
    """(symbol, n_rows, n_bad, n_closes): how many lines of each symbol (a file's name, where files name it) could not be read, and how many have a close."""
    bad = F.sum(F.col(CORRUPT).isNotNull().cast("long")) if CORRUPT in bars.columns else F.lit(0).cast("long")
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_bad"), F.count("close").alias("n_closes"))


def bars_from_ticks(ticks: DataFrame, order: Column) -> DataFrame:
    """OHLCV bars from (symbol, date, px, qty) rows; ``order`` gives the first and last price of a bar."""
    return (
        ticks.withColumn("_k", order).groupBy("symbol", "date")
        .agg(F.min_by("px", "_k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "_k").alias("close"), F.sum("qty").alias("volume"))
    )


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def daily_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of part brands, from line items."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    ticks = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (100 + F.col("l_extendedprice").cast("double") / 10000).alias("px"),
        F.col("l_quantity").cast("double").alias("qty"), *_ORDER,
    )
    return bars_from_ticks(ticks, F.struct(*_ORDER))


def weekly_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of suppliers' nations, from line items."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    ticks = (
        lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("symbol"), F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("date"),
            (100 + F.col("l_extendedprice").cast("double") / 10000).alias("px"), F.col("l_quantity").cast("double").alias("qty"), *_ORDER,
        )
    )
    return bars_from_ticks(ticks, F.struct(*_ORDER))


def save_results(df: DataFrame, path: str, run_id: str, file_type: str = "parquet") -> None:
    """Keep a run's results under its id, beside those of other runs; a run saved again is replaced."""
    if file_type not in ("json", "parquet"):
        raise ValueError(f"unknown file type: {file_type}")
    writer = df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    getattr(writer, file_type)(path)


def load_results(spark: SparkSession, path: str, file_type: str = "parquet") -> DataFrame:
    return getattr(spark.read, file_type)(path)
