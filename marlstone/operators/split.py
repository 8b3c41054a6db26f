"""Time splits, on distinct dates: no date is ever cut in two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class TimeSplit:
    train_start: object
    train_end: object
    validation_start: object
    validation_end: object
    test_start: object
    test_end: object

    def __post_init__(self):
        if not self.train_start <= self.train_end < self.validation_start <= self.validation_end < self.test_start <= self.test_end:
            raise ValueError("the parts of a split must follow each other")


def _numbered(panel: DataFrame) -> DataFrame:
    """(date, k, n): distinct dates in order; one row a date, so that one task can number them."""
    dates = panel.select("date").distinct()
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def split_points(ratios: DataFrame, panel: DataFrame, min_samples: int = 100) -> DataFrame:
    """For rows (split_id, train, validation) of ``ratios``: the six dates of each split."""
    dates = _numbered(panel)
    n = dates.agg(F.max("n").alias("n"))
    i = F.greatest((F.col("n") * F.col("train")).cast("int"), F.lit(min_samples))
    cuts = ratios.join(F.broadcast(n), how="inner").withColumn("i", i)
    cuts = cuts.withColumn("j", F.least(F.greatest((F.col("n") * (F.col("train") + F.col("validation"))).cast("int"), F.col("i") + min_samples), F.col("n") - min_samples))
    ends = F.array(F.lit(0), F.col("i") - 1, F.col("i"), F.col("j") - 1, F.col("j"), F.col("n") - 1)
    names = ("train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end")
    at = cuts.select("split_id", F.posexplode(ends).alias("part", "k")).join(dates.select("k", "date"), "k")
    return at.groupBy("split_id").agg(*[F.max(F.when(F.col("part") == p, F.col("date"))).alias(name) for p, name in enumerate(names)])


def split_by_ratio(panel: DataFrame, train: float = 0.6, validation: float = 0.2, min_samples: int = 100) -> TimeSplit:
    ratios = panel.sparkSession.createDataFrame([(0, float(train), float(validation))], "split_id int, train double, validation double")
    return TimeSplit(*split_points(ratios, panel, min_samples).first()[1:])


def split_by_dates(panel: DataFrame, train_end, validation_end) -> TimeSplit:
    """Each given date stands for the first date of the panel that is not before it."""
    dates = panel.select("date").distinct()
    at = lambda d: F.min(F.when(F.col("date") >= F.lit(d).cast("date"), F.col("date")))
    ends = dates.agg(F.min("date"), at(train_end), at(validation_end), F.max("date")).first()
    after = lambda d: F.min(F.when(F.col("date") > F.lit(d), F.col("date")))
    starts = dates.agg(after(ends[1]), after(ends[2])).first()
    return TimeSplit(ends[0], ends[1], starts[0], ends[2], starts[1], ends[3])


def label(panel: DataFrame, split: TimeSplit) -> DataFrame:
    """The panel with a ``split`` column: train, validation, test, or NULL before the start."""
    d = F.col("date")
    name = F.when(d < F.lit(split.train_start), None).when(d <= F.lit(split.train_end), "train").when(d <= F.lit(split.validation_end), "validation").when(d <= F.lit(split.test_end), "test")
    return panel.withColumn("split", name)


def in_part(panel: DataFrame, split: TimeSplit, part: str) -> DataFrame:
    """The rows of one part (train, validation or test), by a range of dates that reaches a Parquet scan."""
    if part not in ("train", "validation", "test"):
        raise ValueError(f"unknown part: {part}")
    return panel.where(F.col("date").between(F.lit(getattr(split, f"{part}_start")), F.lit(getattr(split, f"{part}_end"))))


def split_frames(panel: DataFrame, split: TimeSplit) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames by ranges of the date, which reach a Parquet scan as filters."""
    return in_part(panel, split, "train"), in_part(panel, split, "validation"), in_part(panel, split, "test")


def train_test(panel: DataFrame, test_ratio: float = 0.2) -> DataFrame:
    """``is_train`` for the first int(n (1 - test_ratio)) rows by (date, symbol).

    A row's number is the count of rows on earlier dates plus its number within its date, so that
    no task has to sort the panel.
    """
    counts = panel.groupBy("date").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(
        "date", F.coalesce(F.sum("c").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("c").over(Window.partitionBy()).alias("_n")
    )
    number = F.col("_before") + F.row_number().over(Window.partitionBy("date").orderBy("symbol"))
    out = panel.join(before, "date").withColumn("is_train", number <= (F.col("_n") * (1 - test_ratio)).cast("long"))
    return out.drop("_before", "_n")


#: The ratios (train, validation, test) of the sweep.
SWEEP = ((0.5, 0.25, 0.25), (0.6, 0.2, 0.2), (0.7, 0.15, 0.15), (0.55, 0.2, 0.25), (0.65, 0.2, 0.15))


def ratio_sweep(panel: DataFrame, ratios: tuple = SWEEP, min_samples: int = 100) -> DataFrame:
    """(split_id, split, symbol, date, ...): the panel once for each split, by a range join with the small table of parts."""
    table = panel.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b, _) in enumerate(ratios)], "split_id int, train double, validation double")
    points = split_points(table, panel, min_samples)
    parts = points.select("split_id", F.explode(F.array(*[F.struct(F.lit(p).alias("split"), F.col(f"{p}_start").alias("a"), F.col(f"{p}_end").alias("b")) for p in ("train", "validation", "test")])).alias("x"))
    parts = parts.select("split_id", "x.split", "x.a", "x.b")
    return panel.join(F.broadcast(parts), (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("b"))).drop("a", "b")  # three rows a split
