"""Placement of values on another calendar: each row takes what was last known at its date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marlstone.functions import scan


def as_of(left: DataFrame, right: DataFrame, columns: list[str] | None = None, tolerance_days: int | None = None, strict: bool = False, by: str = "symbol", on: str = "date", chunk_rows: int | None = None) -> DataFrame:
    """All rows of ``left``, with ``columns`` of the last row of ``right`` of the same ``by`` at or before its date, and that row's date as ``as_of``.

    ``strict`` leaves out the same date; a row of ``right`` older than ``tolerance_days`` counts as none. Of several rows of
    one key and date the one with the largest values counts. Both sides are put together and sorted once, with no join of
    rows with rows; where a key has more rows than a task should hold, the last row is carried from piece to piece.
    """
    columns = columns or [c for c in right.columns if c not in (by, on)]
    known = F.struct(F.col(on).alias("_at"), *[F.col(c) for c in columns])
    kind = right.select(known.alias("_known")).schema["_known"].dataType
    rows = left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(kind).alias("_known"))
    news = right.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), known.alias("_known"))
    # what comes first at one date
    turn = (F.col("_known").isNotNull() if strict else F.col("_row").isNotNull()).cast("int")
    both = rows.unionByName(news).where("_on IS NOT NULL OR _row IS NOT NULL").withColumn("_order", F.struct("_on", turn.alias("_turn"), "_known"))
    if chunk_rows is None:
        chunk_rows = scan.CHUNK_ROWS if scan.is_long(both, "_by") else 0
    if chunk_rows:
        placed = scan.running(both, [scan.Running("_last", "last", F.col("_known"))], "_by", "_order")
    else:
        so_far = Window.partitionBy("_by").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        placed = both.withColumn("_last", F.last("_known", ignorenulls=True).over(so_far))
    placed = placed.where("_row IS NOT NULL")
    fresh = F.col("_last").isNotNull()
    if tolerance_days is not None:
        fresh = fresh & (F.datediff(F.col(f"_row.{on}"), F.col("_last._at")) <= tolerance_days)
    return placed.select("_row.*", *[F.when(fresh, F.col(f"_last.{c}")).alias(c) for c in columns], F.when(fresh, F.col("_last._at")).alias("as_of"))
