"""Long series in pieces: exact row windows and running values, with no task that holds a whole series.

A frame is range-partitioned by (key, order) and written, so that a long series
lies in several pieces, one after the other. Whatever depends on all earlier
rows is put together in two steps: a summary of each (key, piece), one small
scan over the summaries of a key, and its result carried into the pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlstone.storage import materialize

CHUNK_ROWS = 1_000_000
#: Inputs below this size are not looked at for long series: one task holds them.
SMALL_BYTES = 256 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of all that ``df`` reads, by the optimiser's statistics of its leaves; no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def is_long(df: DataFrame, key: str = "symbol", chunk_rows: int = CHUNK_ROWS) -> bool:
    """Whether any key has more than ``chunk_rows`` rows; one count by key, which small inputs are spared."""
    if input_bytes(df) < SMALL_BYTES:
        return False
    most = df.groupBy(key).count().agg(F.max("count")).first()[0]
    return (most or 0) > chunk_rows


def by_key(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows dealt out by key to as many tasks as shuffles have.

    Windows cost far more than their rows' size suggests, by which adaptive execution would put them into few
    tasks; it leaves an exchange of a given number alone, and what comes after on the same key needs no other.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pieces(df: DataFrame, key: str = "symbol", order: str = "date", partitions: int | None = None) -> DataFrame:
    """``df`` with ``_piece``, written: rows of a key are in pieces that follow each other in the order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, key, order).withColumn("_piece", F.spark_partition_id()), "pieces")


def _within(key: str, order: str):
    return Window.partitionBy(key, "_piece").orderBy(order)


def _earlier(key: str):
    return Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece


def number(cut: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """What ``pieces`` gives, with ``_rn``: the number of a row within its key, from 0 on."""
    sizes = cut.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(key, "_piece", F.coalesce(F.sum("_size").over(_earlier(key)), F.lit(0)).alias("_before"))
    place = F.row_number().over(_within(key, order)) - 1
    return cut.join(before, [key, "_piece"]).withColumn("_rn", F.col("_before") + place).drop("_before")


def in_chunks(df: DataFrame, fn: Callable[[DataFrame], DataFrame], before: int, after: int = 0, chunk_rows: int = CHUNK_ROWS, key: str = "symbol", order: str = "date") -> DataFrame:
    """``fn(df)`` for functions whose rows depend on ``before`` rows before them and ``after`` rows after them at most.

    Rows are dealt out in chunks of ``chunk_rows`` consecutive rows of a key,
    with copies of the neighbouring rows; ``fn`` sees each chunk under a key of
    its own (in the column ``key``) and must keep all columns. Only a chunk's own rows are returned.
    """
    chunk_rows = max(chunk_rows, before, after, 1)
    own, place = F.floor(F.col("_rn") / chunk_rows), F.pmod("_rn", F.lit(chunk_rows))
    copies = [own]
    if before:
        copies.append(F.when(place >= chunk_rows - before, own + 1))
    if after:
        copies.append(F.when((place < after) & (own > 0), own - 1))
    rows = number(pieces(df, key, order), key, order).drop("_piece")
    dealt = rows.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies)))).withColumn("_key", F.col(key))
    out = fn(dealt.withColumn(key, F.concat_ws(":", F.col("_chunk").cast("string"), F.col("_key").cast("string"))))
    return out.where(own == F.col("_chunk")).withColumn(key, F.col("_key")).drop("_rn", "_chunk", "_key")


@dataclass(frozen=True)
class Running:
    """A running value ``name`` of ``value``: sum, count, min, max, product, last or next (value that is not NULL), or peak (largest running product so far)."""

    name: str
    kind: str
    value: Column


def _combine_peak(carried: Column, product: Column, high: Column, low: Column) -> Column:
    return F.greatest(carried, F.when(product >= 0, product * high).otherwise(product * low))


def running(df: DataFrame, values: list[Running], key: str = "symbol", order: str = "date", partitions: int | None = None) -> DataFrame:
    """``df`` with a column for each running value, the current row included; NULLs are passed over.

    The same as a window from the first row of each key to the current one (for
    ``next``: from the current one to the last), for keys of any length.
    """
    columns = df.columns
    df = df.withColumns({f"_v{k}": v.value for k, v in enumerate(values)})
    cut = pieces(df, key, order, partitions)
    so_far = _within(key, order).rowsBetween(Window.unboundedPreceding, 0)
    to_come = _within(key, order).rowsBetween(0, Window.unboundedFollowing)
    local: dict[str, Column] = {}
    for k, v in enumerate(values):
        x = F.col(f"_v{k}")
        if v.kind in ("product", "peak"):
            local[f"_l{k}"] = F.product(x).over(so_far)
        elif v.kind in ("last", "next"):
            local[f"_l{k}"] = F.last(x, ignorenulls=True).over(so_far) if v.kind == "last" else F.first(x, ignorenulls=True).over(to_come)
        else:
            local[f"_l{k}"] = getattr(F, v.kind)(x).over(so_far)
    inside = cut.withColumns(local)
    peaks = {f"_{side}{k}": fn(f"_l{k}").over(so_far) for k, v in enumerate(values) if v.kind == "peak" for side, fn in (("high", F.max), ("low", F.min))}
    if peaks:
        inside = inside.withColumns(peaks)
    summary: list[Column] = []
    for k, v in enumerate(values):
        x = F.col(f"_v{k}")
        if v.kind in ("last", "next"):
            pick = F.max_by if v.kind == "last" else F.min_by
            summary.append(pick(x, F.when(x.isNotNull(), F.col(order))).alias(f"_s{k}"))
        elif v.kind in ("product", "peak"):
            summary.append(F.product(x).alias(f"_s{k}"))
        else:
            summary.append(getattr(F, v.kind)(x).alias(f"_s{k}"))
    totals = cut.groupBy(key, "_piece").agg(*summary)
    if peaks:
        totals = totals.join(inside.groupBy(key, "_piece").agg(*[F.max(c).alias(c) if "high" in c else F.min(c).alias(c) for c in peaks]), [key, "_piece"])
    earlier = _earlier(key)
    later = Window.partitionBy(key).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    carries: dict[str, Column] = {}
    for k, v in enumerate(values):
        s = F.col(f"_s{k}")
        if v.kind == "last":
            carries[f"_c{k}"] = F.last(s, ignorenulls=True).over(earlier)
        elif v.kind == "next":
            carries[f"_c{k}"] = F.first(s, ignorenulls=True).over(later)
        elif v.kind in ("product", "peak"):
            carries[f"_c{k}"] = F.product(s).over(earlier)
        else:
            carries[f"_c{k}"] = F.sum(s).over(earlier) if v.kind in ("sum", "count") else getattr(F, v.kind)(s).over(earlier)
    carried = totals.withColumns(carries)
    for k, v in enumerate(values):
        if v.kind == "peak":
            own = _combine_peak(F.lit(None).cast("double"), F.coalesce(f"_c{k}", F.lit(1.0)), F.col(f"_high{k}"), F.col(f"_low{k}"))
            carried = carried.withColumn(f"_peak{k}", own).withColumn(f"_p{k}", F.max(f"_peak{k}").over(earlier))
    kept = [c for c in carried.columns if c in (key, "_piece") or c.startswith(("_c", "_p")) and c[2:].isdigit()]
    out = inside.join(carried.select(*kept), [key, "_piece"])
    result: dict[str, Column] = {}
    for k, v in enumerate(values):
        x, c = F.col(f"_l{k}"), F.col(f"_c{k}")
        if v.kind in ("last", "next"):
            result[v.name] = F.coalesce(x, c)
        elif v.kind == "product":
            result[v.name] = F.when(x.isNull() | c.isNull(), F.coalesce(x, c)).otherwise(x * c)
        elif v.kind == "peak":
            result[v.name] = _combine_peak(F.col(f"_p{k}"), F.coalesce(c, F.lit(1.0)), F.col(f"_high{k}"), F.col(f"_low{k}"))
        elif v.kind == "count":
            result[v.name] = x + F.coalesce(c, F.lit(0))
        elif v.kind == "sum":
            result[v.name] = F.when(x.isNull() | c.isNull(), F.coalesce(x, c)).otherwise(x + c)
        else:
            result[v.name] = F.least(x, c) if v.kind == "min" else F.greatest(x, c)
    return out.select(*[c for c in columns if c not in result], *[r.alias(n) for n, r in result.items()])
