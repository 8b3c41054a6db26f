"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Salts for rows of a hot key in a salted join.
SALTS = 32


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id as decimal text, modulo ``m``; null ids give null."""
    return F.crc32(col.cast("string").cast("binary")) % m


def byte_list(column) -> list:
    """A string or binary Arrow column as a list of bytes or None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def mix64(h: np.ndarray) -> np.ndarray:
    """Final mixing step of a 64-bit hash (multiply and shift), for uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``many`` to ``few`` (one row a key) where single keys may hold a large share of ``many``.

    Each row of ``few`` is repeated once per salt; rows of ``many`` take a salt
    from the hash of all their columns, so that a hot key spreads over SALTS tasks. Null keys match
    nothing.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
