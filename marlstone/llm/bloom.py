"""A Bloom filter of bounded size: it only spares work, never decides a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.common import mix64

#: Largest filter: 2**27 bits are 16 MB.
MAX_BITS = 1 << 27
HASHES = 3


def _positions(values: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each value (uint64), one row a hash."""
    one, two = mix64(values), mix64(values ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(one + np.uint64(k) * two) & np.uint64(bits - 1) for k in range(HASHES)])


def build(ids: DataFrame) -> np.ndarray:
    """The filter, as an array of 64-bit words, of the one long column of ``ids``."""
    count = max(1, ids.count())
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (12 * count).bit_length()))
    name = ids.columns[0]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            p = _positions(values, bits).ravel()
            word, mask = (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    rows = ids.select(F.col(name).cast("long")).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def might_hold(filter_words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value (uint64) may be in the filter."""
    p = _positions(values, len(filter_words) * 64)
    return ((filter_words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(0)
