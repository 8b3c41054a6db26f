"""Hard negatives: for each anchor and each of its best rows of the same label, rows of other labels that score a little less.

Candidates are packed into shards of at most SHARD rows; each holds a cover
tree (``cover_tree``), built once and written. The anchors, a stated query set,
are taken in blocks of about ANCHORS; each block passes over all shards, whose
tasks keep the best few rows per anchor or window and hand on no more. The first pass finds the
positives, the second the negatives in the score windows that they give.

Defined results for edge cases: rows with a null label or vector, or a null or
non-finite component, take no part, and nor do rows with a null id, which can't
be named. Repeated rows stand each for itself: a repeated anchor is answered
twice, a repeated candidate takes two places; a row with the anchor's own id is
never its positive. An anchor without positives, and a positive without
negatives, give no row. A positive score below 0 leaves an empty window, one of 0 only scores of 0. An
empty table gives an empty result; other columns are ignored. Vectors of
different lengths, or with a component of 2**27 or more after scaling, raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marlstone.llm.cover_tree import NODE, build, descend
from marlstone.llm.vector_codes import LARGEST, scaled, usable
from marlstone.storage import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
WINDOW = (50, 95)
SHARD = 4096
#: Anchors of a block on average; a block's vectors, and POSITIVES rows for each, pass through the driver.
ANCHORS = 16_384
#: Anchors that descend a tree together.
TOGETHER = 512
#: The score of an empty place, below all others; its negative is a number too.
_NONE = -np.iinfo(np.int64).max


def _shards(rows: DataFrame) -> DataFrame:
    """One row a shard: points, ids and labels in the order of its tree, and the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def pack(table: pa.Table) -> pa.RecordBatch:
            vectors = table["q"].combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            if sizes.min() != sizes.max() or not sizes[0]:
                raise ValueError("vectors must have one length, and a component")
            points = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sizes), -1)
            if np.abs(points).max(initial=0) >= LARGEST:
                raise ValueError("components are too large for exact sums")
            order, nodes, norm = build(points)
            ids, labels = (table[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)[order] for c in ("vec_id", "label"))
            blobs = [points[order].astype(np.int32).tobytes(), ids.tobytes(), labels.tobytes(), nodes.tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in blobs), pa.array([norm]), pa.array([points.shape[1]], pa.int32())], names=["points", "ids", "labels", "nodes", "norm", "size"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            while count >= SHARD:
                table = pa.concat_tables(held)
                yield pack(table.slice(0, SHARD))
                held, count = [table.slice(SHARD)], count - SHARD
        if count:
            yield pack(pa.concat_tables(held))

    return rows.select("vec_id", "label", "q").mapInArrow(run, "points binary, ids binary, labels binary, nodes binary, norm double, size int")


class _Best:
    """The best ``k`` rows of each slot, by score, then by id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), _NONE), np.full((slots, k), np.iinfo(np.int64).max)

    def last(self, slots: np.ndarray) -> np.ndarray:
        """The score that a row must reach to enter; the least number while a slot is not full."""
        return self.score[slots, -1]

    def enters(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        worst = self.score[slots, -1]
        return (score > worst) | (score == worst) & (ids < self.id[slots, -1])

    def add(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        touched = np.unique(slots)
        slots = np.concatenate([slots, np.repeat(touched, self.k)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        at = np.lexsort((ids, -score, slots))
        slots, score, ids = slots[at], score[at], ids[at]
        begins = np.searchsorted(slots, touched)
        rows = begins[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[rows], ids[rows]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.id < np.iinfo(np.int64).max)
        return slot, self.id[slot, place], self.score[slot, place]


def _search(shards: DataFrame, slots: int, k: int, searcher) -> DataFrame:
    """(slot, id, score): each task's best ``k`` rows of each slot over all of its shards, then the best of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(slots, k)
        for batch in batches:
            for points, ids, labels, nodes, norm in zip(*(batch.column(c).to_pylist() for c in range(5))):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                searcher(best, np.frombuffer(points, np.int32).reshape(len(ids), -1).astype(np.int64), ids, labels, np.frombuffer(nodes, NODE), norm)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["slot", "id", "score"])

    found = shards.select("points", "ids", "labels", "nodes", "norm").mapInArrow(run, "slot long, id long, score long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _positives(shards: DataFrame, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, k: int) -> DataFrame:
    def searcher(best: _Best, points, ids, labels, nodes, norm) -> None:
        for begin in range(0, len(anchors), TOGETHER):
            part = np.arange(begin, min(begin + TOGETHER, len(anchors)))

            def is_open(low, high, active):
                return high >= best.last(part[active])

            def offer(rows, scores, active):
                slots = part[active]
                good = (labels[rows][:, None] == anchor_labels[slots]) & (ids[rows][:, None] != anchor_ids[slots]) & (scores >= best.last(slots))
                r, a = np.nonzero(good)
                slots, scores, found = slots[a], scores[r, a], ids[rows[r]]
                enters = best.enters(slots, scores, found)
                best.add(slots[enters], scores[enters], found[enters])

            descend(points, nodes, norm, anchors[part], is_open, offer)

    return _search(shards, len(anchors), k, searcher)


def _negatives(shards: DataFrame, anchors: np.ndarray, anchor_labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> DataFrame:
    """``lows`` and ``highs``: the windows of each anchor, one column a positive; slots are numbered by anchor and column."""
    width = lows.shape[1]

    def searcher(best: _Best, points, ids, labels, nodes, norm) -> None:
        last = best.score.reshape(len(anchors), width, k)[:, :, -1]
        for begin in range(0, len(anchors), TOGETHER):
            part = np.arange(begin, min(begin + TOGETHER, len(anchors)))
            part = part[(lows[part] <= highs[part]).any(1)]

            def is_open(low, high, active):
                own = part[active]
                out = np.zeros(low.shape, bool)
                for w in range(width):
                    out |= (high >= np.maximum(lows[own, w], last[own, w])) & (low <= highs[own, w]) & (lows[own, w] <= highs[own, w])
                return out

            def offer(rows, scores, active):
                own = part[active]
                good = (labels[rows][:, None] != anchor_labels[own]) & (scores >= lows[own].min(1)) & (scores <= highs[own].max(1))
                r, a = np.nonzero(good)
                own, scores, found = own[a], scores[r, a], ids[rows[r]]
                for w in range(width):
                    inside = (scores >= lows[own, w]) & (scores <= highs[own, w])
                    slots, s, f = own[inside] * width + w, scores[inside], found[inside]
                    enters = best.enters(slots, s, f)
                    best.add(slots[enters], s[enters], f[enters])

            descend(points, nodes, norm, anchors[part], is_open, offer)

    return _search(shards, len(anchors) * width, k, searcher)


def mine(vectors: DataFrame, is_anchor, vector: str = "embedding", label=None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` and ``label`` are columns over ``vectors``."""
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = vectors.where(usable(vector)).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled(vector, scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL")
    shards = materialize(_shards(rows), "candidate-shards")
    sizes = shards.agg(F.min("size"), F.max("size")).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors must have one length")
    stated = materialize(rows.where("anchor").select("vec_id", "label", "q"), "anchors")
    blocks = -(-stated.count() // block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for number in range(blocks):
        own = stated.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)) == number).toArrow()
        if not len(own):
            continue
        ids, labels = (own[c].combine_chunks().to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        anchors = own["q"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), -1)
        found = _positives(shards, anchors, ids, labels, positives).toArrow()  # ``positives`` rows an anchor of the block at most
        slot, place = found["slot"].to_numpy(), found["place"].to_numpy() - 1
        positive_ids, scores = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1, np.int64)
        positive_ids[slot, place], scores[slot, place] = found["id"].to_numpy(), found["score"].to_numpy()
        # an absent positive has a negative score, and so an empty window
        empty = scores < 0
        lows, highs = np.where(empty, 1, -((-window[0] * scores) // 100)), np.where(empty, 0, (window[1] * scores) // 100)
        negatives_of = _negatives(shards, anchors, labels, lows, highs, negatives)

        def named(batches: Iterator[pa.RecordBatch], ids=ids, positive_ids=positive_ids, scores=scores) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column(0).to_numpy()
                a, w = slot // positives, slot % positives
                columns = [pa.array(ids[a]), pa.array(positive_ids[a, w]), batch.column(3).cast(pa.int32()), batch.column(1), pa.array(scores[a, w]), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        part = materialize(negatives_of.select("slot", "id", "score", "place").mapInArrow(named, schema), "negatives")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=label)


#: The same in DuckDB.
SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
