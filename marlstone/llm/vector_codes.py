"""Compression of vectors to short codes: a codebook for each of several parts, trained by exact rounds of k-means over metric trees.

Rows are packed into shards of at most SHARD vectors, and each shard holds a
metric tree for each part, built once and written. A round sends the codebooks
(ENTRIES entries a part, so their size is bounded) to all shards; a tree hands
whole balls to an entry with their cached sums and counts
(``metric_tree.nearest``); sums per entry add up in Spark.

Defined results for edge cases: rows whose vector is null or holds a null or
non-finite component are dropped; rows with a null id are coded, but never seed
a codebook; repeated rows count each for itself, and of rows with one id that
seed a codebook the smaller vector comes first; fewer than ENTRIES rows give
fewer entries; an empty table gives an empty result; other columns are ignored.
Vectors of different lengths, of a length that the parts don't divide, or with
a component of 2**27 or more after scaling (exact sums need that) raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.llm.common import salted_join
from marlstone.llm.metric_tree import build, nearest, node_type
from marlstone.storage import materialize, release

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
SHARD = 4096
LARGEST = 1 << 27
#: Labels up to this number are broadcast with their sums; more meet the rows in a salted join.
MAX_BROADCAST_LABELS = 100_000


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    infinite = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))


def scaled(vector: str, scale: int) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _shards(rows: DataFrame, parts: int) -> DataFrame:
    """One row a shard: ids and labels, the points, and the order and nodes of each part's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def pack(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            vectors = table["q"].chunk(0) if table["q"].num_chunks else table["q"].combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            if sizes.min() != sizes.max() or sizes[0] % parts or not sizes[0]:
                raise ValueError(f"vectors must have one length that {parts} parts divide")
            points = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sizes), -1)
            if np.abs(points).max() >= LARGEST:
                raise ValueError("components are too large for exact sums")
            m = points.shape[1] // parts
            trees = [x.tobytes() for p in range(parts) for x in build(points[:, p * m : (p + 1) * m])]
            columns = [pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([table["label"].to_pylist()], pa.list_(pa.int64()))]
            columns += [pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary())), pa.array([points.shape[1]], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees", "size"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            while count >= SHARD:
                table = pa.concat_tables(held)
                yield pack(table.slice(0, SHARD))
                held, count = [table.slice(SHARD)], count - SHARD
        if count:
            yield pack(pa.concat_tables(held))

    return rows.select("vec_id", "label", "q").mapInArrow(run, "ids array<long>, labels array<long>, points binary, trees array<binary>, size int")


def _parts_of(row: dict, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, order, points in that order, nodes) of each tree of a shard."""
    points = np.frombuffer(row["points"], np.int32).reshape(len(row["ids"]), -1).astype(np.int64)
    m = points.shape[1] // parts
    for p in range(parts):
        order = np.frombuffer(row["trees"][2 * p], np.int32)
        yield p, order, points[order, p * m : (p + 1) * m], np.frombuffer(row["trees"][2 * p + 1], node_type(m))


def _totals(shards: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s0, s1, ...): number and sum of the points nearest to each entry that has any."""
    parts, _, m = books.shape
    names = [f"s{i}" for i in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, _, points, nodes in _parts_of(row, parts):
                    _, s, n = nearest(points, nodes, books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        table = sums[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), *(pa.array(table[:, i]) for i in range(m))], names=["part", "entry", "n", *names])

    partial = shards.select("ids", "points", "trees").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def train(shards: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and replacement; each round reads back one row an entry."""
    for _ in range(rounds):
        fresh = books.copy()
        for part, entry, n, *sums in _totals(shards, books).collect():  # parts x entries rows at most
            fresh[part, entry] = np.array(sums, np.int64) // n
        if (fresh == books).all():
            break  # further rounds change nothing
        books = fresh
    return books


def assign(shards: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each row."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, order, points, nodes in _parts_of(row, parts):
                    own = nearest(points, nodes, books[p])[0]
                    codes[order, p] = own
                    error[order] += ((points - books[p][own]) ** 2).sum(1)
                digits = codes.tobytes().hex()
                code = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return shards.select("ids", "labels", "points", "trees").mapInArrow(run, "vec_id long, label long, code string, error long")


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), codebooks): codes of all usable rows, and the codebooks (part, entry, component), None without rows; at most 256 entries a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = vectors.where(usable(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled(vector, scale).alias("q"))
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "q").limit(entries).collect()  # the entries of a codebook
    shards = materialize(_shards(rows, parts), "vector-shards")
    sizes = shards.agg(F.min("size"), F.max("size")).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors must have one length")
    if not first:
        if sizes[0] is not None:
            raise ValueError("no row with an id to begin a codebook from")
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    begin = np.array([r["q"] for r in first], np.int64)
    books = train(shards, begin.reshape(len(begin), parts, -1).transpose(1, 0, 2).copy(), rounds)
    out = materialize(assign(shards, books), "vector-codes")
    release(shards)
    return out, books


def digest(books: np.ndarray | None) -> str:
    """sha256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of errors of all rows of the same label, null labels together."""
    key = F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = codes.withColumn("_key", key)
    sums = materialize(keyed.groupBy("_key").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= MAX_BROADCAST_LABELS:
        return keyed.join(F.broadcast(sums), "_key").drop("_key")
    return salted_join(keyed, sums, "_key", "inner").drop("_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB: every part against every entry, round by round."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""part AS MATERIALIZED (SELECT rid, vec_id, p, q[p * len(q) // {parts} + 1 : (p + 1) * len(q) // {parts}] AS v FROM kept, range({parts}) t(p))""",
        f"""c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS e, v FROM part WHERE vec_id IS NOT NULL QUALIFY e < {entries})""",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT rid, p, min((list_inner_product(part.v, part.v) - 2 * list_inner_product(part.v, c.v) + list_inner_product(c.v, c.v))::BIGINT * {entries} + e) AS m FROM part JOIN c{k} c USING (p) GROUP BY rid, p)""")
        if k < rounds:
            ctes.append(f"""n{k} AS MATERIALIZED (SELECT p, e, list(f ORDER BY i) AS v FROM (SELECT p, m % {entries} AS e, i, floor(sum(v[i]) / count(*)) AS f FROM a{k} JOIN part USING (rid, p), range(1, len(v) + 1) r(i) GROUP BY ALL) GROUP BY p, e)""")
            ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n USING (p, e))""")
    body = ",\n".join(ctes)
    return f"""WITH {body},
coded AS (SELECT rid, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(v[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{rounds}, range(1, len(v) + 1) r(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), books"""


SQL = _sql()
