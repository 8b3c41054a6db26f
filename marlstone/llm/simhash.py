"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted into tiles by the population counts of their
four 16-bit parts. Two fingerprints at r or fewer differing bits have counts
that differ by r or less in sum, so only such pairs of tiles meet (the others
are skipped without a look); a pair is compared exactly, with exclusive-or and
bit counts. Each comparison returns a spanning forest of its links, and
components are joined up by ``connected_components``.

Defined results for edge cases: null and empty texts, and texts without a word,
have fingerprint zero and are linked like any other; repeated rows share a
component; rows with a null id are fingerprinted, and never name a component;
other columns are ignored; an empty table gives an empty result.

``near_duplicates`` is op2's query (3-word shingles, 2 of 64 bits);
``similar_sets``, which the pipeline uses, links texts whose SimHashes of 5-word
shingles (128 bits) differ by PRINT_RADIUS bits or fewer and whose shingle sets
have the similarity.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list, map_rows, mix64
from marlstone.llm.components import connected_components
from marlstone.llm.linking import link_groups, near, nearest_forest, nearest_of
from marlstone.llm.minhash import band_keys, simhashes
from marlstone.storage import materialize, partitions_for

SEED = 42
PARTS = 4
TILE = 2048
#: Of ``similar_sets``: words of a shingle, least Jaccard similarity, MinHash bands and values of a band (a pair at 0.8 meets with probability 0.9998).
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
#: Words of 64 bits of its fingerprints, and bits in which they may differ. Sets of equal size at 0.8 differ in 15 % of the bits,
#: 19 on average; sets of 4 and 5 shingles, the worst case, in 19 %, 24 on average, and in over 40 with a probability of 0.0002.
PRINT_WORDS = 2
PRINT_RADIUS = 40
_PRINT = [f"w{k}" for k in range(PRINT_WORDS)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """Fingerprint of the word shingles of a text (XXH64, seed 42), as an unsigned number."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]
    # bytes of a digest run from the highest to the lowest
    table = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)[:, ::-1]
    counts = np.bincount((table + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in byte_list(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, fp long")


def _steps(radius: int) -> list[int]:
    """Half of the differences between packed counts that add up to ``radius`` or less, and no difference."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=PARTS):
        if sum(map(abs, d)) <= radius and d >= (0,) * PARTS:
            out.append(sum(x << (8 * (PARTS - 1 - k)) for k, x in enumerate(d)))
    return out


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between ids whose fingerprints are within ``radius``, from distinct (fp, id)."""
    part = 64 // PARTS
    key = sum(
        (F.bit_count(F.shiftrightunsigned("fp", k * part).bitwiseAND(F.lit((1 << part) - 1))).cast("long") + 16) * (1 << (8 * k)) for k in range(PARTS)
    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        task, number = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, fps, ids = (c.to_numpy() for c in batch.columns)
            ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)) if len(keys) else []
            low, rows = 0, []
            for high in ends:
                for at in range(low, high, TILE):
                    to = min(high, at + TILE)
                    rows.append((int(keys[low]), task << 40 | number, fps[at:to].tobytes(), ids[at:to].tobytes()))
                    number += 1
                low = high
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())],
                names=["key", "tile", "fps", "ids"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for same, f, i, g, j in zip(*(c.to_pylist() for c in batch.columns)):
                left, right = np.frombuffer(f, np.uint64), None if same else np.frombuffer(g, np.uint64)
                ids = np.frombuffer(i if same else i + j, np.int64)
                a, b = near(left, right, radius)
                one.append(ids[a])
                two.append(ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], names=["a", "b"])

    n = partitions_for(classes, 1 << 20)
    made = materialize(
        classes.where(F.col("id").isNotNull()).select(key.alias("key"), "fp", "id")
        .repartitionByRange(n, "key", "fp").sortWithinPartitions("key", "fp")
        .mapInArrow(tiles, "key long, tile long, fps binary, ids binary"),
        "tiles",
    )
    left = made.select("tile", "fps", "ids", "key", F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius)])).alias("step"))
    pairs = (
        left.withColumn("target", F.col("key") + F.col("step")).alias("l")
        .join(made.alias("r"), (F.col("l.target") == F.col("r.key")) & ((F.col("l.step") != 0) | (F.col("l.tile") <= F.col("r.tile"))))
        .select((F.col("l.tile") == F.col("r.tile")).alias("same"), "l.fps", "l.ids", F.col("r.fps").alias("fps2"), F.col("r.ids").alias("ids2"))
    )
    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id reachable."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    roots = connected_components(links(classes, radius))
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    # a hot fingerprint makes a large partition of the left side, which adaptive execution splits
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes (uint64) of the word shingles of a text, in order; none for a text without a word."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, starts = b" ".join(words), list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[shingle:] if len(words) > shingle else [len(joined) + 1]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)], np.uint64))


def set_prints(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints (PRINT_WORDS numbers, uint64, a row) of sets of hashes that lie one after the other, ``lengths`` of each at least 1."""
    return np.stack([simhashes(mix64(hashes + np.uint64(w << 32)), lengths) for w in range(PRINT_WORDS)], 1)


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = PRINT_RADIUS) -> DataFrame:
    """(doc_id, component_id) for every row; components of the links between texts whose fingerprints are within ``radius`` and whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Fingerprints are compared tile by tile among the texts that share one of BANDS MinHash bands,
    so that not all are compared with all. Links of near fingerprints make groups, and each near pair
    of a group is verified with its exact sets. Texts with equal sets
    count as one; those without a word are one set. component_id is the
    smallest id reachable, null ids never name one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, shingle) for t in byte_list(batch.column(1))]
        some = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
        hashes, lengths = np.concatenate(some), np.fromiter(map(len, some), np.int64, len(some))
        keys = band_keys((hashes >> np.uint64(32)).astype(np.uint32), lengths, BANDS, ROWS)
        words = set_prints(hashes, lengths).view(np.int64).T
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), *map(pa.array, words)],
            names=["doc_id", "text", "set", "bands", *_PRINT],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = ", ".join(f"{w} long" for w in _PRINT)
    sets = materialize(map_rows(rows, run, f"doc_id long, text string, set binary, bands array<long>, {printed}"), "shingle-sets")
    classes = materialize(sets.groupBy("set").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("bands", *_PRINT)]), "set-classes")
    members = classes.select(F.posexplode("bands").alias("band", "value"), F.col("set").alias("id"), *_PRINT)

    def prints(table: pa.Table) -> np.ndarray:
        return np.stack([table[c].to_numpy().view(np.uint64) for c in _PRINT], 1)

    def by_bits(one: pa.Table, two: pa.Table | None):
        return nearest_forest(prints(one), None if two is None else prints(two), radius)

    def of_pairs(table: pa.Table, i: np.ndarray, j: np.ndarray):
        return nearest_of(prints(table), i, j, radius)

    keyed = members.select(F.concat_ws("-", "band", "value").alias("key"), "id", *_PRINT)
    groups = connected_components(link_groups(keyed, by_bits, partitions_for(classes, 2 << 20), of_pairs=of_pairs))
    groups = materialize(groups.select(F.col("node").alias("set"), "root"), "near-prints")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = pa.array([shingle_hashes(t, shingle).tobytes() for t in byte_list(batch.column(2))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hashes, *batch.columns[3:]], names=["set", "root", "hashes", *_PRINT])

    # the sets themselves, of those texts alone whose fingerprint is near another
    texts = sets.select("set", "text", *_PRINT).join(groups, "set").groupBy("set").agg(*[F.first(c).alias(c) for c in ("root", "text", *_PRINT)])
    held = materialize(map_rows(texts, hashed, f"set binary, root binary, hashes binary, {printed}"), "near-sets")

    def verify(one: pa.Table, two: pa.Table | None):
        sets = [np.frombuffer(x, np.uint64) for t in (one, two) if t is not None for x in t["hashes"].to_pylist()]
        fps = np.concatenate([prints(t) for t in (one, two) if t is not None])
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for k in range(len(one)):
            low = k + 1 if two is None else len(one)
            for j in (low + np.flatnonzero(np.bitwise_count(fps[low:] ^ fps[k]).sum(1) <= radius)).tolist():
                few, many = sorted((len(sets[k]), len(sets[j])))
                if few < similarity * many - 1e-9 or (a := root(k)) == (b := root(j)):
                    continue
                both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                if both >= similarity * (few + many - both) - 1e-9:
                    parent[b] = a
                    found.append((k, j))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    links_of = link_groups(held.select(F.hex("root").alias("key"), F.col("set").alias("id"), "hashes", *_PRINT), verify, partitions_for(held, 1 << 20), tile_rows=256)
    roots = connected_components(links_of)
    named = classes.select("set", "id").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return sets.select("doc_id", "set").join(named.join(least, "root").select("set", "component_id"), "set", "left").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
