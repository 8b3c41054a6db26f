"""Benchmark decontamination with a distributed positional inverted index.

All training texts are indexed once, in shards of about SHARD_WORDS words, one
row each, stored in the shared folder: for every term of the shard its postings, the positions
of its occurrences, as compressed gaps. A search goes to all shards. Within a
shard the windows of the test items are looked up together: the postings of
each window's rarest term (by count in the shard) give candidate starts, and
those are intersected, offset by offset, with the postings of the other terms,
from rare to frequent. What is left are exact phrase matches, or with ``slop``
proximity matches (each term within ``slop`` words of its place).

Test items go in blocks of at most ``block_bytes`` bytes of distinct text (one
item at least), so that what is broadcast, a block's windows, is bounded; blocks
are searched one after the other in the same index. A document is known by its
shard and its number there, never by its id, so that the blocks' hits are
united row by row, at every number of blocks.

Defined results for edge cases: null or empty text and text without a word has
no words and no hits; items without a word have no window; rows of documents
that share an id, or have none, stand each for itself; of items that share an
id, each counts, under one id; items without an id count as one item, without a
name in ``items``; other columns are ignored; an empty table gives an empty
result. A single text is indexed within one shard, however long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list
from marlstone.storage import materialize

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
_SPLIT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and bytes beyond ASCII."""
    return text.translate(_SPLIT).split() if text else []


def build_index(docs: DataFrame, gap: int) -> DataFrame:
    """One row a shard: its name, its documents (ids, lengths), its terms in order, and their counts and positions.

    ``gap`` positions between documents stay unused, so that no match spans two of them.
    """

    def shard(ids: list, lengths: list[int], numbers: list[int], terms: dict[bytes, int]) -> pa.RecordBatch:
        import zstandard

        lengths, of = np.array(lengths, np.int64), np.array(numbers, np.int32)
        starts = np.cumsum(lengths + gap) - lengths - gap
        position = np.arange(len(of)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        names = sorted(terms)
        place = np.empty(len(names), np.int32)
        place[np.fromiter((terms[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        of = place[of]
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(names))
        gaps = np.diff(position[order], prepend=0).astype(np.int32)
        first = np.cumsum(counts) - counts
        gaps[first] = position[order][first]  # each term's postings begin anew
        planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
        name = f"{pyspark.TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.binary())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=1).compress(planes)], pa.binary()),
            ],
            names=["shard", "doc_ids", "lengths", "terms", "counts", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, numbers, terms = [], [], [], {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
                words = words_of(text)
                ids.append(i), lengths.append(len(words))
                numbers += [terms.setdefault(w, len(terms)) for w in words]
                if len(numbers) + gap * len(ids) >= SHARD_WORDS:
                    yield shard(ids, lengths, numbers, terms)
                    ids, lengths, numbers, terms = [], [], [], {}
        if ids:
            yield shard(ids, lengths, numbers, terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "shard string, doc_ids array<long>, lengths array<long>, terms array<binary>, counts array<long>, positions binary")


class Windows:
    """Distinct windows of the test items, by length, as numbers of ``terms``, and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.terms = sorted({w for _, words in items for w in words})
        number = {w: n for n, w in enumerate(self.terms)}
        by_length: dict[int, dict[tuple, set]] = {}
        for name, words in items:
            ids = [number[w] for w in words]
            n = min(width, len(ids))
            for k in range(len(ids) - n + 1):
                by_length.setdefault(n, {}).setdefault(tuple(ids[k : k + n]), set()).add(name)
        self.groups = [(n, np.array(list(w), np.int64), [list(x) for x in w.values()]) for n, w in sorted(by_length.items()) if n]


def postings(windows: Windows, terms: list[bytes], counts: np.ndarray, positions: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's index: which of the windows' terms it holds, their counts, and their positions."""
    import zstandard

    have = {t: k for k, t in enumerate(terms)}
    found = [(n, have[t]) for n, t in enumerate(windows.terms) if t in have]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(positions), np.uint8).reshape(4, -1)
    gaps = np.ascontiguousarray(planes.T).view(np.int32).ravel()
    first = np.cumsum(counts) - counts
    own = np.array([k for _, k in found])
    return np.array([n for n, _ in found]), counts[own], np.concatenate([np.cumsum(gaps[first[k] : first[k] + counts[k]]) for k in own])


def phrase_starts(windows: np.ndarray, order: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window number, start) of the matches in one shard."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    keys = (np.repeat(terms, counts).astype(np.int64) << 32) | positions  # sorted by term, then position
    rows = np.arange(len(windows))
    rarest = windows[rows, order[:, 0]]
    at = np.minimum(np.searchsorted(terms, rarest), len(terms) - 1)
    have = terms[at] == rarest
    number, at = rows[have], at[have]
    size = counts[at]
    which = np.repeat(number, size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    start = positions[np.repeat(first[at], size) + within].astype(np.int64) - order[which, 0]
    for k in range(1, windows.shape[1]):
        if not len(which):
            break
        offset = order[which, k]
        term = windows[which, offset]
        place = np.maximum(start + offset - slop, 0)
        low = np.searchsorted(keys, (term << 32) | place)
        found = keys[np.minimum(low, len(keys) - 1)]
        good = (low < len(keys)) & (found >> 32 == term) & ((found & 0xFFFFFFFF) <= start + offset + slop)
        which, start = which[good], start[good]
    return which, start


def search(index: DataFrame, windows: Windows, gap: int, slop: int = 0) -> DataFrame:
    """(shard, at, hits, items) for every document that has any: ``at`` is its number in the shard, hits are the word numbers that matches cover."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for shard, lengths, terms, counts, positions in zip(*(batch.column(k) for k in range(5))):
                lengths, counts = lengths.values.to_numpy(), counts.values.to_numpy()
                starts = np.cumsum(lengths + gap) - lengths - gap
                hits: dict[int, set] = {}
                items: dict[int, set] = {}
                found, counts, places = postings(asked, terms.as_py(), counts, positions.as_py())
                rarity = np.zeros(len(asked.terms), np.int64)
                rarity[found] = counts
                for n, matrix, names in asked.groups:
                    order = np.argsort(rarity[matrix], axis=1, kind="stable")
                    which, start = phrase_starts(matrix, order, found, counts, places, slop)
                    # with slop a phrase may begin before its document does
                    doc = np.searchsorted(starts, np.maximum(start + slop, 0), side="right") - 1 if slop else np.searchsorted(starts, start, side="right") - 1
                    for w, s, d in zip(which.tolist(), (start - starts[doc]).tolist(), doc.tolist()):
                        hits.setdefault(d, set()).update(k for k in range(s, s + n) if 0 <= k < lengths[d])
                        items.setdefault(d, set()).update(names[w])
                at = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array([sorted(hits[d]) for d in at], pa.list_(pa.int32())),
                        pa.array([list(items[d]) for d in at], pa.list_(pa.string())),
                    ],
                    names=["shard", "at", "hits", "items"],
                )

    return index.select("shard", "lengths", "terms", "counts", "positions").mapInArrow(run, "shard string, at int, hits array<int>, items array<string>")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of documents against all items of ``benchmark``."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    gap = width + slop + 1
    index = materialize(build_index(docs, gap), "postings")
    size, count = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks, found = max(1, min(count, -(-2 * size // block_bytes))), None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        windows = Windows([(r["item"], words_of(bytes(r["text"]))) for r in part], width)
        hits = search(index, windows, gap, slop)
        found = hits if found is None else found.union(hits)
    united = found.groupBy("shard", "at").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("at", "x")).select("shard", "at", F.col("x.doc_ids").alias("doc_id"), F.col("x.lengths").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return listed.join(united, ["shard", "at"], "left").select("doc_id", "n_words", none("hits", "int"), none("items", "string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_overlaps(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, range(1, len(w) - least(len(w), 10) + 2) r(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM d, (SELECT DISTINCT l FROM iw) x, range(1, len(w) - l + 2) r(i) WHERE len(w) >= l
), m AS (
  SELECT doc_id, item_id, l, i FROM dw JOIN iw USING (l, g)
), h AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, range(0, 10) o(k) WHERE k < l GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
