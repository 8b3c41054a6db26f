"""Removal of long repeated byte strings, with run-length indexes over what repeats.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
in the corpus. Every window of LENGTH bytes is named by its anchor, the gram of
GRAM bytes with the smallest hash in it (the leftmost of equal ones). Windows
that follow each other with the same anchor form one context. Equal windows
have equal anchors, so windows need comparing only within the contexts of one anchor.

1. Contexts are listed as (anchor hash, content hash, place), packed and
   shuffled by anchor. Of equal contexts all but the earliest are wholly
   repeats (already so within a map task, before the shuffle); an anchor that is left with one
   context is done.
2. For anchors with several different contexts, one of each is fetched from its
   document and goes to a shard. A shard of such contexts, near-copies of each
   other, is indexed by a run-compressed Burrows-Wheeler transform with sampled
   run ends; its stream of matching statistics marks the windows that have an earlier match.
3. An anchor with very many different contexts (``CROWD`` in one map task, or
   ``16 * CROWD`` in all) would make a large shard. Its windows are compared one by one instead: each is
   its own anchor and its own context, so that step 1 settles them all, spread over all tasks.
4. Marks go back to their documents, where spans are merged and cut out.

Defined results for edge cases: null or empty text, and text of fewer bytes
than LENGTH, keeps all; repeated rows (same id and text) are at the same place, so that
they never remove each other; different texts that share a doc_id count as documents of
their own, one after the other by a hash of the text; rows with a null id keep all; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marlstone.llm import bloom
from marlstone.llm.common import byte_list, mix64
from marlstone.llm.run_length_index import RunLengthIndex
from marlstone.storage import materialize, partitions_for

LENGTH, GRAM = 100, 40
#: Different contexts of one anchor, in one batch of a map task, from which the anchor counts as crowded.
CROWD = 256
#: Window starts taken at once, and bits for places within them.
STEP, PLACE_BITS = 1 << 18, 19
SHARD_BYTES = 1 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the two hashes
_FIELDS = (("anchor", np.uint64), ("content", np.uint64), ("doc", np.int64), ("start", np.int64), ("count", np.uint16), ("offset", np.uint16))


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor**k and its inverse modulo 2**64, for k below n."""
    out = []
    for f in (factor, pow(factor, -1, 1 << 64)):
        p = np.full(n, f, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Scanner:
    """Finds the contexts of texts, by anchors of ``gram`` bytes."""

    def __init__(self, gram: int = GRAM, step: int = STEP):
        self.powers = [_powers(f, step + 4 * LENGTH) for f in _FACTORS]
        self.gram, self.step, self.width = gram, step, LENGTH - gram + 1

    def contexts(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """anchor, content, start, count, offset of the contexts of the windows that start at ``valid`` places of ``data``."""
        n = len(data)
        sums = []
        for power, _ in self.powers:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=s[1:])
            sums.append(s)
        gram = mix64((sums[0][self.gram :] - sums[0][: -self.gram]) * self.powers[0][1][: n - self.gram + 1])
        place = np.uint64((1 << PLACE_BITS) - 1)
        low = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while 2 * reach <= self.width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (self.width - reach)], low[self.width - reach :])
        anchor = (low[valid] & place).astype(np.int64)
        first = np.ones(len(valid), bool)
        first[1:] = (np.diff(valid) != 1) | (np.diff(anchor) != 0)
        heads = np.flatnonzero(first)
        count = np.diff(np.append(heads, len(valid)))
        start, anchor = valid[heads], anchor[heads]
        end = start + count + LENGTH - 1
        offset = anchor - start
        content = mix64((sums[1][end] - sums[1][start]) * self.powers[1][1][start] + (count * 64 + offset).astype(np.uint64))
        return gram[anchor], content, start, count, offset

    def scan(self, pieces: Iterator[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
        """The contexts of many pieces of documents: (id, place of the piece in its document, bytes)."""
        parts: list[tuple] = []
        group: list[tuple[int, int, bytes]] = []  # id, place in the document, bytes
        size = 0

        def flush():
            data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
            length = np.array([len(g[2]) for g in group])
            begin = np.cumsum(length) - length
            windows = length - LENGTH + 1
            which = np.repeat(np.arange(len(group)), windows)
            valid = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[which]
            anchor, content, start, count, offset = self.contexts(data, valid)
            of = np.searchsorted(begin, start, side="right") - 1
            doc, place = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
            parts.append((anchor, content, doc[of], start - begin[of] + place[of], count, offset))

        for i, place, text in pieces:
            for at in range(0, len(text) - LENGTH + 1, self.step):
                piece = text[at : at + self.step + LENGTH - 1]
                if size + len(piece) > self.step + LENGTH and group:
                    flush()
                    group, size = [], 0
                group.append((i, place + at, piece))
                size += len(piece)
        if group:
            flush()
        return {name: np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind) for k, (name, kind) in enumerate(_FIELDS)}


def _pack(fields: dict[str, np.ndarray]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(fields["doc"])).tobytes() + b"".join(np.ascontiguousarray(fields[n], k).tobytes() for n, k in _FIELDS))


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    import zstandard

    out: dict[str, list] = {n: [] for n, _ in _FIELDS}
    for blob in blobs:
        data, at = zstandard.ZstdDecompressor().decompress(blob), 8
        n = int(np.frombuffer(data, np.int64, 1)[0])
        for name, kind in _FIELDS:
            out[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {n: np.concatenate(v) for n, v in out.items()}


def _equal_contexts(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contexts in order of (anchor, content, doc, start), and the index of the earliest equal one of each."""
    order = np.lexsort((c["start"], c["doc"], c["content"], c["anchor"]))
    c = {n: v[order] for n, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["anchor"][1:] != c["anchor"][:-1]) | (c["content"][1:] != c["content"][:-1])
    return c, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _later(c: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    return (c["doc"] != c["doc"][first]) | (c["start"] != c["start"][first])


#: What becomes of a context: all of it repeats, it goes to an index, or to a comparison window by window.
REPEAT, WANTED, CROWDED, MARKER = range(4)
_FOUND = "kind int, doc_id long, start long, count int, anchor long"


def _found(kind: int, c: dict[str, np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
    n = int(pick.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(c["doc"][pick]), pa.array(c["start"][pick]), pa.array(c["count"][pick].astype(np.int32)), pa.array(c["anchor"][pick].view(np.int64))],
        names=["kind", "doc_id", "start", "count", "anchor"],
    )


def _crowded(anchors: np.ndarray, most: int) -> np.ndarray:
    """Which of these sorted anchors occur more than ``most`` times."""
    _, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
    return counts[inverse] > most


def compare_contexts(pieces: DataFrame, buckets: int, gram: int = GRAM, step: int = STEP, crowd: int = CROWD) -> DataFrame:
    """Contexts of ``pieces`` (doc_id, place, text), but for those that surely repeat nothing, by kind.

    With ``gram`` equal to LENGTH each window is its own context, and all are settled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(gram, step)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2)))
            c, first = _equal_contexts(scanner.scan((i, p, t) for i, p, t in rows if i is not None and t is not None))
            own = first == np.arange(len(first))
            later = ~own & _later(c, first)
            busy = np.zeros(len(own), bool)
            busy[own] = _crowded(c["anchor"][own], crowd)
            out = []
            # what is settled here goes, packed, through the same shuffle; so does a marker for each crowded anchor
            for kind, pick in ((REPEAT, later), (CROWDED, busy)):
                if pick.any():
                    out.append((int(c["doc"][pick][0] % buckets), kind, _pack({n: v[pick] for n, v in c.items()})))
            marker = np.zeros(len(own), bool)
            marker[np.flatnonzero(busy)[np.unique(c["anchor"][busy], return_index=True)[1]]] = True
            for kind, pick in ((MARKER, marker), (WANTED, own & ~busy)):
                keep = {n: v[pick] for n, v in c.items()}
                bucket = (keep["anchor"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts) if len(order) else ():
                    out.append((int(bucket[part[0]]), kind, _pack({n: v[part] for n, v in keep.items()})))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["bucket", "kind", "contexts"])

    def settle(blobs: list[bytes], markers: list[bytes]) -> Iterator[pa.RecordBatch]:
        c, first = _equal_contexts(_unpack(blobs))
        own = first == np.arange(len(first))
        yield _found(REPEAT, c, ~own & _later(c, first))
        # anchors with two different contexts or more, or with one here and a crowd elsewhere
        at = np.flatnonzero(own)
        a = c["anchor"][at]
        same = a[1:] == a[:-1]
        several = np.append(same, False) | np.append(False, same)
        busy = _crowded(a, 16 * crowd)
        if markers:
            busy |= np.isin(a, _unpack(markers)["anchor"])
        for kind, these in ((CROWDED, busy), (WANTED, several & ~busy)):
            pick = np.zeros(len(own), bool)
            pick[at[these]] = True
            yield _found(kind, c, pick)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, markers = None, [], []
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind in (REPEAT, CROWDED):
                    c = _unpack([blob])
                    yield _found(kind, c, np.ones(len(c["doc"]), bool))
                    continue
                if bucket != current:
                    if held:
                        yield from settle(held, markers)
                    held, markers = [], []
                current = bucket
                (markers if kind == MARKER else held).append(blob)
        if held:
            yield from settle(held, markers)

    dealt = pieces.mapInArrow(scan, "bucket int, kind int, contexts binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, _FOUND)


def _only(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose id may be among ``ids``, and those whose id surely isn't."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(ids))

    def part(keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(0)
                maybe = bloom.might_hold(shared.value, known.fill_null(0).to_numpy().view(np.uint64)) & known.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(maybe == keep))

        return run

    return docs.mapInArrow(part(True), docs.schema), docs.mapInArrow(part(False), docs.schema)


def fetch_contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(anchor, doc_id, start, bytes) of contexts, from the documents that hold any."""
    by_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "anchor")).alias("asked"))
    near, _ = _only(docs, asked.select("doc_id"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), byte_list(batch.column("text")), batch.column("asked").to_pylist()):
                for x in asked or ():
                    part = (text or b"")[x["start"] : x["start"] + x["count"] + LENGTH - 1]
                    if len(part) == x["count"] + LENGTH - 1:
                        out.append((x["anchor"], doc, x["start"], part))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "doc_id", "start", "bytes"])

    return near.join(by_doc, "doc_id").mapInArrow(fetch, "anchor long, doc_id long, start long, bytes binary")


def match_contexts(fetched: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, start, count): runs of windows of the fetched contexts that have an earlier match."""

    def index(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (anchor, doc, start, bytes) in that order: a place in the shard stands for the place in the corpus."""
        built = RunLengthIndex([r[3] for r in rows])
        repeat = built.repeats(LENGTH)
        edge = np.diff(np.concatenate(([False], repeat, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(built.starts, begin, side="right") - 1
        doc, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(start[of] + begin - built.starts[of]), pa.array((end - begin).astype(np.int32))], names=["doc_id", "start", "count"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and row[:3] == held[-1][:3]:  # a repeated row
                    continue
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield index(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield index(held)

    dealt = fetched.repartition(partitions, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.mapInArrow(shards, "doc_id long, start long, count int")


def _numbered(rows: DataFrame) -> DataFrame:
    """(number, doc_id, text): numbers in the order of the ids, and of hashes of texts that share one; equal rows share a number, null ids have none.

    Keys are range-partitioned and written; totals of the partitions (one small row each) give their offsets.
    """
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    keys = keyed.where("doc_id IS NOT NULL").select("doc_id", "hash").distinct()
    ranged = materialize(keys.repartitionByRange(partitions_for(keys, 8 << 20), "doc_id", "hash").withColumn("part", F.spark_partition_id()), "row-keys")
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "hash")) - 1
    return keyed.join(ranged.join(F.broadcast(before), "part").select("doc_id", "hash", number.alias("number")), ["doc_id", "hash"], "left").select("number", "doc_id", "text")


def find_repeats(docs: DataFrame, step: int = STEP, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) for every document; spans are the removed (start, end), in bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = F.xxhash64("text")
    shared = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min(hashed) < F.max(hashed)).alias("shared")).where("shared")
    if not shared.limit(1).count():
        return _find_repeats(rows, step, crowd)
    numbered = materialize(_numbered(rows), "numbered")
    out = _find_repeats(numbered.select(F.col("number").alias("doc_id"), "text"), step, crowd).withColumnRenamed("doc_id", "number")
    ids = numbered.where("number IS NOT NULL").select("number", "doc_id").distinct()
    return out.join(ids, "number", "left").select("doc_id", "n_bytes", "spans", "kept_sha256")


def _find_repeats(rows: DataFrame, step: int, crowd: int) -> DataFrame:
    """As ``find_repeats``, of (doc_id, text) where rows that share an id share their text."""
    buckets = partitions_for(rows, 4 << 20)
    pieces = rows.select("doc_id", F.lit(0).cast("long").alias("place"), F.col("text").cast("binary").alias("text"))
    found = materialize(compare_contexts(pieces, buckets, GRAM, step, crowd), "contexts")
    of_kind = lambda kind: found.where(F.col("kind") == kind).select("doc_id", "start", "count", "anchor")
    marks = of_kind(REPEAT).drop("anchor").union(match_contexts(fetch_contexts(rows, of_kind(WANTED)), buckets))
    crowded = of_kind(CROWDED)
    if crowded.limit(1).count():
        alone = fetch_contexts(rows, crowded).select("doc_id", F.col("start").alias("place"), F.col("bytes").alias("text"))
        windows = compare_contexts(alone, buckets, LENGTH, step, 1 << 60)
        marks = marks.union(windows.where(F.col("kind") == REPEAT).select("doc_id", "start", "count"))
    spans = materialize(marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("marks")), "marks")
    touched, untouched = _only(rows, spans.select("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, digests = [], [], []
            for text, marks in zip(byte_list(batch.column("text")), batch.column("marks").to_pylist()):
                text, merged = text or b"", []
                for start, count in sorted((m["start"], m["count"]) for m in marks or ()):
                    end = start + count + LENGTH - 1
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                kept, at = [], 0
                for start, end in merged:
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                sizes.append(len(text)), spans.append([{"start": a, "end": b} for a, b in merged])
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    some = touched.join(spans, "doc_id", "left").mapInArrow(cut, schema)
    text = F.coalesce("text", F.lit(""))
    none = untouched.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )
    return some.union(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
