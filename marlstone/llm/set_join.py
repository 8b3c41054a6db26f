"""Similarity join of shingle sets by vertical partitioning.

All shingles have one global order, from rare to frequent. The order is cut
into FRAGMENTS; each fragment counts, apart from the others, how many of its
shingles two sets share, and these partial overlaps are summed for each pair.

1. Texts with equal sets are one class. A class with more than
   100 - PERCENT hundredths of its shingles held by no other class cannot be
   linked. That is seen first on a fixed share of all shingles, chosen by value
   (an undercount, so no class that may be linked goes), then on all of them.
2. Two classes can only be linked if they share one of their rarest shingles
   (the prefix). Classes that meet in a prefix, directly or through others, form
   a group.
3. Classes are laid in tiles by group. A tile's overlaps are counted within it,
   fragment by fragment, as products of 0-1 matrices, and give the first links.
4. Groups larger than a tile are laid again, by the components so far, and
   tiles that share a prefix shingle are compared, unless all of both is one
   component already. A large group of near copies thus becomes one component
   within tiles, and its pairs are never listed.

Sets are of 64-bit hashes of shingles; classes are known by 128-bit digests of them.

Defined results for edge cases: null and empty texts and texts without a word
have an empty set, size 0, and are linked with nothing, not even each other;
repeated rows share a component; a row with a null id never names a component;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm import bloom
from marlstone.llm.common import byte_list, map_rows, mix64
from marlstone.llm.components import connected_components
from marlstone.llm.linking import link_groups, spanning
from marlstone.storage import materialize, partitions_for, release

SHINGLE = 4
#: Least Jaccard similarity, in hundredths.
PERCENT = 85
FRAGMENTS = 8
#: Most classes and shingles of a tile; a class with more shingles has a tile of its own.
TILE = 256
TILE_SHINGLES = 1 << 18
#: Share of all shingles that the first sieve looks at.
SIEVE = 0.25
#: Words whose hashes a task keeps.
WORDS = 500_000
_FACTOR = 0x9E3779B97F4A7C15
_SEGMENT = "tile long, fragment int, nums binary, sizes binary, roots binary, comps binary, slots binary, tokens binary"
_COUNTS = "left long, right long, left_nums binary, right_nums binary, left_sizes binary, right_sizes binary, i binary, j binary, n binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_set(text: bytes | None, hashes: dict, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes (uint64, ascending) of the word shingles of a text; of its whole sequence if that is shorter; none without a word."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(_FACTOR) + h[j : len(h) - k + 1 + j]
    return np.unique(mix64(out))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, set, owner, n): digest of each document's set, its first 64 bits, and the set's size."""
    hashes = _WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, hashes, shingle) for t in byte_list(batch.column(2))]
        names = [_digest(s) for s in sets]
        owner = np.frombuffer(b"".join(names), np.int64)[::2]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(owner), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "text_key", "set", "owner", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, text_key long, set binary, owner long, n long")


def _unshared(docs: DataFrame, shingle: int, share: float) -> DataFrame:
    """(owner, u): how many of a class's shingles, among a share of all chosen by value, no other class has."""
    hashes, limit = _WordHashes(), np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, tokens = [], [np.empty(0, np.uint64)]
        for t in byte_list(batch.column(0)):
            s = shingle_set(t, hashes, shingle)
            tokens.append(s[: np.searchsorted(s, limit, "right")])
            owners.append(int.from_bytes(_digest(s)[:8], "little", signed=True))
        owner = np.repeat(np.array(owners, np.int64), [len(t) for t in tokens[1:]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(owner)], names=["token", "owner"])

    held = map_rows(docs.select(F.col("text").cast("string").alias("text")), run, "token long, owner long").groupBy("token").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return held.where("owner = other").groupBy("owner").agg(F.count(F.lit(1)).alias("u"))


def _may_link(n, shared, percent: int):
    return 100 * shared >= percent * n


def _with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(text_key, text) of the documents, without most of those whose key is not among ``keys``, so that their texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.might_hold(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    return docs.select(F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "text_key long, text string")


def _candidates(docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(num, set, n, pos, tokens) of each class that may be linked: its shingles that others have, in the global order, and their places in it."""
    sizes = sets.where("n > 0").groupBy("set", "owner").agg(F.first("n").alias("n"), F.min("text_key").alias("text_key"))
    first = sizes.join(_unshared(docs, shingle, SIEVE), "owner", "left")
    first = materialize(first.where(_may_link(F.col("n"), F.col("n") - F.coalesce("u", F.lit(0)), percent)).select("set", "n", "text_key"), "sieved")
    texts = _with_keys(docs, first.select("text_key")).join(first, "text_key").groupBy("set").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    hashes = _WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [shingle_set(t, hashes, shingle) for t in byte_list(batch.column(2))]
        # another text may have the same key
        same = [_digest(s) == name.as_py() for s, name in zip(tokens, batch.column(0))]
        arrays = pa.array([s.view(np.int64) if ok else None for s, ok in zip(tokens, same)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays], names=["set", "n", "tokens"])

    held = map_rows(texts, run, "set binary, n long, tokens array<long>").where("tokens IS NOT NULL")
    held = materialize(held.select(F.monotonically_increasing_id().alias("num"), "set", "n", "tokens"), "candidate-sets")
    each = held.select("num", F.explode("tokens").alias("token"))
    shared = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-shingles")
    # the place of a shingle: its frequency, then its hash as a fraction of 1
    pos = F.col("df") + F.shiftrightunsigned("token", 11).cast("double") / float(1 << 53)
    lists = each.join(shared, "token").groupBy("num").agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), "token"))).alias("s"))
    ordered = held.select("num", "set", "n").join(lists, "num").where(_may_link(F.col("n"), F.size("s"), percent))
    out = materialize(ordered.select("num", "set", "n", F.col("s.pos").alias("pos"), F.col("s.token").alias("tokens")), "ordered-sets")
    for old in (first, held, shared):
        release(old)
    return out


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(num, token): of a class of n shingles the n - ceil(n PERCENT / 100) + 1 first in the global order, those that no other class has left out."""
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("tokens"))
    return classes.select("num", F.explode(F.slice("tokens", F.lit(1), length.cast("int"))).alias("token"))


def _meet(one: pa.Table, two: pa.Table | None):
    n = len(one) if two is None else 2  # two tiles of one shingle need one link
    return np.zeros(n - 1, np.int64), np.arange(1, n) if two is None else np.array([len(one)])


def _segments(classes: DataFrame, cuts: list[float], partitions: int) -> DataFrame:
    """Tiles of classes in order of (root, comp, num), one row for each tile and fragment: who is in the tile, and which shingles of the fragment each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        task, number = pyspark.TaskContext.get().partitionId(), 0
        rows, size = [], 0

        def tile() -> pa.RecordBatch:
            nonlocal number, rows, size
            nums, sizes, roots, comps = (np.array([r[k] for r in rows], np.int64).tobytes() for k in range(4))
            lengths = [len(r[5]) for r in rows]
            slots, pos, tokens = np.repeat(np.arange(len(rows), dtype=np.int32), lengths), np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows])
            fragment = np.searchsorted(cuts, pos, "right")
            out = [(task << 40 | number, int(f), nums, sizes, roots, comps, slots[own].tobytes(), tokens[own].tobytes()) for f in np.unique(fragment) for own in [fragment == f]]
            number, rows, size = number + 1, [], 0
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["tile", "fragment", "nums", "sizes", "roots", "comps", "slots", "tokens"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for k in range(batch.num_rows):
                row = (*(c[k] for c in columns), *(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (4, 5)))
                new_root = rows and rows[-1][2] != row[2]
                if rows and (len(rows) >= TILE or size + len(row[5]) > TILE_SHINGLES or new_root and len(rows) >= TILE // 2):
                    yield tile()
                rows.append(row)
                size += len(row[5])
        if rows:
            yield tile()

    ranged = classes.select("num", "n", "root", "comp", "pos", "tokens").repartitionByRange(partitions, "root", "comp", "num").sortWithinPartitions("root", "comp", "num")
    return materialize(ranged.mapInArrow(run, _SEGMENT), "segments")


def _products(lt, ls, nl: int, rt, rs, nr: int, columns: int = 2048) -> np.ndarray:
    """Number of common tokens of each left and right set; without right ones, of the left ones among each other."""
    if rt is None:
        values, counts = np.unique(lt, return_counts=True)
        values = values[counts > 1]
    else:
        values = np.intersect1d(lt, rt)
    out = np.zeros((nl, nl if rt is None else nr), np.float32)

    def presence(tokens, slots, n: int, part) -> np.ndarray:
        at = np.searchsorted(part, tokens)
        good = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == tokens)
        m = np.zeros((n, len(part)), np.float32)
        m[slots[good], at[good]] = 1
        return m

    for k in range(0, len(values), columns):
        part = values[k : k + columns]
        left = presence(lt, ls, nl, part)
        out += left @ (left if rt is None else presence(rt, rs, nr, part)).T
    return out


def _overlaps(units: DataFrame, percent: int) -> DataFrame:
    """Partial overlaps of one fragment and pair of tiles a row, for pairs of one group and two components whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["left"] == row["right"]
                left, right = ({c: np.frombuffer(row[side + c], np.int32 if c == "slots" else np.int64) for c in ("nums", "sizes", "roots", "comps", "slots", "tokens")} for side in (("l_", "l_") if same else ("l_", "r_")))
                a, b = left["sizes"][:, None], right["sizes"][None, :]
                good = (left["roots"][:, None] == right["roots"][None, :]) & (left["comps"][:, None] != right["comps"][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if same:
                    good = np.triu(good, 1)
                if not good.any():
                    continue
                n = _products(left["tokens"], left["slots"], len(a), None if same else right["tokens"], right["slots"], b.shape[1])
                i, j = np.nonzero(good & (n > 0))
                if len(i):
                    blobs = [row["l_nums"], right["nums"].tobytes(), row["l_sizes"], right["sizes"].tobytes(), i.astype(np.uint16).tobytes(), j.astype(np.uint16).tobytes(), n[i, j].astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([row["left"]], pa.int64()), pa.array([row["right"]], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=["left", "right", "left_nums", "right_nums", "left_sizes", "right_sizes", "i", "j", "n"])

    return units.mapInArrow(run, _COUNTS)


def _linked(counts: DataFrame, percent: int) -> DataFrame:
    """Sums the partial overlaps of each pair, and returns a forest (a, b) of the pairs that are similar enough, for each pair of tiles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        left, right, a, b = (np.frombuffer(first[c], np.int64) for c in ("left_nums", "right_nums", "left_sizes", "right_sizes"))
        total = np.zeros((len(left), len(right)), np.int64)
        for i, j, n in zip(rows["i"], rows["j"], rows["n"]):
            total[np.frombuffer(i, np.uint16), np.frombuffer(j, np.uint16)] += np.frombuffer(n, np.int32)
        i, j = np.nonzero((total > 0) & (100 * total >= percent * (a[:, None] + b[None, :] - total)))
        nums, numbers = np.unique(np.concatenate([left, right]), return_inverse=True)
        member, root = spanning(len(nums), numbers[i], numbers[len(left) + j])
        return pd.DataFrame({"a": nums[member], "b": nums[root]})

    return counts.groupBy("left", "right").applyInPandas(run, "a long, b long")


_FIELDS = ("nums", "sizes", "roots", "comps", "slots", "tokens")


def _within(segments: DataFrame) -> DataFrame:
    return segments.select(F.col("tile").alias("left"), F.col("tile").alias("right"), *[F.col(c).alias(f"l_{c}") for c in _FIELDS], *[F.lit(None).cast("binary").alias(f"r_{c}") for c in _FIELDS])


def _across(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    left = segments.select(F.col("tile").alias("left"), "fragment", *[F.col(c).alias(f"l_{c}") for c in _FIELDS])
    right = segments.select(F.col("tile").alias("right"), "fragment", *[F.col(c).alias(f"r_{c}") for c in _FIELDS])
    return pairs.join(left, "left").join(right, ["right", "fragment"]).select("left", "right", *[f"l_{c}" for c in _FIELDS], *[f"r_{c}" for c in _FIELDS])


def _places(segments: DataFrame) -> DataFrame:
    """(num, tile, root, comp) of every class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [[np.frombuffer(x, np.int64) for x in batch.column(k).to_pylist()] for k in range(1, 4)]
        tile = np.repeat(batch.column(0).to_numpy(), [len(x) for x in arrays[0]])
        nums, roots, comps = (np.concatenate(x) for x in arrays)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (nums, tile, roots, comps)], names=["num", "tile", "root", "comp"])

    return map_rows(segments.groupBy("tile").agg(*[F.first(c).alias(c) for c in ("nums", "roots", "comps")]), run, "num long, tile long, root long, comp long")


def _links(classes: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) over the classes' nums: components of all links; None without any candidate."""
    prefixes = materialize(_prefixes(classes, percent), "prefixes")
    groups = connected_components(link_groups(prefixes.select(F.col("token").cast("string").alias("key"), F.col("num").alias("id")), _meet, partitions_for(prefixes, 1 << 18)))
    grouped = materialize(classes.join(groups.withColumnRenamed("node", "num"), "num").select("num", "n", "root", "pos", "tokens"), "grouped-sets")
    shares = [k / FRAGMENTS for k in range(1, FRAGMENTS)]
    cuts = grouped.select(F.explode("pos").alias("pos")).agg(F.percentile_approx("pos", shares, 1000)).first()[0]
    if cuts is None:
        return None
    partitions = partitions_for(grouped, 4 << 20)
    segments = _segments(grouped.withColumn("comp", F.col("num")), cuts, partitions)
    near = materialize(connected_components(_linked(_overlaps(_within(segments), percent), percent)), "near")
    # groups that one tile does not hold, laid by the components so far
    wide = _places(segments).groupBy("root").agg(F.min("tile").alias("low"), F.max("tile").alias("high")).where("low < high").select("root")
    wide = materialize(wide, "wide-groups")
    release(segments)
    if not wide.limit(1).count():
        return near
    again = grouped.join(wide, "root", "left_semi").join(near.select(F.col("node").alias("num"), F.col("root").alias("comp")), "num", "left")
    segments = _segments(again.withColumn("comp", F.coalesce("comp", "num")), cuts, partitions)
    places = materialize(_places(segments), "places")
    pure = places.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    held = materialize(prefixes.join(places.select("num", "tile"), "num").select("token", "tile").distinct().join(pure, "tile"), "prefix-tiles")
    one, two = held.alias("one"), held.alias("two")
    settled = (F.col("one.low") == F.col("one.high")) & (F.col("two.low") == F.col("two.high")) & (F.col("one.low") == F.col("two.low"))
    met = one.join(two, (F.col("one.token") == F.col("two.token")) & (F.col("one.tile") <= F.col("two.tile")) & ~settled)
    pairs = materialize(met.select(F.col("one.tile").alias("left"), F.col("two.tile").alias("right")).distinct(), "tile-pairs")
    links = _linked(_overlaps(_across(segments, pairs), percent), percent)
    out = materialize(connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "components")
    for old in (segments, places, held, pairs):
        release(old)
    return out


def join_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links of Jaccard similarity percent / 100 or more."""
    sets = materialize(_sets(docs, shingle), "sets")
    classes = _candidates(docs, sets, shingle, percent)
    linked = _links(classes, percent)
    named = sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("id"))
    if linked is None:
        named = named.withColumnRenamed("id", "component")
    else:
        members = classes.select("num", "set").join(linked.select(F.col("node").alias("num"), "root"), "num").select("set", "root")
        known = named.join(members, "set", "left")
        least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
        named = known.join(least, "root", "left").select("set", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component"))
    named = materialize(named, "set-components")
    return sets.join(named, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
