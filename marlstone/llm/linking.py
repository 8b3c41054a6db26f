"""Comparison of all members of a group with each other, for groups of any size.

Members are range-partitioned by group, so that a large group spreads over many
tasks. A group that lies within one task and one tile is compared at once;
larger ones are cut into tiles, and pairs of tiles are compared as separate
rows of a join. A comparison returns a spanning forest of the links that it
finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marlstone.storage import materialize

#: A linker gets the rows of one tile, or of two, as Arrow tables, and returns index pairs (left row, right row) of a spanning forest.
Linker = Callable[[pa.Table, pa.Table | None], tuple[np.ndarray, np.ndarray]]


#: Whether the rows of each pair (left row, right row) may be linked at all.
PairFilter = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Tiles of a block; a task holds those of two blocks at a time.
BLOCK = 8


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for the links (i, j) among n members."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of fingerprints (uint64) at ``radius`` or fewer differing bits.

    Indices into ``a`` followed by ``b``; without ``b`` the pairs within ``a``.
    """
    other, shift = (a, 0) if b is None else (b, len(a))
    n = len(a) if b is None else len(a) + len(b)
    found_i, found_j, held = [], [], 0
    for k in range(0, len(a), rows):
        block = a[k : k + rows]
        right = other[k:] if b is None else other
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ right[None, :]) <= radius)
        j = j + (k if b is None else 0)
        i = i + k
        if b is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            found_i.append(i)
            found_j.append(j + shift)
            held += len(i)
            if held > 4 * n + 10_000:
                i, j = spanning(n, np.concatenate(found_i), np.concatenate(found_j))
                found_i, found_j, held = [i], [j], len(i)
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(n, np.concatenate(found_i), np.concatenate(found_j))


def _words(fps: np.ndarray | None) -> list[np.ndarray]:
    """The 64-bit words of fingerprints (uint64, one or several words a row), word by word."""
    return [] if fps is None else [np.ascontiguousarray(w) for w in fps.reshape(len(fps), -1).T] if len(fps) else [fps.ravel()]


def nearest_forest(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64, may_link: PairFilter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``near``, but each link is itself a pair within ``radius`` that passes ``may_link``, and the links of a component are the shortest that hold it together. A row may have several words."""
    shift, one = 0 if b is None else len(a), _words(a)
    two = one if b is None else _words(b)
    n = len(a) if b is None else len(a) + len(b)
    none = np.empty(0, np.int64)
    i, j, d, fresh, held = none, none, none, [], 0
    for k in range(0, len(a), rows):
        low = k if b is None else 0
        bits = sum(np.bitwise_count(x[k : k + rows, None] ^ y[None, low:]) for x, y in zip(one, two))
        x, y = np.nonzero(bits <= radius)
        far = bits[x, y].astype(np.int64)
        x, y = x + k, y + (k if b is None else shift)
        if b is None:
            x, y, far = x[x < y], y[x < y], far[x < y]
        if may_link is not None:
            good = may_link(x, y)
            x, y, far = x[good], y[good], far[good]
        fresh.append((x, y, far))
        held += len(x)
        if held > 4 * n + 10_000 or k + rows >= len(a):
            i, j, d = (np.concatenate([old, *(f[c] for f in fresh)]) for c, old in enumerate((i, j, d)))
            keep = _shortest(n, i, j, d)
            i, j, d, fresh, held = i[keep], j[keep], d[keep], [], 0
    return i, j


def _shortest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Numbers of the links that form a forest of least total length: each component takes its shortest link out, until none has one."""
    label, rank = np.arange(n), np.empty(len(d), np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(d))  # no two links are equally long
    by_rank, picked, open_ = np.argsort(rank), [], np.arange(len(d))
    while True:
        open_ = open_[label[i[open_]] != label[j[open_]]]
        if not len(open_):
            return np.concatenate(picked) if picked else np.empty(0, np.int64)
        least = np.full(n, len(d))
        for end in (i, j):
            np.minimum.at(least, label[end[open_]], rank[open_])
        new = by_rank[np.unique(least[least < len(d)])]
        picked.append(new)
        members, roots = spanning(n, label[i[new]], label[j[new]])
        step = np.arange(n)
        step[members] = roots
        label = step[label]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _edges(ids: pa.ChunkedArray | pa.Array, i: np.ndarray, j: np.ndarray):
    return ids.take(pa.array(i)), ids.take(pa.array(j))


#: Links of many small groups at once: from a table and all pairs (left row, right row) within its groups, those of a spanning forest.
PairLinker = Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Most rows of a small group.
SMALL = 24


def pairs_within(lows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within groups of ``sizes`` rows that begin at ``lows``."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        begin = lows[sizes == size][:, None]
        left.append((begin + i).ravel())
        right.append((begin + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def nearest_of(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest links that hold together what the pairs (i, j) within ``radius`` join."""
    d = sum(np.bitwise_count(w[i] ^ w[j]) for w in _words(fps)).astype(np.int64)
    good = d <= radius
    i, j, d = i[good], j[good], d[good]
    keep = _shortest(len(fps), i, j, d)
    return i[keep], j[keep]


def link_groups(members: DataFrame, linker: Linker, partitions: int, tile_rows: int = 2048, tile_bytes: int = 4 << 20, of_pairs: PairLinker | None = None) -> DataFrame:
    """Edges (a, b) between ids, from ``members`` with columns (key, id, ...).

    ``linker`` sees the columns after ``key``. Members of one key are compared
    with each other, whatever their number; with ``of_pairs`` the small groups of a batch go to it together.
    What is kept for the result stays until ``release``.
    """
    id_type = members.schema["id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        is_first, number = True, 0

        def out(a, b, key, tile, blob):
            n = len(a) if a is not None else 1
            a, b = (a, b) if a is not None else (pa.nulls(1, id_kind), pa.nulls(1, id_kind))
            a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
            return pa.RecordBatch.from_arrays(
                [a, b, pa.array([key] * n, pa.string()), pa.array([tile] * n, pa.string()), pa.array([blob] * n, pa.binary())],
                names=["a", "b", "key", "tile", "blob"],
            )

        def close(key: str, last: bool) -> Iterator[pa.RecordBatch]:
            """The group is over; the first and last of a partition may go on in another one."""
            nonlocal held, is_first, number
            group = pa.concat_tables(held)
            held = []
            whole = not (is_first or last) and number_of_tiles(key) == 0
            is_first = False
            if whole:
                if len(group) > 1:
                    i, j = linker(group, None)
                    if len(i):
                        yield out(*_edges(group["id"], i, j), None, None, None)
            else:
                yield tile_row(key, group)
            tiles.pop(key, None)

        tiles: dict[str, int] = {}

        def number_of_tiles(key: str) -> int:
            return tiles.get(key, 0)

        def tile_row(key: str, group: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            tiles[key] = tiles.get(key, 0) + 1
            return out(None, None, key, f"{task}-{number}", _pack(group))

        import pyspark

        task, key, id_kind = pyspark.TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rest = batch.column(0).cast(pa.string()), pa.Table.from_batches([batch.select(batch.schema.names[1:])])
            id_kind = rest.schema.field("id").type
            codes = keys.dictionary_encode()
            change = np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1
            lows, highs = np.array([0, *change], np.int64), np.array([*change, len(keys)], np.int64)
            # a group of one row within a batch has no pairs; the first and last may go on in other batches
            some = highs - lows > 1
            some[[0, -1]] = True
            if of_pairs is not None:
                small = some & (highs - lows <= SMALL)
                small[[0, -1]] = False
                if small.any():
                    some &= ~small
                    i, j = of_pairs(rest, *pairs_within(lows[small], (highs - lows)[small]))
                    if len(i):
                        yield out(*_edges(rest["id"], i, j), None, None, None)
            for low, high in zip(lows[some], highs[some]):
                this = keys[int(low)].as_py()
                if key is not None and this != key:
                    yield from close(key, False)
                key = this
                held.append(rest.slice(low, high - low))
                size = sum(len(t) for t in held)
                while size >= tile_rows or sum(t.nbytes for t in held) >= tile_bytes and size > 1:
                    group = pa.concat_tables(held)
                    cut = min(tile_rows, max(1, int(len(group) * tile_bytes / max(1, group.nbytes))))
                    yield tile_row(key, group.slice(0, cut))
                    held = [group.slice(cut)] if cut < len(group) else []
                    size = len(group) - cut
                    if not held:
                        held = [group.slice(0, 0)]
                        break
        if key is not None:
            yield from close(key, True)

    ranged = members.repartitionByRange(partitions, "key", "id").sortWithinPartitions("key", "id")
    found = materialize(ranged.mapInArrow(first, f"a {id_type}, b {id_type}, key string, tile string, blob binary"), "linked")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(held: list[tuple[bool, pa.Table]]) -> Iterator[pa.RecordBatch]:
            left = [t for is_left, t in held if is_left]
            right = [t for is_left, t in held if not is_left]
            within = [(one, None) for one in left] + [(one, two) for k, one in enumerate(left) for two in left[:k]]
            for one, two in within if not right else [(one, two) for one in left for two in right]:
                i, j = linker(one, two)
                if len(i):
                    ids = one["id"] if two is None else pa.chunked_array([*one["id"].chunks, *two["id"].chunks])
                    a, b = _edges(ids, i, j)
                    yield pa.RecordBatch.from_arrays([a.combine_chunks(), b.combine_chunks()], names=["a", "b"])

        current, held = None, []
        for batch in batches:
            for key, low, high, is_left, blob in zip(*(batch.column(k) for k in range(5))):
                this = key.as_py(), low.as_py(), high.as_py()
                if this != current:
                    yield from compare(held)
                    current, held = this, []
                if len(tile := _unpack(blob.as_py())):
                    held.append((is_left.as_py(), tile))
        yield from compare(held)

    # the tiles of a group are dealt to blocks, and each pair of blocks is one unit of work: a tile is shuffled once for each block, not once for each tile
    tiles = found.where(F.col("tile").isNotNull()).select("key", "tile")
    own = Window.partitionBy("key")
    block = F.floor((F.row_number().over(own.orderBy("tile")) - 1) / BLOCK).cast("int")
    numbered = tiles.withColumn("block", block).withColumn("blocks", F.max("block").over(own) + 1)
    blobs = found.where(F.col("tile").isNotNull()).select("key", "tile", "blob").join(numbered, ["key", "tile"])
    placed = blobs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("is_left"), "blob"
    )
    linked = placed.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(second, f"a {id_type}, b {id_type}")
    out = found.where(F.col("tile").isNull()).select("a", "b").union(linked)
    out._marlstone_path = found._marlstone_path
    return out
