"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which the tokenizer drops, so that a text
encodes as its words do, one after the other. Documents are read in blocks of about 8 MB. Of
each block the distinct words are dealt by hash to buckets, where each distinct
word is encoded once (the library is called once a word and bucket, for all blocks); the ids go
back to the block by position, and the documents are put together there.
Decoding joins the distinct ids of each block to the table of pieces (as long as the vocabulary, so its
size is bounded); the pieces go to the block with its words, and are put together as the library does without a decoder.

Words and ids travel in compressed lists, one row for each block and bucket. A
block's name is a digest of its contents: were an input to change between the
two passes over it, names would not meet and the job would fail, not go wrong.

Defined results for edge cases: null text encodes as empty text, to no ids;
special strings inside texts count as the library counts them by default; a
text is held in one block, however long;
repeated rows give repeated results; columns other than id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list
from marlstone.llm.token_counts import read_tokenizer
from marlstone.storage import materialize, partitions_for

BLOCK_BYTES = 8 << 20
#: Bytes of input (as stored) for each bucket of words.
BUCKET_BYTES = 8 << 20


def check_kind(config: dict) -> None:
    """The split at white space is proved for tokenizers that drop white space and have no decoder."""
    pre = json.dumps(config.get("pre_tokenizer") or {})
    if '"behavior": "Removed"' not in pre or config.get("decoder") is not None or config.get("post_processor") is not None:
        raise ValueError("this tokenizer does not drop white space, or has a decoder of its own")


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers as one compressed string, bytes of the same rank side by side."""
    import zstandard

    raw = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    raw += [np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def _expand(raw: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 8 * n, []
    for size in np.frombuffer(data, np.int64, n):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * size, at).reshape(4, size).T).view(np.uint32).ravel())
        at += 4 * size
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
            ids.append(i), texts.append(t or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _name(ids: list, texts: list[bytes]) -> str:
    import xxhash

    h = xxhash.xxh3_128(repr(ids).encode())
    for t in texts:
        h.update(len(t).to_bytes(8, "little"))
        h.update(t)
    return h.hexdigest()


def words_of_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, words): the distinct words of each block, by bucket, in order of first appearance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for ids, texts in _blocks(batches):
            words: dict[bytes, None] = {}
            for t in texts:
                words.update(dict.fromkeys(t.split()))
            parts: dict[int, list[bytes]] = {}
            for w in words:
                parts.setdefault(crc32(w) % buckets, []).append(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(ids, texts)] * len(parts), pa.string()), pa.array(list(parts), pa.int32()), pa.array([squeeze(b"\n".join(p)) for p in parts.values()], pa.binary())],
                names=["block", "bucket", "words"],
            )

    return rows.mapInArrow(run, "block string, bucket int, words binary")


def documents_of_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, payload): each block's documents as positions in its list of words; bucket is ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            words: dict[bytes, int] = {}
            sequences = [np.array([words.setdefault(w, len(words)) for w in t.split()], np.uint32) for t in texts]
            bucket = np.fromiter((crc32(w) % buckets for w in words), np.uint32, len(words))
            number = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
            payload = _squeeze(
                number & np.uint64(0xFFFFFFFF), number >> np.uint64(32), np.array([i is None for i in ids], np.uint32),
                np.array([len(s) for s in sequences], np.uint32), bucket, np.concatenate([*sequences, np.empty(0, np.uint32)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array([_name(ids, texts)]), pa.array([buckets], pa.int32()), pa.array([payload], pa.binary())], names=["block", "bucket", "payload"])

    return rows.mapInArrow(run, "block string, bucket int, payload binary")


def encode_words(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """(block, bucket, payload, ids): ids of each list of words, and which ids they are; each distinct word of a bucket is encoded once."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zstandard
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.no_padding(), tokenizer.no_truncation()
        known: dict[bytes, bytes] = {}  # the ids as 32-bit numbers
        current = None
        for batch in batches:
            out, used = [], []
            for bucket, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != current:
                    known, current = {}, bucket
                words = zstandard.ZstdDecompressor().decompress(raw).split(b"\n")
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 4096):
                    part = new[k : k + 4096]
                    for w, e in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)):
                        known[w] = np.array(e.ids, np.uint32).tobytes()
                found = [known[w] for w in words]
                ids = np.frombuffer(b"".join(found), np.uint32)
                out.append(_squeeze(np.array([len(x) // 4 for x in found], np.uint32), ids))
                used.append(np.unique(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(used, pa.list_(pa.int32()))], names=["block", "bucket", "payload", "ids"])

    return words.mapInArrow(run, "block string, bucket int, payload binary, ids array<int>")


def piece_table(spark: SparkSession, tokenizer_json: str) -> DataFrame:
    """(id, piece), one row an id of the vocabulary."""
    return spark.createDataFrame(list(enumerate(pieces(tokenizer_json))), "id int, piece string")


def distinct_ids(encoded: DataFrame) -> DataFrame:
    """(block, ids): the distinct ids of each block, of all its buckets; no more than the words of a block have, or than the vocabulary has."""
    return encoded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def pieces_of_blocks(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """(block, bucket, payload): the pieces of each block's distinct ids, by a join with the table of pieces; bucket is -1, so that they come first."""
    # an id may come from many buckets of a block, so these are put together before there is a row an id
    ids = distinct_ids(encoded).select("block", F.explode("ids").alias("id"))
    found = ids.join(F.broadcast(piece_table(encoded.sparkSession, tokenizer_json)), "id")  # as long as the vocabulary
    # a list is no longer than the vocabulary
    return found.groupBy("block").agg(F.to_json(F.collect_list(F.struct("id", "piece"))).cast("binary").alias("payload")).select("block", F.lit(-1).alias("bucket"), "payload")


def pieces(tokenizer_json: str) -> list[str]:
    """The id-to-piece table, added tokens included."""
    config = json.loads(tokenizer_json)
    table = {i: p for p, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def transcode(docs: DataFrame, tokenizer_json: str, emit: str = "digest") -> DataFrame:
    """Encode and decode every whole text.

    ``emit="digest"``: doc_id, n_tokens, ids_sha256, decoded_sha256;
    ``emit="texts"``: doc_id, n_tokens, ids (array of int), decoded (string).
    """
    check_kind(json.loads(tokenizer_json))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = partitions_for(rows, BUCKET_BYTES)
    words = words_of_blocks(rows, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    encoded = materialize(encode_words(words, tokenizer_json), "encoded-words")
    parts = encoded.drop("ids").union(pieces_of_blocks(encoded, tokenizer_json)).union(documents_of_blocks(rows, buckets))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, text_of, lists, current = {}, {}, {}, None
        for batch in batches:
            for block, bucket, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != current:
                    piece, lists, current = {}, {}, block
                if bucket < 0:
                    piece = {x["id"]: x["piece"] for x in json.loads(raw)}
                    text_of = {i: str(i) for i in piece}
                    continue
                if bucket < buckets:
                    lists[bucket] = raw
                    continue
                low, high, null, lengths, bucket_of, sequence = _expand(raw, 6)
                n = len(bucket_of)
                size, ids, as_text, as_piece = np.zeros(n, np.int64), [()] * n if emit == "texts" else None, [""] * n, [""] * n
                order, at = np.argsort(bucket_of, kind="stable"), 0
                for b in np.unique(bucket_of):
                    counts, values = _expand(lists[int(b)], 2)
                    own = order[at : at + len(counts)]
                    size[own] = counts
                    values, start = values.tolist(), 0
                    for k, end in zip(own.tolist(), np.cumsum(counts).tolist()):
                        x = values[start:end]
                        as_text[k], as_piece[k] = " ".join([text_of[i] for i in x]), " ".join([piece[i] for i in x])
                        if ids is not None:
                            ids[k] = x
                        start = end
                    at += len(counts)
                blank = bool((size == 0).any())
                doc_ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
                out, start = ([], [], []), 0
                for length in lengths.tolist():
                    part = sequence[start : start + length]
                    start += length
                    out[0].append(int(size[part].sum()))
                    words = (part[size[part] > 0] if blank else part).tolist()
                    decoded = " ".join([as_piece[w] for w in words])
                    if emit == "texts":
                        out[1].append([i for w in words for i in ids[w]])
                        out[2].append(decoded)
                    else:
                        out[1].append(hashlib.sha256(" ".join([as_text[w] for w in words]).encode()).hexdigest())
                        out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()) if emit == "texts" else pa.string()), pa.array(out[2], pa.string())],
                    names=["doc_id", "n_tokens", "ids" if emit == "texts" else "ids_sha256", "decoded" if emit == "texts" else "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded string" if emit == "texts" else "ids_sha256 string, decoded_sha256 string")
    return parts.repartition(2 * buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(assemble, schema)


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): a join of ids with the table of pieces, put back by position."""
    spark = encoded.sparkSession
    table = piece_table(spark, tokenizer_json)
    placed = encoded.select("doc_id", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    return placed.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return transcode(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
