"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone by the
tokenizers library; the strings that come back as one token form the
whole-token set. On the executors, texts are cut into pre-tokens, those in the
set count one token without any merging, and only the distinct rest is merged
by the library (with a bounded cache per task).

The cut uses the public split pattern of byte-level BPE. It is proved against
the library's own cut for each code point on the driver; a text with a code point for which
the two differ (another Unicode version) is counted by the library as a whole.

Defined results for edge cases: null or empty text has 0 bytes and 0 tokens;
special strings inside a text count as the library counts them by default;
repeated rows give repeated results; columns other than id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list

#: Fixed value: the pattern that cuts text into pre-tokens in byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text cut before the rest is merged, and entries of a task's cache.
CHUNK_BYTES, CACHE_ENTRIES = 1 << 20, 500_000
#: Code points whose class is compared one by one; all others go to the library.
PROVED = ((0x0, 0xD800), (0xE000, 0x33480), (0xE0000, 0xE01F0))


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def is_supported(config: dict) -> bool:
    """Whether the shortcut is proved for this kind of file: byte-level BPE with plain special tokens."""
    pre = config.get("pre_tokenizer") or {}
    return (
        config.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and config.get("post_processor") is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in config.get("added_tokens", []))
    )


def whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    import regex
    from tokenizers import Tokenizer

    cut, chars = regex.compile(PATTERN), byte_chars()
    texts = []
    for piece in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            text = bytes(chars[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if cut.findall(text) == [text]:
            texts.append(text)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = True
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1)


@functools.lru_cache(4)
def unproved(tokenizer_json: str) -> np.ndarray:
    """For each code point, whether the library and the pattern may cut it differently."""
    import regex
    from tokenizers import Tokenizer

    cut, pre = regex.compile(PATTERN), Tokenizer.from_str(tokenizer_json).pre_tokenizer
    out = np.ones(0x110000, bool)
    for low, high in PROVED:
        for c in range(low, high):
            probe = "a{0}1{0}!{0} {0}\n{0}".format(chr(c))
            out[c] = [x[1] for x in pre.pre_tokenize_str(probe)] != [m.span() for m in cut.finditer(probe)]
    return out


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    spark = docs.sparkSession
    config = json.loads(tokenizer_json)
    if is_supported(config):
        shared = spark.sparkContext.broadcast((tokenizer_json, whole_tokens(tokenizer_json), unproved(tokenizer_json)))
    else:
        shared = spark.sparkContext.broadcast((tokenizer_json, frozenset(), np.ones(0x110000, bool)))
    specials = [t["content"] for t in config.get("added_tokens", [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        source, whole, odd = shared.value
        library, merger = Tokenizer.from_str(source), Tokenizer.from_str(source)
        library.no_padding(), library.no_truncation(), merger.no_padding(), merger.no_truncation()
        merger.encode_special_tokens = True
        merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        cut = regex.compile(PATTERN).findall
        run_of_spaces = regex.compile(r" \s").search
        special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        extra: dict[str, int] = {}  # tokens of a pre-token that is not whole, less one
        after_space: dict[str, int] = {}  # tokens of what stands between two spaces, with the space before it

        def pieces_count(pieces: list[str]) -> int:
            return len(pieces) + sum(extra[p] for p in pieces if p not in whole)

        def counted(texts: list[bytes]) -> list[int]:
            todo, units, loose = [], set(), []
            for raw in texts:
                text = raw.decode()
                if not whole or not text.isascii() and odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                    todo.append(len(library.encode(text, add_special_tokens=False).ids))
                    continue
                parts = special.split(text) if special and any(s in text for s in specials) else [text]
                rows = []
                for part in parts:
                    if part.endswith(" ") or run_of_spaces(part):
                        first, rest = cut(part), []
                    else:  # each single space goes to the pre-token after it, so the text falls apart there
                        head, *rest = part.split(" ")
                        first = cut(head)
                    rows.append((first, rest))
                    loose += first
                    units.update(rest)
                todo.append((len(parts) - 1, rows))
            if len(after_space) > CACHE_ENTRIES:
                after_space.clear()
            if len(extra) > CACHE_ENTRIES:
                extra.clear()
            new = {u: cut(" " + u) for u in units if u not in after_space}
            unknown = {p for pieces in (*new.values(), loose) for p in pieces if p not in whole and p not in extra}
            if unknown:
                unknown = list(unknown)
                for p, e in zip(unknown, merger.encode_batch(unknown, add_special_tokens=False)):
                    extra[p] = len(e.ids) - 1
            for u, pieces in new.items():
                after_space[u] = pieces_count(pieces)
            return [
                x if isinstance(x, int) else x[0] + sum(pieces_count(first) + sum(map(after_space.__getitem__, rest)) for first, rest in x[1])
                for x in todo
            ]

        for batch in batches:
            texts = [t or b"" for t in byte_list(batch.column(1))]
            counts, chunk, size = [], [], 0
            for t in texts:
                chunk.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    counts += counted(chunk)
                    chunk, size = [], 0
            counts += counted(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text; it is read on the driver and shipped with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
