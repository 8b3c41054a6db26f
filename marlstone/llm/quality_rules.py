"""Quality rules with host-level verdicts.

Per document: counts over the whole text. Per host: the share of documents
that fail the base rules, shrunk towards the corpus by a beta prior whose two
parameters are fitted to the hosts (method of moments). A host whose shrunk
rate is over ``max_host_rate`` is rejected, and its verdict is joined back.

Defined results for edge cases: a null or empty text has no words, so it fails
the base rules; a null host takes no part in host statistics, and its documents
are judged by the base rules alone; repeated rows count as separate documents;
columns other than id, text and host are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list, map_rows, salted_join
from marlstone.storage import materialize

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Most hosts for which the verdict table (id and flag) is broadcast; beyond it a salted join is used.
MAX_BROADCAST_HOSTS = 100_000

_SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, base_failed boolean"
)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words covered by windows of ``window`` words that occur twice or more in the list."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # the id of a window is built one word at a time; ids are made dense again before they could overflow
    key, size, base = seq[: n - window + 1].copy(), len(ids), len(ids)
    for k in range(1, window):
        if size * base >= 2**62:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * base + seq[k : n - window + 1 + k]
        size *= base
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.decode()) - spaces,
        sum(text.count(c) for c in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: host, counts and the base verdict."""

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [text_counts(t) for t in byte_list(batch.column(2))]
        table = np.array(rows, np.int64).reshape(len(rows), 5)
        failed = (table[:, 0] < 10) | (100 * table[:, 4] > 20 * table[:, 0])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(table[:, k]) for k in range(5)), pa.array(failed)],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")
    )
    return map_rows(rows, counts, _SCHEMA)


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk by an empirical beta prior.

    Hosts' rates p_i over n_i documents, N in all on k hosts, differ by chance and by host. The prior's mean
    m is the corpus' rate. With b = sum n_i (p_i - m)^2 / (k - 1) between hosts, w = sum n_i p_i (1 - p_i) / (N - k)
    within them and n0 = (N - sum n_i^2 / N) / (k - 1), the share of variance that hosts explain is
    r = (b - w) / (b + (n0 - 1) w), and the prior's strength s = 1 / r - 1, held between 1 and
    1000 (1000 when hosts differ by chance alone); the shrunk rate is
    (n_failed + m s) / (n_docs + s). One job over the hosts gives all sums.
    """
    hosts = (
        measured.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn"))
    prior = sums.withColumn("m", F.col("f") / F.col("n"))
    prior = prior.withColumn("b", F.try_divide(F.col("ff") - F.col("m") * F.col("f"), F.col("k") - 1)).withColumn("w", F.try_divide(F.col("f") - F.col("ff"), F.col("n") - F.col("k")))
    prior = prior.withColumn("n0", F.try_divide(F.col("n") - F.col("nn") / F.col("n"), F.col("k") - 1))
    prior = prior.withColumn("r", F.try_divide(F.col("b") - F.col("w"), F.col("b") + (F.col("n0") - 1) * F.col("w")))
    strength = F.when(F.col("r") > 0, F.least(F.greatest(1 / F.col("r") - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    # one row, so its broadcast is bounded
    return hosts.join(F.broadcast(prior.select("m", strength.alias("s"))), how="inner").select(
        "host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))).alias("rate")
    )


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """Measured rows plus ``host_rate`` and ``kept`` (base rules pass and the host is not rejected)."""
    measured = materialize(measure(docs, host), "rules")
    hosts = materialize(host_rates(measured), "hosts").select("host", F.col("rate").alias("host_rate"))
    if hosts.count() <= MAX_BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(hosts), "host", "left")
    else:
        joined = salted_join(measured, hosts, "host")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return joined.withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS g FROM w, range(1, len(words) - 3) r(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), m AS (
  SELECT w.doc_id, w.source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n_docs, sum(base_failed::INT) AS n_failed FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT count(*) AS k, sum(n_docs)::DOUBLE AS n, sum(n_failed) / sum(n_docs)::DOUBLE AS m FROM h
), q AS (
  SELECT any_value(m) AS m, sum(n_docs * power(n_failed / n_docs - m, 2)) / nullif(any_value(k) - 1, 0) AS b, sum(n_failed * (1 - n_failed / n_docs)) / nullif(any_value(n) - any_value(k), 0) AS w,
    (any_value(n) - sum(n_docs * n_docs) / any_value(n)) / nullif(any_value(k) - 1, 0) AS n0 FROM h, p
), s AS (
  SELECT m, CASE WHEN b > w THEN least(greatest((b + (n0 - 1) * w) / (b - w) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM q
), r AS (
  SELECT source, (n_failed + m * s) / (n_docs + s) AS rate FROM h, s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM b LEFT JOIN r USING (source)
"""
