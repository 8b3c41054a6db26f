"""Language identification with string kernels.

Kernel: blended-spectrum presence kernel over the characters of the
lower-cased text. k(x, y) is the number of distinct strings of 2, 3 and 4 characters
(by 32-bit hashes) that x and y share, divided by the square root of k(x, x) k(y, y). Nystroem:
the kernel against ``landmarks`` texts stands for the whole kernel matrix.
Classifier: one-versus-rest kernel ridge regression on the Nystroem features.
Scoring: presence matrix of a batch times the landmarks' presence matrix times
the coefficients.

Learning uses a bounded sample: about ``landmarks`` landmark texts of at most
``max_landmark_bytes`` bytes (a language with too few so short has pieces of its longer ones too) and about ``train_rows`` training rows, drawn by a hash of
the id, evenly over the languages. Every label is learned: with many languages
both samples grow to LEAST_LANDMARKS landmark texts and LEAST_ROWS training rows
a language, and the presence matrix with them. The kernel rows of the training texts are
computed on the executors over whole texts.

Defined results for edge cases: null text or a text without a letter gives
``und`` and score 0; without any labelled text all rows do; null labels and
null ids are not learned from; held_out of a null id is false; repeated rows
give repeated results; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.llm.common import crc_mod

ORDERS = (2, 3, 4)
UNKNOWN = "und"
BATCH = 64
#: Landmark texts and training rows of a language, at least, however many languages there are.
LEAST_LANDMARKS = 4
LEAST_ROWS = 16


def grams(text: str) -> list[np.ndarray]:
    """Sorted distinct strings of each order, as 32-bit hashes."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, g = [], a
    for n in range(2, max(ORDERS) + 1):
        g = g[:-1] * np.uint32(0x9E3779B1) + a[n - 1 :] if len(a) >= n else np.empty(0, np.uint32)
        if n in ORDERS:
            s = g ^ (g >> np.uint32(15))
            s = s * np.uint32(0x85EBCA6B)
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


class Landmarks:
    """Presence matrix of the landmark texts over their own vocabulary."""

    def __init__(self, texts: list[str]):
        found = [grams(t) for t in texts]
        self.vocabulary = [np.unique(np.concatenate([f[k] for f in found])) for k in range(len(ORDERS))]
        self.starts = np.concatenate(([0], np.cumsum([len(v) for v in self.vocabulary])))
        self.presence = np.zeros((len(texts), self.starts[-1]), np.float32)
        for row, f in enumerate(found):
            self.presence[row, self.columns(f)] = 1
        self.norms = np.sqrt(np.maximum(1, self.presence.sum(1)))

    def columns(self, found: list[np.ndarray]) -> np.ndarray:
        out = []
        for vocabulary, start, u in zip(self.vocabulary, self.starts, found):
            if len(u) and len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, u), len(vocabulary) - 1)
                out.append(at[vocabulary[at] == u] + start)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel of the texts (rows) against the landmarks (columns)."""
        presence, norms = np.zeros((len(texts), self.starts[-1]), np.float32), np.ones(len(texts))
        for row, text in enumerate(texts):
            found = grams(text)
            presence[row, self.columns(found)] = 1
            norms[row] = np.sqrt(max(1, sum(map(len, found))))
        return (presence @ self.presence.T) / (norms[:, None] * self.norms[None, :])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _share(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000.0


def _draw(train: DataFrame, counts: dict[str, int], each: int, seed: int) -> DataFrame:
    """About ``each`` rows of each language, chosen by a hash of the id."""
    rates = train.sparkSession.createDataFrame([(lang, min(1.0, 1.3 * each / n + 10 / n)) for lang, n in counts.items()], "lang string, rate double")
    return train.join(F.broadcast(rates), "lang").where(_share(seed) < F.col("rate"))


def learn(docs: DataFrame, landmarks: int = 128, train_rows: int = 2048, ridge: float = 0.1, max_landmark_bytes: int = 8192):
    """The model as (languages, Landmarks, coefficients), or None without labelled text."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod(F.col("doc_id"), 5) != 0))
    found = train.groupBy("lang").count().collect()
    if not found:
        return None
    counts = {r["lang"]: r["count"] for r in sorted(found, key=lambda r: r["lang"])}
    each, trained = max(LEAST_LANDMARKS, landmarks // len(counts)), max(LEAST_ROWS, train_rows // len(counts))
    drawn = _draw(train, counts, 4 * each, 1).select("lang", "text", F.octet_length("text").alias("size"), _share(3).alias("draw"))
    rows = drawn.where(F.col("size") <= max_landmark_bytes).select("lang", "text", "draw").collect()
    short = [lang for lang in counts if len({r["text"] for r in rows if r["lang"] == lang}) < each]
    if short:
        # a piece from anywhere in each longer text
        most = max_landmark_bytes // 4
        begin = 1 + F.pmod(F.xxhash64("text"), F.length("text") - most).cast("int")
        longer = drawn.where((F.col("size") > max_landmark_bytes) & F.col("lang").isin(short) & (F.length("text") > most))
        rows += longer.select("lang", F.col("text").substr(begin, F.lit(most)).alias("text"), (F.col("draw") + 1).alias("draw")).collect()
    texts: list[str] = []
    for lang in counts:
        # at random, copies once, and longer ones first, as they hold more
        own = {r["text"]: None for r in sorted(rows, key=lambda r: (len(r["text"]) < 200, r["draw"], r["text"])) if r["lang"] == lang}
        texts += list(own)[:each]
    index = Landmarks(texts)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).to_pylist()
            for k in range(0, len(texts), BATCH):
                values = shared.value.kernel(texts[k : k + BATCH]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([langs[k : k + BATCH], pa.array([v.tobytes() for v in values], pa.binary())], names=["lang", "row"])

    sample = _draw(train, counts, trained, 2).select("lang", "text").mapInArrow(kernel_rows, "lang string, row binary").collect()
    languages = list(counts)
    kernel = np.array([np.frombuffer(r["row"], np.float32) for r in sample], float).reshape(len(sample), len(texts))
    own = (index.presence @ index.presence.T) / np.outer(index.norms, index.norms)
    values, vectors = np.linalg.eigh(own.astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    labels = np.array([languages.index(r["lang"]) for r in sample], int)
    target = np.where(labels[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = np.bincount(labels, minlength=len(languages)).astype(float)
    weight = (len(labels) / (len(languages) * np.maximum(1, share)))[labels][:, None]  # languages count alike
    system = features.T @ (weight * features) + ridge * np.eye(features.shape[1])
    return languages, index, (root @ np.linalg.solve(system, features.T @ (weight * target))).astype(np.float32)


def label(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is not None:
        languages, index, coefficients = model
        todo = [k for k, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(todo), BATCH):
            part = todo[at : at + BATCH]
            margins = index.kernel([texts[k] for k in part]) @ coefficients
            for k, b, row in zip(part, margins.argmax(1), margins):
                names[k], scores[k] = languages[b], float(min(1.0, max(0.0, (1 + row[b]) / 2)))
    return names, scores


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = label(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, but for those that are ``und`` or that no language claims (score under ``min_score``)."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = label(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array([n != UNKNOWN and x >= min_score for n, x in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs))
