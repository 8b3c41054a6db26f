"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one from good and one from bad labelled
texts. A text is compressed with both, in pieces of PIECE bytes, so that the
dictionaries count all the way through a long text; the difference of the two sizes divided
by their sum, a pure number in (-1, 1), is all that a score is made of. It becomes a probability through a
logistic curve fitted to further labelled rows. The length of a text only picks the curve:
each of BINS classes of length has its own, fitted with labels weighted to the
same share of good ones in every class, so that a length says nothing by itself.

Learning uses bounded samples of labelled rows, drawn by a hash of the id:
about ``dictionary_rows`` texts a class (pieces of longer ones, of ``max_sample_bytes`` bytes at most) for the
dictionaries, about ``calibration_rows`` rows a class for the curve. Scoring reads
every whole text.

Defined results for edge cases: null text scores as empty text; without labelled
rows of both classes every score is the share of good labels (0.5 without any);
null labels and null ids are not learned from; of several labels of an id the
largest counts; held_out of a null id is false; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import byte_list, crc_mod

LEVEL = 3
DICTIONARY_BYTES = 112_640
PIECE = 1024
BINS = 8
#: Least labelled rows of either label for a class of length to have its own curve.
LEAST_ROWS = 20
THRESHOLD = 0.7


class Differences:
    """Normalised differences of compressed sizes, with a dictionary of bad and with one of good texts."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.compress = []
        for raw in (good, bad):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.compress.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def of(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            pieces = [text[at : at + PIECE] for at in range(0, max(1, len(text)), PIECE)]
            good, bad = (sum(len(compress(p)) for p in pieces) for compress in self.compress)
            out[k] = (bad - good) / (bad + good)
        return out


class Curves:
    """A logistic curve over the difference for each class of length."""

    def __init__(self, difference: np.ndarray, lengths: np.ndarray, y: np.ndarray, good_share: float):
        self.edges = np.unique(np.quantile(lengths, np.linspace(0, 1, BINS + 1)[1:-1]))
        which, whole = np.searchsorted(self.edges, lengths), fit_curve(difference, y, good_share)
        self.curves = np.array([whole] * (len(self.edges) + 1))
        for k in range(len(self.curves)):
            own = which == k
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LEAST_ROWS:
                self.curves[k] = fit_curve(difference[own], y[own], good_share)

    def score(self, difference: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        base, slope = self.curves[np.searchsorted(self.edges, lengths)].T
        return 1 / (1 + np.exp(-np.clip(base + slope * SCALE * difference, -30, 30)))


#: Brings differences, mostly within a few hundredths, to the size that the penalty is meant for.
SCALE = 20


def fit_curve(difference: np.ndarray, y: np.ndarray, good_share: float, ridge: float = 1e-2) -> np.ndarray:
    """Base and slope by Newton's method, labels weighted to their shares of all labels."""
    x, w = np.column_stack([np.ones(len(y)), SCALE * difference]), np.zeros(2)
    weight = np.where(y == 1, good_share / max(1, (y == 1).sum()), (1 - good_share) / max(1, (y == 0).sum())) * len(y)
    penalty = ridge * np.eye(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((weight * p * (1 - p))[:, None] * x) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, dictionary_rows: int = 2000, calibration_rows: int = 2000, max_sample_bytes: int = 16_384):
    """The model: (good dictionary, bad dictionary, curves), or a single score where it can't be learned."""
    import zstandard as z

    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("quality"))
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    each = dictionary_rows + calibration_rows
    share = F.pmod(F.xxhash64(F.lit(10), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000.0
    rate = F.when(F.col("quality") == 1, min(1.0, 1.2 * each / counts[1])).otherwise(min(1.0, 1.2 * each / counts[0]))
    # of a text over the bound a piece from anywhere in it
    most = max_sample_bytes // 4
    begin = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - most)).cast("int")
    piece = F.when(F.octet_length("text") <= max_sample_bytes, F.col("text")).otherwise(F.col("text").substr(begin, F.lit(most)))
    # a bounded number of labels, so their broadcast is bounded
    drawn = F.broadcast(known.where(share < rate))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"), piece.alias("text"))
        .join(drawn, "doc_id")
        .select("doc_id", "quality", "size", F.col("text").cast("binary").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], bytes(r["text"] or b"")))
    sides = {q: [(bytes(r["text"]), r["size"]) for r in rows if r["quality"] == q and r["text"]] for q in (0, 1)}
    if not (sides[0] and sides[1]):
        return counts[1] / (counts[0] + counts[1])
    cut = {q: max(1, min(dictionary_rows, len(t) // 2)) for q, t in sides.items()}
    raw = []
    for q in (1, 0):
        try:
            raw.append(z.train_dictionary(DICTIONARY_BYTES, [t for t, _ in sides[q][: cut[q]]], k=200, d=8, level=LEVEL).as_bytes())
        except z.ZstdError:  # too few samples to train on: their bytes themselves serve
            raw.append(b"\n".join(t for t, _ in sides[q][: cut[q]])[-DICTIONARY_BYTES:])
    rest = {q: t[cut[q] :] or t for q, t in sides.items()}
    texts = rest[1] + rest[0]
    y = np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])])
    return raw[0], raw[1], Curves(Differences(*raw).of([t for t, _ in texts]), np.array([size for _, size in texts]), y, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = isinstance(shared.value, float)
        differences = None if flat else Differences(*shared.value[:2])
        for batch in batches:
            texts = [t or b"" for t in byte_list(batch.column(2))]
            if flat:
                p = np.full(len(texts), shared.value)
            else:
                p = shared.value[2].score(differences.of(texts), np.array([len(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels))
