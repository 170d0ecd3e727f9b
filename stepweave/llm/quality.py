"""Quality classifier: regularised quadratic discriminant analysis over statistics of a text.

Each text becomes ``FEATURES`` transformed statistics. Class counts, sums and cross products are added up over all
labelled rows in Spark; the driver sees only these sums, of a fixed size. A class covariance is shrunk towards the
pooled covariance and its diagonal, and kept as the inverse of its Cholesky factor, which the tasks reuse for all rows:
the squared norm of the whitened difference is the Mahalanobis distance, and the difference of the two log densities,
divided by the root of the number of statistics because these depend on each other, is the score's logit.

Defined results: null reads as the empty text, and an empty text has statistics and a score like any other; rows
without an id are scored but never learned from; labels that are null are left out, repeated labels count each time;
repeated document rows give one result each; columns other than doc_id and text are not read. With no rows of one of
the classes every score is 0.5. Texts are read whole.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import fold, mapped, text_chunks, to_batch, written

FEATURES = ("word_length", "upper", "digits", "marks", "symbols", "bars", "distinct", "compressed", "sentences",
            "short_words", "symbol_ends", "repeated_pairs", "shouts", "doubled_words")
#: Every text counts as if so much ordinary text stood behind it, so that a few words prove little.
SPARE_WORDS, SPARE_BYTES = 40, 250
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
FOLDS, HELD, CUT = 5, 0, 0.3
MAX_LOGIT = 12.0

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PLAIN = b".,;:'\"()-"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOL = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _PLAIN)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    size = len(text)
    words = text.split()
    n = len(words) + SPARE_WORDS

    def share(kept: bytes, typical: float) -> float:
        return (size - len(text.translate(None, kept)) + typical * SPARE_BYTES) / (size + SPARE_BYTES)

    def of_words(count: float, typical: float) -> float:
        return (count + typical * SPARE_WORDS) / n

    pairs = max(len(words) - 1, 0)
    symbol = share(_SYMBOL, 0.0)
    ends = sum(map(text.count, (b". ", b".\n", b"! ", b"? ")))
    return [
        np.log(of_words(size, 6.0)), np.sqrt(share(_UPPER, 0.02)), np.sqrt(share(_DIGIT, 0.0)),
        np.sqrt(share(_PLAIN, 0.03)), np.sqrt(symbol), np.sqrt(of_words(text.count(b" | "), 0.0)),
        of_words(len(set(words)), 0.7), (len(zlib.compress(text, 1)) + 0.5 * SPARE_BYTES) / (size + 20 + SPARE_BYTES),
        np.sqrt(of_words(ends, 0.1)), of_words(sum(len(w) <= 3 for w in words), 0.3),
        np.sqrt(of_words(sum(w[-1] in _SYMBOL for w in words), 0.0)),
        np.sqrt(of_words(pairs - len(set(zip(words, words[1:]))), 0.02)),
        np.sqrt(of_words(sum(map(bytes.isupper, words)), 0.0)),
        np.sqrt(of_words(sum(map(operator.eq, words, words[1:])), 0.0)),
    ]


_ARROW = pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.float64()))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        yield to_batch(_ARROW, doc_id=batch.column(0), f=[statistics(t) for t in texts])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``f`` of every text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _measure, "doc_id bigint, f array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: count, sums and cross products, one row per number."""
    d = len(FEATURES) + 1
    held = np.zeros((2, d, d))
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d - 1)
        x = np.hstack([np.ones((len(x), 1)), x])
        for c in (0, 1):
            held[c] += x[label == c].T @ x[label == c]
    at = np.argwhere(np.ones_like(held))
    yield to_batch(_MOMENT, c=at[:, 0].astype(np.int32), i=at[:, 1].astype(np.int32), j=at[:, 2].astype(np.int32),
                   v=held.ravel())


_MOMENT = pa.schema([("c", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])


class Discriminant:
    """Class means, whitening matrices (inverse Cholesky factors) and log determinants."""

    def __init__(self, moments: np.ndarray) -> None:
        counts = moments[:, 0, 0]
        self.usable = bool((counts >= 2).all())
        if not self.usable:
            return
        self.mean = moments[:, 0, 1:] / counts[:, None]
        cov = moments[:, 1:, 1:] / counts[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (cov * counts[:, None, None]).sum(0) / counts.sum()
        floor = 1e-6 + 1e-3 * np.diag(pooled)
        self.white, self.log_det = [], []
        for c in (0, 1):
            one = (1 - SHRINK_POOLED) * cov[c] + SHRINK_POOLED * pooled
            one = (1 - SHRINK_DIAGONAL) * one + SHRINK_DIAGONAL * np.diag(np.diag(one)) + np.diag(floor)
            factor = np.linalg.cholesky(one)
            self.white.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())
        self.prior = np.log(counts[1] / counts[0])

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(x))
        part = [((x - self.mean[c]) @ self.white[c].T) for c in (0, 1)]
        density = [-0.5 * ((p * p).sum(1) + d) for p, d in zip(part, self.log_det)]
        # a tempered difference: the statistics depend on each other, so raw densities are overconfident
        return np.clip((density[1] - density[0]) / np.sqrt(x.shape[1]) + self.prior, -MAX_LOGIT, MAX_LOGIT)


def fit(measures: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~fold(FOLDS, HELD)))
    sums = (mapped(known.join(measures, "doc_id").select("quality", "f"), _moments, "c int, i int, j int, v double")
            .groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect())
    moments = np.zeros((2, len(FEATURES) + 1, len(FEATURES) + 1))
    for r in sums:
        moments[r.c, r.i, r.j] = r.v
    return Discriminant(moments)


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield to_batch(_SCORED, doc_id=batch.column(0), score=1 / (1 + np.exp(-model.logit(x))))
    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    measures = written(measured(docs), "quality")
    model = fit(measures, labels)
    return mapped(measures, _score(model), "doc_id bigint, score double").select(
        "doc_id", fold(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: scored and filtered in one pass."""
    model = fit(measured(docs), labels)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            good = 1 / (1 + np.exp(-model.logit(x))) >= CUT
            yield batch.filter(pa.array(good))
    return mapped(docs, accept, docs.schema)
