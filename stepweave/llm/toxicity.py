"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of rows of four hashed tables: two for the word, so that two words rarely share both, and one
for each of two lengths of its beginning, so that unseen forms of a word lie near the seen ones. Filters of the widths
``WIDTHS`` run over the words of the whole text, each keeps its greatest activation (max pooling), and a logistic layer
gives the score. Backpropagation reaches only the words under the pooled places. Because filters are linear in the
embeddings, the fitted network is turned into tables of what a bucket adds to each filter and offset; scoring is a lookup
per distinct word, shifted sums, and a maximum per document.

Training takes at most ``SAMPLE`` labelled texts per class, those of least hash of the id, of at most ``SAMPLE_CHARS``
characters (the documented bound of the fit); scoring reads every text whole. ``thresholds`` calibrates, per language, the
score that separates best on rows set aside from the sample; languages without both classes there use ``CUT``. Language
never enters a score.

Defined results: null reads as the empty text and an empty text has the score of padding; rows without an id are scored
but never learned from; null labels are left out; repeated rows give one result each; only the columns named are read.
Without both classes among the training rows every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import drawn, fold, text_chunks, to_batch

FOLDS, HELD, CUT = 5, 0, 0.5
SAMPLE, SAMPLE_CHARS = 3000, 20000
BUCKETS, DIM, FILTERS = 1 << 14, 8, 6
WIDTHS = (1, 2, 3)
STARTS = (4, 6)
TABLES = 2 + len(STARTS)
#: A bucket met in fewer training texts is not learned and adds nothing, or the network would learn texts by heart.
LEAST_TEXTS = 3
#: The first coordinate starts from the log of how much more often than expected toxic texts hold the bucket, with this
#: weight of prior texts.
PRIOR = 20
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 7
PAD = max(WIDTHS) - 1

#: A-Z to lower case, other ASCII bytes but letters and digits to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def buckets(words: list[bytes]) -> np.ndarray:
    """The row of each word in each table; row 0 is padding."""
    ways = (words, [b"2" + w for w in words], *[[w[:n] for w in words] for n in STARTS])
    codes = [np.fromiter(map(zlib.crc32, way), np.int64, len(words)) for way in ways]
    return np.stack(codes, 1) % (BUCKETS - 1) + 1


class Network:
    """Embeddings (TABLES, BUCKETS, DIM), one filter bank per width, and the logistic layer."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.tables = rng.normal(0, 0.1, (TABLES, BUCKETS, DIM)).astype(np.float32)
        self.tables[:, 0] = 0
        self.filters = [rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = rng.normal(0, 0.5, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, *self.filters, *self.biases, self.weights, self.bias]


def _layout(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with PAD rows of padding behind each: row codes, first row, last row of a text."""
    sizes = np.array([len(c) + PAD for c in codes])
    pad = np.zeros((PAD, TABLES), np.int64)
    flat = np.concatenate([x for c in codes for x in (c, pad)])
    starts = np.cumsum(sizes) - sizes
    return flat, starts, np.maximum(starts + sizes - PAD, starts + 1)


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on mini-batches; classes weigh the same."""
    net, rng = Network(), np.random.default_rng(SEED)
    codes = [buckets(words_of(t) or [b""]) for t in texts]
    seen, toxic = np.zeros((TABLES, BUCKETS)), np.zeros((TABLES, BUCKETS))
    for c, label in zip(codes, labels):
        for side in range(TABLES):
            met = np.unique(c[:, side])
            seen[side, met] += 1
            toxic[side, met] += label
    rare = seen < LEAST_TEXTS
    share = labels.mean()
    net.tables[:, :, 0] = np.log((toxic + PRIOR * share) / ((seen + PRIOR) * share))
    net.tables[:, 0] = 0
    for bank in net.filters:
        bank[:, 0] = np.abs(bank[:, 0])
    codes = [np.where(rare[np.arange(TABLES), c], 0, c) for c in codes]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    held = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            step += 1
            _descend(net, held, step, [codes[d] for d in docs], labels[docs].astype(np.float32), weight[docs])
    net.tables[rare] = 0
    return net


def _descend(net: Network, held: list, step: int, codes: list, labels: np.ndarray, weight: np.ndarray) -> None:
    flat, starts, ends = _layout(codes)
    rows = sum(net.tables[side, flat[:, side]] for side in range(TABLES))
    pooled, chosen = [], []
    for width, bank, bias in zip(WIDTHS, net.filters, net.biases):
        span = len(rows) - width + 1
        out = sum(rows[i:i + span] @ bank[i] for i in range(width)) + bias
        for s, e in zip(starts, ends):
            best = out[s:min(e, span)].argmax(0) + s
            chosen.append(best)
            pooled.append(out[best, np.arange(FILTERS)])
    n = len(starts)
    best = np.array(chosen).reshape(len(WIDTHS), n, FILTERS)
    raw = np.array(pooled).reshape(len(WIDTHS), n, FILTERS)
    hidden = np.maximum(raw, 0)
    flat_hidden = hidden.transpose(1, 0, 2).reshape(n, -1)
    chance = 1 / (1 + np.exp(-np.clip(flat_hidden @ net.weights + net.bias[0], -30, 30)))
    error = ((chance - labels) * weight / n).astype(np.float32)
    grads: list[np.ndarray] = [np.zeros_like(p) for p in net.parameters()[1:]]
    k = len(WIDTHS)
    grads[2 * k] = flat_hidden.T @ error
    grads[2 * k + 1][0] = error.sum()
    below = (error[:, None] * net.weights).reshape(n, k, FILTERS).transpose(1, 0, 2) * (raw > 0)
    touched, moved = [], []
    for j, width in enumerate(WIDTHS):
        grads[k + j] = below[j].sum(0)
        for i in range(width):
            place = best[j] + i
            seen = rows[place]
            grads[j][i] = np.einsum("nfd,nf->df", seen, below[j])
            touched.append(place.ravel())
            moved.append((below[j][:, :, None] * net.filters[j][i].T[None]).reshape(-1, DIM))
    place, change = np.concatenate(touched), np.concatenate(moved)
    used = np.abs(change).sum(1) > 0
    place, change = place[used], change[used]
    correct = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
    for p, g, (m, v) in zip(net.parameters()[1:], grads, held[1:]):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= correct * m / (np.sqrt(v) + 1e-8)
    m, v = held[0]
    for side in range(TABLES):  # lazy Adam: only rows that were under a pooled place move
        row, at = np.unique(flat[place, side], return_inverse=True)
        g = np.zeros((len(row), DIM), np.float32)
        np.add.at(g, at, change)
        g[row == 0] = 0
        m[side, row] += 0.1 * (g - m[side, row])
        v[side, row] += 0.001 * (g * g - v[side, row])
        net.tables[side, row] -= correct * m[side, row] / (np.sqrt(v[side, row]) + 1e-8)


class Scorer:
    """What each bucket of either table adds to every filter, by offset within the filter."""

    def __init__(self, net: Network | None) -> None:
        self.usable = net is not None
        if net is None:
            return
        self.adds = [np.concatenate([net.tables[side] @ bank[i] for bank in net.filters for i in range(len(bank))], 1)
                     .astype(np.float32) for side in range(TABLES)]
        self.biases, self.weights, self.bias = net.biases, net.weights, float(net.bias[0])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.usable or not texts:
            return np.full(len(texts), 0.5)
        vocabulary: dict[bytes, int] = {}
        parts = []
        for text in texts:
            words = words_of(text) or [b""]
            parts.append(np.fromiter([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64, len(words)))
        rows = buckets(list(vocabulary))
        known = sum(self.adds[side][rows[:, side]] for side in range(TABLES))
        adds = np.vstack([known, np.zeros((1, known.shape[1]), np.float32)])
        pad = np.full(PAD, len(vocabulary))
        sizes = np.array([len(p) + PAD for p in parts])
        flat = np.concatenate([x for p in parts for x in (p, pad)])
        starts = np.cumsum(sizes) - sizes
        # places where a text has ended do not count, but each text has one place at least
        inside = np.ones(len(flat), bool)
        for i in range(PAD):
            inside[starts + sizes - 1 - i] = False
        pooled, column = [], 0
        for width, bias in zip(WIDTHS, self.biases):
            out = adds[flat, column:column + FILTERS]
            for i in range(1, width):
                out[:-i] += adds[flat[i:], column + i * FILTERS:column + (i + 1) * FILTERS]
            out[~inside] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(out, starts, axis=0) + bias, 0))
            column += width * FILTERS
        return 1 / (1 + np.exp(-np.clip((np.hstack(pooled) @ self.weights).astype(float) + self.bias, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame) -> list:
    """The bounded training sample: (text, toxic, lang) of at most SAMPLE rows per class outside the held-out fold."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~fold(FOLDS, HELD)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       lang.cast("string").alias("lang"))
    short = rows.where(F.length("text") <= SAMPLE_CHARS).select("doc_id")
    held = known.join(short, "doc_id", "left_semi")
    chosen = None
    for toxic in (0, 1):
        one = drawn(held.where(F.col("toxic") == toxic), F.xxhash64("doc_id"), SAMPLE, "doc_id")
        chosen = one if chosen is None else chosen.unionByName(one)
    # at most 2 * SAMPLE ids of fixed width: small enough to send to every task
    return (rows.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(4 * SAMPLE).collect())


class Model:
    """The fitted scorer and the thresholds by language."""

    def __init__(self, rows: list) -> None:
        labels = np.array([r.toxic for r in rows], int)
        texts = [(r.text or "").encode() for r in rows]
        aside = np.arange(len(rows)) % 5 == 4
        self.thresholds: dict[str, float] = {}
        if not 0 < labels.sum() < len(labels) or not 0 < labels[~aside].sum() < (~aside).sum():
            self.scorer = Scorer(None)
            return
        kept = np.flatnonzero(~aside)
        self.scorer = Scorer(train([texts[i] for i in kept], labels[kept]))
        rest = np.flatnonzero(aside)
        scores = self.scorer.score([texts[i] for i in rest])
        for lang in sorted({rows[i].lang for i in rest if rows[i].lang is not None}):
            own = np.array([rows[i].lang == lang for i in rest])
            self.thresholds[lang] = _threshold(scores[own], labels[rest][own])


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap that gives the best balanced accuracy; CUT without both classes."""
    if not 0 < labels.sum() < len(labels):
        return CUT
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    right = np.cumsum(y == 0) / (y == 0).sum() + 1 - np.cumsum(y) / y.sum()
    best = int(right.argmax())
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(sample(docs, labels))


_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("flagged", pa.int32())])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= CUT) and flagged (by the threshold of the row's language)."""
    model = fit(docs, labels)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            scores = model.scorer.score(texts)
            cut = np.array([model.thresholds.get(x, CUT) for x in batch.column(2).to_pylist()])
            yield to_batch(_ARROW, doc_id=batch.column(0), score=scores, flagged=(scores >= cut).astype(np.int32))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       lang.cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id bigint, score double, flagged int").select(
        "doc_id", fold(FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        "flagged")
