"""LM scoring: a hidden Markov model of the corpus' words, with an add-one unigram score beside it.

``encode`` stores the corpus as blocks of documents in the shared folder: the block's distinct words, and the tokens as
indices into them. Word counts of the training rows are summed over the blocks by a shuffle on the word and stay a table;
a block's counts come back by a join on the word, so no task or driver holds the vocabulary. A word's class is its own
for the ``TOP`` most frequent words and a hash for all others, so a state's emissions have a fixed size; within a hashed
class a word has its add-one share of the class' tokens. What is stored then are class sequences and each document's sums
over its words.

Each Baum-Welch step runs over every training token: tasks add up expected counts of starts, transitions and emissions,
Spark sums them, and the driver normalises the sums. Training cuts documents into segments of ``SEGMENT`` tokens, later
segments starting from a learned distribution of their own. Scoring does not cut: the scaled forward recursion runs over
whole documents, all documents of a block side by side.

Defined results: null and empty texts are the end token alone; rows without an id are scored, held out and never learned
from; repeated rows count and are scored each; other columns are not read. Without training rows all counts are 0.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import fold, gathered, mapped, text_chunks, to_batch, written

FOLDS, HELD = 7, 2
STATES, TOP, HASHED = 6, 1024, 1024
CLASSES = TOP + HASHED + 1
END = CLASSES - 1
SEGMENT, ROUNDS, SEED = 64, 4, 11
BLOCK_BYTES, STEP_TOKENS = 12 << 20, 1 << 18
SMOOTH = 0.1
#: The first model: states that last, with emissions spread by chance around the class counts.
STAY, SPREAD = 100, 0.5

#: A-Z to lower case; all else stays.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BLOCKS = ("block bigint, doc_ids array<bigint>, held binary, lengths binary, words array<binary>, seen array<int>, "
           "hashed binary, codes binary")
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.binary()),
                           ("lengths", pa.binary()), ("words", pa.list_(pa.binary())), ("seen", pa.list_(pa.int32())),
                           ("hashed", pa.binary()), ("codes", pa.binary())])


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unpacked(held: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(held, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII spaces, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, (batch, texts) in enumerate(text_chunks(gathered(batches, BLOCK_BYTES), BLOCK_BYTES)):
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        parts = []
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        lengths = np.array([len(p) for p in parts], np.int32)
        codes = np.concatenate(parts)
        seen = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(vocabulary)).astype(np.int32)
        words = list(vocabulary)
        hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % HASHED
        yield to_batch(_BLOCKS_ARROW, block=[part << 36 | number], doc_ids=[batch.column(0).to_pylist()],
                       held=[held.tobytes()], lengths=[lengths.tobytes()], words=[words], seen=[seen],
                       hashed=[packed(hashed.astype(np.int16))], codes=[packed(codes)])


def encode(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       fold(FOLDS, HELD).alias("held"))
    return written(mapped(rows, _encode, _BLOCKS), "blocks", compression="zstd")


class Model:
    """Start distributions (of a document, of a later segment), transitions and emissions by class."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        self.start = (start + SMOOTH) / (start + SMOOTH).sum(1, keepdims=True)
        self.moves = (moves + SMOOTH) / (moves + SMOOTH).sum(1, keepdims=True)
        # every state also gives each class a little, in proportion to all of its tokens
        prior = (emits.sum(0) + SMOOTH) / (emits.sum(0) + SMOOTH).sum()
        emits = emits + SMOOTH * CLASSES * prior
        self.emits = np.ascontiguousarray((emits / emits.sum(1, keepdims=True)).T)

    @staticmethod
    def first(tokens: np.ndarray) -> "Model":
        rng = np.random.default_rng(SEED)
        emits = tokens[None] * np.exp(SPREAD * rng.normal(size=(STATES, CLASSES)))
        return Model(np.ones((2, STATES)), 1 + STAY * np.eye(STATES), emits)


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of these sizes one after another: first token and length of each segment, and its rank in its text."""
    per = -(-sizes // SEGMENT)
    rank = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(sizes) - sizes, per) + rank * SEGMENT
    return first, np.minimum(np.repeat(sizes, per) - rank * SEGMENT, SEGMENT), rank


def expected(model: Model, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over the segments: scaled forward and backward recursions, all at once."""
    starts, moves = np.zeros((2, STATES)), np.zeros((STATES, STATES))
    if not len(sizes):
        return starts, moves, np.zeros((STATES, CLASSES))
    first, length, rank = segments(sizes)
    order = np.argsort(-length, kind="stable")
    first, length, rank = first[order], length[order], rank[order]
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]  # length > t
    ends = np.cumsum([0, *active])
    # by step: the tokens of all segments that have one there lie side by side
    token = classes[np.concatenate([first[:n] + t for t, n in enumerate(active)])]
    emits, go = model.emits.astype(np.float32)[token], model.moves.astype(np.float32)
    one = np.ones((STATES, 1), np.float32)
    later = (rank > 0).astype(int)
    ahead, scale = np.empty_like(emits), np.empty((len(emits), 1), np.float32)
    a = model.start.astype(np.float32)[later]
    for t, n in enumerate(active):
        a = (a[:n] @ go if t else a) * emits[ends[t]:ends[t + 1]]
        c = a @ one
        a /= c
        ahead[ends[t]:ends[t + 1]], scale[ends[t]:ends[t + 1]] = a, c
    emits /= scale
    pushed = np.zeros((STATES, STATES))
    for t in range(len(active) - 2, -1, -1):
        n, at = active[t + 1], ends[t]
        push = emits[ends[t + 1]:ends[t + 2]]  # by now times what lies behind it
        pushed += ahead[at:at + n].T @ push
        emits[at:at + n] *= push @ go.T
    # emits holds b * beta / c; times the state's chance before the token, that is gamma: bring it there from the ahead
    weights = np.empty_like(emits)
    before = model.start.astype(np.float32)[later]
    for t, n in enumerate(active):
        reached = ahead[ends[t - 1]:ends[t - 1] + n] @ go if t else before
        weights[ends[t]:ends[t + 1]] = reached * emits[ends[t]:ends[t + 1]]
    for k in (0, 1):
        starts[k] = weights[:active[0]][later == k].sum(0, dtype=float)
    counts = np.stack([np.bincount(token, weights[:, s], CLASSES) for s in range(STATES)])
    return starts, moves + model.moves * pushed, counts


def log_likelihood(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text's classes: the scaled forward recursion over whole texts."""
    order = np.argsort(-sizes, kind="stable")
    first, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    logs = np.zeros(len(sizes))
    one = np.ones((STATES, 1))
    ending = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # length > t
    a = np.repeat(model.start[:1], len(sizes), 0)
    for t, n in enumerate(ending.tolist()):
        a = (a[:n] @ model.moves if t else a) * model.emits[classes[first[:n] + t]]
        c = a @ one
        a /= c
        logs[:n] += np.log10(c[:, 0])
    out = np.empty(len(sizes))
    out[order] = logs
    return out


_COUNTS = pa.schema([("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
_CLASSED = "doc_ids array<bigint>, held binary, sizes binary, classes binary, known binary, base binary, inner binary"
_CLASSED_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in (
    "held", "sizes", "classes", "known", "base", "inner")]])


def _classify(total: int, ends: int, class_tokens: np.ndarray, class_words: np.ndarray):
    """Blocks with their found counts to class sequences and sums over words. total: tokens and distinct tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c[at] for c in batch.columns)))
                lengths = np.frombuffer(row["lengths"].as_py(), np.int32).astype(np.int64)
                n = row["n_words"].as_py()
                count, of = np.zeros(n + 1), np.empty(n + 1, np.int64)
                of[:n], of[n] = TOP + unpacked(row["hashed"].as_py(), np.int16, n), END
                if row["places"].is_valid:
                    places = row["places"].values.to_numpy()
                    rank = row["ranks"].values.to_numpy()
                    count[places] = row["counts"].values.to_numpy()
                    of[places[rank >= 0]] = rank[rank >= 0]
                count[n] = ends
                inner = np.log10((count + 1) / (class_tokens[of] + class_words[of] + 1))
                inner[(of < TOP) | (of == END)] = 0
                word = np.insert(unpacked(row["codes"].as_py(), np.int32, int(lengths.sum())), np.cumsum(lengths), n)
                sizes = lengths + 1
                start = np.cumsum(sizes) - sizes
                sums = {"known": (count > 0).astype(np.int64), "base": np.log10((count + 1) / total), "inner": inner}
                yield to_batch(_CLASSED_ARROW, doc_ids=[row["doc_ids"].as_py()], held=[row["held"].as_py()],
                               sizes=[sizes.tobytes()], classes=[packed(of[word].astype(np.int16))],
                               **{k: [np.add.reduceat(v[word], start).tobytes()] for k, v in sums.items()})
    return run


def _sequences(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, classes and the held-out marks of a row of classed documents."""
    held, sizes, classes = (batch.column(batch.schema.get_field_index(n))[at].as_py() for n in ("held", "sizes", "classes"))
    sizes = np.frombuffer(sizes, np.int64)
    return sizes, unpacked(classes, np.int16, int(sizes.sum())), np.frombuffer(held, bool)


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, classes, held = _sequences(batch, at)
                classes, sizes = classes[np.repeat(~held, sizes)], sizes[~held]
                ends = np.cumsum(sizes)
                # documents are taken about STEP_TOKENS at a time
                part = np.searchsorted(ends, np.arange(0, int(sizes.sum()) + STEP_TOKENS, STEP_TOKENS))
                for a, b in zip(part, [*part[1:], len(sizes)]):
                    if a < b:
                        found = expected(model, classes[ends[a] - sizes[a]:ends[b - 1]], sizes[a:b])
                        for whole, one in zip(total, found):
                            whole += one
        for kind, whole in enumerate(total):
            i, j = np.nonzero(whole)
            yield to_batch(_COUNTS, kind=np.full(len(i), kind, np.int32), i=i.astype(np.int32), j=j.astype(np.int32),
                           v=whole[i, j])
    return run


def train(classed: DataFrame, tokens: np.ndarray) -> Model:
    """Baum-Welch over the training documents; ``tokens``: of each class, for the first model."""
    model = Model.first(tokens)
    read = classed.select("held", "sizes", "classes")
    for _ in range(ROUNDS):
        sums = (mapped(read, _expect(model), "kind int, i int, j int, v double")
                .groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).collect())  # of fixed size
        total = [np.zeros((2, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))]
        for r in sums:
            total[r.kind][r.i, r.j] = r.v
        model = Model(*total)
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(model: Model, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, classes, held = _sequences(batch, at)
                row = {n: batch.column(batch.schema.get_field_index(n))[at].as_py() for n in (
                    "doc_ids", "known", "base", "inner")}
                yield to_batch(_SCORES, doc_id=row["doc_ids"], held_out=held, n_tokens=sizes,
                               n_known=np.frombuffer(row["known"], np.int64), train_tokens=np.full(len(sizes), tokens),
                               base_score=np.frombuffer(row["base"]),
                               score=log_likelihood(model, classes, sizes) + np.frombuffer(row["inner"]))
    return run


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, c): tokens of each word in the training rows, where there are any."""
    each = blocks.select(F.explode(F.arrays_zip("words", "seen")).alias("x")).where("x.seen > 0")
    return written(each.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.seen").alias("c")), "words")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    blocks = encode(docs)
    counts = word_counts(blocks)
    ends = docs.where(~fold(FOLDS, HELD)).count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(TOP).collect()
    ranks = docs.sparkSession.createDataFrame([(bytearray(r.word), i) for i, r in enumerate(top)], "word binary, rank int")
    # TOP rows at most
    ranked = counts.join(F.broadcast(ranks), "word", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for at, r in enumerate(top):
        tokens[at] = r.c
    for r in ranked.where("rank < 0").groupBy((F.crc32("word") % HASHED).alias("k")).agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tokens[TOP + r.k], kinds[TOP + r.k] = r.c, r.n
    tokens[END] = ends
    asked = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = (asked.join(ranked, "word").groupBy("block").agg(F.collect_list(F.struct("at", "c", "rank")).alias("x"))
             .select("block", F.col("x.at").alias("places"), F.col("x.c").alias("counts"), F.col("x.rank").alias("ranks")))
    total = words + ends + distinct + (ends > 0) + 1
    counted = blocks.select("block", "doc_ids", "held", "lengths", F.size("words").alias("n_words"), "hashed", "codes").join(
        found, "block", "left")
    classed = written(mapped(counted, _classify(total, ends, tokens, kinds), _CLASSED), "classed")
    return mapped(classed, _score(train(classed, tokens), words + ends),
                  "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                  "base_score double, score double")
