"""Ranked lexical search with per-term geometric blocking: exact top documents for every item of a query set.

One pass counts the terms of every document; the corpus statistics follow by aggregation. The index is cut into shards of
documents. In a shard, every term's posting list is clustered into blocks of similar documents: documents are projected to a
few dimensions, every so many-th of a list is a centre, and each posting goes to the nearest centre. A block stores its
documents and a summary, for each coordinate the maximum over its documents. Coordinates are terms that share an item with
the list's term; terms are coded by falling weight, and a list's summary holds those from its own term on, because documents
with heavier terms of the item are dealt with in those terms' lists.

Search takes an item's lists from the heaviest term on. A block is skipped only if its summary's bound, weights times maxima
summed over the item, is below the score of the item's last place so far; what remains is scored exactly, best bounds
first. Places rise from shard to shard within a task; the tasks' best are merged by a window.

Items go over the corpus in blocks of about ``BLOCK_BYTES`` of text, one index each, restricted to the block's terms: what is
sent to tasks is bounded whatever the number of items.

Defined results: null and texts without a term are no documents; rows that repeat an id are documents of their own; equal
scores are ranked by id, a missing id last; each benchmark row is an item, also where ids repeat; an item without terms has
no rows; no item or document gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import text_chunks, to_batch, written

PLACES = 10
#: Parts of a hundred that the document's length weighs.
BY_LENGTH = 90
SCALE, STEEP = 1_000_000_000, 8
SHARD_DOCS = 4096
SHARD_ENTRIES = 1 << 20
BLOCK_DOCS = 64
DIMENSIONS = 16
BLOCK_BYTES = 4 << 20

#: A-Z to lower case, every other ASCII byte but digits and letters to a space.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
COUNTED_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                           ("counts", pa.list_(pa.int32()))])
#: One row per shard: documents with their entries (code, saturation), blocks by term with their documents, and summaries.
PARTS = {"sizes": np.int32, "codes": np.int32, "values": np.int32, "block_terms": np.int32, "block_sizes": np.int32,
         "block_docs": np.int32, "summary_sizes": np.int32, "summary_codes": np.int32, "summary_values": np.int32}
INDEX_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(name, pa.binary()) for name in PARTS]])
INDEX = "doc_ids array<bigint>, " + ", ".join(f"{name} binary" for name in PARTS)
FOUND = "item int, doc_id bigint, score bigint"
FOUND_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Items:
    """A block of items with its vocabulary; ``weigh`` codes the terms by falling weight."""

    def __init__(self, texts: list[bytes]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [sorted({self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of(x)}) for x in texts]

    def weigh(self, n: int, found: dict[int, int]) -> "Items":
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(self.vocabulary))]
        order = sorted(range(len(weights)), key=lambda t: (-weights[t], t))
        self.code = np.empty(len(order), np.int32)
        self.code[order] = np.arange(len(order), dtype=np.int32)
        self.weight = np.array(weights, np.int64)[order]
        self.terms = [sorted(self.code[t].tolist()) for t in self.terms]
        shared: list[set] = [set() for _ in order]
        for terms in self.terms:
            for at, t in enumerate(terms):
                shared[t].update(terms[at:])
        self.shared = [np.array(sorted(x), np.int32) for x in shared]
        self.vocabulary = {}
        return self


def _counts(vocabulary: dict[bytes, int]) -> Callable:
    """Every document's number of terms, and its counts of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            sizes, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                held = Counter(words)
                kept = [(vocabulary[t], c) for t, c in held.items() if t in vocabulary]
                sizes.append(len(words))
                terms.append([t for t, _ in kept])
                counts.append([c for _, c in kept])
            yield to_batch(COUNTED_ARROW, doc_id=batch.column(0), n=sizes, terms=terms, counts=counts)
    return run


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several runs one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _blocks(sizes: np.ndarray, codes: np.ndarray, values: np.ndarray, items: Items) -> dict[str, np.ndarray]:
    """Cluster every posting list of a shard and summarise the clusters."""
    starts = np.cumsum(sizes) - sizes
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    axes = np.random.default_rng(0).standard_normal((len(items.weight), DIMENSIONS)).astype(np.float32)
    place = np.zeros((len(sizes), DIMENSIONS), np.float32)
    strength = items.weight[codes] * values.astype(np.float64)
    for d in range(DIMENSIONS):
        place[:, d] = np.bincount(doc_of, strength * axes[codes, d], len(sizes))
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-30)
    by_term = np.argsort(codes, kind="stable")
    present, first = np.unique(codes[by_term], return_index=True)
    lists = np.split(doc_of[by_term], first[1:]) if len(present) else []
    wanted = np.zeros(len(items.weight), bool)
    out: dict[str, list] = {name: [] for name in PARTS if name.startswith(("block", "summary"))}
    for term, docs in zip(present.tolist(), lists):
        n = -(-len(docs) // BLOCK_DOCS)
        centres = place[docs[np.arange(n) * len(docs) // n]]
        nearest = (place[docs] @ centres.T).argmax(1) if n > 1 else np.zeros(len(docs), np.int64)
        order = np.argsort(nearest, kind="stable")
        filled, nearest, amounts = np.unique(nearest[order], return_inverse=True, return_counts=True)
        docs = docs[order]
        wanted[items.shared[term]] = True
        entries = spread(starts[docs], sizes[docs])
        block = np.repeat(nearest, sizes[docs])
        good = wanted[codes[entries]]
        entries, block = entries[good], block[good]
        wanted[items.shared[term]] = False
        key = block * len(items.weight) + codes[entries]
        order = np.argsort(key, kind="stable")
        key, at = np.unique(key[order], return_index=True)
        out["block_terms"].append(np.full(len(filled), term))
        out["block_sizes"].append(amounts)
        out["block_docs"].append(docs)
        out["summary_sizes"].append(np.bincount(key // len(items.weight), minlength=len(filled)))
        out["summary_codes"].append(key % len(items.weight))
        out["summary_values"].append(np.maximum.reduceat(values[entries][order], at))
    return {name: np.concatenate(x) if x else np.zeros(0, np.int32) for name, x in out.items()}


def _shards(items: Items, n_docs: int, n_terms: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.diff(batch.column(2).offsets.to_numpy())
            starts = [0]
            for at, total in enumerate(np.cumsum(held).tolist()):
                before = int(held[:starts[-1]].sum())
                if at > starts[-1] and (total - before > SHARD_ENTRIES or at - starts[-1] >= SHARD_DOCS):
                    starts.append(at)
            for a, z in zip(starts, [*starts[1:], batch.num_rows]):
                if z > a:
                    yield _shard(batch.slice(a, z - a), items, n_docs, n_terms)
    return run


def _shard(rows: pa.RecordBatch, items: Items, n_docs: int, n_terms: int) -> pa.RecordBatch:
    sizes = np.diff(rows.column(2).offsets.to_numpy()).astype(np.int64)
    codes = items.code[rows.column(2).flatten().to_numpy()]
    tf = rows.column(3).flatten().to_numpy().astype(np.int64)
    length = 100 - BY_LENGTH + BY_LENGTH * rows.column(1).to_numpy() * n_docs // n_terms
    values = SCALE * tf // (1000 * tf + STEEP * np.repeat(length, sizes))
    order = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * len(items.weight) + codes, kind="stable")
    codes, values = codes[order], values[order]
    parts = {"sizes": sizes, "codes": codes, "values": values, **_blocks(sizes, codes, values, items)}
    return to_batch(INDEX_ARROW, doc_ids=[rows.column(0).to_pylist()],
                    **{name: [parts[name].astype(kind).tobytes()] for name, kind in PARTS.items()})


class Shard:
    """A stored shard, read for search."""

    def __init__(self, row: dict, weight: np.ndarray) -> None:
        parts = {name: np.frombuffer(row[name], kind) for name, kind in PARTS.items()}
        self.ids, self.weight = row["doc_ids"], weight
        self.sizes, self.codes, self.values = parts["sizes"].astype(np.int64), parts["codes"], parts["values"]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.docs, self.block_sizes = parts["block_docs"], parts["block_sizes"].astype(np.int64)
        self.block_starts = np.cumsum(self.block_sizes) - self.block_sizes
        self.summary_codes, self.summary_values = parts["summary_codes"], parts["summary_values"]
        self.summary_sizes = parts["summary_sizes"].astype(np.int64)
        self.summary_starts = np.cumsum(self.summary_sizes) - self.summary_sizes
        terms, first, amount = np.unique(parts["block_terms"], return_index=True, return_counts=True)
        self.lists = dict(zip(terms.tolist(), zip(first.tolist(), amount.tolist())))

    def _sums(self, codes: np.ndarray, values: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """For each run of entries the weighted sum over the item's terms."""
        amount = np.where(asked[codes], self.weight[codes] * values, 0)
        total = np.concatenate([[0], np.cumsum(amount)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def bounds(self, term: int, asked: np.ndarray) -> np.ndarray:
        first, amount = self.lists[term]
        sizes = self.summary_sizes[first:first + amount]
        at = slice(self.summary_starts[first], self.summary_starts[first] + int(sizes.sum()))
        return self._sums(self.summary_codes[at], self.summary_values[at], sizes, asked)

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        entries = spread(self.starts[docs], self.sizes[docs])
        return self._sums(self.codes[entries], self.values[entries], self.sizes[docs], asked)

    def documents(self, blocks: np.ndarray) -> np.ndarray:
        return self.docs[spread(self.block_starts[blocks], self.block_sizes[blocks])]


def search_shard(shard: Shard, terms: list[int], asked: np.ndarray, best: list[tuple]) -> tuple[int, int]:
    """Add the shard's documents to an item's ``best`` places; how many blocks there are and how many were scored."""
    seen = np.zeros(len(shard.ids), bool)
    there = opened = 0
    for term in terms:
        if term not in shard.lists:
            continue
        bounds = shard.bounds(term, asked)
        first = shard.lists[term][0]
        order = np.argsort(-bounds, kind="stable")
        there, at, take = there + len(order), 0, 1
        while at < len(order):
            least = -best[-1][0] if len(best) == PLACES else 1
            chosen = order[at:at + take]
            chosen = chosen[bounds[chosen] >= least]
            if not len(chosen):
                break
            at, take, opened = at + take, take * 2, opened + len(chosen)
            docs = np.unique(shard.documents(first + chosen))
            docs = docs[~seen[docs]]
            seen[docs] = True
            scores = shard.scores(docs, asked)
            for at_doc in np.flatnonzero(scores >= least).tolist():
                doc = shard.ids[docs[at_doc]]
                place = (-int(scores[at_doc]), doc is None, doc or 0)
                if len(best) < PLACES or place < best[-1]:
                    bisect.insort(best, place)
                    del best[PLACES:]
    return there, opened


def _search(items: Items) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items.terms]
        asked = np.zeros(len(items.weight), bool)
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], items.weight)
                for terms, places in zip(items.terms, best):
                    asked[terms] = True
                    search_shard(shard, terms, asked, places)
                    asked[terms] = False
        rows = [(i, None if none else doc, -score) for i, places in enumerate(best) for score, none, doc in places]
        item, doc, score = zip(*rows) if rows else ([], [], [])
        yield to_batch(FOUND_ARROW, item=list(item), doc_id=list(doc), score=list(score))
    return run


def build_index(docs: DataFrame, texts: list[bytes]) -> tuple[DataFrame, Items]:
    """The shards of ``docs`` (doc_id, text) for a block of items, stored in the shared folder."""
    items = Items(texts)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = written(rows.mapInArrow(_counts(items.vocabulary), COUNTED).where("n > 0"), "terms", compression="zstd")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    items.weigh(n_docs, {r["term"]: r["count"] for r in found})
    shards = counted.where(F.size("terms") > 0).mapInArrow(_shards(items, n_docs, n_terms), INDEX)
    return written(shards, "blocks", compression="zstd"), items


def rank(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best ``PLACES`` documents."""
    rows = written(benchmark.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                    F.monotonically_increasing_id().alias("row")), "items")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for number in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").collect()
        index, items = build_index(docs, [r.text.encode() for r in held])
        numbers = F.broadcast(docs.sparkSession.createDataFrame(
            [(at, r.row, r.item_id) for at, r in enumerate(held)], f"item int, row bigint, item_id {rows.schema['item_id'].dataType.simpleString()}"))
        parts.append(index.mapInArrow(_search(items), FOUND).join(numbers, "item"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PLACES)
            .select("item_id", "rank", "doc_id", "score"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_at, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT row_at, term, count(*) AS tf FROM (SELECT row_at, unnest(w) AS term FROM d) GROUP BY row_at, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT row_number() OVER () AS item_at, item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_at, unnest(w) AS term FROM b),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, s),
scored AS (SELECT item_at, row_at, sum(weight * (({SCALE} * tf) // (1000 * tf + {STEEP} * ({100 - BY_LENGTH}
    + ({BY_LENGTH} * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN d USING (row_at), s GROUP BY item_at, row_at),
r AS (SELECT *, row_number() OVER (PARTITION BY item_at ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN d USING (row_at) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN b USING (item_at) WHERE rank <= {PLACES}"""
