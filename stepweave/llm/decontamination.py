"""Benchmark decontamination: a distributed positional inverted index of the training tokens.

``build_index`` cuts the corpus into shards of documents and stores for each shard the posting lists of all its
tokens: for each term the ascending positions, in a position space where documents lie apart by ``GAP``. ``search``
takes the test items' windows to every shard. For each window whose terms all occur there, the posting list of its
rarest term, shifted by the term's offset, gives the candidate starts; the shifted lists of the other terms, by rising
length, are intersected with them one after another. What is left are exact phrase matches. Proximity matches are found window
by window: of the ``NEAR_TERMS`` rarest distinct terms of a window that the corpus holds, by their number in it and then by
name, all but one (all, if there are two or one) lie less than ``GAP`` tokens from one place of the rarest or the second
rarest. So every exact match is a proximity match of its item, and a window with one word replaced is, too.

Test items go to the shards in blocks of at most about ``BLOCK_BYTES`` of text: one pass over the index per block, so
the size of what is sent is bounded whatever the size of the benchmark.

Defined results: null and empty texts have no words and no hits; a benchmark row without an id or without words is
left out; rows that repeat an id count as one item; an item of fewer than ``WINDOW`` words is one window of its own
length; repeated document rows give one result each; other columns are not read. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import mapped, matched, text_chunks, text_key, to_batch, written

WINDOW = 10
GAP = 32
NEAR_TERMS = 5
BLOCK_BYTES = 16 << 20

#: A-Z to lower case, every other ASCII byte but digits and letters to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = ("shard string, doc_ids array<bigint>, text_keys array<binary>, starts array<int>, lengths array<int>, "
         "terms binary, counts binary, positions binary")
INDEX_ARROW = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.binary())),
                         ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()),
                         ("counts", pa.binary()), ("positions", pa.binary())])
FOUND = ("shard string, doc_at int, doc_id bigint, text_key binary, n_words bigint, hits array<int>, "
         "items array<string>, near array<string>")
FOUND_ARROW = pa.schema([("shard", pa.string()), ("doc_at", pa.int32()), ("doc_id", pa.int64()),
                         ("text_key", pa.binary()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())),
                         ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, (batch, texts) in enumerate(text_chunks(batches)):
        ids, text_keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        lengths, parts = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        sizes = np.array(lengths, np.int64)
        starts = np.cumsum(sizes + GAP) - sizes - GAP
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        places = np.arange(len(codes)) + np.repeat(GAP * np.arange(len(sizes)), sizes)
        keys = codes << 32 | places
        keys.sort()
        counts = np.bincount(codes, minlength=len(vocabulary)).astype(np.int32)
        yield to_batch(INDEX_ARROW, shard=[f"{part}-{number}"], doc_ids=[ids], text_keys=[text_keys],
                       starts=[starts.astype(np.int32)], lengths=[sizes.astype(np.int32)], terms=[b" ".join(vocabulary)], counts=[counts.tobytes()],
                       positions=[(keys & 0xFFFFFFFF).astype(np.int32).tobytes()])


def build_index(docs: DataFrame) -> DataFrame:
    """Posting lists of all tokens of ``docs`` (doc_id, text), one row per shard, stored in the shared folder."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key().alias("text_key"))
    return written(mapped(docs, _shards, INDEX), "postings", compression="zstd")


class Windows:
    """The windows of one block of test items, their terms and items."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[str]] = {}
        for name, text in items:
            codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(codes) - WINDOW + 1) if codes else 0):
                owners.setdefault(tuple(codes[at:at + WINDOW]), set()).add(name)
        self.vocabulary = vocabulary
        self.terms = np.full((len(owners), WINDOW), -1, np.int64)
        for row, codes in enumerate(owners):
            self.terms[row, :len(codes)] = codes
        self.lengths = (self.terms >= 0).sum(1)
        self.owners = [sorted(x) for x in owners.values()]
        self.items = sorted({name for held in self.owners for name in held})
        self.rank({})

    def rank(self, counts: dict[bytes, int]) -> None:
        """Choose the terms of proximity search by their counts in the whole corpus: distinct (item, rarest terms)."""
        names, row_of = list(self.vocabulary), {name: i for i, name in enumerate(self.items)}
        place = {t: i for i, t in enumerate(sorted((t for t, w in enumerate(names) if counts.get(w)),
                                                   key=lambda t: (counts[names[t]], names[t])))}
        chosen = set()
        for codes, owners in zip(self.terms.tolist(), self.owners):
            rare = sorted((place[t], t) for t in set(codes) if t in place)[:NEAR_TERMS]
            if rare:
                key = tuple(t for _, t in rare) + (-1,) * (NEAR_TERMS - len(rare))
                chosen.update((row_of[name], key) for name in owners)
        rows = sorted(chosen)
        self.rare_items = np.array([r for r, _ in rows], np.int64)
        self.rare_terms = np.array([k for _, k in rows], np.int64).reshape(-1, NEAR_TERMS)
        size = (self.rare_terms >= 0).sum(1)
        self.rare_least = np.where(size > 2, size - 1, size)


class Shard:
    """Posting lists of one stored shard, restricted to the terms of a block of test items."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, vocabulary: dict) -> None:
        lengths = np.frombuffer(counts, np.int32).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        places = np.frombuffer(positions, np.int32)
        n = len(vocabulary)
        self.count, lists = np.zeros(n, np.int64), [places[:0]] * n
        for row, term in enumerate(terms.split()):
            code = vocabulary.get(term)
            if code is not None:
                self.count[code] = lengths[row]
                lists[code] = places[first[row]:first[row] + lengths[row]]
        self.first = np.cumsum(self.count) - self.count
        self.places = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
        self.keys = np.repeat(np.arange(n, dtype=np.int64), self.count) << 32 | self.places

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting lists of the terms one after another: which of the terms, and the position."""
        size = self.count[terms]
        which = np.repeat(np.arange(len(terms)), size)
        return which, self.places[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                                  + np.repeat(self.first[terms], size)]

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms << 32 | np.maximum(places, 0)
        at = np.searchsorted(self.keys, wanted)
        return (places >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def near(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """True where the term has a posting within less than GAP of the place."""
        wanted = (terms << 32) + np.maximum(places - GAP + 1, 0)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at]
        return (found >= wanted) & (found >> 32 == terms) & ((found & 0xFFFFFFFF) < places + GAP)


def phrases(shard: Shard, block: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches: window and start position."""
    there = np.where(block.terms >= 0, shard.count[np.maximum(block.terms, 0)], np.iinfo(np.int64).max)
    alive = np.flatnonzero((there > 0).all(1))
    order = np.argsort(there[alive], axis=1, kind="stable")
    if not len(alive):
        return alive, alive
    which, places = shard.lists(block.terms[alive, order[:, 0]])
    starts = places - order[which, 0]
    for rank in range(1, WINDOW):
        offset = order[which, rank]
        term = block.terms[alive[which], offset]
        good = (term < 0) | shard.has(np.maximum(term, 0), starts + offset)
        which, starts = which[good], starts[good]
    kept = starts >= 0
    return alive[which[kept]], starts[kept]


def proximities(shard: Shard, block: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Items with a window whose rarest terms lie close together: item and position of the term that was started from."""
    terms, least = block.rare_terms, block.rare_least
    there = (terms >= 0) & (shard.count[np.maximum(terms, 0)] > 0) if len(shard.keys) else np.zeros(terms.shape, bool)
    alive = np.flatnonzero(there.sum(1) >= least)
    items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in (0, 1):
        rows = alive[there[alive, start]]
        which, place = shard.lists(terms[rows, start])
        which, met = rows[which], np.ones(len(place), np.int64)
        others = [k for k in range(NEAR_TERMS) if k != start]
        for left, k in zip(range(len(others) - 1, -1, -1), others):
            term = terms[which, k]
            met = met + ((term >= 0) & shard.near(np.maximum(term, 0), place))
            # what cannot reach its number with the terms that are left goes
            good = met + left >= least[which]
            which, place, met = which[good], place[good], met[good]
        items.append(block.rare_items[which])
        places.append(place)
    return np.concatenate(items), np.concatenate(places)


def _counted(index: DataFrame, vocabulary: dict[bytes, int]) -> dict[bytes, int]:
    """Corpus counts of a block's terms: at most as many rows as the block has terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total.update({t: n for t, n in zip(terms.split(), np.frombuffer(counts, np.int32).tolist()) if t in vocabulary})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         names=["term", "n"])
    rows = mapped(index.select("terms", "counts"), run, "term binary, n bigint")
    return {bytes(r.term): r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _search(block: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _found(row, block)
    return run


def _found(row: dict, block: Windows) -> pa.RecordBatch:
    ids, starts, lengths = row["doc_ids"], np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
    shard = Shard(row["terms"], row["counts"], row["positions"], block.vocabulary)
    hits: list[list[int]] = [[] for _ in ids]
    items: list[set] = [set() for _ in ids]
    near: list[set] = [set() for _ in ids]
    window, start = phrases(shard, block)
    if len(window):
        end = int(starts[-1] + lengths[-1]) + 1
        change = np.zeros(end + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + block.lengths[window], -1)
        covered = np.flatnonzero(np.cumsum(change) > 0)
        of = np.searchsorted(starts, covered, "right") - 1
        docs, first = np.unique(of, return_index=True)
        for doc, places in zip(docs.tolist(), np.split(covered, first[1:])):
            hits[doc] = (places - starts[doc]).tolist()
        pairs = np.unique(np.stack([np.searchsorted(starts, start, "right") - 1, window], 1), axis=0)
        for doc, w in pairs.tolist():
            items[doc].update(block.owners[w])
    item, place = proximities(shard, block)
    if len(item):
        for doc, i in np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, item], 1), axis=0).tolist():
            near[doc].add(block.items[i])
    return to_batch(FOUND_ARROW, shard=[row["shard"]] * len(ids), doc_at=list(range(len(ids))), doc_id=ids,
                    text_key=row["text_keys"], n_words=lengths, hits=hits, items=[sorted(x) for x in items], near=[sorted(x) for x in near])


def search(index: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document: n_words, positions hit, items with an exact window, items found by proximity."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = None
    for number in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        block = Windows([(r.item_id, r.text.encode()) for r in held])
        block.rank(_counted(index, block.vocabulary))
        one = mapped(index, _search(block), FOUND)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        def merged(name: str) -> "F.Column":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
        found = (found.groupBy("shard", "doc_at")
                 .agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
                      merged("hits"), merged("items"), merged("near")))
    return found.drop("shard", "doc_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Index the documents, then look the benchmark up; see ``search``."""
    return search(build_index(docs), benchmark)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns kept; a row is known by its id, which may be missing, and its text."""
    found = decontaminate(docs, benchmark).where(F.size("hits") > 0).select("doc_id", "text_key").distinct()
    return matched(docs, found, "left_anti")


def _sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    words += "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_at, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, w[i + 1:i + {WINDOW}] AS part FROM (
  SELECT item, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(part) AS n FROM iw),
dw AS (SELECT row_at, i, n, w[i + 1:i + n] AS part FROM (
  SELECT row_at, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
m AS (SELECT row_at, i, n, item FROM dw JOIN iw USING (part)),
hit AS (SELECT row_at, count(DISTINCT i + s)::BIGINT AS n_hit FROM m, range({WINDOW}) r(s) WHERE s < n GROUP BY row_at),
named AS (SELECT row_at, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_at, item FROM m) GROUP BY row_at),
place AS (SELECT row_at, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
df AS (SELECT term, count(*) AS c FROM place GROUP BY term),
windows AS (SELECT row_number() OVER () AS win, item, part FROM (SELECT DISTINCT item, part FROM iw)),
ranked AS (SELECT win, item, term, row_number() OVER (PARTITION BY win ORDER BY c, encode(term)) AS k
  FROM (SELECT DISTINCT win, item, unnest(part) AS term FROM windows) JOIN df USING (term)),
rare AS (SELECT *, max(k) OVER (PARTITION BY win) AS most FROM ranked WHERE k <= {NEAR_TERMS}),
sets AS (SELECT DISTINCT item, list(term ORDER BY k) AS terms, any_value(most) AS most FROM rare GROUP BY win, item),
seed AS (SELECT DISTINCT item, terms, most, row_at, pos FROM sets s, LATERAL (SELECT unnest(s.terms[1:2]) AS term) t
  JOIN place USING (term)),
met AS (SELECT s.item, s.terms, s.most, s.row_at, s.pos, count(DISTINCT a.term) AS k FROM seed s JOIN place a
  ON a.row_at = s.row_at AND a.pos > s.pos - {GAP} AND a.pos < s.pos + {GAP} AND list_contains(s.terms, a.term)
  GROUP BY ALL),
near AS (SELECT row_at, count(DISTINCT item)::BIGINT AS n_near FROM met
  WHERE k >= CASE WHEN most > 2 THEN most - 1 ELSE most END GROUP BY row_at)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (row_at) LEFT JOIN named USING (row_at) LEFT JOIN near USING (row_at)"""


SQL = _sql()
