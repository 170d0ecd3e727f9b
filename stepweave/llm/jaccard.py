"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more, as components.

The join is exact, skips index lists by blocks, and derives a set's answers from those of a highly similar set:

1. Every text becomes a sorted set of 64-bit shingle hashes; equal sets form a class (128-bit fingerprint). Only the
   hashes in the lowest ``LOW`` of the hash space are kept, and counted over all documents: a class with so many hashes of
   its own that no other can share four fifths of its set is alone. What is left is small where most texts are alone.
2. For the classes left, whole sets are stored. Shingles are ordered by document frequency; the prefix of a set that any
   similar set must share a shingle with is indexed, without the shingles that only one class has.
3. Each index list proposes its least edited set as centre. A set is compared with the centres it meets most often, and
   joins the star of the most similar one. Comparisons at the threshold are links.
4. What remains are sets of different components in one list. The lists are made of blocks, one per star part, with the
   ranges of size and position of their entries; a set skips blocks whose ranges rule a link out, and blocks whose
   components rank below its own, for those sets look at its block themselves.
5. In a block the overlap of a set with one member gives its overlap with all others by their differences. One link per
   set and component suffices. Sets meet blocks in bounded groups, so no task holds a whole list, star or component.

Skipping loses no link: every pair of similar sets shares a list, and is either in one component already or compared.

Defined results: null, empty and wordless texts have an empty set and are their own component; fewer than five words are
one shingle; rows without an id take part, and their component is the least id reached (null if none); rows that repeat an
id are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import mapped, matched, text_chunks, text_key, to_batch, written
from stepweave.llm.components import components

WORDS = 5
LOW = 0.3
FILTER_BITS = 1 << 22
CENTRES = 2
BLOCK_SHINGLES = 1 << 20
GROUP = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                np.uint64)
_HASH_LIMIT = -(1 << 63) + int(LOW * (1 << 64))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as int64."""
    known: dict[bytes, int] = {}
    sets = []
    for text in texts:
        words = words_of(text)
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(words) - WORDS + 1, min(len(words), 1))
        s = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(words))):
            s += h[i:i + n] * _MIX[i]
        if len(words) < WORDS:
            s += np.uint64(len(words))
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        sets.append(np.unique(s.view(np.int64)))
    return sets


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)) if parts else pa.array([], pa.int64()))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int64()), ("print", pa.binary()),
                     ("f", pa.int64()), ("low", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches):
        sets = shingle_sets(texts)
        prints = [fingerprint(s) for s in sets]
        yield to_batch(_SIGNED, doc_id=batch.column(0), text_key=batch.column(2), n=[len(s) for s in sets], print=prints,
                       f=[int.from_bytes(p[:8], "little", signed=True) for p in prints],
                       low=_lists([s[:np.searchsorted(s, _HASH_LIMIT)] for s in sets]))


def _prefix(n: str = "n") -> "F.Column":
    """Length of the prefix: n - ceil(4 n / 5) + 1."""
    return F.expr(f"{n} - (4 * {n} + 4) div 5 + 1")


def _not_alone(signed: DataFrame) -> DataFrame:
    """(print, rep) of the classes that may have a similar one; rep is their least doc_id."""
    low = signed.select("f", F.explode("low").alias("h"))
    own = (low.groupBy("h").agg(F.min("f").alias("f"), F.max("f").alias("g")).where("f = g")
           .groupBy("f").agg(F.count(F.lit(1)).alias("own")))
    classes = signed.where("n > 0").groupBy("print").agg(
        F.min("f").alias("f"), F.min("n").alias("n"), F.min("doc_id").alias("rep"))
    return written(classes.join(own, "f", "left").where(F.coalesce("own", F.lit(0)) < _prefix()).select("print", "rep"),
                   "classes")


_SETS = pa.schema([("c", pa.int64()), ("doc_id", pa.int64()), ("print", pa.binary()), ("n", pa.int64()),
                   ("s", pa.list_(pa.int64()))])


def _bit(column: str) -> "F.Column":
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _filter(classes: DataFrame) -> np.ndarray:
    """A bit per hashed id of a class' representative: FILTER_BITS bits, whatever the number of classes."""
    words = (classes.where("rep IS NOT NULL").select(_bit("rep").alias("bit"))
             .groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("m"))
             .collect())
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words:
        bits[r.word] = r.m
    return bits


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns],
                                         names=["c", *batch.schema.names])
        at += batch.num_rows


def _sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, print, n, s) of one row of each class, numbered; texts are read again rather than kept."""
    bits = _filter(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            maybe = (bits[bit // 32] >> (bit % 32).astype(np.uint32) & 1).astype(bool) | batch.column(0).is_null().to_numpy(
                zero_copy_only=False)
            for part, texts in text_chunks(iter([batch.filter(pa.array(maybe))])):
                sets = shingle_sets(texts)
                yield to_batch(pa.schema(list(_SETS)[1:]), doc_id=part.column(0), print=[fingerprint(s) for s in sets],
                               n=[len(s) for s in sets], s=_lists(sets))
    rows = docs.select("doc_id", "text", _bit("doc_id").alias("bit"))
    found = mapped(rows, run, "doc_id bigint, print binary, n bigint, s array<bigint>")
    one = (found.join(classes.withColumnRenamed("print", "p"),
                      (F.col("print") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("rep")))
           .select("print", "n", "s").dropDuplicates(["print"]))
    return written(mapped(one, _number, "c bigint, print binary, n bigint, s array<bigint>"), "sets")


def _index(sets: DataFrame) -> DataFrame:
    """Entries (h, c, n, own, pos): the indexed prefix of each set, shingles by frequency and hash, rarest first."""
    each = sets.select("c", "n", F.explode("s").alias("h"))
    shared = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequency")
    held = (each.join(shared, "h").groupBy("c", "n")
            .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("held"))
            .withColumn("own", F.col("n") - F.size("held")).where(F.col("own") < _prefix()))
    first = F.slice("held", F.lit(1), (_prefix() - F.col("own")).cast("int"))
    return written(held.select("c", "n", "own", F.posexplode(first).alias("at", "x"))
                   .select(F.col("x.h").alias("h"), "c", "n", "own", (F.col("own") + F.col("at")).alias("pos")), "index")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        both = [len(np.intersect1d(left[i].values.to_numpy(), right[i].values.to_numpy(), assume_unique=True))
                for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()),
             pa.array([len(x) for x in left], pa.int64()), pa.array([len(x) for x in right], pa.int64())],
            names=["c", "centre", "both", "n", "m"])


def _centred(index: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, centre, both, n, m): each set's overlap with the centres that its lists propose most often."""
    centre = written(index.groupBy("h").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("edits"), F.xxhash64("c").alias("r"), F.col("c"))).alias("x"),
        F.count(F.lit(1)).alias("k")).where("k > 1").select("h", F.col("x.c").alias("centre")), "centres")
    met = index.join(centre, "h").where("c <> centre").groupBy("c", "centre").agg(F.count(F.lit(1)).alias("k"))
    best = Window.partitionBy("c").orderBy(F.col("k").desc(), "centre")
    pairs = written(met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= CENTRES).select("c", "centre"),
                    "pairs")
    left = pairs.join(sets.select("c", F.col("s").alias("a")), "c")
    right = sets.select(F.col("c").alias("centre"), F.col("s").alias("b"))
    return written(mapped(
        left.join(right, "centre").select("c", "centre", "a", "b"), _overlaps, "c bigint, centre bigint, both bigint, n bigint, m bigint"), "overlaps")


PLACE = "struct(doc_id IS NULL AS none, doc_id, text_key)"
LINK = "9 * both >= 4 * (n + m)"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def block_links(members: list[tuple[int, int, np.ndarray]], asked: list[tuple[int, int, np.ndarray]],
                centre: int) -> list[tuple[int, int]]:
    """Links (set, member), one per set and other component, of ``asked`` with the block's ``members``.

    Both hold (number, component, shingles). Overlaps are computed with one member and derived for the others from what
    they add to it and lack of it.
    """
    members = sorted(members, key=lambda m: (m[0] != centre, m[0]))
    base = members[0][2]
    added = [np.setdiff1d(m[2], base, assume_unique=True) for m in members]
    lacked = [np.setdiff1d(base, m[2], assume_unique=True) for m in members]
    space = np.unique(np.concatenate([base, *added]))
    where = np.searchsorted(space, np.concatenate([x for pair in zip(added, lacked) for x in pair]))
    sizes = np.array([len(m[2]) for m in members])
    more, less = np.array([len(x) for x in added]), np.array([len(x) for x in lacked])
    sign = np.repeat(np.tile([1, -1], len(members)), np.stack([more, less], 1).ravel())
    ends = np.cumsum(more + less)
    groups = np.array([m[1] for m in members])
    of_base = np.searchsorted(space, base)
    found = []
    for number, group, s in asked:
        at = np.minimum(np.searchsorted(space, s), len(space) - 1)
        has = np.zeros(len(space), np.int64)
        has[at[space[at] == s]] = 1
        with_base = has[of_base].sum()
        if not (9 * (with_base + more) >= 4 * (len(s) + sizes)).any():
            continue  # no member adds enough
        running = np.concatenate([[0], np.cumsum(has[where] * sign)])
        both = with_base + running[ends] - running[ends - more - less]
        good = np.flatnonzero((9 * both >= 4 * (len(s) + sizes)) & (groups != group))
        for i in good[np.unique(groups[good], return_index=True)[1]]:
            found.append((number, members[i][0]))
    return found


def _compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    def rows(t: pa.Table) -> list:
        return [(c.as_py(), g.as_py(), s.values.to_numpy()) for c, g, s in zip(*t.columns[:3])]
    links = block_links(rows(left), rows(right), key[0].as_py()) if left.num_rows and right.num_rows else []
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _across(index: DataFrame, sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Links between components, found by taking sets to the blocks of their lists; placed: c, centre, part, component,
    size (of the component)."""
    entries = index.join(placed, "c")
    mixed = written(entries.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .where("lo <> hi").select("h"), "mixed")
    entries = written(entries.join(mixed, "h", "left_semi"), "entries")
    blocks = entries.groupBy("h", "centre", "part").agg(
        F.max(F.struct("size", "component")).alias("top"), F.min("n").alias("n_low"), F.max("n").alias("n_high"),
        F.max("pos").alias("pos_high"), F.max(F.col("n") - F.col("pos") - 1).alias("rest_high"))
    asking = entries.select("h", "c", "n", "pos", F.struct("size", "component").alias("rank"))
    most = F.least("pos", "pos_high") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("rest_high"))
    asked = (asking.join(blocks, "h").where((F.col("rank") < F.col("top")) & (5 * F.col("n_high") >= 4 * F.col("n"))
                                            & (5 * F.col("n") >= 4 * F.col("n_low"))
                                            & (9 * most >= 4 * (F.col("n") + F.col("n_low"))))
             .select("c", "centre", "part").distinct())
    asked = written(asked, "asked")
    groups = asked.groupBy("centre", "part").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    key = ["centre", "part", "number"]
    chunk = F.pmod(F.xxhash64("c"), F.col("groups")).cast("int").alias("number")
    left = (placed.join(groups, ["centre", "part"])
            .select("c", "component", "centre", "part", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int")))
                    .alias("number")).join(sets.select("c", "s"), "c"))
    right = (asked.join(groups, ["centre", "part"]).select("c", "centre", "part", chunk)
             .join(placed.select("c", "component"), "c").join(sets.select("c", "s"), "c"))
    names = ["c", "component", "s", *key]
    left = left.select(*[F.col(x).alias(x) for x in names])
    right = right.select(*[F.col(x).alias(f"by_{x}") for x in names])
    return left.groupBy(*key).cogroup(right.groupBy(*[f"by_{x}" for x in key])).applyInArrow(
        _compare, "a bigint, b bigint")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, print, ...) of every row of ``docs`` (doc_id, text), and (print, first) of every class of
    rows with words: the first row (none, doc_id, text_key) of its component, rows without an id last."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key().alias("text_key"))
    signed = written(mapped(
        docs, _sign, "doc_id bigint, text_key binary, n bigint, print binary, f bigint, low array<bigint>"), "signed")
    classes = _not_alone(signed)
    sets = _sets(docs, classes)
    index = _index(sets)
    overlaps = _centred(index, sets)
    links = overlaps.where(LINK).select(F.col("c").alias("a"), F.col("centre").alias("b"))
    tied = written(components(links), "components")

    near = overlaps.where("4 * both >= n + m").withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(
        (F.col("both") / (F.col("n") + F.col("m"))).desc(), "centre"))).where("r = 1").select("c", "centre")
    members = (index.select("c", "n").distinct().join(near, "c", "left")
               .withColumn("centre", F.coalesce("centre", "c"))
               .join(tied.withColumnRenamed("node", "c"), "c", "left")
               .withColumn("component", F.coalesce("component", "c")))
    # tables, like those below, so that the joins can be split where one star or component is very large
    members = written(members, "members")
    parts = written(members.groupBy("centre").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts")), "parts")
    sizes = written(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    placed = written(members.join(parts, "centre").join(sizes, "component").select(
        "c", "centre", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), "component", "size"), "placed")
    more = _across(index, sets, placed)
    tied = components(links.unionByName(more))

    named = sets.select("c", "print").join(tied, F.col("c") == F.col("node")).select("print", "component")
    of_class = signed.where("n > 0").groupBy("print").agg(F.min(F.expr(PLACE)).alias("first"))
    merged = written(of_class.join(named, "print"), "merged")
    least = written(merged.groupBy("component").agg(F.min("first").alias("component_first")), "component-first")
    of_class = written(of_class.join(merged.join(least, "component").select("print", "component_first"), "print", "left")
                       .select("print", F.coalesce("component_first", "first").alias("first")), "first")
    return signed, of_class


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    signed, of_class = _judged(docs)
    return (signed.select("doc_id", "n", "print").join(of_class, "print", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of least id, rows without an id last, then of least hash of its text; of rows that
    repeat both, one. Rows without words are components of their own and stay. Repeated rows are counted before they meet
    their class, and merged in each task before the shuffle."""
    signed, of_class = _judged(docs)
    rows = (signed.where("n > 0").groupBy("doc_id", "text_key", "print").agg(F.count(F.lit(1)).alias("copies"))
            .join(of_class, "print").withColumn("own", F.expr(PLACE) == F.col("first")))
    judged = written(rows.where("NOT own OR copies > 1").select("doc_id", "text_key", "own"), "judged")
    # a table of its own: mostly empty, so that the documents are not shuffled for it
    repeated = written(judged.where("own"), "repeated")
    return matched(docs, judged, "left_anti").unionByName(
        matched(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, w[i + 1:i + {WORDS}] AS part FROM (
  SELECT doc_id, w, unnest(range(greatest(len(w) - {WORDS - 1}, 1))) AS i FROM d WHERE w <> ['']) ),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.part = b.part AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""
