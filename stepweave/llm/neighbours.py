"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt by hash to shards of about ``SHARD_ROWS`` vectors of one dimension. A shard keeps its distinct vectors,
the least ids of each, and per layer a flat array of neighbours (-1: none). Nodes enter in order of falling level; a node
is tied to earlier nodes that are nearer to it than to each other, and ties are mutual, up to ``2 * DEGREE`` (``DEGREE``
above the lowest layer). Nearness in the graph is the inner product itself, for building as for searching, so long
vectors become the hubs that searches for large products pass through. Every row is indexed; nothing is sampled.

A shard's row travels once for each ``CHUNK`` queries, ahead of them in one sorted partition, and the queries stream past it
in groups of at most ``GROUP``: greedy descent through the upper layers, then a beam over the lowest, ``BEAM`` wide for up to
64 dimensions and wider in proportion beyond, for all queries of the group at once. Scores are computed again in double precision on the original
vectors, copies of a vector are listed by their ids, and each query's best rows over all shards are merged by a window
that keeps no more than the asked number per task before the shuffle.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and rows without an id, take no
part; vectors of different dimension are not compared; rows that repeat id and vector count once; of rows that repeat an
id with other vectors each is a candidate, but not for that id, and their own searches are one; ties go to the smaller id; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import mapped, to_batch, written

SHARD_ROWS = 32768
DEGREE, CANDIDATES, BEAM, EXPANDED, GROUP, CHUNK = 16, 64, 192, 8, 2048, 1 << 17
ASKED, EVERY, SEED = 20, 20, 5
ROWS = 256  # at a time against a whole shard while building


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<float>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where("vec_id IS NOT NULL AND size(embedding) > 0").where(~F.coalesce(bad, F.lit(True)))
            .where(F.exists("embedding", lambda x: x != 0)).distinct().withColumn("dim", F.size("embedding")))


def _spread(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates, by falling similarity, those nearer to it than to any chosen before; -1 elsewhere."""
    chosen = np.full((len(nodes), degree), -1, np.int32)
    count = np.zeros(len(nodes), np.int64)
    for at in range(found.shape[1]):
        c = found[:, at]
        open_ = np.flatnonzero((c >= 0) & (count < degree))
        if not len(open_):
            break
        held = chosen[open_]
        between = np.einsum("nkd,nd->nk", x[held], x[c[open_]])
        between[held < 0] = -np.inf
        good = open_[(between.max(1) < near[open_, at])]
        chosen[good, count[good]] = c[good]
        count[good] += 1
    return chosen


def _sorted(found: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)


def layer(x: np.ndarray, degree: int, most: int) -> np.ndarray:
    """Neighbour lists (n, most) of nodes in order of entry."""
    n = len(x)
    ties = np.full((n, degree), -1, np.int32)
    for at in range(0, n, ROWS):
        rows = np.arange(at, min(at + ROWS, n))
        near = x[rows] @ x[:rows[-1] + 1].T
        near[np.arange(rows[-1] + 1)[None] >= rows[:, None]] = -np.inf  # earlier nodes only
        k = min(CANDIDATES, near.shape[1])
        found = np.argpartition(-near, k - 1, axis=1)[:, :k].astype(np.int32)
        found, near = _sorted(found, np.take_along_axis(near, found, 1))
        found[np.isneginf(near)] = -1
        ties[rows] = _spread(x, rows, found, near, degree)
    start, end = np.nonzero(ties >= 0)[0], ties[ties >= 0]
    source, target = np.concatenate([start, end]), np.concatenate([end, start])
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    size = np.bincount(source, minlength=n)
    rank = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
    lists = np.full((n, max(int(size.max(initial=0)), most)), -1, np.int32)
    lists[source, rank] = target
    full = np.flatnonzero(size > most)
    for at in range(0, len(full), ROWS):
        rows = full[at:at + ROWS]
        width = int(size[rows].max())
        found = lists[rows, :width]
        near = np.empty(found.shape, np.float32)
        for j in range(width):
            near[:, j] = np.einsum("nd,nd->n", x[found[:, j]], x[rows])
        near[found < 0] = -np.inf
        found, near = _sorted(found, near)
        kept = _spread(x, rows, found, near, most)
        lists[rows] = -1
        lists[rows, :most] = kept
    return np.ascontiguousarray(lists[:, :most])


class Graph:
    """Distinct vectors in order of entry, ids of each, and the layers, lowest first; layer l has the first ``sizes[l]``."""

    def __init__(self, x: np.ndarray, sizes: list[int], lists: list[np.ndarray], first: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.sizes, self.lists, self.first, self.ids = x, sizes, lists, first, ids

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray) -> "Graph":
        x = np.ascontiguousarray(x + np.float32(0))  # -0.0 and 0.0 are one
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, one, of = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True,
                               return_inverse=True)
        rng = np.random.default_rng(SEED)
        level = np.floor(-np.log(1 - rng.random(len(one))) / np.log(DEGREE)).astype(int)
        enter = np.argsort(-level, kind="stable")
        place = np.empty(len(one), np.int64)
        place[enter] = np.arange(len(one))
        of = place[of]
        group = np.argsort(of, kind="stable")
        size = np.bincount(of, minlength=len(one))
        first = np.concatenate([[0], np.cumsum(size)])
        distinct = x[one[enter]]
        sizes = [int((level >= l).sum()) for l in range(level.max(initial=0) + 1)]
        lists = [layer(distinct[:n], DEGREE, DEGREE * (2 if l == 0 else 1)) for l, n in enumerate(sizes)]
        return Graph(distinct, sizes, lists, first, ids[group])

    def search(self, q: np.ndarray) -> np.ndarray:
        """For each query the nodes of its beam (-1: none)."""
        n = len(q)
        now = np.zeros(n, np.int64)
        best = q @ self.x[0]
        for lists in self.lists[:0:-1]:
            moving = np.arange(n)
            while len(moving):
                near = lists[now[moving]]
                like = np.einsum("nkd,nd->nk", self.x[near], q[moving])
                like[near < 0] = -np.inf
                at = like.argmax(1)
                up = like[np.arange(len(moving)), at] > best[moving]
                moving, at, like, near = moving[up], at[up], like[up], near[up]
                now[moving], best[moving] = near[np.arange(len(moving)), at], like[np.arange(len(moving)), at]
        width = BEAM * max(1, -(-self.x.shape[1] // 64))
        beam = np.full((n, width), -1, np.int64)
        like = np.full((n, width), -np.inf, np.float32)
        done = np.ones((n, width), bool)
        seen = np.zeros((n, len(self.x)), bool)
        beam[:, 0], like[:, 0], done[:, 0] = now, best, False
        seen[np.arange(n), now] = True
        live = np.arange(n)
        while len(live):
            # the nearest unexpanded nodes of each beam, several at a time
            open_ = np.where(done[live], -np.inf, like[live])
            at = np.argpartition(-open_, EXPANDED - 1, axis=1)[:, :EXPANDED]
            value = np.take_along_axis(open_, at, 1)
            going = ~np.isneginf(value.max(1))
            live, at, value = live[going], at[going], value[going]
            if not len(live):
                break
            done[live[:, None], at] = True
            near = self.lists[0][np.where(np.isneginf(value), 0, beam[live[:, None], at])].astype(np.int64)
            near[np.isneginf(value)] = -1
            near = np.sort(near.reshape(len(live), -1), axis=1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, column = np.nonzero(fresh)
            node = near[row, column]
            seen[live[row], node] = True
            score = np.full(near.shape, -np.inf, np.float32)
            score[row, column] = np.einsum("nd,nd->n", self.x[node], q[live[row]])
            all_like = np.hstack([like[live], score])
            top = np.argpartition(-all_like, width - 1, axis=1)[:, :width]
            like[live] = np.take_along_axis(all_like, top, 1)
            beam[live] = np.take_along_axis(np.hstack([beam[live], near]), top, 1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~fresh]), top, 1)
        return np.where(np.isneginf(like), -1, beam)

    def nearest(self, ids: np.ndarray, q: np.ndarray, asked: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query (its place): ids and exact scores of the best rows found, none of its own id."""
        beams = self.search(q)
        for at in range(len(q)):
            nodes = beams[at][beams[at] >= 0]
            score = (self.x[nodes].astype(np.float64) * q[at].astype(np.float64)).sum(1)
            rows, of = [], []
            for k in np.lexsort((self.ids[self.first[nodes]], -score)):
                own = self.ids[self.first[nodes[k]]:self.first[nodes[k] + 1]][:asked + 1]
                rows.append(own[own != ids[at]])
                of.append(np.full(len(rows[-1]), score[k]))
            if rows:
                rows, of = np.concatenate(rows), np.concatenate(of)
                order = np.lexsort((rows, -of))[:asked]
                yield at, rows[order], of[order]


_STORED = "dim int, shard int, ids binary, x binary, first binary, sizes array<int>, lists array<binary>"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    g = Graph.build(rows["vec_id"].to_numpy(), _matrix(rows["embedding"], dim))
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "ids": [g.ids.tobytes()],
                     "x": [g.x.tobytes()], "first": [g.first.astype(np.int64).tobytes()],
                     "sizes": pa.array([g.sizes], pa.list_(pa.int32())),
                     "lists": pa.array([[l.tobytes() for l in g.lists]], pa.list_(pa.binary()))})


def _load(row: dict) -> Graph:
    lists = [np.frombuffer(l, np.int32).reshape(n, -1) for l, n in zip(row["lists"], row["sizes"])]
    return Graph(np.frombuffer(row["x"], np.float32).reshape(-1, row["dim"]), row["sizes"], lists,
                 np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int64))


def build_index(rows: DataFrame) -> DataFrame:
    """One stored row per shard of the usable rows (vec_id, embedding, dim)."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = rows.join(sizes, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("shards")).cast("int").alias("shard"), "vec_id", "embedding")
    # as many tasks as shards, so that small shards are not put together
    return written(dealt.repartition(max(1, total), "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, _STORED),
                   "graphs")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _answer(asked: int):
    """Searches of a sorted partition: a shard's row, then the queries that are to meet it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph = None, None
        for batch in batches:
            own = batch.select(["dim", "shard", "part"]).to_pylist()
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if not is_query[at]:
                    key, graph = own[at], _load({**own[at], **batch.select(STORED).slice(at, 1).to_pylist()[0]})
                    at += 1
                    continue
                end = at + 1
                while end < batch.num_rows and end - at < GROUP and is_query[end] and own[end] == own[at]:
                    end += 1
                if own[at] == key:
                    yield _group(graph, batch.slice(at, end - at), key["dim"], asked)
                at = end
    return run


def _group(graph: Graph, rows: pa.RecordBatch, dim: int, asked: int) -> pa.RecordBatch:
    own, q = rows.column("query_id").to_numpy(), _matrix(pa.chunked_array([rows.column("query")]), dim)
    ids, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, near, score in graph.nearest(own, q, asked):
        ids.append(np.full(len(near), own[at]))
        found.append(near)
        scores.append(score)
    return to_batch(_FOUND, query_id=np.concatenate(ids), vec_id=np.concatenate(found), score=np.concatenate(scores))


STORED = ["ids", "x", "first", "sizes", "lists"]


def search(index: DataFrame, queries: DataFrame, asked: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``asked`` nearest found of each query (vec_id, embedding, dim)."""
    queries = written(queries.select("vec_id", "embedding", "dim"), "queries")
    parts = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    tasks = shards.join(parts, "dim").agg(F.coalesce(F.sum((F.col("last") + 1) * F.col("parts")), F.lit(0))).first()[0]
    left = index.join(parts, "dim").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           F.lit(False).alias("is_query"), *STORED)
    right = queries.join(parts, "dim").join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("is_query"),
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    key = ["dim", "shard", "part"]
    both = left.unionByName(right, allowMissingColumns=True).repartition(max(1, min(tasks, 4096)), *key)
    met = mapped(both.sortWithinPartitions(*key, "is_query"), _answer(asked), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= asked)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame) -> DataFrame:
    """The neighbours of every row whose id is divisible by EVERY, among all rows."""
    rows = usable(vectors)
    return search(build_index(rows), rows.where(F.col("vec_id") % EVERY == 0))
