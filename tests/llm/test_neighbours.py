"""Near copies, nearest vectors, components and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stepweave.llm import jaccard, neighbours
from stepweave.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id bigint, text string, h long, c long, n int, component string, part int, centre string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, "y") for i, t in rows], COLUMNS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """(doc_id, size, component) of every row by comparing all pairs; rows without an id take part."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    ids = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        ids[top(a)].append(i)
    return sorted(((i, len(sets[a]), min((x for x in ids[top(a)] if x is not None), default=None)
                    if sets[a] else i) for a, (i, _) in enumerate(rows)), key=repr)


def near_copies(seed, bases, copies, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text += [rng.choice(words)] * rng.randrange(4)
            rows.append((len(rows) * 3 % 1009, " ".join(text).title() if rng.random() < 0.1 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,bases,copies,edits", [(1, 25, 6, 3), (2, 2, 90, 4), (3, 60, 3, 1)])
def test_jaccard_components(spark, monkeypatch, seed, bases, copies, edits):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 400)  # several blocks to a star
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rows = near_copies(seed, bases, copies, edits)
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (None, "one two"),
             (None, rows[0][1]), (2006, rows[3][1]), (2006, rows[3][1]), (None, "lonely words without a document id"),
             (2007, "r " * 3000)]
    found = jaccard.link(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == groups(rows)


def test_one_of_each(spark):
    rows = near_copies(5, 20, 5, 2) + [(None, "a document without an id"), (3000, None)]
    docs = frame(spark, rows)
    kept = jaccard.one_of_each(docs)
    want = [i for i, _, c in groups(rows) if i is None or i == c]
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(7, text), (None, text), (None, text), (None, near), (None, "own words of a row without an id"), (None, None)]
    kept = jaccard.one_of_each(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([rows[0], *rows[4:]], key=repr)


def test_one_of_repeated_rows(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(7, text)] * 40 + [(8, text), (8, "unrelated text with the id of a copy"), (9, "alone")] + [(7, near)] * 2
    rows += [(None, "copied text without any id")] * 5 + [(None, "Copied text without any id"), (10, "")]
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, rows).repartition(5)).collect())
    assert set(kept.values()) == {1} and kept.keys() >= {rows[41], rows[42], (10, "")} and len(kept) == 5
    assert sorted(i for i, t in kept if t in (text, near)) == [7]
    assert sum(i is None for i, _ in kept) == 1


def test_no_documents_to_link(spark):
    assert jaccard.link(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.link(frame(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def test_block_answers():
    rng = np.random.default_rng(3)
    base = np.arange(0, 400, 2)
    members = [(k, k // 3, np.unique(np.concatenate([rng.choice(base, 200 - k, False), rng.integers(1, 900, k)])))
               for k in range(40)]
    asked = [(100 + k, k, np.unique(np.concatenate([rng.choice(base, 190, False), rng.integers(1, 900, 3 * k)])))
             for k in range(14)]
    want = set()
    for number, own, s in asked:
        for k, group, m in members:
            if group != own and 9 * len(np.intersect1d(s, m)) >= 4 * (len(s) + len(m)):
                want.add((number, group))
    got = jaccard.block_links(members, asked, 7)
    assert {(a, members[b][1]) for a, b in got} == want and len(got) == len(want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 640)] + [(9, 9)]
    up = {a: a for e in edges for a in e}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    want = {(a, top(a)) for a in up if any(a in e and e[0] != e[1] for e in edges)}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, dim int, shard int")


def exact(rows, asked=20):
    ok = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in ok:
        if q % 20 == 0:
            scored = [(-float(np.dot(np.float64(a), np.float64(b))), i) for i, b in ok if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:asked]]
    return out


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    monkeypatch.setattr(neighbours, "GROUP", 40)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.uniform(0.3, 2)]) for i in range(1600)]
    longest = max(np.linalg.norm(v) for _, v in rows)
    rows[5] = (5, [float(x * longest / np.linalg.norm(rows[5][1])) for x in rows[5][1]])
    rows += [(1600 + i, rows[5][1]) for i in range(500)]  # a vector with many copies
    rows += [(4000, None), (4020, []), (4040, [0.0] * 24), (4060, [1.0, None] * 12), (4080, [float("nan")] * 24),
             (4100, [float("inf")] + [1.0] * 23), (None, rows[1][1]), (4120, [1.0, 2.0]), (4121, [3.0, 1.0]),
             (40, rows[40][1]), (4140, [0.5] * 7)]
    got = defaultdict(list)
    for r in neighbours.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1 and r.vec_id != r.query_id
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == {q for q, v in want.items() if v} and got[4120] == want[4120]
    hit = sum(len({i for i, _ in v} & {i for i, _ in got[q]}) for q, v in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))
    true = {i: np.float64(np.float32(v)) for i, v in rows if i is not None and v and None not in v}
    for q, found in got.items():
        assert all(abs(s - true[q] @ true[i]) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in got[1600 + 20]] == [5, *range(1600, 1619)]


def test_several_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    rng = np.random.default_rng(3)
    rows = vectors(spark, [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5)]) for i in range(600)])
    whole = sorted(map(tuple, neighbours.nearest(rows).collect()))
    monkeypatch.setattr(neighbours, "CHUNK", 4)
    assert sorted(map(tuple, neighbours.nearest(rows).collect())) == whole and len(whole) == 600


@pytest.mark.parametrize("dim", [64, 256])
def test_recall_by_dimension(dim):
    x = np.random.default_rng(dim).normal(size=(6000, dim)).astype(np.float32)
    graph, asked = neighbours.Graph.build(np.arange(len(x)), x), np.arange(0, 6000, 40)
    found = {at: set(near) for at, near, _ in graph.nearest(asked, x[asked], 20)}
    like = x[asked].astype(float) @ x.T.astype(float)
    like[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-like, axis=1)[:, :20]
    assert np.mean([len(set(w) & found[i]) / 20 for i, w in enumerate(want)]) > 0.95


def test_no_vectors(spark):
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [(20, [1.0])])).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        assert docs.columns == columns and [f.dataType for f in docs.schema] and {r.doc_id for r in docs.collect()} <= set(rows)
        if name != "line dedup":
            assert all(tuple(r) == tuple(rows[r.doc_id]) for r in docs.collect())
        if name == "n-gram Jaccard join":
            want = [i for i, _, c in groups([(r.doc_id, r.text) for r in rows.values()]) if i == c]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        before = rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "sample", "n_pieces", "ids"]
    assert Counter(map(str, last.select(key).collect())) == Counter(map(str, whole.select(key).collect()))
    assert before and 0 < last.select("doc_id").distinct().count() <= len(before)
