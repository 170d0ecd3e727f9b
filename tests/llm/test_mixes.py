"""Source mixing, the Merkle manifest and ranked search against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from stepweave.llm import merkle, mixing, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Further columns with names that also occur inside the operators.
EXTRA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, name string, size string, none int, row int, "
         "place string, position string, before string, target string, leaf int, at string, block string, docs int, n string, "
         "terms string, counts int, item string, rank string, score string, range string, budget int, path string, root int")
LONG = "Lorem " * 60000 + "End"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2, "c", "d", "e", "f", 3, "g", "h", 4, "i", "j", 5, "k", "l", "m", "n", 6, "o", 7)
                                  for r in rows], EXTRA).repartition(3)


def by_sql(sql, docs, items=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if docs:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    if items:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def corpus(n, seed, sources=7, langs=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "x1", "y-z", "of", "The", "in", "ñandú"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        hot = rng.random() < 0.35
        rows.append((i, text, f"l{0 if hot else rng.randrange(langs)}", f"s{0 if hot else rng.randrange(sources)}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "", "", 0), (n + 2, "one two", "l1", None, 7), (n + 3, LONG, "l1", "s2", 1),
             (None, "no id here", "l0", "s1", 3), (None, None, None, "s1", None), (5, rows[5][1], *rows[5][2:]),
             (5, rows[5][1], *rows[5][2:]), (6, "another text of an equal id", "l2", "s3", 2), (-3, "a\tb\x0bc d", "l1", "s4", 1)]
    return rows


def targets(sizes):
    """Sharing by weight and sharing the excess again, until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    held, rest, free = {}, Fraction(sum(sizes.values())), set(order)
    while free:
        share = rest / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not above:
            return held | {s: share * weight[s] for s in free}
        for s in above:
            held[s] = Fraction(3 * sizes[s])
            rest -= held[s]
        free -= above
    return held


@pytest.mark.parametrize("sources", [1, 7, 40])
def test_mix(spark, sources):
    docs = corpus(400, sources, sources)
    names = ["doc_id", "size", "source_size", "target", "taken"]
    first = mixing.mix(frame(spark, docs))
    columns, want = by_sql(mixing.SQL, docs)
    assert first.columns == names and columns == names
    got = rows_of(first, names)
    assert got == sorted(want, key=repr) == rows_of(mixing.mix(frame(spark, docs).repartition(5)), names)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in docs]
    assert sorted(size) == sorted(r[1] for r in got)
    total = Counter()
    for n, d in zip(size, docs):
        total[d[3]] += n
    wanted = sorted(float(x) for x in targets(total).values())
    assert np.allclose(sorted({(r[2], r[3]) for r in got}, key=lambda r: r[1])[-1][1], wanted[-1])
    by_target = defaultdict(int)
    for _, n, source_size, target, taken in got:
        assert n * int(min(target / source_size, 3) if source_size else 0) <= taken <= 3 * n
        by_target[source_size, target] += taken
    for (source_size, target), taken in by_target.items():
        n = sum(v == source_size for v in total.values())
        assert abs(taken - n * target) <= n
    assert all(np.isclose(wanted, t).any() for _, t in by_target)


def test_mix_of_no_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, "en", "a", 0), (2, " \n", "en", None, 0)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(d, text):
        return hashed(*map(field, (d[0], d[3], d[2], d[4], text)))

    def climb(nodes):
        """The last node, and for each node its siblings (before, after) by level."""
        paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
            for i, members in enumerate(under):
                run, at = runs[i // 8], i % 8
                for m in members:
                    paths[m].append(("".join(run[:at]), "".join(run[at + 1:])))
            under = [[m for x in under[i:i + 8] for m in x] for i in range(0, len(under), 8)]
            nodes = [hashed(*run) for run in runs]
        return nodes[0], paths

    langs = defaultdict(list)
    for d in docs:
        langs[d[2]].append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    climbed = {x: climb([leaf for *_, leaf, _ in sorted(langs[x], key=lambda r: r[:3])]) for x in order}
    if not order:
        return []
    root, above = climb([climbed[x][0] for x in order])
    out = []
    for x, upper in zip(order, above):
        subroot, paths = climbed[x]
        for (_, _, mine, d), path in zip(sorted(langs[x], key=lambda r: r[:3]), paths):
            path = path + upper
            node = mine
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0:
                node = leaf(d, d[1] and d[1].translate(LOWER))
            for a, z in path:
                node = hashed(a, node, z)
            out.append((d[0], mine, subroot, root, hashed(*(s for p in path for s in p)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, n, langs", [(3, 700, 3), (1, 700, 2), (1, 90, 70), (1, 900, 10)])
def test_manifest(spark, monkeypatch, levels, n, langs):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** levels)
    docs = corpus(n, levels + langs, langs=langs)
    found = merkle.manifest(frame(spark, docs))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == names
    got = rows_of(found, names)
    assert got == brute_manifest(docs)
    columns, want = by_sql(merkle.SQL, docs)
    assert columns == names and got == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9])
def test_small_manifests(spark, n):
    docs = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = rows_of(merkle.manifest(frame(spark, docs)), names)
    assert got == brute_manifest(docs)
    assert n != 1 or got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()


def brute_ranks(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [Counter(pattern.findall((d[1] or "").translate(LOWER))) for d in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for c in counts for t in c)
    out = []
    for name, text in items:
        terms = set(pattern.findall((text or "").translate(LOWER)))
        scores = []
        for d, c, s in zip(docs, counts, sizes):
            m = 10 + 90 * s * n // total if s else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if c[t])
            if score > 0:
                scores.append((-score, d[0] is None, d[0] or 0))
        out += [(name, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def searched(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["É", "É2", "MiX", "w_1"]
    docs = []
    for i in range(1500):
        topic = rng.sample(vocabulary, 12)
        docs.append((i, " ".join(rng.choice(topic if rng.random() < 0.7 else vocabulary) for _ in range(rng.randrange(0, 60))),
                     "en", "s", 1))
    docs += [(2000 + i, docs[3][1], "en", "s", 1) for i in range(30)] + [(3, docs[3][1], "en", "s", 1)]
    docs += [(None, docs[3][1], "en", "s", 1), (9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "--", "en", "s", 1),
             (9003, LONG, "en", "s", 1)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    items += [(50, docs[3][1]), (51, None), (52, ""), (53, "absent"), (54, "lorem, END"), (None, "w1 w2"), (3, "w3 w5 w5")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_ranks(spark, block):
    docs, items = searched(5)
    bench = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in items], "item_id bigint, text string, rank string, row int, doc_id string")
    found = ranked.rank(frame(spark, docs), bench, block)
    names = ["item_id", "rank", "doc_id", "score"]
    assert found.columns == names
    got = rows_of(found, names)
    assert got == brute_ranks(docs, items)
    columns, want = by_sql(ranked.SQL, docs, items)
    assert columns == names and got == sorted(want, key=repr)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert ranked.rank(frame(spark, []), some).count() == 0
    assert ranked.rank(frame(spark, searched(1)[0][:5]), none).count() == 0


def test_summaries_bound_and_skip():
    """Every document lies in a block of each of its terms, under the block's bound; unskipped search agrees with skipping."""
    docs, texts = searched(8)
    items = ranked.Items([(t or "").encode() for _, t in texts])
    counted = [Counter(ranked.terms_of((d[1] or "").encode())) for d in docs]
    kept = [[(items.vocabulary[t], c) for t, c in held.items() if t in items.vocabulary] for held in counted]
    df = Counter(t for row in kept for t, _ in row)
    items.weigh(len(docs), df)
    rows = ranked.pa.RecordBatch.from_arrays([
        ranked.pa.array([d[0] for d in docs], ranked.pa.int64()), ranked.pa.array([sum(c.values()) for c in counted], ranked.pa.int64()),
        ranked.pa.array([[t for t, _ in row] for row in kept], ranked.pa.list_(ranked.pa.int32())),
        ranked.pa.array([[c for _, c in row] for row in kept], ranked.pa.list_(ranked.pa.int32()))], schema=ranked.COUNTED_ARROW)
    shard = ranked.Shard(ranked._shard(rows, items, len(docs), sum(sum(c.values()) for c in counted)).to_pylist()[0], items.weight)
    there = opened = 0
    for terms in items.terms:
        asked = np.zeros(len(items.weight), bool)
        asked[terms] = True
        scores = shard.scores(np.arange(len(docs)), asked)
        heavier = np.zeros(len(docs), bool)
        for term in terms:
            if term not in shard.lists:
                continue
            first, amount = shard.lists[term]
            bounds, members = shard.bounds(term, asked), []
            for at in range(amount):
                block = shard.documents(np.array([first + at]))
                assert (scores[block[~heavier[block]]] <= bounds[at]).all()
                members.append(block)
            members = np.concatenate(members)
            assert len(set(members.tolist())) == len(members) == df[int(np.flatnonzero(items.code == term)[0])]
            heavier[members] = True
        best = []
        a, o = ranked.search_shard(shard, terms, asked, best)
        there, opened = there + a, opened + o
        want = sorted((-int(s), docs[i][0] is None, docs[i][0] or 0) for i, s in enumerate(scores) if s > 0)
        assert best == want[:10]
    assert opened < there
