"""The trained operators: held-out accuracy, brute force on small inputs, and odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from stepweave.llm import markov, pieces, quality, toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id bigint, text string, lang string, score string, f int, n int, held string, label int"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (5, "x" * 9000), (6, "wort " * 30000),
       (7, "twice the same"), (7, "twice the same"), (8, "é ü ß ﬁ 　 \U0001F600 ▁ \x00")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "h", 3) for i, t in rows], COLUMNS)


def held(doc_id, of, rest):
    return doc_id is None or (zlib.crc32(str(doc_id).encode()) % of == rest)


def real(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_held_out(spark):
    docs, labels = real(spark, "documents"), real(spark, "labels")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert bad and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8
    kept = {r.doc_id for r in quality.kept(docs, labels).collect()}
    wanted = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    assert kept == wanted and quality.kept(docs, labels).columns == docs.columns


def test_quality_density_is_gaussian():
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(400, d)), rng.normal(0.7, 2, size=(300, d))]
    moments = np.stack([np.hstack([np.ones((len(a), 1)), a]).T @ np.hstack([np.ones((len(a), 1)), a]) for a in x])
    model = quality.Discriminant(moments)
    for c in (0, 1):
        cov = np.linalg.inv(model.white[c].T @ model.white[c])
        assert np.isclose(np.linalg.slogdet(cov)[1], model.log_det[c])
        diff = x[c][:5] - model.mean[c]
        assert np.allclose(((diff @ model.white[c].T) ** 2).sum(1), np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff))


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_scores_of_odd_rows(spark, classify):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(40)] + [(None, 1, 1, "x"), (3, None, None, "x"),
                                                                              (3, 1, 1, "x")],
                                   "doc_id bigint, quality int, toxic int, text string")
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    got = classify(docs.unionByName(frame(spark, [(i, f"word{i % 2} more text {i}") for i in range(10, 40)])), labels).collect()
    assert len(got) == len(ODD) + 30 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert classify(frame(spark, []), none).count() == 0


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(["zounds", "Knave!", "villain"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    marks = spark.createDataFrame(labels, "doc_id int, toxic int")
    got = toxicity.classify(frame(spark, rows), marks).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got]) > 0.95
    assert {"flagged", "predicted", "score"} <= set(got[0].asDict())


def test_unigram_scores(spark):
    rng = random.Random(6)
    pool = ["a", "B", "b", "É", "é", "c,", "d d", "THE", "the"]
    rows = [(i, rng.choice([" ", "\n", "\t"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))) for i in range(80)]
    rows += ODD + [(900, "never seen words")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]) for i, t in rows]
    count = collections.Counter(w for i, ws in tokens if not held(i, 7, 2) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i, 7, 2), len(ws), sum(count[w] > 0 for w in ws), n,
                    round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 8)) for i, ws in tokens), key=repr)
    found = markov.score(frame(spark, rows)).collect()
    assert sorted((tuple(r[:5]) + (round(r.base_score, 8),) for r in found), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert markov.score(frame(spark, [])).count() == 0
    unseen = next(i for i in range(100) if held(i, 7, 2))
    only = markov.score(frame(spark, [(unseen, "a b")])).first()
    assert (only.n_known, only.train_tokens, only.base_score) == (0, 0, 0.0)


def test_forward_and_expectations():
    rng = np.random.default_rng(1)
    sizes = np.append(rng.integers(1, 200, 30), 1)
    classes = rng.integers(0, markov.CLASSES, sizes.sum())
    model = markov.Model.first(np.bincount(classes, minlength=markov.CLASSES).astype(float))
    want = []
    for end, size in zip(np.cumsum(sizes), sizes):
        a, log = model.start[0], 0.0
        for t, c in enumerate(classes[end - size:end]):
            a = (a @ model.moves if t else a) * model.emits[c]
            log += math.log10(a.sum())
            a = a / a.sum()
        want.append(log)
    assert np.allclose(markov.log_likelihood(model, classes, sizes), want)
    start, moves, emits = np.zeros((2, markov.STATES)), np.zeros_like(model.moves), np.zeros((markov.STATES, markov.CLASSES))
    for first, size, rank in zip(*markov.segments(sizes)):
        s = classes[first:first + size]
        ahead = [model.start[int(rank > 0)] * model.emits[s[0]]]
        for c in s[1:]:
            ahead.append(ahead[-1] / ahead[-1].sum() @ model.moves * model.emits[c])
        back = [np.ones(markov.STATES)]
        for c in s[:0:-1]:
            back.insert(0, model.moves @ (model.emits[c] * back[0] / back[0].sum()))
        for t, c in enumerate(s):
            gamma = ahead[t] * back[t] / (ahead[t] @ back[t])
            emits[:, c] += gamma
            start[int(rank > 0)] += gamma * (t == 0)
            if t + 1 < size:
                both = ahead[t][:, None] * model.moves * (model.emits[s[t + 1]] * back[t + 1])
                moves += both / both.sum()
    for got, expected in zip(markov.expected(model, classes, sizes), (start, moves, emits)):
        assert np.allclose(got, expected, rtol=1e-3, atol=1e-3)
    before = markov.log_likelihood(model, classes, sizes).sum()
    assert markov.log_likelihood(markov.Model(start, moves, emits), classes, sizes).sum() > before


def test_markov_beats_unigram_on_held_out(spark):
    rows = markov.score(real(spark, "documents")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


TINY = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bab"]
                         + [f"<0x{i:02X}>" for i in range(256)], [False] + [True] * 8 + [False] * 256,
                         {i: 9 + i for i in range(256)})


def segmentations(text):
    """All segmentations with their probabilities, by plain recursion over the text with its mark."""
    log = dict(zip([TINY.bytes[i] for i in TINY.ids], TINY.log))
    text = (" " + text).encode()

    def walk(at):
        if at == len(text):
            return [((), 0.0)]
        return [((p, *rest), float(log[p]) + w) for p in log if text.startswith(p, at) for rest, w in walk(at + len(p))]
    found = walk(0)
    total = sum(math.exp(w) for _, w in found)
    return {s: math.exp(w) / total for s, w in found}


def test_sampling_without_replacement():
    text, n = "abab ba", 6000
    want = segmentations(text)
    first, either = collections.Counter(), collections.Counter()
    rows = [r for b in pieces.encode_block(TINY, list(range(n)), [text.encode()] * n, 2) for r in b.to_pylist()]
    by_doc = collections.defaultdict(list)
    for r in rows:
        s = tuple(TINY.bytes[i] for i in r["ids"])
        assert abs(r["log_prob"] - math.log(want[s])) < 1e-5 and r["decoded"]
        by_doc[r["doc_id"]].append((r["perturbed"], s))
        first[s] += r["sample"] == 1
        either[s] += 1
    assert all(len({s for _, s in v}) == 2 and v[0][0] > v[1][0] for v in by_doc.values())
    for s, p in want.items():
        second = p + sum(q * p / (1 - q) for t, q in want.items() if t != s)
        for got, chance in ((first[s], p), (either[s], second)):
            assert abs(got / n - chance) < 5 * math.sqrt(chance * (1 - chance) / n) + 1e-3


def test_all_segmentations_and_inclusion():
    text = "abab"
    want = segmentations(text)
    got = [r for b in pieces.encode_block(TINY, [3], [text.encode()], 1000) for r in b.to_pylist()]
    assert {tuple(TINY.bytes[i] for i in r["ids"]) for r in got} == set(want) and len(got) == len(want)
    assert all(r["log_inclusion"] == 0 for r in got)
    few = [r for b in pieces.encode_block(TINY, list(range(3000)), [text.encode()] * 3000, 2) for r in b.to_pylist()]
    # weighted by the inverse of its inclusion chance, the samples' probability adds up to one on average
    assert abs(sum(math.exp(r["log_prob"] - r["log_inclusion"]) for r in few) / 3000 - 1) < 0.05


def test_round_trip(spark):
    rows = ODD + [(20, "  two  spaces "), (21, "a\r\nb\tc"), (22, " "), (23, "▁"), (24, "a ▁ b")]
    found = pieces.encode(frame(spark, rows), samples=3)
    texts = collections.Counter((r.doc_id, r.text) for r in pieces.decode(found).where("sample = 1").collect())
    assert texts == collections.Counter((i, t or "") for i, t in rows)
    all_rows = found.collect()
    assert all(r.decoded for r in all_rows) and pieces.decode(found).where("sample = 3").count() > 0
    same = [tuple(r.ids) for r in all_rows if r.doc_id == 7 and r.sample == 2]
    assert len(same) == 2 and same[0] == same[1]
    assert [r.ids for r in all_rows if r.doc_id == 2] == [[]] and pieces.encode(frame(spark, [])).count() == 0
    again = {(r.doc_id, r["sample"], tuple(r.ids)) for r in pieces.encode(frame(spark, rows[::-1]), samples=3).collect()}
    assert again == {(r.doc_id, r["sample"], tuple(r.ids)) for r in all_rows}
