"""Classifiers against plain versions: statistics and densities, gradients and convolutions, notices scored one by one."""

import math
import random
import re
import zlib

import numpy as np
import xxhash

from stepweave.llm import licences, quality, toxicity

SYMBOLS = set("!#$%&*+/<=>?@[\\]^_`{|}~")


def plain_statistics(text):
    """The fourteen statistics, counted character by character and word by word."""
    data, words = text.encode(), text.encode().split()
    n, size = len(words) + 40, len(data)

    def share(test, typical):
        return (sum(map(test, data)) + typical * 250) / (size + 250)

    def per_word(count, typical):
        return (count + typical * 40) / n
    pairs = [(a, b) for a, b in zip(words, words[1:])]
    symbol = [chr(b) in SYMBOLS for b in range(128)] + [False] * 128
    return [math.log(per_word(size, 6.0)), math.sqrt(share(lambda b: 65 <= b <= 90, 0.02)), math.sqrt(share(lambda b: 48 <= b <= 57, 0)),
            math.sqrt(share(lambda b: chr(b) in ".,;:'\"()-", 0.03)), math.sqrt(share(lambda b: symbol[b], 0)),
            math.sqrt(per_word(len(re.findall(r" \| ", text)), 0)), per_word(len(set(words)), 0.7),
            (len(zlib.compress(data, 1)) + 125) / (size + 270),
            math.sqrt(per_word(len(re.findall(r"\. |\.\n|! |\? ", text)), 0.1)), per_word(sum(len(w) <= 3 for w in words), 0.3),
            math.sqrt(per_word(sum(symbol[w[-1]] for w in words), 0)), math.sqrt(per_word(len(pairs) - len(set(pairs)), 0.02)),
            math.sqrt(per_word(sum(w.isupper() for w in words), 0)), math.sqrt(per_word(sum(a == b for a, b in pairs), 0))]


def test_quality_statistics_and_scores(spark):
    rng = random.Random(4)
    words = ["the", "Of", "ÄRGER", "x1", "BUY!!!", "$$$", "end.", "why?", "naïve", "a,b", "12", "(so)", "OK", "|", "lorem"]
    texts = [(i, " ".join(rng.choices(words[:6 + i % 9], k=rng.randrange(0, 60))) + rng.choice(["", "\n", ". A"])) for i in range(150)]
    for _, t in texts:
        assert np.allclose(quality.statistics(t.encode()), plain_statistics(t))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 150, 2)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    x = {i: np.array(plain_statistics(t)) for i, t in texts}
    fitted = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5]
    of = [np.array([x[i] for i, y in fitted if y == c]) for c in (0, 1)]
    cov = [np.cov(m.T, bias=True) for m in of]
    pooled = sum(c * len(m) for c, m in zip(cov, of)) / len(fitted)

    def density(v, c):
        one = 0.9 * cov[c] + 0.1 * pooled
        one = 0.95 * one + 0.05 * np.diag(np.diag(one)) + np.diag(1e-6 + 1e-3 * np.diag(pooled))
        d = v - of[c].mean(0)
        return -0.5 * (d @ np.linalg.solve(one, d) + np.linalg.slogdet(one)[1])
    for r in rows:
        v = x[r.doc_id]
        logit = (density(v, 1) - density(v, 0)) / math.sqrt(14) + math.log(len(of[1]) / len(of[0]))
        assert np.isclose(r.score, 1 / (1 + math.exp(-max(-12, min(12, logit)))), atol=1e-6)


def plain_forward(net, codes):
    """Chance of each text: every filter at every place of the text, the greatest value, the logistic layer."""
    tables, out = net.tables.astype(float), []
    for c in codes:
        rows = sum(tables[s, c[:, s]] for s in range(toxicity.TABLES))
        rows = np.vstack([rows, np.zeros((toxicity.PAD, toxicity.DIM))])
        hidden = []
        for width, bank, bias in zip(toxicity.WIDTHS, net.filters, net.biases):
            values = [sum(rows[at + i] @ bank[i].astype(float) for i in range(width)) + bias for at in range(len(c))]
            hidden.append(np.maximum(np.max(values, axis=0), 0))
        out.append(1 / (1 + np.exp(-(np.concatenate(hidden) @ net.weights.astype(float) + float(net.bias[0])))))
    return np.array(out)


def random_texts(n):
    rng = random.Random(n)
    words = [f"word{i}" for i in range(40)]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 14))).encode() for _ in range(n)]


def test_toxicity_scorer_equals_the_plain_convolution():
    net, texts = toxicity.Network(), random_texts(40)
    net.biases = [np.linspace(-0.2, 0.2, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    codes = [toxicity.buckets(toxicity.words_of(t) or [b""]) for t in texts]
    assert np.allclose(toxicity.Scorer(net).score(texts), plain_forward(net, codes), atol=1e-5)


def test_toxicity_gradient_equals_differences():
    net, texts = toxicity.Network(), random_texts(12)
    codes = [toxicity.buckets(toxicity.words_of(t)) for t in texts]
    labels, weight = np.arange(12) % 2, np.linspace(0.5, 1.5, 12)

    def loss():
        p = plain_forward(net, codes)
        return -np.mean(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p)))
    before = [p.copy() for p in net.parameters()]
    held = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    toxicity._descend(net, held, 1, codes, labels.astype(np.float32), weight.astype(np.float32))
    grads = [m / 0.1 for m, _ in held]  # the first step's running mean is a tenth of the gradient
    for p, b in zip(net.parameters(), before):
        p[...] = b
    rng, checked = np.random.default_rng(1), 0
    for p, g in zip(net.parameters(), grads):
        strong = np.argwhere(np.abs(g) > np.abs(g).max() * 0.3)
        for at in map(tuple, rng.permutation(strong)[:6]):
            kept, ends = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = kept + step
                ends.append(loss())
            p[at] = kept
            assert np.isclose((ends[0] - ends[1]) / 2e-3, g[at], rtol=0.05, atol=1e-5)
            checked += 1
    assert checked > 20


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_features(passage):
    words = [w.encode() for w in re.split(r"[^a-z0-9]+", passage.lower()) if w]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    return list(dict.fromkeys(map(signed, one + [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, words[1:])])))


def test_licence_scores_one_by_one(spark):
    rng = random.Random(7)
    words = "the of project file use public version this under free and work permission granted code".split()
    texts = [(i, ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(4))) for i in range(60)]
    texts += [(100, "Some words first.\nReleased under the MIT License."), (101, "Licensed under the GNU GPL v3. All rights reserved."),
              (102, "This work is licensed under a Creative Commons\nAttribution 4.0 International License.")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model, templates = licences.train(docs)
    own = [(r.family, set(r.features) - set(model.common)) for r in templates.collect()]
    got = {(r.doc_id, x["at"]): (x.family, x.probability, x.agreement, x.confirmed) for r in licences.scan(docs).collect() for x in r.found}
    want, k = {}, len(licences.FAMILIES)
    weights = {f: w for f, w in zip(model.features, model.weights)}
    for i, text in texts:
        passages = []
        for s in re.split(r"(?<=[.!?])\s+|\n(?:[^\w\n]*\n)+", text):
            passages += [s, *s.split("\n")] if "\n" in s else [s]
        for at, passage in enumerate(passages):
            fs = plain_features(passage)
            if not fs or not any(f in weights for f in fs):
                continue
            z = sum(weights.get(f, model.rest) for f in fs) * licences.SCALE / len(fs) + model.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            best = int(p[:k].argmax())
            kept = set(fs) - set(model.common)
            both = [(len(t & set(fs) ), len(t)) for family, t in own if family == licences.FAMILIES[best]]
            if p[best] > model.cut and z[best] > z[-1] and any(b for b, _ in both):
                agreement = max(max(2 * b / (len(kept) + t), b / t if b / t >= licences.HELD else 0) for b, t in both if b)
                want[i, at] = (licences.FAMILIES[best], p[best], agreement, agreement >= licences.CONFIRM)
    assert got.keys() == want.keys() and {100, 101, 102} <= {i for i, _ in got}
    for key, (family, p, agreement, good) in want.items():
        assert got[key][0] == family and np.allclose(got[key][1:3], (p, agreement)) and got[key][3] == good


def test_licence_training_reads_every_passage(spark):
    """Words of templates held by just one passage in a hundred, and by one passage more, are told apart."""
    few = "software restriction merchantability warranties redistribution binary conditions implied compliance writing".split()
    many = "permission granted copyright publisher publication distribute sublicense merge attribution creative".split()
    held = [w for w in few for _ in range(80)] + [w for w in many for _ in range(81)]
    passages = [f"u{i} x{i} {held[i] if i < len(held) else f'y{i}'}." for i in range(8000)]
    random.Random(3).shuffle(passages)
    texts = [(i, " ".join(passages[i * 50:i * 50 + 50])) for i in range(160)]
    docs = spark.createDataFrame(texts + texts[:40] + [(500, texts[3][1]), (501, "Released under the MIT License."), (502, None)],
                                 "doc_id bigint, text string")
    model, templates = licences.train(docs)
    every = {f for r in templates.collect() for f in r.features}
    single = {w: plain_features(w)[0] for w in few + many}
    assert set(model.common) & every == {single[w] for w in many if single[w] in every}
    assert {single[w] for w in few if single[w] in every} <= set(model.features)
    assert sum(single[w] in every for w in few) >= 8 and sum(single[w] in every for w in many) >= 8


def test_licence_threshold_is_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.6, 0.7, 0.75 + rng.randrange(3) * 2.0 ** -50, 1 - rng.random() / 2]), rng.randrange(1, 4)) for _ in range(400)]
    rows += [(1.0, 2), (0.9, 1), (0.9, 3)]
    scores = spark.createDataFrame(rows, "score double, amount bigint")
    plain = sorted((s for s, n in rows for _ in range(n)), reverse=True)
    for above in (0, 1, 2, 9, 250, 500, len(plain) - 1):
        assert licences.ranked(scores, above, 0.5) == plain[above]
    assert licences.ranked(scores, len(plain), 0.5) == 0.5
