"""Segmented scans, block merges and token lifetimes against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import memory
from stepweave.operators import ordered as o


@pytest.mark.parametrize("seed", range(4))
def test_composed_moves(seed):
    rng = np.random.default_rng(seed)
    moves, begins = rng.integers(0, 4, (200, 4)), rng.random(200) < (0, 0.02, 0.3, 1)[seed]
    want, held = [], np.arange(4)
    for move, new in zip(moves, begins):
        held = move if new else move[held]
        want.append(held)
    assert (o.composed(moves, begins) == np.array(want)).all()


def test_earlier_blocks(spark):
    rng = random.Random(1)
    rows = [(e, b, [f"{e}.{b}.{i}" for i in range(rng.randrange(3))]) for e, n in ((1, 1), (2, 2), (3, 7), (4, 16))
            for b in range(0, 2 * n, 2)]
    df = spark.createDataFrame(rows, "k int, _blk int, v array<string>")
    got = {(r.k, r._blk): r.v for r in o.over_earlier_blocks(df, ["k"], "v", lambda a, b: F.concat(a, b)).collect()}
    for k, b, _ in rows:
        earlier = [x for e, at, v in rows if e == k and at < b for x in v]
        assert got[k, b] == (earlier if b else None)


@pytest.mark.parametrize("keep", [1, 5, 40])
def test_token_lifetimes(either, keep):
    rng = random.Random(keep)
    tokens = sorted({(e, rng.randrange(150), rng.randrange(2), rng.randrange(20)) for e in range(3) for _ in range(120)})
    rows = [(*t, rng.choice([0.5, 1.0, rng.random()])) for t in tokens]
    scores = either.createDataFrame(rows, "epis_idx int, step_idx int, view int, patch int, score double")
    steps = either.createDataFrame([(e, s) for e in range(4) for s in range(160)], "epis_idx int, step_idx int")
    lives = memory.token_lifetimes(scores, steps, keep).collect()
    at = {}
    for r in lives:
        assert r["from"] < r["to"] <= 160
        for s in range(r["from"], r["to"]):
            assert (r.step, r.view, r.patch) not in at.setdefault((r.epis_idx, s), set())
            at[r.epis_idx, s].add((r.step, r.view, r.patch))
    for e in range(4):
        for s in range(160):
            best = sorted(((v, t, w, p) for k, t, w, p, v in rows if k == e and t <= s), reverse=True)[:keep]
            assert at.get((e, s), set()) == {x[1:] for x in best}
    online = memory.online_tokens(steps, scores, budget=keep, keep=max(keep, 9)).collect()
    assert len(online) == 640
    for r in online:
        assert [tuple(x) for x in r.tokens] == sorted(at.get((r.epis_idx, r.step_idx), set()))
