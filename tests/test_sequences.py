"""Window, fold and memory operators, against pinned values and brute force, whole and split."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import folds, memory, sampling, windows
from stepweave.operators import ordered as o
from stepweave.plans import jobs


def steps_frame(spark, episodes, **extra):
    """episodes: list of (env, exec_start, texts)."""
    rows = [(e, i, len(texts), t, start, i < start, env, [float(i)], [float(i) + 1])
            for e, (env, start, texts) in enumerate(episodes) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "epis_idx int, step_idx int, n int, subgoal string, exec_start int, is_demo boolean, "
                                       "env_id string, state array<double>, action array<double>")


def random_episodes(seed, count=4, length=90):
    rng = random.Random(seed)
    envs = ["BinFill", "PatternLock", "PickHighlight", "ButtonUnmask", "RouteStick", "StopCube"]
    out = []
    for i in range(count):
        texts, word = [], "a"
        for _ in range(rng.randint(length // 2, length)):
            if rng.random() < 0.12:
                word = rng.choice(["a", "b", "c", "complete", "d at <1, 2>"])
            texts.append(word)
        out.append((envs[i % len(envs)], rng.choice([0, 3, 8]), texts))
    return out


def per_episode(df, *cols):
    out = {}
    for r in df.orderBy("epis_idx", *cols).collect():
        out.setdefault(r.epis_idx, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def transitions(texts, start, env, strided):
    if strided and "PatternLock" in env:
        found = list(range(start, len(texts), 32))
        return found if found[-1] == len(texts) - 1 else [*found, len(texts) - 1]
    found, last = [], None
    for i in range(start, len(texts)):
        now = last if "complete" in texts[i] else texts[i]
        if now != last:
            found.append(i)
        last = now
    return [*found, len(texts) - 1]


def test_transitions_and_selection(either):
    episodes = random_episodes(1, 6)
    df = steps_frame(either, episodes)
    found = windows.transitions(df)
    expect = {e: transitions(t, s, env, True) for e, (env, s, t) in enumerate(episodes)}
    assert {e: [x for x, _ in rows] for e, rows in per_episode(found, "step_idx", "kind").items()} == expect
    picked = per_episode(windows.select_frames(found, 4, slow_stride=8), "step_idx", "duplicates")
    for e, (env, _, t) in enumerate(episodes):
        stride, chosen, copies = (8 if "StopCube" in env else 4), set(), {}
        for a, b in zip(expect[e][:-1], expect[e][1:]):
            m = (b - a) // stride
            chosen |= {int(a + i * ((b - a) / m)) for i in range(m)}
            copies[b] = max(m - 1, 0)
        copies.pop(len(t) - 1, None)
        chosen.add(len(t) - 1)
        assert picked[e] == [(x, copies.get(x, 0)) for x in sorted(chosen)]


def test_segment_sampling_pinned(spark):
    rows = [(0, s, k, 100, "BinFill") for s, k in ((0, 0), (40, 0), (50, 0), (99, 1))]
    points = spark.createDataFrame(rows, "epis_idx int, step_idx int, kind int, n int, env_id string")
    got = per_episode(windows.select_frames(points), "step_idx", "duplicates")[0]
    assert [x for x, _ in got] == [0, 20, 50, 66, 82, 99] and dict(got)[50] == 0


def test_merged_and_median_keyframes(either):
    rows = [(0, s, 10) for s in (5, 12, 20, 40, 45, 80)]
    df = either.createDataFrame(rows, "epis_idx int, step_idx int, exec_start int")
    assert per_episode(windows.merge_keyframes(df, F.lit(True)), "step_idx")[0] == [20, 45, 80]
    rows = [(0, s) for s in (1, 5, 9, 30, 33)]
    df = either.createDataFrame(rows, "epis_idx int, step_idx int")
    assert per_episode(windows.median_keyframes(df, F.lit(True)), "step_idx")[0] == [5, 33]


def average_merge(items):
    out = []
    for x in items:
        if out and abs(x - out[-1]) < 10:
            out[-1] = (x + out[-1]) // 2
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_average_merge(either, seed):
    rng = random.Random(seed)
    lists = {e: sorted(rng.sample(range(400), 60)) for e in range(3)} | {9: [3, 5, 12, 30]}
    df = either.createDataFrame([(e, s, 0) for e, x in lists.items() for s in x], "epis_idx int, step_idx int, exec_start int")
    got = per_episode(folds.average_merge(df), "step_idx")
    assert got == {e: average_merge(x) for e, x in lists.items()}


def test_local_minima(either):
    rng = random.Random(5)
    values = {e: [rng.random() for _ in range(120)] for e in range(2)}
    rows = [(e, i, 120, [0.0], [x]) for e, xs in values.items() for i, x in enumerate(xs)]
    df = either.createDataFrame(rows, "epis_idx int, step_idx int, n int, state array<double>, action array<double>")
    got = per_episode(folds.local_minima(df, threshold=0.5), "step_idx")
    for e, xs in values.items():
        kept = []
        for i in range(1, len(xs) - 1):
            if xs[i] < 0.5 and xs[i] < xs[i - 1] and xs[i] < xs[i + 1] and not (kept and i - kept[-1] < 5):
                kept.append(i)
        assert got[e] == kept


def test_chunks(either):
    rows = [(0, s, [float(s)]) for s in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10)]
    df = either.createDataFrame(rows, "epis_idx int, step_idx int, action array<double>")
    got = dict(per_episode(windows.action_chunks(df, 4, gaps=True), "step_idx", "actions")[0])
    assert got[2] == [[2.0], [3.0], [3.0], [5.0]] and got[9] == [[9.0], [10.0], [10.0], [10.0]]
    dense = df.where("step_idx >= 5")
    got = dict(per_episode(windows.action_chunks(dense, 4), "step_idx", "actions")[0])
    assert got[5] == [[5.0], [6.0], [7.0], [8.0]] and got[10] == [[10.0]] * 4


def test_trajectory_chunks(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(windows.traj_chunks(F.col("a"), 2).alias("x")).head().x == [[1, 2], [2, 3], [3, 3]]


def keyframes(env, listed):
    keys = list(listed)
    if env == "PickHighlight" and len(keys) >= 2:
        keys = sorted([*keys, int(keys[0] + (keys[1] - keys[0]) / 2)])
    if env in "ButtonUnmaskSwap" and len(keys) >= 3:
        a, b, c = keys[:3]
        extra = [int(p + i * ((q - p) / 3)) for p, q in ((a, b), (b, c)) for i in (1, 2)]
        keys = sorted(keys + extra)
    return keys[:-1]


def emitted(texts, start, keys):
    """The sequential rule: (step, frames, memory, candidate) per sample."""
    keys, memory_frames, frames, hit, out = list(keys), [], [], None, []
    n = len(texts)
    for count, idx in enumerate(range(start, n, 2)):
        frames.append(idx)
        if hit is None and keys and abs(idx - keys[0]) < 2:
            hit = (len(frames), idx)
        if count % 8 == 0 or idx in (n - 1, n - 2):
            out.append((idx, list(frames), list(memory_frames), hit[0] if hit else None))
            if hit:
                memory_frames.append(hit[1])
                keys.pop(0)
            frames, hit = [], None
    return out


def test_keyframe_samples(either):
    episodes = [e for e in random_episodes(3, 6) if e[0] not in ("PatternLock", "RouteStick")]
    df = steps_frame(either, episodes)
    keys = windows.keyframes(df, minima=folds.local_minima(df))
    expect = {e: keyframes(env, transitions(t, s, env, False)) for e, (env, s, t) in enumerate(episodes)}
    assert per_episode(keys, "step_idx") == expect
    got = per_episode(jobs.keyframe_samples(df, keys), "step_idx", "execution", "memory", "candidate")
    assert got == {e: emitted(t, s, expect[e]) for e, (_, s, t) in enumerate(episodes)}


def test_keyframe_emission_steps(spark):
    df = steps_frame(spark, [("BinFill", 0, ["a"] * 40)])
    got = per_episode(jobs.keyframe_samples(df, windows.keyframes(df)), "step_idx")[0]
    assert got == [0, 16, 32, 38]


def test_history_and_carry(either):
    texts = ["a", "a", "complete", "b at <1, 2>", "b at <3, 4>", "a", "a", "c", "c"]
    df = steps_frame(either, [("BinFill", 0, texts)])
    carried = windows.carry_forward(df, "subgoal", "subgoal")
    marked = carried.withColumns({"masked": F.regexp_replace("subgoal", "<.*>", "<bbox>"),
                                  "boxes": F.when(F.col("subgoal").contains("at"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))})
    got = per_episode(windows.history(marked, "masked", boxes="boxes"), "step_idx", "history", "history_boxes")[0]
    assert got[0][1] == [] and got[3][1] == ["a"] and got[4][1:] == (["a", "b at <bbox>"], [1])
    assert got[8][1:] == (["a", "b at <bbox>", "a", "c"], [1])


def test_numbering(either):
    episodes = random_episodes(7, 5, 30)
    df = steps_frame(either, episodes).withColumn("file", F.concat(F.lit("f"), (F.col("epis_idx") % 2).cast("string")))
    rows = jobs.number_samples(df, file="file").orderBy("file", "epis_idx", "step_idx").collect()
    assert [r.total_id for r in rows] == list(range(len(rows)))
    assert [r.sample_id for r in rows if not r.is_demo] == list(range(sum(not r.is_demo for r in rows)))
    assert [r.epis_number for r in rows] == sorted(r.epis_number for r in rows)


def test_skewed_group_is_cut(spark):
    spark.conf.set(o.SPLIT_ROWS, "10")
    df = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("g"), "id")
    cut = o.split(df, ["g"], "id")
    sizes = [r["count"] for r in cut.groupBy("g", o.BLOCK).count().collect()]
    spark.conf.unset(o.SPLIT_ROWS)
    assert max(sizes) <= 11 and len(sizes) == 6 + 40
    assert not o.is_split(o.split(df, ["g"], "id"))


def test_online_tokens_follow_the_heap(either):
    rng = random.Random(2)
    frames = [(0, s, [rng.random() for _ in range(64)]) for s in range(40)]
    df = either.createDataFrame(frames, "epis_idx int, step_idx int, pixels array<double>")
    scores = memory.token_scores(df, stride=4)
    assert sorted({r.step_idx for r in scores.collect()}) == [0, *range(3, 40, 4)]
    got = dict(per_episode(memory.online_tokens(df.select("epis_idx", "step_idx"), scores, budget=50, keep=80), "step_idx", "tokens")[0])
    rows = sorted(scores.collect(), key=lambda r: r.step_idx)
    for t in (0, 3, 11, 39):
        best = heapq.nlargest(50, [(r.score, r.step_idx, r.view, r.patch) for r in rows if r.step_idx <= t])
        assert [tuple(x) for x in got[t]] == sorted(b[1:] for b in best)


def test_shuffle_and_batches(spark):
    df = spark.range(10)
    ranked = sampling.shuffle(df, 1, "id")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(10))
    assert sampling.batches(ranked, 4).count() == 8
    wrapped = sampling.take_batches(sampling.shuffle(spark.range(4), 1, "id"), 4, 10)
    assert wrapped.groupBy("draw").count().count() == 10
    with pytest.raises(Exception, match="smaller than one batch"):
        sampling.batches(ranked, 11).collect()


def test_gather_history_misses_raise(spark):
    from stepweave.operators.joins import gather_history

    samples = spark.createDataFrame([(0, 1, [0, 1])], "epis_idx int, step_idx int, i array<int>")
    features = spark.createDataFrame([(0, 0, 5)], "epis_idx int, step_idx int, x int")
    with pytest.raises(Exception, match="no feature row for step 1"):
        gather_history(samples, features, "i", ["x"]).collect()


def test_blocks_hold_equal_numbers_of_rows(spark):
    from stepweave.operators import ordered

    rows = [(0, t, t) for t in range(1999)] + [(0, 10 ** 9, 1999)] + [(1, t, t) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, at long, n int")
    spark.conf.set(ordered.SPLIT_ROWS, "100")
    try:
        cut = ordered.split(df, ["k"], "at")
        sizes = [r["count"] for r in cut.where("k = 0").groupBy(ordered.BLOCK).count().collect()]
        assert len(sizes) >= 19 and max(sizes) <= 200 and cut.where(f"k = 1 AND {ordered.BLOCK} IS NOT NULL").count() == 0
        names = spark.createDataFrame([(f"data_{i % 97}", i) for i in range(1000)], "file string, episode int")
        marked = names.withColumn("b", ordered.quantile_bucket(names, ["file", "episode"]))
        sizes = [r["count"] for r in marked.groupBy("b").count().collect()]
        assert len(sizes) == 10 and max(sizes) <= 200
        numbered = ordered.number_all(names, ordered.quantile_bucket(names, ["file", "episode"]), ["file", "episode"],
                                      {"i": F.lit(1)}).orderBy("file", "episode").collect()
        assert [r.i for r in numbered] == list(range(1000))
        lists = ordered.prefix_list(df, ["k"], "at", F.when(F.col("n") % 3 == 0, F.col("n")), "before")
        for r in lists.collect():
            assert r.before == list(range(0, r.n, 3))
    finally:
        spark.conf.unset(ordered.SPLIT_ROWS)


def test_merged_tokens_keep_the_greatest():
    from stepweave.operators.memory import FIRST_SCORE, MIN_SCORE
    from stepweave.streaming.memory import merge_tokens

    rng = np.random.default_rng(0)
    pixels = rng.normal(size=(60, 5)).round(1)
    want, previous = [], pixels[0]
    for step in range(60):
        if step and (step + 1) % 4 == 0:
            want += [(s, step, 0, p) for p, s in enumerate(np.abs(pixels[step] - previous).tolist()) if s >= MIN_SCORE]
            previous = pixels[step]
    want = sorted([(FIRST_SCORE, 0, 0, p) for p in range(5)] + want)[-12:]
    kept, last = np.zeros((0, 4)), None
    for a, b in ((0, 1), (1, 2), (2, 30), (30, 60)):
        kept, last = merge_tokens(kept, np.arange(a, b), pixels[a:b], last, 4, 12)
    assert np.allclose(kept, want)
    one, _ = merge_tokens(np.zeros((0, 4)), np.arange(0, 8), pixels[:8], None, 4, 2)
    assert len(one) == 5


def test_histograms_keep_values_outside(spark):
    from stepweave.operators import stats

    df = spark.createDataFrame([([0.5],), ([5.0],), ([-3.0],), ([1.0],)], "x array<double>")
    got = {r.bin: r["count"] for r in stats.fixed_histogram(df, "x", 0.0, 1.0, 4).collect()}
    assert got == {2: 1, 4: 1, -1: 1, 3: 1}


def test_boxes_of_chat_records_are_drawn_once_per_step(spark):
    steps = spark.createDataFrame([(e, t, "goal", f"s{t // 2}", f"pick at <{t}, 5>", 0, 6, f"E{e}") for e in range(2) for t in range(6)],
                                  "epis_idx int, step_idx int, goal string, subgoal string, grounded string, exec_start int, n int, env_id string")
    steps = steps.withColumns({"completed": F.lit(False), "boundary": F.lit(False), "is_demo": F.lit(False)})
    out = jobs.build_chat_single(steps, noise_seed=3, stride=1, slow_stride=2)
    plan = out.select("epis_idx", "objects")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("explode(sequence")[0]
    assert "md5" in plan and "md5" not in above
