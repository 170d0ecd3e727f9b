"""Histories of samples that share what they ask for."""

import random

import pytest
from pyspark.sql import functions as F

from stepweave.operators import joins, memory, stats
from stepweave.plans import jobs

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def rows_of(df):
    return sorted(tuple(map(repr, r)) for r in df.collect())


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_shared_histories_are_plain_ones(spark, batch):
    rng = random.Random(5)
    # two rows of a sample and of a feature, a list with repeats, one of later steps, an empty and a null one
    samples = [(e, s, f"{e}:{s}", [rng.randrange(30) for _ in range(rng.randrange(1, 9))]) for e in range(3) for s in range(30)]
    samples += [(1, 7, "again", [2, 29]), (2, 7, "later", [29, 28]), (0, 50, "empty", []), (0, 51, "null", None)]
    features = [(e, s, [float(e), float(s)], None if s % 7 == 0 else "x" * s) for e in range(4) for s in range(30)]
    features += [(1, 29, [0.5], "first"), (1, 2, [9.0], None), (None, 3, [1.0], "no key")]
    left = spark.createDataFrame(samples, "epis_idx int, step_idx int, mark string, i array<int>")
    right = spark.createDataFrame(features, "epis_idx int, step_idx int, x array<double>, y string")
    shared = [F.col("step_idx") % 4, F.floor(F.col("step_idx") / 8)]
    plain = joins.gather_history(left, right, "i", ["x", "y"])
    spark.conf.set(BATCH, batch)
    try:
        got = joins.gather_history(left, right, "i", ["x", "y"], shared=shared)
        assert got.columns == plain.columns and dict(got.dtypes) == dict(plain.dtypes)
        assert rows_of(got) == rows_of(plain) and got.count() == 92
    finally:
        spark.conf.unset(BATCH)


def test_shared_histories_miss_and_lack_keys(spark):
    features = spark.createDataFrame([(0, 0, 5), (0, 3, 6)], "epis_idx int, step_idx long, x int")
    kind = "epis_idx int, step_idx long, i array<long>"
    known = spark.createDataFrame([(0, 1, [3, 0]), (None, 1, [0]), (0, None, [0])], kind)
    got = joins.gather_history(known, features, "i", ["x"], shared=[F.col("step_idx") % 2]).collect()
    assert [(r.step_idx, [(h._pos, h.at, h.x) for h in r.history]) for r in got] == [(1, [(0, 3, 6), (1, 0, 5)])]
    with pytest.raises(Exception, match="no feature row for step 1"):
        joins.gather_history(spark.createDataFrame([(0, 1, [0, 1])], kind), features, "i", ["x"],
                             shared=[F.col("step_idx") % 2]).collect()


def recurrent(spark, n, wide=1):
    """An episode whose vectors tell their step, and its samples after two steps of demonstration."""
    features = spark.range(n).select(F.lit(4).alias("epis_idx"), F.col("id").cast("int").alias("step_idx"),
                                     F.array(F.array_repeat(F.col("id").cast("float"), wide)).alias("image_emb_8x8"),
                                     F.array(F.array_repeat(F.col("id") * 0.5, wide)).alias("pos_emb_8x8"),
                                     F.array(F.col("id").cast("double")).alias("state"))
    return features.where("step_idx >= 2").select("epis_idx", "step_idx", F.lit(2).alias("exec_start")), features


def test_recurrent_memory_of_long_episodes(spark):
    samples, features = recurrent(spark, 2500, wide=300)
    got = memory.assemble_recurrent(samples, features).select("step_idx", F.transform(
        "recur_image_emb", lambda x: F.get(F.get(x, F.lit(0)), F.lit(299))).alias("at"), F.transform(
        "recur_state_emb", lambda x: F.get(x, F.lit(0))).alias("state"), F.transform("recur_mask", lambda m: m.cast("int")).alias("mask"))
    found = {r.step_idx: (r.at, r.state, sum(r.mask)) for r in got.collect()}
    assert sorted(found) == list(range(2, 2500))
    for t, (at, state, used) in found.items():
        asked = ([0] + ([t] if t - 2 < 16 else list(range((t - 2) % 16 + 2, t + 1, 16))))[-64:]
        assert at == state == [0.0] * (64 - len(asked)) + asked and used == len(asked)


def test_histories_are_not_exchanged_and_do_not_wait_for_prompts(spark):
    samples, features = recurrent(spark, 40)
    given = samples.select("*", F.col("step_idx").cast("bigint").alias("sample_id"), F.lit("Pick up").alias("prompt"),
                           F.array(F.lit(0.1), F.lit(0.2)).alias("state"), F.array(F.array(F.lit(0.3), F.lit(0.4))).alias("actions"))
    norm = {"state": stats.NormStats([0.1, 0.1], [0.5, 0.5]), "actions": stats.NormStats([0.05, 0.05], [0.2, 0.2])}
    out = jobs.training_examples(given, features, norm=norm, use_quantiles=False, memory_type="recurrent", mask=[True, False])
    plan = out._jdf.queryExecution().executedPlan().toString()
    above, below = plan[:plan.index("MapInArrow gather")], plan[plan.index("MapInArrow gather"):]
    assert not any(word in above for word in ("Exchange", "Sort ", "Join", "Aggregate", "ArrowEvalPython"))
    assert "ArrowEvalPython" in below and "collect_list" not in plan
    assert out.columns[-2:] == ["tokenized_prompt", "tokenized_prompt_mask"]
    row = out.where("step_idx = 20").head()
    assert row.tokenized_prompt[:8] == [*b"Pick up", 0] and sum(row.tokenized_prompt_mask) == 7 and sum(row.recur_mask) == 3
