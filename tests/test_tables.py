"""Schema operators, statistics, joins, sources, sinks, streams and reports."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.operators import joins, reports, sampling, shape, stats
from stepweave.sources import readers, sinks
from stepweave.streaming import memory as live
from stepweave.streaming import run


def nested(spark, data):
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(data)]))


def as_dict(df):
    return df.head().asDict(recursive=True)


def test_repack(spark):
    df = nested(spark, {"cam": {"left": {"px": 7}, "t": 3}, "goal": "stack"})
    wanted = {"prompt": "goal", "obs": {"image": {"base": "cam/left/px"}, "time": "cam/t"}}
    assert as_dict(shape.repack(df, wanted)) == {"prompt": "stack", "obs": {"image": {"base": 7}, "time": 3}}
    with pytest.raises(KeyError):
        shape.repack(df, {"prompt": "cam/right/px"})


def test_rename(spark):
    arm = nested(spark, {"arm": {"pose": 4, "grip": 9}, "wrist": {"pose": 6}})
    moved = shape.rename_by_pattern(arm, {"(arm|wrist)/pose": r"\1/q", "arm/grip": "hand/open"})
    assert as_dict(moved) == {"arm": {"q": 4}, "wrist": {"q": 6}, "hand": {"open": 9}}
    assert as_dict(shape.rename_by_pattern(arm, {"wrist/pose": "arm/grip", "arm/grip": None})) == {"arm": {"pose": 4, "grip": 6}}
    assert as_dict(shape.rename_by_pattern(arm, {"arm": None})) == as_dict(arm)
    assert shape.rename_by_pattern(arm, {"(arm|wrist)/.*": None}).columns == []
    with pytest.raises(ValueError, match="already exists"):
        shape.rename_by_pattern(arm, {"wrist/pose": "arm/pose"})
    with pytest.raises(ValueError):
        shape.rename_by_pattern(arm, {"wrist/pose": "arm/grip/inner"})


def test_adapters(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.5, [9.0], [8.0])], "j array<double>, g double, e array<double>, w array<double>")
    obs = df.select(F.struct(F.col("j").alias("joint_position"), F.col("g").alias("gripper_position"),
                             F.col("e").alias("exterior_image_1_left"), F.col("w").alias("wrist_image_left")).alias("observation"))
    row = as_dict(shape.adapt_inputs(obs, "joint_arm"))
    assert row["state"] == [1.0, 2.0, 0.5]
    assert row["image_mask"] == {"base_0_rgb": True, "left_wrist_0_rgb": True, "right_wrist_0_rgb": False}
    row = as_dict(shape.adapt_inputs(obs, "joint_arm", token_model=True))
    assert row["image"] == {"base_0_rgb": [9.0], "base_1_rgb": [0.0], "wrist_0_rgb": [8.0]} and all(row["image_mask"].values())
    arms = df.select(F.struct(F.col("e").alias("cam_high")).alias("images"), F.array_repeat(F.lit(0.1), 14).alias("state"))
    assert as_dict(shape.adapt_inputs(arms, "two_arms"))["image_mask"] == {
        "base_0_rgb": True, "left_wrist_0_rgb": False, "right_wrist_0_rgb": False}
    with pytest.raises(ValueError, match="unexpected cameras"):
        shape.adapt_inputs(df.select(F.struct(F.col("e").alias("cam_high"), F.col("w").alias("cam_x")).alias("images")), "two_arms")


def test_contract(spark):
    df = spark.createDataFrame([([1.0], [2.0, 3.0])], "a array<double>, b array<double>")
    contract = T.StructType([T.StructField("a", T.ArrayType(T.DoubleType()))])
    shape.check_contract(df, contract, {"a": [1], "b": ["d"]}).collect()
    with pytest.raises(Exception, match="sizes disagree"):
        shape.check_contract(df, contract, {"a": ["d"], "b": ["d"]}).collect()
    with pytest.raises(ValueError, match="together"):
        shape.check_contract(df, contract, paired=[("a", "c")])


def test_transform_groups():
    log = []
    mark = lambda name: lambda df: (log.append(name), df)[1]

    class Frame:
        def transform(self, fn):
            return fn(self)

    group = shape.Group([mark("i1")], [mark("o1")]).push([mark("i2")], [mark("o2")])
    group.apply_inputs(Frame()), group.apply_outputs(Frame())
    assert log == ["i1", "i2", "o2", "o1"]


def test_vector_stats(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    row = stats.vector_stats(df, "x").head()
    assert row["mean"] == pytest.approx(x.mean(0).tolist()) and row["std"] == pytest.approx(x.std(0).tolist()) and row["count"] == 4
    y = np.random.default_rng(0).normal(size=(2, 3, 4))
    row = stats.vector_stats(spark.createDataFrame([(m.tolist(),) for m in y], "x array<array<double>>"), "x").head()
    assert row["mean"] == pytest.approx(y.reshape(-1, 4).mean(0).tolist()) and row["count"] == 6
    with pytest.raises(Exception, match="fewer than 2"):
        stats.vector_stats(df.limit(1), "x").collect()
    with pytest.raises(Exception, match="differ in length"):
        stats.vector_stats(df.union(spark.createDataFrame([([1.0],)], "x array<double>")), "x").collect()


def test_quantiles_of_a_constant_and_a_ramp(spark):
    df = spark.range(1001).select(F.array(F.lit(3.0), F.col("id").cast("double")).alias("x"))
    rows = {r.dim: (r.q01, r.q99) for r in stats.hist_quantiles(df, "x").collect()}
    assert rows[0] == (3.0, 3.0) and rows[1] == pytest.approx((10.0, 990.0), abs=0.25)


def test_norm_stats_file(spark, tmp_path):
    found = {"state": stats.NormStats([0.1, 1 / 3], [1.0, 2.0], [0.0, 0.0], [1.0, 1.0]), "actions": stats.NormStats([0.5], [0.25])}
    sinks.save_norm_stats(spark, found, f"{tmp_path}/stats")
    assert readers.load_norm_stats(spark, f"{tmp_path}/stats") == found
    assert readers.norm_stats_or_none(spark, f"{tmp_path}/missing") is None
    df = spark.createDataFrame([([1.0],)], "x array<double>")
    assert stats.normalize(df, None) is df
    with pytest.raises(ValueError):
        stats.normalize(df, {"x": stats.NormStats([0.0], [1.0])}, use_quantiles=True)
    with pytest.raises(ValueError):
        stats.normalize(df, {"y": stats.NormStats([0.0], [1.0])})


def test_prompt_lookup(spark):
    tasks = spark.createDataFrame([(1, "Hello, world!")], "task_index int, task string")
    df = spark.createDataFrame([(1,)], "task_index int")
    assert joins.prompt_from_task(df, tasks).head().prompt == "Hello, world!"
    with pytest.raises(Exception, match="no task for index 2"):
        joins.prompt_from_task(spark.createDataFrame([(2,)], "task_index int"), tasks).collect()
    with pytest.raises(ValueError):
        joins.prompt_from_task(spark.range(1), tasks)


def test_range_filter(spark):
    frames = spark.range(3000).select(F.lit("k").alias("key"), F.col("id").alias("t"))
    ranges = spark.createDataFrame([("k", 5, 8), ("k", 1000, 2100), ("k", 2000, 2200), ("k", 9, 9), ("x", 0, 9)],
                                   "episode_key string, start int, end int")
    got = sorted(r.t for r in joins.filter_ranges(frames, ranges, F.col("key"), F.col("t")).collect())
    assert got == [5, 6, 7, *range(1000, 2200)]
    assert joins.filter_ranges(frames, None, F.col("key"), F.col("t")) is frames


def test_run_logs(spark, tmp_path):
    for seed, body in (("seed0", json.dumps({"success_rate": {"BinFill": 0.5}, "total_success_rate": 0.5})), ("seed7", "{broken")):
        folder = tmp_path / "m" / "ckpt1" / seed
        folder.mkdir(parents=True)
        (folder / "log.json").write_text(body)
    rows = readers.read_run_logs(spark, str(tmp_path), "m", ["ckpt1", "ckpt2"], ["seed0", "seed7", "seed42"]).collect()
    assert [(r.checkpoint, r.seed, r.task, r.rate) for r in rows] == [("ckpt1", "seed0", "BinFill", 0.5)]
    assert readers.read_run_logs(spark, str(tmp_path), "absent", ["a"], ["b"]).count() == 0
    with pytest.raises(ValueError):
        readers.read_run_logs(spark, str(tmp_path), "m-symbolic", ["a"], ["b"], "other")
    with pytest.raises(ValueError):
        readers.read_run_logs(spark, str(tmp_path), "m", ["a"], ["b"], "oracle")


def test_report_of_a_single_run(spark):
    logs = spark.createDataFrame([("c1", "s", "BinFill", 1.0), ("c0", "s", "BinFill", 0.5)], "checkpoint string, seed string, task string, rate double")
    summary = reports.summarize_runs(reports.suite_scores(reports.fill_tasks(logs)))
    rows = reports.report_table(summary, ["c1", "c0"]).collect()
    assert [r.checkpoint for r in rows] == ["c1", "c0", "ALL"]
    assert rows[0].BinFill == "100.00 ± nan" and rows[0].Counting == "25.00 ± nan" and rows[2].BinFill == "75.00 ± 35.36"


def test_sample_sink(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("sample_id"), (F.col("id") % 2000).cast("int").alias("epis_idx"))
    sinks.write_samples(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 5000
    assert sorted(p.name for p in Path(f"{tmp_path}/s").glob("epis_bucket=*")) == ["epis_bucket=0", "epis_bucket=1"]
    with pytest.raises(ValueError, match="collision"):
        sinks.write_samples(df.union(df.limit(1)), f"{tmp_path}/t")


def test_changed_folders_alone_are_replaced(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3000).cast("int").alias("epis_idx"), F.array(F.lit(1)).alias("kept"))
    sinks.write_kept(rows, f"{tmp_path}/k")
    sinks.write_kept(rows.where("epis_idx BETWEEN 1100 AND 1200").withColumn("kept", F.array(F.lit(2))), f"{tmp_path}/k", changed_only=True)
    got = spark.read.parquet(f"{tmp_path}/k").groupBy(F.floor(F.col("epis_idx") / 1024).alias("b"), "kept").count().collect()
    assert sorted((r.b, r.kept[0], r["count"]) for r in got) == [(0, 1, 1024), (1, 2, 101), (2, 1, 952)]


def test_chat_lines_leave_out_null_keys(spark, tmp_path):
    df = spark.createDataFrame([("simple", ["a.png"], None), ("simple", ["b.png"], ["v.mp4"])], "kind string, images array<string>, videos array<string>")
    sinks.write_chat_jsonl(df, f"{tmp_path}/c", kinds=["simple"])
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/c/simple_subgoal_train.jsonl").collect())
    assert lines == ['{"images":["a.png"]}', '{"images":["b.png"],"videos":["v.mp4"]}']


def test_fake_dataset_does_not_depend_on_partitions(spark):
    spec = {"observation/state": ("float", 3), "tokens": ("int", 2), "done": ("bool", 1)}
    a = sampling.fake_dataset(spark, spec, 20, seed=1, index="i").orderBy("i").collect()
    b = sampling.fake_dataset(spark.range(20).repartition(5).withColumnRenamed("id", "i"), spec, seed=1, index="i").orderBy("i").collect()
    assert a == b and all(-1 <= x < 1 for r in a for x in r.observation.state) and all(0 <= x < 2048 for r in a for x in r.tokens)


def test_stream_reset_and_exec_start(spark, tmp_path):
    schema = "epis_idx int, seq bigint, frames int, exec_start int, reset boolean"
    batches = [[(0, 1, 3, 2, False), (0, 2, 2, None, False), (1, 1, 1, None, False)], [(0, 3, 2, 0, False), (0, 4, 1, None, True), (1, 2, 2, 5, False)]]
    rows = spark.createDataFrame([(*r, i) for i, rows in enumerate(batches) for r in rows], f"{schema}, batch int")
    run.write_slices(rows, F.col("batch"), f"{tmp_path}/in", 2)
    run.use_state_store(spark)
    out = run.run_to_table(live.episode_memory(run.replay(spark, f"{tmp_path}/in")), str(tmp_path))
    got = [(r.epis_idx, r.seq, r.step_idx, r.exec_start, r.newest) for r in out.orderBy("epis_idx", "seq", "step_idx").collect()]
    assert got == [(0, 1, 0, 2, False), (0, 1, 1, 2, False), (0, 1, 2, 2, True), (0, 2, 3, 2, False), (0, 2, 4, 2, True),
                   (0, 3, 5, 2, False), (0, 3, 6, 2, True), (0, 4, 0, 0, True), (1, 1, 0, 0, True), (1, 2, 1, 5, False), (1, 2, 2, 5, True)]


def test_chunk_expansion(spark):
    df = spark.createDataFrame([(0, 8, [1, 2, 3])], "epis_idx int, step_idx int, actions array<int>")
    assert [(r.step_idx, r.action) for r in live.expand_chunks(df, 2).collect()] == [(8, 1), (9, 2)]


def test_positions_of_several_views(spark):
    tokens = spark.createDataFrame([(s, w, p) for s in range(3) for w in range(2) for p in range(2)], "step_idx int, view int, patch int")
    table = spark.createDataFrame([(t, p, [float(t), float(p)]) for t in range(6) for p in range(2)], "t int, patch int, emb array<double>")
    got = joins.attach_pos(tokens, table, views=2).collect()
    assert len(got) == 12 and all(r.pos_emb == [r.step_idx * 2 + r.view, r.patch] for r in got)
    with pytest.raises(Exception, match="no position row"):
        joins.attach_pos(tokens, table.where("t < 5"), views=2).collect()
