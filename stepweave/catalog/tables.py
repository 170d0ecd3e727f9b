"""Sources, sinks, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.registry import EVAL, FRAMES, STEPS, TASK_LIST, TRAJ, query, rnd, work_dir
from stepweave.functions import vectors as v
from stepweave.operators import ordered as o
from stepweave.operators import reports, sampling, shape, stats
from stepweave.plans import jobs
from stepweave.sources import readers, runlogs, sinks, views


@query("src01_step_table", f"""WITH {STEPS}
SELECT epis_idx, step_idx, n, subgoal, exec_start, is_demo, value AS s0, k FROM v_steps""")
def src01(spark, sf):
    keyed = views.steps(spark, sf).withColumn("timestep", F.concat(F.lit("timestep_"), F.col("step_idx").cast("string")))
    return keyed.select("epis_idx", readers.key_number(F.col("timestep")).alias("step_idx"), "n", "subgoal",
                        "exec_start", "is_demo", F.get("state", F.lit(0)).alias("s0"), "k")


@query("src02_env_id_from_file", f"""
SELECT env_id, count(*) AS files, min(c_custkey) AS first_key FROM (
  SELECT {TASK_LIST}[c_custkey % 16 + 1] AS env_id, c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY env_id""")
def src02(spark, sf):
    suffix = F.when(F.col("c_custkey") % 3 != 0, F.lit(".v1.h5")).otherwise(F.lit(".txt"))
    files = views.table(spark, sf, "customer").withColumn(
        "path", F.concat(F.lit("/raw/data_"), views.task_of(F.col("c_custkey")), suffix))
    return shape.with_env_id(files, "path").groupBy("env_id").agg(
        F.count(F.lit(1)).alias("files"), F.min("c_custkey").alias("first_key"))


@query("src03_episode_cap", f"""WITH {STEPS}
SELECT file, epis_idx, step_idx FROM (
  SELECT 'data_' || (epis_idx % 7) || '.h5' AS file, epis_idx, step_idx,
         dense_rank() OVER (PARTITION BY epis_idx % 7 ORDER BY epis_idx) AS r FROM v_steps) WHERE r <= 5""")
def src03(spark, sf):
    filed = views.steps(spark, sf).withColumn(
        "file", F.concat(F.lit("data_"), (F.col("epis_idx") % 7).cast("string"), F.lit(".h5")))
    return readers.cap_episodes(filed, 5, episode="epis_idx").select("file", "epis_idx", "step_idx")


def trajectory_rows(spark, sf):
    """Recordings as stored: arrays over frames, long ones in segments with a start offset."""
    flat = views.frame_table(spark, sf)
    row = F.struct("t", "joint_position", "joint_velocity", "gripper_position")
    packed = flat.groupBy("traj", "file_path", "recording_folderpath", *([o.BLOCK] if o.is_split(flat) else [])).agg(
        F.array_sort(F.collect_list(row)).alias("_r"), F.min("t").alias("start"))
    nested = packed.select("traj", "start", F.struct(F.struct("file_path", "recording_folderpath").alias(
        "episode_metadata")).alias("traj_metadata"), *[F.col(f"_r.{c}").alias(c) for c in (
            "joint_position", "joint_velocity", "gripper_position")])
    return nested


@query("src04_trajectory_scan", f"WITH {TRAJ} SELECT traj, t, file_path, position, gripper FROM v_traj")
def src04(spark, sf):
    folder = work_dir(spark)
    trajectory_rows(spark, sf).write.parquet(folder)
    frames = readers.trajectory_frames(readers.read_trajectories(spark, folder),
                                       ["joint_position", "joint_velocity", "gripper_position"], start="start")
    return frames.select("traj", "t", F.col("traj_metadata.episode_metadata.file_path").alias("file_path"),
                         F.get("joint_position", F.lit(0)).alias("position"),
                         F.get("gripper_position", F.lit(0)).alias("gripper"))


SAMPLES = STEPS + """,
v_samples AS (
  SELECT *, row_number() OVER (ORDER BY epis_idx, step_idx) - 1 AS sample_id FROM v_steps WHERE NOT is_demo)"""


def numbered(spark, sf):
    return jobs.number_samples(views.steps(spark, sf))


@query("src05_sample_lookup", f"""WITH {SAMPLES}
SELECT epis_idx, step_idx, sample_id, (SELECT count(*) FROM v_samples) AS n_samples FROM v_samples WHERE sample_id = 1000""")
def src05(spark, sf):
    rows = numbered(spark, sf)
    size = readers.n_samples(sinks.dataset_stats(rows)).scalar()
    return readers.sample(rows, 1000).select("epis_idx", "step_idx", "sample_id", size.alias("n_samples"))


@query("src06_fake_dataset", f"""
SELECT o_orderkey AS index, round(sum(2.0 * {rnd(7, 'o_orderkey', "'observation/state'", 'i')} / 4294967296.0 - 1), 3) AS state_sum,
       (sum({rnd(7, 'o_orderkey', "'tokens'", 'i')} % 2048) FILTER (WHERE i < 4))::BIGINT AS token_sum, 0 AS zero_sum
FROM orders CROSS JOIN range(8) r(i) GROUP BY o_orderkey""")
def src06(spark, sf):
    ids = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"))
    fake = sampling.fake_dataset(ids, {"observation/state": ("float", 8), "tokens": ("int", 4), "flag": ("bool", 2)}, seed=7)

    def total(c, zero):
        return F.aggregate(c, zero, lambda a, x: a + x.cast("double" if zero is dzero else "bigint"))
    dzero, izero = F.lit(0.0), F.lit(0).cast("bigint")
    return fake.select("index", F.round(total(F.col("observation.state"), dzero), 3).alias("state_sum"),
                       total(F.col("tokens"), izero).alias("token_sum"),
                       total(F.col("flag"), izero).cast("int").alias("zero_sum"))


RATES = EVAL + """,
v_rates AS (
  SELECT checkpoint, seed, task, avg((status = 'true')::INT) AS rate FROM v_eval WHERE status <> 'error'
  GROUP BY checkpoint, seed, task)"""


@query("src07_run_logs", f"WITH {RATES} SELECT checkpoint, seed, task, round(rate, 9) AS rate FROM v_rates")
def src07(spark, sf):
    root = work_dir(spark)
    rates = reports.success_rates(views.evaluations(spark, sf), ["checkpoint", "seed"])
    runlogs.write_logs(rates, f"{root}/model")
    seen = views.table(spark, sf, "orders").agg(F.collect_set("o_orderpriority"), F.collect_set("o_orderstatus")).first()
    logs = readers.read_run_logs(spark, root, "model", *seen)
    return logs.select("checkpoint", "seed", "task", F.round("rate", 9).alias("rate"))


@query("snk01_sample_table", f"WITH {SAMPLES} SELECT epis_idx, step_idx, sample_id, subgoal FROM v_samples")
def snk01(spark, sf):
    folder = work_dir(spark)
    sinks.write_samples(shape.execution_only(numbered(spark, sf)), folder)
    return spark.read.parquet(folder).select("epis_idx", "step_idx", "sample_id", "subgoal")


@query("snk02_dataset_stats", f"""WITH {STEPS}
SELECT count(*) FILTER (WHERE NOT is_demo) AS execution_samples, count(*) AS total_samples FROM v_steps""")
def snk02(spark, sf):
    folder = work_dir(spark)
    sinks.write_stats(views.steps(spark, sf), folder)
    return spark.read.schema("execution_samples bigint, total_samples bigint").json(folder)


@query("snk03_chat_lines", """
SELECT conv_id, turn, role, md5(text) AS text_hash, 'simple' AS kind FROM conversations""")
def snk03(spark, sf):
    folder = work_dir(spark)
    rows = views.table(spark, sf, "conversations").select(
        F.lit("simple").alias("kind"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
        F.array(F.concat_ws("/", "conv_id", "turn")).alias("images"),
        F.lit(None).cast("array<string>").alias("videos"))
    sinks.write_chat_jsonl(rows, folder, kinds=["simple"])
    back = spark.read.schema("messages array<struct<role:string,content:string>>, images array<string>").json(
        f"{folder}/simple_subgoal_train.jsonl")
    name = F.split(F.get("images", F.lit(0)), "/")
    first = F.get("messages", F.lit(0))
    return back.select(F.get(name, F.lit(0)).cast("bigint").alias("conv_id"), F.get(name, F.lit(1)).cast("bigint").alias("turn"),
                       first["role"].alias("role"), F.md5(first["content"]).alias("text_hash"), F.lit("simple").alias("kind"))


@query("snk04_norm_stats_file", """
SELECT dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std FROM (
  SELECT unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)
GROUP BY dim""")
def snk04(spark, sf):
    path = work_dir(spark)
    sinks.save_norm_stats(spark, {"x": stats.collect_norm_stats(views.vectors(spark, sf), "x")}, path)
    loaded = readers.load_norm_stats(spark, path)["x"]
    rows = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(loaded.mean, loaded.std))]
    return spark.createDataFrame(rows, "dim int, mean double, std double").select(
        "dim", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("snk06_progress", f"WITH {EVAL} SELECT task, episode::VARCHAR AS episode, status FROM v_eval")
def snk06(spark, sf):
    folder = work_dir(spark)
    sinks.write_progress(views.evaluations(spark, sf), folder)
    return spark.read.schema("task string, episode string, status string").json(folder)


@query("snk07_conversation_log", """
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS turn, 'text' AS type,
       md5(role) AS query_hash, md5(text) AS response_hash FROM conversations""")
def snk07(spark, sf):
    folder = work_dir(spark)
    rows = sinks.conversation_rows(views.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    sinks.write_conversation(rows, folder, "conv_id")
    back = spark.read.schema("conv_id bigint, turn int, type string, path string, query string, response string").json(folder)
    return back.select("conv_id", "turn", "type", F.md5("query").alias("query_hash"), F.md5("response").alias("response_hash"))


@query("proj01_repack", """
SELECT l_orderkey AS item_key, l_quantity AS state_qty, l_tax AS state_tax, l_returnflag AS flag FROM lineitem""")
def proj01(spark, sf):
    raw = views.table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", F.struct("l_quantity", "l_tax").alias("obs")).alias("step"), "l_returnflag")
    packed = shape.repack(raw, {"item": {"key": "step/l_orderkey"}, "state": {"qty": "step/obs/l_quantity", "tax": "step/obs/l_tax"},
                                "flag": "l_returnflag"})
    return packed.select(F.col("item.key").alias("item_key"), F.col("state.qty").alias("state_qty"),
                         F.col("state.tax").alias("state_tax"), "flag")


@query("proj02_flatten", f"""WITH {TRAJ}
SELECT traj, count(*) AS frames, any_value(file_path) AS "traj_metadata/episode_metadata/file_path",
       any_value(recording_folderpath) AS "traj_metadata/episode_metadata/recording_folderpath" FROM v_traj GROUP BY traj""")
def proj02(spark, sf):
    nested = trajectory_rows(spark, sf)
    flat = shape.flatten(shape.unflatten(shape.flatten(nested)))
    meta = [c for c in flat.columns if c.startswith("traj_metadata/")]
    return flat.groupBy("traj", *[F.col(f"`{c}`") for c in meta]).agg(F.sum(F.size("joint_position")).alias("frames"))


@query("proj03_rename", """
SELECT s_suppkey AS "key", s_nationkey AS "nation/id", s_acctbal AS "state/balance" FROM supplier""")
def proj03(spark, sf):
    raw = views.table(spark, sf, "supplier").select(
        F.struct("s_suppkey", "s_name", F.struct("s_nationkey").alias("nation"), "s_acctbal").alias("rec"))
    out = shape.rename_by_pattern(raw, {"rec/s_suppkey": "key", "rec/nation/s_(.+)key": r"\1/id", "rec/s_name": None,
                                        "rec/s_acct(.*)": r"state/\1ance"})
    return shape.flatten(out)


@query("proj04_default_prompt", "SELECT doc_id, lang, 'be helpful' AS prompt FROM documents")
def proj04(spark, sf):
    return shape.inject_default(views.table(spark, sf, "documents").select("doc_id", "lang"), "prompt", "be helpful")


@query("proj05_drop_strings", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def proj05(spark, sf):
    return shape.drop_strings(views.table(spark, sf, "customer"))


@query("proj06_optional_columns", f"""WITH {SAMPLES}
SELECT epis_idx, step_idx, subgoal AS simple_subgoal, NULL::VARCHAR AS prompt, TRUE AS no_memory FROM v_samples""")
def proj06(spark, sf):
    rows = shape.execution_only(views.steps(spark, sf)).select(
        "epis_idx", "step_idx", F.col("subgoal").alias("simple_subgoal"), F.upper("subgoal").alias("simple_subgoal_online"))
    full = shape.ensure_columns(rows)
    missing = F.col("static_mask").isNull() & F.col("recur_mask").isNull()
    return full.select("epis_idx", "step_idx", "simple_subgoal", "prompt", missing.alias("no_memory"))


@query("proj07_input_adapter", f"""WITH {TRAJ}
SELECT traj, t, position AS s0, gripper AS s1, position AS base, velocity AS wrist, 0.0::DOUBLE AS padded,
       TRUE AS base_mask, FALSE AS pad_mask, 'reach ' || traj AS prompt FROM v_traj""")
def proj07(spark, sf):
    flat = views.frame_table(spark, sf).select(
        "traj", "t", F.struct("joint_position", F.get("gripper_position", F.lit(0)).alias("gripper_position"),
                              F.col("joint_position").alias("exterior_image_1_left"),
                              F.col("joint_velocity").alias("wrist_image_left")).alias("observation"),
        F.get("instructions", F.lit(0)).alias("prompt"))
    out = shape.adapt_inputs(flat, "joint_arm")

    def first(c):
        return F.get(F.col(c), F.lit(0))
    return out.select("traj", "t", first("state").alias("s0"), F.get("state", F.lit(1)).alias("s1"),
                      first("image.base_0_rgb").alias("base"), first("image.left_wrist_0_rgb").alias("wrist"),
                      first("image.right_wrist_0_rgb").alias("padded"), F.col("image_mask.base_0_rgb").alias("base_mask"),
                      F.col("image_mask.right_wrist_0_rgb").alias("pad_mask"), "prompt")


CHUNK_SUM = """, v_sum AS (
  SELECT epis_idx, step_idx, sum(a0) AS a0_sum, sum(a1) AS a1_sum, count(*) AS n_actions FROM v_chunk GROUP BY ALL)"""


def chunk_total(column: str, dim: int):
    return F.aggregate(column, F.lit(0.0), lambda acc, a: acc + F.get(a, F.lit(dim)))


@query("proj08_output_adapter", f"""WITH {STEPS}
SELECT epis_idx, step_idx, 8 AS dims, round(a0, 6) AS first, round(a0, 6) AS eighth FROM v_steps""")
def proj08(spark, sf):
    wide = views.steps(spark, sf).withColumn("actions", F.array(F.flatten(F.array_repeat("action", 5))))
    out = shape.adapt_outputs(wide, "history_arm")
    row = F.get("actions", F.lit(0))
    return out.select("epis_idx", "step_idx", F.size(row).alias("dims"), F.round(F.get(row, F.lit(0)), 6).alias("first"),
                      F.round(F.get(row, F.lit(6)), 6).alias("eighth"))


@query("proj09_pixel_ranges", f"""WITH {FRAMES},
px AS (SELECT epis_idx, step_idx, unnest(list_transform(pixels, lambda x: trunc(x::DOUBLE * 255)::INT)) AS p FROM v_frames)
SELECT epis_idx, step_idx, sum(p)::BIGINT AS u8_sum, round(sum(p / 255.0 * 2 - 1), 6) AS scaled_sum FROM px GROUP BY ALL""")
def proj09(spark, sf):
    frames = views.frames(spark, sf).withColumn("u8", v.to_uint8(F.col("pixels"), check=True))
    return frames.select("epis_idx", "step_idx", F.aggregate("u8", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("u8_sum"),
                         F.round(F.aggregate(v.scale_pixels(F.col("u8")), F.lit(0.0), lambda a, x: a + x), 6).alias("scaled_sum"))


@query("flt01_execution_rows", f"WITH {STEPS} SELECT epis_idx, step_idx, exec_start FROM v_steps WHERE NOT is_demo")
def flt01(spark, sf):
    return shape.execution_only(views.steps(spark, sf)).select("epis_idx", "step_idx", "exec_start")


@query("flt02_success_paths", "SELECT page_id, url FROM pages WHERE regexp_full_match(url, '.*ref.*')")
def flt02(spark, sf):
    return shape.success_only(views.table(spark, sf, "pages").select("page_id", "url"), "url", "ref")


@query("flt03_task_lists", f"""WITH {EVAL},
kept AS (SELECT task, episode::VARCHAR AS episode, status FROM v_eval
         WHERE task IN ('BinFill', 'MoveCube', 'RouteStick', 'StopCube') AND task NOT IN ('StopCube', 'InsertPeg'))
SELECT * FROM kept UNION ALL
SELECT t.task, i::VARCHAR, 'false' FROM (VALUES ('StopCube'), ('InsertPeg')) t(task), range(50) r(i)""")
def flt03(spark, sf):
    exclude = ["StopCube", "InsertPeg"]
    chosen = reports.select_tasks(views.evaluations(spark, sf), ["BinFill", "MoveCube", "RouteStick", "StopCube"], exclude)
    return reports.with_excluded(chosen, exclude).select("task", "episode", "status")


@query("chk01_contract", f"WITH {STEPS} SELECT epis_idx, step_idx, round(value + a0, 6) AS pair FROM v_steps")
def chk01(spark, sf):
    from pyspark.sql import types as T

    rows = views.steps(spark, sf).select("epis_idx", "step_idx", "state", "action")
    contract = T.StructType([T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("action", T.ArrayType(T.DoubleType()))])
    checked = shape.check_contract(rows, contract, {"state": ["d"], "action": ["d"]}, paired=[("state", "action")])
    return checked.select("epis_idx", "step_idx", F.round(F.get("state", F.lit(0)) + F.get("action", F.lit(0)), 6).alias("pair"))
