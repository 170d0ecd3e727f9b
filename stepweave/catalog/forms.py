"""Further forms of operators: other robot profiles, hold rules, nested records, merged histograms, read-back tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.memories import KEPT_SQL, RECUR, SCORES_SQL, kept
from stepweave.catalog.registry import EVAL, STEPS, TRAJ, query, rnd, work_dir
from stepweave.catalog.streams import SLICES, event_stream, few_partitions
from stepweave.operators import shape, stats, windows
from stepweave.plans import jobs
from stepweave.sources import readers, sinks, views
from stepweave.streaming import memory as live
from stepweave.streaming import run


def _first(column: str):
    return F.get(F.col(column), F.lit(0))


@query("proj07_other_profiles", f"""WITH {TRAJ}
SELECT p.profile, traj, t, position AS s0, CASE p.profile WHEN 'two_arms' THEN 14 ELSE 1 END AS dims, position AS base,
       velocity AS wrist, CASE WHEN p.profile <> 'history_arm' THEN 0.0::DOUBLE END AS padded,
       CASE WHEN p.profile <> 'history_arm' THEN FALSE END AS pad_mask
FROM v_traj, (VALUES ('history_arm'), ('single_arm'), ('two_arms')) p(profile)""")
def proj07_others(spark, sf):
    frames = views.frame_table(spark, sf).drop("_blk")
    position, velocity = F.col("joint_position"), F.col("joint_velocity")
    arm = frames.select("traj", "t", F.struct(position.alias("image"), velocity.alias("wrist_image"), position.alias("state"))
                        .alias("observation"))
    two = frames.select("traj", "t", F.struct(position.alias("cam_high"), velocity.alias("cam_left_wrist")).alias("images"),
                        F.array_repeat(_first("joint_position"), 14).alias("state"))
    out = None
    for profile, source in (("history_arm", arm), ("single_arm", arm), ("two_arms", two)):
        made = shape.adapt_inputs(source, profile)
        third = profile != "history_arm"
        one = made.select(
            F.lit(profile).alias("profile"), "traj", "t", _first("state").alias("s0"), F.size("state").alias("dims"),
            _first("image.base_0_rgb").alias("base"), _first("image.left_wrist_0_rgb").alias("wrist"),
            (_first("image.right_wrist_0_rgb") if third else F.lit(None).cast("double")).alias("padded"),
            (F.col("image_mask.right_wrist_0_rgb") if third else F.lit(None).cast("boolean")).alias("pad_mask"))
        out = one if out is None else out.unionByName(one)
    return out


@query("win20_keep_period", f"""WITH {STEPS}
SELECT epis_idx, step_idx, step_idx = 0 OR step_idx > 10 AS query,
       last_value(CASE WHEN (step_idx = 0 OR step_idx > 10) AND NOT contains(subgoal, 'error') THEN subgoal END IGNORE NULLS)
         OVER (PARTITION BY epis_idx ORDER BY step_idx ROWS UNBOUNDED PRECEDING) AS held FROM v_steps""")
def win20_keep(spark, sf):
    out = windows.query_schedule(views.steps(spark, sf), "subgoal", keep_period=10, finished=("error",))
    return out.select("epis_idx", "step_idx", "query", "held")


@query("snk06_nested_progress", f"""WITH {EVAL}
SELECT task, md5('{{' || string_agg('"' || episode || '":"' || status || '"', ',' ORDER BY episode::VARCHAR) || '}}') AS episodes
FROM v_eval GROUP BY task""")
def snk06_nested(spark, sf):
    return sinks.progress_rows(views.evaluations(spark, sf)).select("task", F.md5("episodes").alias("episodes"))


@query("src01_read_steps", f"""WITH {STEPS} SELECT epis_idx AS episode_idx, step_idx, subgoal, k FROM v_steps""")
def src01_read(spark, sf):
    folder = work_dir(spark)
    steps = views.steps(spark, sf)
    steps.select(F.concat(F.lit("episode_"), F.col("epis_idx").cast("string")).alias("episode"),
                 F.concat(F.lit("timestep_"), F.col("step_idx").cast("string")).alias("timestep"), "subgoal", "k"
                 ).write.parquet(folder)
    return readers.read_steps(spark, folder).select("episode_idx", "step_idx", "subgoal", "k")


HISTOGRAM = """
SELECT dim::INT AS dim, CASE WHEN x < 0.02 THEN -1 WHEN x > 40 THEN 8
         ELSE least(floor((x - 0.02) / (40 - 0.02) * 8), 7) END::INT AS bin, count(*) AS count
FROM (SELECT unnest(range(4)) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)
GROUP BY ALL"""


@query("agg03_merged_histograms", HISTOGRAM)
def agg03_histograms(spark, sf):
    rows = views.vectors(spark, sf)
    parts = [stats.fixed_histogram(rows.where(F.col("l_orderkey") % 2 == k), "x", 0.02, 40.0, 8) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("dim", "bin").agg(F.sum("count").alias("count"))


@query("stm03_running_histogram", HISTOGRAM)
def stm03_histogram(spark, sf):
    folder = work_dir(spark)
    run.write_slices(views.vectors(spark, sf), F.col("l_orderkey"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        return run.run_complete(live.running_histogram(run.replay(spark, f"{folder}/in"), "x", 0.02, 40.0, 8), folder)


def widening_sql(rows: str, key: str) -> str:
    """q01 and q99 of (key, dim, x) rows by bins of a power of two that follow from the range."""
    return f"""wv AS ({rows}),
we AS (SELECT {key}, greatest(CASE WHEN hi > lo THEN ceil(round(log2((hi - lo) / {stats.WIDENING_BINS}.0), 9)) END,
         CASE WHEN size > 0 THEN floor(round(log2(size), 9)) - 50 END, {stats.LEAST_EXPONENT})::INT AS e, lo, n FROM (
  SELECT {key}, min(x) AS lo, max(x) AS hi, greatest(abs(min(x)), abs(max(x))) AS size, count(*) AS n FROM wv GROUP BY {key})),
wb AS (SELECT {key}, e, lo, n, floor(x * pow(2.0, -e)) AS bin, count(*) AS c FROM wv JOIN we USING ({key}) GROUP BY ALL),
wc AS (SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY bin) AS cum FROM wb)
SELECT {key}, max(n)::BIGINT AS count, round(min(greatest(lo, bin * pow(2.0, e))) FILTER (WHERE cum >= 0.01 * n), 6) AS q01,
       round(min(greatest(lo, bin * pow(2.0, e))) FILTER (WHERE cum >= 0.99 * n), 6) AS q99 FROM wc GROUP BY {key}"""


MIXED = "[l_quantity, l_extendedprice, -l_discount * l_extendedprice, l_tax]"


def mixed_vectors(spark, sf):
    return views.table(spark, sf, "lineitem").select("l_orderkey", F.array(
        "l_quantity", "l_extendedprice", -F.col("l_discount") * F.col("l_extendedprice"), "l_tax").alias("x"))


def shown_quantiles(df):
    return df.withColumns({q: F.round(q, 6) for q in ("q01", "q99")})


@query("agg03_merged_quantiles", "WITH " + widening_sql(
    f"SELECT unnest(range(4))::INT AS dim, unnest({MIXED}) AS x FROM lineitem", "dim"))
def agg03_quantiles(spark, sf):
    rows = mixed_vectors(spark, sf)
    price = F.get("x", F.lit(1))
    # parts of very different ranges, merged two by two
    parts = [stats.widening_histogram(rows.where(c), "x") for c in (
        price < 2000, (price >= 2000) & (price < 30000), price >= 30000)]
    state = stats.merge_histograms(stats.merge_histograms(parts[2], parts[0]), parts[1])
    return shown_quantiles(stats.histogram_quantiles(state))


@query("stm03_running_quantiles", f"""WITH r AS (SELECT min(l_orderkey)::DOUBLE AS lo, max(l_orderkey)::DOUBLE AS hi FROM lineitem),
s AS (SELECT least(floor((l_orderkey::DOUBLE - lo) / ((hi - lo) / {SLICES})), {SLICES - 1})::INT AS slice, {MIXED} AS v FROM lineitem, r),
""" + widening_sql(f"""SELECT as_of::INT AS as_of, unnest(range(4))::INT AS dim, unnest(v) AS x
  FROM s JOIN range({SLICES}) a(as_of) ON slice <= as_of""", "as_of, dim"))
def stm03_quantiles(spark, sf):
    folder = work_dir(spark)
    run.write_slices(mixed_vectors(spark, sf), F.col("l_orderkey"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        return shown_quantiles(live.running_quantiles(run.replay(spark, f"{folder}/in"), "x", folder))


@query("agg10_kept_tokens", f"""WITH {KEPT_SQL},
c AS (SELECT epis_idx, count(*) AS kept_tokens FROM v_kept GROUP BY epis_idx)
SELECT epis_idx, count(*) AS timesteps, 0 AS exec_start, coalesce(any_value(kept_tokens), 0) AS kept_tokens
FROM v_frames LEFT JOIN c USING (epis_idx) GROUP BY epis_idx""")
def agg10_kept(spark, sf):
    frames = views.frames(spark, sf).withColumn("is_demo", F.lit(False))
    return jobs.with_kept_tokens(jobs.episode_summary(frames), kept(spark, sf))


@query("job05_picked_images", f"""WITH {TRAJ}
SELECT traj, t, CASE WHEN {rnd('7.1.image', 'recording_folderpath', 'file_path')} % 2 = 0 THEN position ELSE velocity END AS image
FROM v_traj WHERE contains(file_path, 'success')""")
def job05_images(spark, sf):
    out = jobs.trajectory_frames(views.frame_table(spark, sf), None, horizon=4, seed=7, epoch=1,
                                 images=["joint_position", "joint_velocity"])
    return out.select("traj", "t", _first("image").alias("image"))


@query("join06_between_rows", f"""WITH {STEPS}
SELECT s.epis_idx, s.step_idx, round(sum(a.value), 6) AS total, count(*) FILTER (WHERE s.step_idx + o.ahead > s.n - 1) AS padded
FROM v_steps s CROSS JOIN (VALUES (0), (2), (3), (5)) o(ahead)
JOIN v_steps a ON a.epis_idx = s.epis_idx AND a.step_idx = least(s.step_idx + o.ahead, s.n - 1) GROUP BY ALL""")
def join06_between(spark, sf):
    steps = views.steps(spark, sf).withColumn("value", F.get("state", F.lit(0)))
    out = windows.offset_sequence(steps, "value", 4, fps=20, rate=30)
    return out.select("epis_idx", "step_idx", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                      F.size(F.filter("is_pad", lambda x: x)).cast("bigint").alias("padded"))


STREAM_RECUR = RECUR.replace("(SELECT *, epis_idx * 3 AS e FROM v_frames)",
                             "(SELECT epis_idx, step_idx, least(epis_idx % 5, step_idx) AS e FROM v_steps)")


@query("stm02_recurrent", f"""WITH {STEPS}, {STREAM_RECUR}
SELECT y.epis_idx, y.step_idx, string_agg(y.at::VARCHAR, ',' ORDER BY y.at) AS steps FROM y GROUP BY y.epis_idx, y.step_idx""")
def stm02_recurrent(spark, sf):
    folder = work_dir(spark)
    with few_partitions(spark):
        run.use_state_store(spark)
        out = run.run_to_table(live.online_selection(event_stream(spark, sf, folder), "recurrent", horizon=4, max_steps=8,
                                                     max_video=5), folder)
    return out.select("epis_idx", "step_idx", F.array_join(
        F.transform("indices", lambda i: i.cast("string")), ",").alias("steps"))


@query("stm02_online_tokens", f"""WITH {SCORES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY epis_idx ORDER BY score DESC, step_idx DESC, patch DESC) AS r FROM v_scores)
SELECT epis_idx, step_idx, patch, round(score, 6) AS score FROM k WHERE r <= 64""")
def stm02_tokens(spark, sf):
    folder = work_dir(spark)
    run.write_slices(views.frames(spark, sf).drop("_blk"), F.col("step_idx"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        run.use_state_store(spark)
        out = run.run_to_table(live.online_selection(run.replay(spark, f"{folder}/in"), "tokens", budget=64, keep=300), folder)
    latest = out.groupBy("epis_idx").agg(F.max("as_of").alias("as_of"))
    return out.join(latest, ["epis_idx", "as_of"]).select(
        "epis_idx", "step_idx", F.col("patch").cast("bigint").alias("patch"), F.round("score", 6).alias("score"))
