"""Window, sequence and fold operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.registry import CHUNK_ROWS, STEPS, TRAJ, query
from stepweave.constants import LONG_FIRST_ACTION_TASKS, TASKS
from stepweave.functions import indices
from stepweave.functions import vectors as v
from stepweave.operators import folds, windows
from stepweave.plans import jobs
from stepweave.sources import views

SENTINEL = views.SENTINEL


def dim_sum(column, dim):
    return F.aggregate(column, F.lit(0.0), lambda acc, a: acc + F.get(a, F.lit(dim)))


def joined(column):
    return F.array_join(column.cast("array<string>"), ",")


@query("win01_action_chunks", f"""WITH {CHUNK_ROWS}
SELECT epis_idx, step_idx, count(*) AS size, round(sum(a0), 4) AS a0_sum, sum(a1) AS a1_sum,
       max(a0) FILTER (WHERE i = 19) AS last_a0 FROM v_chunk GROUP BY epis_idx, step_idx""")
def win01(spark, sf):
    out = windows.action_chunks(views.steps(spark, sf), 20)
    return out.select("epis_idx", "step_idx", F.size("actions").cast("bigint").alias("size"),
                      F.round(dim_sum("actions", 0), 4).alias("a0_sum"), dim_sum("actions", 1).alias("a1_sum"),
                      F.get(F.element_at("actions", -1), F.lit(0)).alias("last_a0"))


@query("win01_chunks_with_gaps", f"""WITH {STEPS},
g AS (SELECT * FROM v_steps WHERE step_idx % 5 <> 3),
x AS (SELECT s.epis_idx, s.step_idx, i.i, (SELECT max(p.step_idx) FROM g p WHERE p.epis_idx = s.epis_idx
        AND p.step_idx <= s.step_idx + i.i AND p.step_idx >= s.step_idx) AS at FROM g s CROSS JOIN range(6) i(i))
SELECT x.epis_idx, x.step_idx, round(sum(a.a0), 4) AS a0_sum FROM x JOIN g a ON a.epis_idx = x.epis_idx AND a.step_idx = x.at
GROUP BY ALL""")
def win01_gaps(spark, sf):
    holes = views.steps(spark, sf).where(F.col("step_idx") % 5 != 3)
    out = windows.action_chunks(holes, 6, gaps=True)
    return out.select("epis_idx", "step_idx", F.round(dim_sum("actions", 0), 4).alias("a0_sum"))


@query("win02_trajectory_chunks", f"""WITH {TRAJ}
SELECT s.traj, s.t, round(sum(a.position), 3) AS total, round(sum(a.gripper), 3) AS grip FROM v_traj s CROSS JOIN range(4) i(i)
JOIN v_traj a ON a.traj = s.traj AND a.t = least(s.t + i.i, s.traj_len - 1) GROUP BY ALL""")
def win02(spark, sf):
    acted = views.frame_table(spark, sf).withColumn("action", F.concat("joint_position", "gripper_position"))
    out = windows.action_chunks(acted, 4, keys=["traj"], step="t")
    return out.select("traj", "t", F.round(dim_sum("actions", 0), 3).alias("total"), F.round(dim_sum("actions", 1), 3).alias("grip"))


@query("win03_cut_and_subsample", f"""WITH {CHUNK_ROWS}
SELECT epis_idx, step_idx, round(sum(a0) FILTER (WHERE i < 16), 4) AS cut_sum,
       round(sum(a0) FILTER (WHERE i % 3 = 0), 4) AS strided_sum FROM v_chunk GROUP BY epis_idx, step_idx""")
def win03(spark, sf):
    out = windows.action_chunks(views.steps(spark, sf), 20)
    return out.select("epis_idx", "step_idx", F.round(dim_sum(v.cut(F.col("actions"), 16), 0), 4).alias("cut_sum"),
                      F.round(dim_sum(v.subsample(F.col("actions"), 3), 0), 4).alias("strided_sum"))


@query("win04_carry_forward", f"""WITH {STEPS}
SELECT epis_idx, step_idx, last_value(CASE WHEN NOT completed THEN subgoal END IGNORE NULLS) OVER (
         PARTITION BY epis_idx ORDER BY step_idx) AS carried FROM v_steps""")
def win04(spark, sf):
    out = windows.carry_forward(views.steps(spark, sf), "subgoal", "carried", done=F.col("completed"))
    return out.select("epis_idx", "step_idx", "carried")


def transition_sql(strided: bool) -> str:
    """CTE v_trans(epis_idx, env_id, n, exec_start, step_idx, kind) with the sentinel ``error``."""
    pattern = "contains(env_id, 'PatternLock')" if strided else "FALSE"
    return f"""
e AS (SELECT *, CASE WHEN NOT contains(subgoal, 'error') THEN subgoal END AS s FROM v_steps WHERE step_idx >= exec_start),
c AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS now,
      last_value(s IGNORE NULLS) OVER (PARTITION BY epis_idx ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
f AS (SELECT *, {pattern} AS strided, (step_idx - exec_start) % 32 = 0 AS grid FROM c),
v_trans AS (
  SELECT epis_idx, env_id, n, exec_start, step_idx, 0 AS kind FROM f
  WHERE CASE WHEN strided THEN grid ELSE now IS DISTINCT FROM before END
  UNION ALL SELECT epis_idx, env_id, n, exec_start, step_idx, 1 FROM f WHERE step_idx = n - 1 AND NOT (strided AND grid))"""


@query("win05_transitions", f"WITH {STEPS}, {transition_sql(True)} SELECT epis_idx, step_idx, kind FROM v_trans")
def win05(spark, sf):
    return windows.transitions(views.steps(spark, sf), sentinel=SENTINEL).select("epis_idx", "step_idx", "kind")


@query("win06_merged_keyframes", f"""WITH {STEPS}
SELECT epis_idx, step_idx FROM (
  SELECT epis_idx, step_idx, lead(step_idx) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS nxt FROM v_steps
  WHERE boundary AND step_idx >= exec_start) WHERE nxt IS NULL OR nxt - step_idx > 4""")
def win06(spark, sf):
    return windows.merge_keyframes(views.steps(spark, sf), F.col("boundary"), 4).select("epis_idx", "step_idx")


@query("win07_median_keyframes", f"""WITH {STEPS},
f AS (SELECT epis_idx, step_idx, step_idx - lag(step_idx) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS gap
      FROM v_steps WHERE boundary),
g AS (SELECT *, sum(CASE WHEN gap <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS run FROM f),
l AS (SELECT epis_idx, run, list(step_idx ORDER BY step_idx) AS s FROM g GROUP BY epis_idx, run)
SELECT epis_idx, s[len(s) // 2 + 1] AS step_idx FROM l""")
def win07(spark, sf):
    return windows.median_keyframes(views.steps(spark, sf), F.col("boundary"), 4).select("epis_idx", "step_idx")


MERGE = """list_reduce(list_transform({items}, lambda x: [x]), lambda acc, y:
  CASE WHEN y[1] - acc[len(acc)] < 10 THEN list_concat(acc[1:len(acc) - 1], [(y[1] + acc[len(acc)]) // 2])
       ELSE list_concat(acc, y) END)"""


@query("win08_average_merge", f"""WITH {STEPS}, {transition_sql(False)},
u AS (SELECT DISTINCT epis_idx, step_idx FROM v_trans WHERE step_idx % 3 = 0
      UNION SELECT epis_idx, step_idx FROM v_steps WHERE boundary AND step_idx >= exec_start AND k < 40),
l AS (SELECT epis_idx, list(step_idx ORDER BY step_idx) AS s FROM u GROUP BY epis_idx)
SELECT epis_idx, unnest({MERGE.format(items='s')})::INT AS step_idx FROM l""")
def win08(spark, sf):
    steps = views.steps(spark, sf)
    a = windows.transitions(steps, sentinel=SENTINEL, strided_env=None).where(F.col("step_idx") % 3 == 0)
    b = steps.where(F.col("boundary") & (F.col("step_idx") >= F.col("exec_start")) & (F.col("k") < 40))
    cols = ["epis_idx", "exec_start", "step_idx"]
    return folds.average_merge(a.select(*cols).union(b.select(*cols)).distinct()).select("epis_idx", "step_idx")


MINIMA = """
m0 AS (SELECT *, sqrt((a0 - value) ** 2 + (a1 - k) ** 2) AS x FROM v_steps),
m1 AS (SELECT *, lag(x) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS xl,
       lead(x) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS xr FROM m0),
m2 AS (SELECT epis_idx, list(step_idx ORDER BY step_idx) AS s FROM m1 WHERE x < 60 AND x < xl AND x < xr GROUP BY epis_idx),
v_minima AS (
  SELECT epis_idx, unnest(list_reduce(list_transform(s, lambda x: [x]), lambda acc, y:
    CASE WHEN y[1] - acc[len(acc)] >= 5 THEN list_concat(acc, y) ELSE acc END)) AS step_idx FROM m2)"""


@query("win09_local_minima", f"WITH {STEPS}, {MINIMA} SELECT epis_idx, step_idx FROM v_minima")
def win09(spark, sf):
    return folds.local_minima(views.steps(spark, sf), threshold=60.0).select("epis_idx", "step_idx")


@query("win10_interior_points", f"""WITH {STEPS}
SELECT epis_idx, step_idx, list_aggregate(list_transform([1, 2, 3], lambda i:
         trunc(exec_start + i * ((step_idx - exec_start) / 4.0::DOUBLE))::INT), 'string_agg', ',') AS points FROM v_steps""")
def win10(spark, sf):
    points = indices.interior(F.col("exec_start"), F.col("step_idx"), 3)
    return views.steps(spark, sf).select("epis_idx", "step_idx", joined(points).alias("points"))


def interior_sql(a: str, b: str, num: int) -> str:
    return f"list_transform(range(1, {num + 1}), lambda i: trunc({a} + i * (({b} - {a}) / {num + 1}.0::DOUBLE))::INT)"


KEYS_SQL = f"""{transition_sql(False)}, {MINIMA},
t AS (SELECT epis_idx, any_value(env_id) AS env_id, any_value(exec_start) AS e, list(step_idx ORDER BY step_idx, kind) AS s
      FROM v_trans GROUP BY epis_idx),
mm AS (SELECT epis_idx, list(step_idx) AS m FROM v_minima GROUP BY epis_idx),
b AS (SELECT epis_idx, env_id, CASE WHEN env_id IN ('PatternLock', 'RouteStick') THEN
        {MERGE.format(items="list_sort(list_filter(list_distinct(list_concat(s, coalesce(m, []))), lambda x: x >= e))")}
        ELSE s END AS s FROM t LEFT JOIN mm USING (epis_idx)),
x AS (SELECT epis_idx, list_sort(list_concat(s, CASE
        WHEN env_id = 'PickHighlight' AND len(s) >= 2 THEN {interior_sql('s[1]', 's[2]', 1)}
        WHEN contains('ButtonUnmaskSwap', env_id) AND len(s) >= 3
          THEN list_concat({interior_sql('s[1]', 's[2]', 2)}, {interior_sql('s[2]', 's[3]', 2)})
        ELSE [] END)) AS s FROM b),
v_keys AS (SELECT epis_idx, unnest(s[1:len(s) - 1])::INT AS step_idx, unnest(range(len(s) - 1))::INT AS pos FROM x)"""


def keyframe_list(steps):
    return windows.keyframes(steps, minima=folds.local_minima(steps, threshold=60.0), sentinel=SENTINEL)


@query("win11_keyframes", f"WITH {STEPS}, {KEYS_SQL} SELECT epis_idx, step_idx, pos FROM v_keys")
def win11(spark, sf):
    return keyframe_list(views.steps(spark, sf)).select("epis_idx", "step_idx", "pos")


def even_sql(step: str, budget: int) -> str:
    return f"""list_transform(range(least({step} + 1, {budget})), lambda i: CASE WHEN {step} < {budget} THEN i
      WHEN i = {budget - 1} THEN {step} ELSE floor(i * ({step} / {budget - 1}.0::DOUBLE)) END::INT)"""


@query("win12_even_frames", f"""WITH {STEPS}
SELECT epis_idx, step_idx, list_aggregate({even_sql('step_idx', 16)}, 'string_agg', ',') AS frames FROM v_steps""")
def win12(spark, sf):
    return views.steps(spark, sf).select("epis_idx", "step_idx", joined(indices.even_indices(F.col("step_idx"), 16)).alias("frames"))


RECURRENT = """
SELECT epis_idx, step_idx, list_aggregate(list_slice(z, greatest(1, len(z) - 7), len(z)), 'string_agg', ',') AS frames FROM (
  SELECT epis_idx, step_idx, list_concat(
    CASE WHEN e = 0 THEN [] WHEN e <= 8 THEN range(0, e, 2) WHEN e <= 20 THEN range(0, e, 4)
         ELSE list_transform(range(5), lambda i: CASE WHEN i = 4 THEN e - 1 ELSE floor(i * ((e - 1) / 4.0::DOUBLE)) END::BIGINT) END,
    CASE WHEN step_idx - e < 4 THEN [step_idx] ELSE range((step_idx - e) % 4 + e, step_idx + 1, 4) END) AS z
  FROM (SELECT *, epis_idx % 37 AS e FROM v_steps) WHERE step_idx >= e)"""


@query("win13_recurrent_frames", f"WITH {STEPS} {RECURRENT}")
def win13(spark, sf):
    steps = views.steps(spark, sf).withColumn("e", F.col("epis_idx") % 37).where(F.col("step_idx") >= F.col("e"))
    frames = indices.recurrent_indices(F.col("step_idx"), F.col("e"), horizon=4, max_steps=8, max_video=5)
    return steps.select("epis_idx", "step_idx", joined(frames).alias("frames"))


# Short strides, so that the short event episodes have segments with several points.
SELECTED = f"""{transition_sql(True)},
seg AS (SELECT *, lead(step_idx) OVER w AS nxt, lag(step_idx) OVER w AS prv,
        CASE WHEN contains(env_id, 'StopCube') THEN 2 ELSE 1 END AS stride FROM v_trans
        WINDOW w AS (PARTITION BY epis_idx ORDER BY step_idx, kind)),
seg2 AS (SELECT *, (nxt - step_idx) // stride AS m, coalesce((step_idx - prv) // stride, 0) AS pm FROM seg),
pts AS (SELECT epis_idx, step_idx AS s, n, pm, unnest(CASE WHEN nxt IS NULL THEN [step_idx]
          WHEN m > 0 THEN list_transform(range(m), lambda i: trunc(step_idx + i * ((nxt - step_idx) / m::DOUBLE))::INT)
          ELSE [] END)::INT AS step_idx FROM seg2),
v_sel AS (SELECT epis_idx, step_idx, CASE WHEN step_idx = s AND s <> n - 1 THEN greatest(pm - 1, 0) ELSE 0 END::INT AS duplicates
          FROM pts)"""


def selected(spark, sf):
    return windows.select_frames(windows.transitions(views.steps(spark, sf), sentinel=SENTINEL), stride=1, slow_stride=2)


@query("win14_selected_frames", f"WITH {STEPS}, {SELECTED} SELECT epis_idx, step_idx, duplicates FROM v_sel")
def win14(spark, sf):
    return selected(spark, sf).select("epis_idx", "step_idx", "duplicates")


@query("win15_duplicated_rows", f"""WITH {STEPS}, {SELECTED}
SELECT epis_idx, step_idx, unnest(range(duplicates + 1))::INT AS copy FROM v_sel""")
def win15(spark, sf):
    return windows.duplicate_rows(selected(spark, sf)).select("epis_idx", "step_idx", "copy")


HISTORY = """
h AS (SELECT *, subgoal IS DISTINCT FROM lag(subgoal) OVER (PARTITION BY epis_idx ORDER BY step_idx)
        OR row_number() OVER (PARTITION BY epis_idx ORDER BY step_idx) = 1 AS changed FROM v_steps),
hl AS (SELECT *, list(subgoal) FILTER (WHERE changed) OVER (PARTITION BY epis_idx ORDER BY step_idx
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM h)"""


@query("win16_history", f"""WITH {STEPS}, {HISTORY}
SELECT epis_idx, step_idx, coalesce(len(hist), 0)::INT AS size, md5(coalesce(array_to_string(hist, '|'), '')) AS history FROM hl""")
def win16(spark, sf):
    out = windows.history(views.steps(spark, sf).select("epis_idx", "step_idx", "subgoal", "_blk"), "subgoal")
    return out.select("epis_idx", "step_idx", F.size("history").alias("size"), F.md5(F.array_join("history", "|")).alias("history"))


@query("win17_sample_numbers", f"""WITH {STEPS}
SELECT epis_idx, step_idx, dense_rank() OVER (ORDER BY epis_idx) - 1 AS epis_number,
       row_number() OVER (ORDER BY epis_idx, step_idx) - 1 AS total_id,
       CASE WHEN NOT is_demo THEN count(*) FILTER (WHERE NOT is_demo) OVER (ORDER BY epis_idx, step_idx) - 1 END AS sample_id
FROM v_steps""")
def win17(spark, sf):
    return jobs.number_samples(views.steps(spark, sf)).select("epis_idx", "step_idx", "epis_number", "total_id", "sample_id")


@query("win17_numbers_over_files", f"""WITH {STEPS},
f AS (SELECT *, 'data_' || env_id || '.h5' AS file FROM v_steps)
SELECT file, epis_idx, step_idx, dense_rank() OVER (ORDER BY file, epis_idx) - 1 AS epis_number,
       row_number() OVER (ORDER BY file, epis_idx, step_idx) - 1 AS total_id FROM f""")
def win17_files(spark, sf):
    steps = views.steps(spark, sf).withColumn("file", F.concat(F.lit("data_"), "env_id", F.lit(".h5")))
    return jobs.number_samples(steps, file="file").select("file", "epis_idx", "step_idx", "epis_number", "total_id")


@query("win18_recent_frames", f"""WITH {STEPS}
SELECT epis_idx, step_idx, list_aggregate(list_reverse(list_filter(list_transform(range(8), lambda i: step_idx - 2 * i),
         lambda x: x >= 0)), 'string_agg', ',') AS frames FROM v_steps""")
def win18(spark, sf):
    steps = views.steps(spark, sf).withColumn("frame", F.col("step_idx"))
    return windows.recent_frames(steps, "frame").select("epis_idx", "step_idx", joined(F.col("recent")).alias("frames"))


@query("win19_downsampled", f"""WITH {STEPS},
g AS (SELECT *, row_number() OVER (PARTITION BY epis_idx ORDER BY step_idx) - 1 AS r, count(*) OVER (PARTITION BY epis_idx) AS c
      FROM v_steps WHERE step_idx % 2 = 0)
SELECT epis_idx, step_idx FROM g WHERE CASE WHEN c > 10 THEN r % (c // 10) = 0 ELSE TRUE END""")
def win19(spark, sf):
    return windows.downsample(views.steps(spark, sf), max_n=10, interval=2).select("epis_idx", "step_idx")


LONG = "(" + ", ".join(f"'{t}'" for t in LONG_FIRST_ACTION_TASKS) + ")"
SCHEDULE = f"""
q AS (SELECT *, step_idx = 0 OR (NOT (env_id IN {LONG} AND step_idx < 20) AND step_idx % 6 = 0) AS query FROM v_steps),
v_sched AS (SELECT *, last_value(CASE WHEN query AND NOT contains(subgoal, 'error') THEN subgoal END IGNORE NULLS) OVER (
              PARTITION BY epis_idx ORDER BY step_idx) AS held FROM q)"""


def scheduled(spark, sf):
    return windows.query_schedule(views.steps(spark, sf), "subgoal", every=6, first_hold=20, finished=["error"])


@query("win20_query_schedule", f"WITH {STEPS}, {SCHEDULE} SELECT epis_idx, step_idx, query, held FROM v_sched")
def win20(spark, sf):
    return scheduled(spark, sf).select("epis_idx", "step_idx", "query", "held")


HOLDS = {TASKS[0]: [("view", 5), ("click", 11)], TASKS[3]: [("", 8)], TASKS[5]: [("purchase", 20), ("", 3)], TASKS[9]: [("c", 7)]}


def hold_sql() -> str:
    """The period in force after an answer: by the task's first rule whose text it contains."""
    return "CASE " + " ".join(f"WHEN s.env_id = '{task}' AND contains(a, '{mark}') THEN {period}"
                              for task, rules in HOLDS.items() for mark, period in rules) + " ELSE 0 END"


@query("win20_hold_rules", f"""WITH RECURSIVE {STEPS},
answered AS (SELECT *, CASE WHEN k % 7 <> 0 THEN subgoal END AS a FROM v_steps), s AS (SELECT s.*, {hold_sql()} AS period FROM answered s),
r AS (SELECT epis_idx, step_idx, true AS query, a AS held, period FROM s WHERE step_idx = 0
  UNION ALL SELECT s.epis_idx, s.step_idx, r.held IS NULL OR s.step_idx > r.period,
    CASE WHEN r.held IS NULL OR s.step_idx > r.period THEN s.a ELSE r.held END,
    CASE WHEN r.held IS NULL OR s.step_idx > r.period THEN s.period ELSE r.period END
  FROM r JOIN s ON s.epis_idx = r.epis_idx AND s.step_idx = r.step_idx + 1)
SELECT epis_idx, step_idx, query, held FROM r""")
def win20_holds(spark, sf):
    steps = views.steps(spark, sf).select("epis_idx", "step_idx", "env_id", F.when(F.col("k") % 7 != 0, F.col("subgoal")).alias("answer"), "_blk")
    return windows.hold_schedule(steps, "answer", rules=HOLDS).select("epis_idx", "step_idx", "query", "held")


@query("win21_rollout_outcomes", f"""WITH {STEPS},
f AS (SELECT epis_idx, count(*) AS c, min(step_idx) FILTER (WHERE boundary AND k > 95 AND step_idx < 60) AS stop_step FROM v_steps GROUP BY epis_idx),
r AS (SELECT f.epis_idx, stop_step, CASE WHEN stop_step IS NOT NULL THEN CASE WHEN s.value > 50 THEN 'success' ELSE 'fail' END
        WHEN c > 60 THEN 'timeout' ELSE 'unknown' END AS outcome
      FROM f LEFT JOIN v_steps s ON s.epis_idx = f.epis_idx AND s.step_idx = f.stop_step)
SELECT *, CASE outcome WHEN 'unknown' THEN 'error' WHEN 'success' THEN 'true' ELSE 'false' END AS status FROM r""")
def win21(spark, sf):
    steps = views.steps(spark, sf).withColumn(
        "flag", F.when(F.get("state", F.lit(0)) > 50, F.lit("success")).otherwise(F.lit("fail")))
    return windows.rollout_outcome(steps, F.col("boundary") & (F.col("k") > 95), "flag", max_steps=60)


@query("win22_clips", f"""WITH {STEPS}, {SCHEDULE},
c AS (SELECT *, coalesce(sum(query::INT) OVER (PARTITION BY epis_idx ORDER BY step_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clip FROM v_sched)
SELECT epis_idx, clip, count(*)::INT AS frames, max(step_idx) AS last_step, arg_max(coalesce(held, ''), step_idx) AS label,
       CASE WHEN count(*) <= 3 THEN 'image' ELSE 'video' END AS kind FROM c GROUP BY epis_idx, clip""")
def win22(spark, sf):
    return windows.route_clips(scheduled(spark, sf)).withColumn("label", F.coalesce("label", F.lit("")))
