"""Composite jobs and the chat records they emit."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.arrays import letterbox_sql
from stepweave.catalog.joining import FILLED, pos_sql
from stepweave.catalog.memories import KEPT_SQL, OFFLINE_SQL, deep_sum
from stepweave.catalog.registry import CHUNK_ROWS, EVAL, FRAMES, STEPS, TRAJ, query, rnd, work_dir
from stepweave.catalog.sampled import permuted_sql
from stepweave.catalog.windowing import KEYS_SQL, SELECTED, SENTINEL, dim_sum, keyframe_list
from stepweave.functions import vectors as v
from stepweave.operators import memory, reports, stats, windows
from stepweave.plans import jobs
from stepweave.sources import sinks, store, views


@query("job01_training_samples", f"""WITH {CHUNK_ROWS},
c AS (SELECT epis_idx, step_idx, last_value(CASE WHEN NOT completed THEN subgoal END IGNORE NULLS) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS subgoal,
        CASE WHEN NOT is_demo THEN count(*) FILTER (WHERE NOT is_demo) OVER (ORDER BY epis_idx, step_idx) - 1 END AS sample_id FROM v_steps),
a AS (SELECT epis_idx, step_idx, count(*)::INT AS size, round(sum(a0), 4) AS a0_sum, round(sum(a1), 4) AS a1_sum,
        max(a0) FILTER (WHERE i = 0) AS first_a0, max(a0) FILTER (WHERE i = 19) AS last_a0 FROM v_chunk WHERE NOT is_demo GROUP BY ALL)
SELECT a.*, c.subgoal, c.sample_id FROM a JOIN c USING (epis_idx, step_idx)""")
def job01(spark, sf):
    out = jobs.build_samples(views.steps(spark, sf))
    return out.select("sample_id", "epis_idx", "step_idx", "subgoal", F.size("actions").alias("size"),
                      F.round(dim_sum("actions", 0), 4).alias("a0_sum"), F.round(dim_sum("actions", 1), 4).alias("a1_sum"),
                      F.get(F.element_at("actions", 1), F.lit(0)).alias("first_a0"),
                      F.get(F.element_at("actions", -1), F.lit(0)).alias("last_a0"))


def grounded_steps(spark, sf):
    return views.steps(spark, sf).withColumns({
        "grounded": F.concat("subgoal", F.lit(" at <"), F.col("k").cast("string"), F.lit(", 5>")), "goal": F.upper("env_id")})


GROUNDED = "subgoal || ' at <' || k || ', 5>'"


def carried(text: str) -> str:
    return f"last_value(CASE WHEN NOT contains(subgoal, 'error') THEN {text} END IGNORE NULLS) OVER (PARTITION BY epis_idx ORDER BY step_idx)"


def history_sql(value: str, name: str) -> str:
    return f"""list(coalesce({value}, 'None')) FILTER (WHERE {name}) OVER (PARTITION BY epis_idx ORDER BY step_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def numbered_sql(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: i || '. ' || x), '; ')"


def user_sql(hist: str, kind: str) -> str:
    return f"""CASE WHEN exec_start > 0 THEN '<video>' ELSE '' END || 'The task goal is: ' || lower(env_id) || chr(10) ||
  CASE WHEN {hist} IS NULL OR len({hist}) = 0 THEN 'This is the initial turn for prediction' || chr(10)
       ELSE 'The history of previous predicted {kind}s are: ' || {numbered_sql(hist)} || chr(10) END ||
  '<image>What''s the next {kind} based on current observation?'"""


CHAT = f"""{SELECTED},
s0 AS (SELECT s.*, v.duplicates FROM v_sel v JOIN v_steps s USING (epis_idx, step_idx)),
s1 AS (SELECT *, {carried('subgoal')} AS simple, coalesce({carried(GROUNDED)}, 'None') AS ground FROM s0),
s2 AS (SELECT *, regexp_replace(ground, 'at <(\\d+), (\\d+)>', 'at <bbox>', 'g') AS masked,
         regexp_extract(ground, 'at <(\\d+), (\\d+)>', 1) AS box FROM s1),
s3 AS (SELECT *, row_number() OVER w = 1 OR simple IS DISTINCT FROM lag(simple) OVER w AS cs,
         row_number() OVER w = 1 OR masked IS DISTINCT FROM lag(masked) OVER w AS cg FROM s2
       WINDOW w AS (PARTITION BY epis_idx ORDER BY step_idx)),
s4 AS (SELECT *, {history_sql('simple', 'cs')} AS hs, {history_sql('masked', 'cg')} AS hg,
         sum(CASE WHEN cg AND box <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY epis_idx ORDER BY step_idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb FROM s3),
v_chat AS (
  SELECT *, 'simple' AS kind, md5({user_sql('hs', 'language subgoal')}) AS user_text, simple AS answer, NULL::INT AS boxes FROM s4
  UNION ALL SELECT *, 'grounded', md5({user_sql('hg', 'grounded language subgoal')}), masked,
    (coalesce(hb, 0) + (box <> '')::INT)::INT FROM s4)"""


def chat_rows(spark, sf):
    return jobs.build_chat_single(grounded_steps(spark, sf), sentinel=SENTINEL, noise_seed=None, stride=1, slow_stride=2)


@query("str10_single_image_records", f"""WITH {STEPS}, {CHAT}
SELECT epis_idx, step_idx, unnest(range(duplicates + 1))::INT AS copy, kind, user_text, answer, boxes FROM v_chat""")
def str10(spark, sf):
    out = chat_rows(spark, sf)
    return out.select("epis_idx", "step_idx", "copy", "kind", F.md5(F.get("messages", F.lit(1))["content"]).alias("user_text"),
                      F.get("messages", F.lit(2))["content"].alias("answer"), F.size("objects.bbox").alias("boxes"))


@query("job02_single_image_chat", f"""WITH {STEPS}, {CHAT}
SELECT epis_idx, step_idx, kind, unnest(range(duplicates + 1))::INT AS copy, env_id || '_ep' || epis_idx || '_step' || step_idx || '.png' AS image,
       CASE WHEN exec_start > 0 THEN env_id || '_ep' || epis_idx || '_video.mp4' END AS video FROM v_chat""")
def job02(spark, sf):
    return chat_rows(spark, sf).select("epis_idx", "step_idx", "kind", "copy", F.get("images", F.lit(0)).alias("image"),
                                       F.get("videos", F.lit(0)).alias("video"))


def jittered_sql(seed: int, value: str, index: str, axis: int) -> str:
    return f"least(greatest({value} + {rnd(seed, 'epis_idx', 'step_idx', index, str(axis))} % 4 - 2, 0), 255)"


def box_sum(boxes):
    """Sum of the boxes' coordinates, weighted by their places."""
    one = F.transform(boxes, lambda b, i: (i + 1) * (F.get(b, F.lit(0)) * 256 + F.get(b, F.lit(1))))
    return F.aggregate(one, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query("job02_jittered_boxes", f"""WITH {STEPS}, {CHAT},
l AS (SELECT *, list(CASE WHEN cg AND box <> '' THEN box::INT END) OVER (PARTITION BY epis_idx ORDER BY step_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s4),
m AS (SELECT epis_idx, step_idx, duplicates, list_concat(list_filter(coalesce(before, []), lambda b: b IS NOT NULL),
        CASE WHEN box <> '' THEN [box::INT] ELSE [] END) AS boxes FROM l),
u AS (SELECT epis_idx, step_idx, unnest(boxes) AS y, unnest(range(len(boxes))) AS i FROM m),
j AS (SELECT epis_idx, step_idx, sum((i + 1) * ({jittered_sql(9, 'y', 'i', 0)} * 256 + {jittered_sql(9, '5', 'i', 1)}))::BIGINT AS boxes
  FROM u GROUP BY epis_idx, step_idx)
SELECT m.epis_idx, m.step_idx, unnest(range(duplicates + 1))::INT AS copy, len(m.boxes)::INT AS n, coalesce(j.boxes, 0) AS boxes
FROM m LEFT JOIN j ON j.epis_idx = m.epis_idx AND j.step_idx = m.step_idx""")
def job02_jittered(spark, sf):
    out = jobs.build_chat_single(grounded_steps(spark, sf), sentinel=SENTINEL, noise_seed=9, stride=1, slow_stride=2)
    return out.where("kind = 'grounded'").select("epis_idx", "step_idx", "copy", F.size("objects.bbox").alias("n"),
                                                 box_sum(F.col("objects.bbox")).alias("boxes"))


KEYFRAME = f"""{KEYS_SQL},
kk AS (SELECT k.epis_idx, k.pos, k.step_idx - s.exec_start AS off, s.exec_start AS e, (s.n - s.exec_start + 1) // 2 AS nf
       FROM v_keys k JOIN v_steps s ON s.epis_idx = k.epis_idx AND s.step_idx = 0),
ff AS (SELECT *, off // 2 AS f1, CASE WHEN off % 2 = 1 AND off // 2 + 1 < nf THEN off // 2 + 1 ELSE off // 2 END AS f2 FROM kk),
ab AS (SELECT *, ceil(f1 / 8.0)::INT AS a, ceil(f2 / 8.0)::INT AS b FROM ff),
rec AS (
  SELECT DISTINCT epis_idx, -1 AS pos, -1 AS m, 0 AS f, 0 AS e FROM ab
  UNION ALL
  SELECT r.epis_idx, r.pos + 1, CASE WHEN ab.a > r.m THEN ab.a WHEN ab.b > r.m THEN ab.b ELSE 1000000 END,
         CASE WHEN ab.a > r.m THEN ab.f1 ELSE ab.f2 END, ab.e
  FROM rec r JOIN ab ON ab.epis_idx = r.epis_idx AND ab.pos = r.pos + 1),
v_match AS (SELECT epis_idx, m AS grp, CASE WHEN m = 0 THEN 1 ELSE f - (m - 1) * 8 END AS candidate, e + 2 * f AS frame_step
            FROM rec WHERE pos >= 0 AND m < 1000000),
x0 AS (SELECT *, (step_idx - exec_start) // 2 AS f FROM v_steps WHERE step_idx >= exec_start AND (step_idx - exec_start) % 2 = 0),
x1 AS (SELECT *, {carried('subgoal')} AS simple, coalesce({carried(GROUNDED)}, 'None') AS ground FROM x0),
g0 AS (SELECT epis_idx, ceil(f / 8.0)::INT AS grp, count(*) AS frames, max(step_idx) AS step_idx, arg_max(coalesce(simple, 'None'), step_idx) AS simple,
         arg_max(ground, step_idx) AS ground, any_value(env_id) AS env_id, any_value(exec_start) AS exec_start FROM x1 GROUP BY ALL),
v_memer AS (SELECT g.*, m.candidate::INT AS candidate, (SELECT count(*) FROM v_match q WHERE q.epis_idx = g.epis_idx AND q.grp < g.grp) AS memory
            FROM g0 g LEFT JOIN v_match m ON m.epis_idx = g.epis_idx AND m.grp = g.grp)"""
KEYFRAME_WITH = f"WITH RECURSIVE {STEPS}, {KEYFRAME}"


def images_sql(n: str) -> str:
    return f"'[' || array_to_string(list_transform(range({n}), lambda i: '<image>'), ', ') || ']'"


RECORD_USER = f"""CASE WHEN exec_start > 0 THEN 'The task has a video input for initial setup: <video>' || chr(10) ELSE '' END ||
  'The task goal is: ' || lower(env_id) || chr(10) ||
  'Here are the selected frames from the entirety of the full execution that are of particular importance:' || {images_sql('memory')} ||
  chr(10) || 'Here is current input image list from the front-view camera: ' || {images_sql('frames')} || chr(10) || chr(10) ||
  'What subtask should the robot execute and what is the keyframe position?'"""


def answer_sql(text: str) -> str:
    return f"""CASE WHEN candidate IS NOT NULL THEN '{{"current_subtask": "' || {text} || '", "keyframe_positions": [' || candidate || ']}}'
  ELSE '{{"current_subtask":"' || {text} || '", "keyframe_positions": []}}' END"""


def keyframe_rows(spark, sf):
    steps = grounded_steps(spark, sf)
    return jobs.build_chat_keyframes(steps, keyframe_list(steps), sentinel=SENTINEL, noise_seed=None)


@query("str11_keyframe_records", f"""{KEYFRAME_WITH},
m AS (SELECT *, regexp_replace(ground, 'at <(\\d+), (\\d+)>', 'at <bbox>', 'g') AS masked FROM v_memer)
SELECT epis_idx, grp AS "group", 'simple' AS kind, md5({RECORD_USER}) AS user_text, {answer_sql('simple')} AS answer FROM m
UNION ALL SELECT epis_idx, grp, 'grounded', md5({RECORD_USER}), {answer_sql('masked')} FROM m""")
def str11(spark, sf):
    return keyframe_rows(spark, sf).select(
        "epis_idx", "group", "kind", F.md5(F.get("messages", F.lit(1))["content"]).alias("user_text"),
        F.get("messages", F.lit(2))["content"].alias("answer"))


@query("job03_keyframe_chat", f"""{KEYFRAME_WITH}
SELECT epis_idx, grp AS "group", step_idx, candidate, (memory + frames)::INT AS images, kind.kind AS kind,
       CASE WHEN exec_start > 0 THEN env_id || '_ep' || epis_idx || '_video.mp4' END AS video
FROM v_memer, (VALUES ('simple'), ('grounded')) kind(kind)""")
def job03(spark, sf):
    return keyframe_rows(spark, sf).select("epis_idx", "group", "step_idx", "candidate", F.size("images").alias("images"), "kind",
                                           F.get("videos", F.lit(0)).alias("video"))


@query("job03_jittered_boxes", f"""{KEYFRAME_WITH},
bx AS (SELECT epis_idx, grp, step_idx, regexp_extract(ground, 'at <(\\d+), (\\d+)>', 1) AS box FROM v_memer)
SELECT epis_idx, grp AS "group", (box <> '')::INT AS n, CASE WHEN box = '' THEN 0 ELSE
  {jittered_sql(4, "box::INT", "'0'", 0)} * 256 + {jittered_sql(4, '5', "'0'", 1)} END::BIGINT AS boxes FROM bx""")
def job03_jittered(spark, sf):
    steps = grounded_steps(spark, sf)
    out = jobs.build_chat_keyframes(steps, keyframe_list(steps), sentinel=SENTINEL, noise_seed=4)
    return out.where("kind = 'grounded'").select("epis_idx", "group", F.size("objects.bbox").alias("n"),
                                                 box_sum(F.col("objects.bbox")).alias("boxes"))


@query("agg11_largest_sample", f"{KEYFRAME_WITH} SELECT max(memory + frames)::INT AS max_frames FROM v_memer")
def agg11(spark, sf):
    steps = views.steps(spark, sf)
    return reports.max_frames(jobs.keyframe_samples(steps, keyframe_list(steps), sentinel=SENTINEL), "memory", "execution")


@query("job04_norm_statistics", f"""WITH {CHUNK_ROWS},
v AS (SELECT 'actions' AS name, 0 AS dim, a0 - s0 AS x FROM v_chunk UNION ALL SELECT 'actions', 1, a1 FROM v_chunk
      UNION ALL SELECT 'state', 0, value FROM v_steps UNION ALL SELECT 'state', 1, k FROM v_steps),
r AS (SELECT name, dim, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v GROUP BY name, dim),
b AS (SELECT name, dim, least(4999, floor((x - lo) / (hi - lo) * 5000)) AS bin, lo, hi, n FROM v JOIN r USING (name, dim)),
c AS (SELECT name, dim, bin, lo, hi, n, sum(count(*)) OVER (PARTITION BY name, dim ORDER BY bin) AS cum FROM b
      GROUP BY name, dim, bin, lo, hi, n),
q AS (SELECT name, dim, min(lo + bin * (hi - lo) / 5000) FILTER (WHERE cum >= 0.01 * n) AS q01,
        min(lo + bin * (hi - lo) / 5000) FILTER (WHERE cum >= 0.99 * n) AS q99 FROM c GROUP BY name, dim)
SELECT name, dim::INT AS dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(any_value(q01), 4) AS q01,
       round(any_value(q99), 4) AS q99 FROM v JOIN q USING (name, dim) GROUP BY name, dim""")
def job04(spark, sf):
    chunks = windows.action_chunks(views.steps(spark, sf), 20)
    stats = jobs.compute_norm_stats(chunks, mask=v.bool_mask(1, -1))
    rows = [(name, i, float(s.mean[i]), float(s.std[i]), float(s.q01[i]), float(s.q99[i]))
            for name, s in stats.items() for i in range(len(s.mean))]
    out = spark.createDataFrame(rows, "name string, dim int, mean double, std double, q01 double, q99 double")
    return out.select("name", "dim", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q01", "q99")])


@query("job04_adapted_statistics", f"""WITH {FRAMES},
n AS (SELECT epis_idx, max(step_idx) AS last FROM v_frames GROUP BY epis_idx),
ch AS (SELECT f.pixels[3]::DOUBLE - s.pixels[1]::DOUBLE AS a0, f.pixels[4]::DOUBLE AS a1 FROM v_frames s JOIN n USING (epis_idx)
  CROSS JOIN range(20) r(i) JOIN v_frames f ON f.epis_idx = s.epis_idx AND f.step_idx = least(s.step_idx + i, n.last)),
v AS (SELECT 'actions' AS name, 0 AS dim, a0 AS x FROM ch UNION ALL SELECT 'actions', 1, a1 FROM ch
      UNION ALL SELECT 'state', 0, pixels[1]::DOUBLE FROM v_frames UNION ALL SELECT 'state', 1, pixels[2]::DOUBLE FROM v_frames)
SELECT name, dim::INT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM v GROUP BY name, dim""")
def job04_adapted(spark, sf):
    chunks = windows.action_chunks(frame_steps(spark, sf), 20)
    found = jobs.compute_norm_stats(chunks, jobs.SAMPLE_STRUCTURE, mask=v.bool_mask(1, -1))
    rows = [(name, i, s.mean[i], s.std[i]) for name, s in found.items() for i in range(len(s.mean))]
    out = spark.createDataFrame(rows, "name string, dim int, mean double, std double")
    return out.select("name", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("job05_trajectory_frames", f"""WITH {TRAJ},
ch AS (SELECT s.traj, s.t, any_value(s.file_path) AS file_path, any_value(s.recording_folderpath) AS folder, round(sum(a.position), 3) AS total
       FROM v_traj s CROSS JOIN range(4) i(i) JOIN v_traj a ON a.traj = s.traj AND a.t = least(s.t + i.i, s.traj_len - 1)
       WHERE contains(s.file_path, 'success') GROUP BY s.traj, s.t)
SELECT traj, t, total, folder || '--' || file_path || '--' || t AS step_id,
       (['reach ', 'pick ', 'place '])[{rnd('7.1', 'folder', 'file_path')} % 3 + 1] || traj AS prompt
FROM ch WHERE t < 2 OR (t >= 3 AND t < 3 + traj % 5)""")
def job05(spark, sf):
    frames = views.frame_table(spark, sf)
    key = F.concat_ws("--", "recording_folderpath", "file_path")
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")), F.struct(F.lit(3).alias("s"), (3 + F.col("traj") % 5).alias("e")))
    ranges = frames.select("traj", key.alias("episode_key")).distinct().withColumn("r", F.explode(spans)).select(
        "episode_key", F.col("r.s").alias("start"), F.col("r.e").alias("end"))
    out = jobs.trajectory_frames(frames, ranges, horizon=4, seed=7, epoch=1)
    return out.select("traj", "t", F.round(dim_sum("actions", 0), 3).alias("total"), "step_id", "prompt")


@query("job05_trajectory_batches", f"""WITH RECURSIVE {TRAJ},
k AS (SELECT traj, t, recording_folderpath AS folder, file_path FROM v_traj WHERE contains(file_path, 'success')),
i AS (SELECT *, row_number() OVER (ORDER BY folder, file_path, t) - 1 AS id FROM k), {permuted_sql("p", "SELECT id FROM i", "7.1")}
SELECT traj, t, rank // 256 AS batch, (rank % 256)::INT AS slot FROM p JOIN i USING (id) WHERE rank < n // 256 * 256""")
def job05_batches(spark, sf):
    frames = jobs.trajectory_frames(views.frame_table(spark, sf), horizon=4, seed=7, epoch=1)
    return jobs.trajectory_batches(frames, 256, seed=7, epoch=1).select("traj", "t", "batch", "slot")


NORM = {"state": stats.NormStats([0.1, 0.1], [0.5, 0.5]), "actions": stats.NormStats([0.05, 0.05], [0.2, 0.2])}
FITTED = (10, 12)
BATCH = 16


def frame_steps(spark, sf):
    """Embedding rows as recorded steps: two images, state, action, texts, and a demonstration ahead of some episodes."""
    frames = views.frames(spark, sf)
    text_at = F.concat(F.lit("go at <12, "), (F.col("step_idx") % 5 + 30).cast("string"), F.lit(">"))
    return frames.withColumns({
        "state": F.transform(F.slice("pixels", 1, 2), lambda x: x.cast("double")),
        "action": F.transform(F.slice("pixels", 3, 2), lambda x: x.cast("double")),
        "image": F.col("pixels"), "wrist_image": F.reverse("pixels"), "completed": F.lit(False),
        "exec_start": F.col("epis_idx") % 3, "is_demo": F.col("step_idx") < F.col("epis_idx") % 3,
        "prompt": F.concat(F.lit(" Pick_up the cube "), F.col("epis_idx").cast("string")),
        "simple_subgoal": F.lit("Go on"), "grounded_subgoal": text_at,
        "simple_subgoal_online": F.lit("go on"), "grounded_subgoal_online": text_at})


def built(spark, sf):
    return jobs.build_dataset(f"{work_dir(spark)}/store", frame_steps(spark, sf), subgoals=("simple_subgoal", "grounded_subgoal"),
                              keep=300, pos_dim=12, rows_per_bucket=128)


SAMPLED = """v_ids AS (SELECT *, epis_idx % 3 AS exec_start, row_number() OVER (ORDER BY epis_idx, step_idx) - 1 AS id
  FROM v_frames WHERE step_idx >= epis_idx % 3)"""


@query("job01_committed_build", f"""WITH {KEPT_SQL}, {SAMPLED},
n AS (SELECT epis_idx, max(step_idx) AS last FROM v_frames GROUP BY epis_idx),
a AS (SELECT s.id, round(sum((i + 1) * f.pixels[3]::DOUBLE), 4) AS a0, round(sum((i + 1) * f.pixels[4]::DOUBLE), 4) AS a1
  FROM v_ids s JOIN n USING (epis_idx) CROSS JOIN range(20) r(i)
  JOIN v_frames f ON f.epis_idx = s.epis_idx AND f.step_idx = least(s.step_idx + i, n.last) GROUP BY s.id)
SELECT id AS sample_id, epis_idx, step_idx, a0, a1, 'go at <12, ' || (step_idx % 5 + 30) || '>' AS grounded_subgoal,
  round(list_sum(pixels::DOUBLE[]), 5) AS fine, round(list_sum(pixels::DOUBLE[]) / 16, 5) AS coarse,
  (SELECT count(*) FROM v_kept k WHERE k.epis_idx = v_ids.epis_idx)::INT AS kept,
  (SELECT max(step_idx) FROM v_kept k WHERE k.epis_idx = v_ids.epis_idx)::INT AS kept_until,
  (SELECT count(*) FROM v_ids) AS execution_samples, (SELECT count(*) FROM v_frames) AS total_samples FROM v_ids JOIN a USING (id)""")
def job01_build(spark, sf):
    made = built(spark, sf)
    again = store.Store.open(spark, made.folder.rpartition("/version=")[0])

    def rows(t):
        own = t["features"].select("epis_idx", "step_idx", F.round(deep_sum("image_emb_8x8"), 5).alias("fine"),
                                   F.round(deep_sum("image_emb_2x2"), 5).alias("coarse"))
        return t["samples"].join(own, ["epis_idx", "step_idx"]).join(t["kept"], "epis_idx")
    out = again.each(rows)
    return out.select("sample_id", "epis_idx", "step_idx", F.round(weighted(F.transform("actions", lambda a: F.get(a, F.lit(0)))), 4).alias("a0"),
                      F.round(weighted(F.transform("actions", lambda a: F.get(a, F.lit(1)))), 4).alias("a1"), "grounded_subgoal",
                      "fine", "coarse", F.size("kept").alias("kept"), F.array_max(F.col("kept.step")).alias("kept_until"),
                      F.lit(again.n_samples()).cast("bigint").alias("execution_samples"),
                      F.lit(again.about["total_samples"]).cast("bigint").alias("total_samples"))


@query("snk01_memory_tables", f"""WITH {KEPT_SQL}
SELECT epis_idx, step_idx, round(list_sum(pixels::DOUBLE[]) / 4, 5) AS mid,
  (SELECT count(*) FROM v_kept k WHERE k.epis_idx = f.epis_idx)::INT AS kept,
  (SELECT min(patch) FROM v_kept k WHERE k.epis_idx = f.epis_idx AND k.pos = 0)::INT AS least FROM v_frames f""")
def snk01_memory(spark, sf):
    folder = work_dir(spark)
    features, kept = jobs.build_memory(frame_steps(spark, sf), keep=300, pos_dim=12)
    sinks.write_features(features, f"{folder}/features")
    sinks.write_kept(memory.kept_lists(kept), f"{folder}/kept")
    lists = spark.read.parquet(f"{folder}/kept").select("epis_idx", F.size("kept").alias("kept"), F.get("kept", F.lit(0))["patch"].alias("least"))
    rows = spark.read.parquet(f"{folder}/features").join(lists, "epis_idx")
    return rows.select("epis_idx", "step_idx", F.round(deep_sum("image_emb_4x4"), 5).alias("mid"), "kept", "least")


@query("src05_stored_sample", f"""WITH {FRAMES}, {SAMPLED}
SELECT id AS sample_id, epis_idx, step_idx, round(pixels[1]::DOUBLE, 6) AS state0, (SELECT count(*) FROM v_ids) AS n_samples
FROM v_ids WHERE id = 137""")
def src05_stored(spark, sf):
    found = built(spark, sf)
    return found.sample(137).select("sample_id", "epis_idx", "step_idx", F.round(F.get("state", F.lit(0)), 6).alias("state0"),
                                    F.lit(found.n_samples()).cast("bigint").alias("n_samples"))


def weighted(values):
    """Sum of the values times their places from 1: a change of order or place shows."""
    return F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def example_columns(out, parts):
    """Every array of an example as a sum weighted by places, next to its length."""
    rows = {"image_emb": f"{parts}_image_emb", "pos_emb": f"{parts}_pos_emb", "state_emb": f"{parts}_state_emb"} if parts else {}
    flat = {n: F.flatten(F.col(c)) if parts == "recur" and n != "state_emb" else F.col(c) for n, c in rows.items()}
    sums = {n: F.round(weighted(F.transform(c, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")))), 3)
            for n, c in flat.items()}
    mask = F.aggregate(F.transform(f"{parts}_mask", lambda m, i: F.when(m, i + 1).otherwise(0)), F.lit(0), lambda a, x: a + x) if parts else None
    shown = {"size": F.size(f"{parts}_mask"), "mask": mask, **sums} if parts else {}
    return out.select(
        "batch", "slot", "epis_idx", "step_idx", F.size("actions").alias("horizon"), F.size("state").alias("dim"),
        F.round(weighted(F.col("state")), 4).alias("state"),
        F.round(weighted(F.transform("actions", weighted)), 3).alias("actions"),
        F.round(weighted(F.col("image.base_0_rgb")), 3).alias("base_image"),
        F.round(weighted(F.col("image.left_wrist_0_rgb")), 3).alias("wrist_image"), F.size("image.base_0_rgb").alias("pixels"),
        F.to_json("image_mask").alias("cameras"),
        F.md5(F.array_join(F.filter("tokenized_prompt", lambda x: x > 0), ",")).alias("prompt"),
        *[c.alias(n) for n, c in shown.items()])


def examples(spark, sf, parts, **options):
    found = built(spark, sf)
    out = found.each(lambda t: jobs.training_examples(
        t["samples"], t["features"], t["kept"], norm=NORM, use_quantiles=False, budget=64, mask=v.bool_mask(1, -1),
        structure=jobs.SAMPLE_STRUCTURE, image_shape=(8, 8, 1), image_size=FITTED, **options))
    return example_columns(jobs.training_batches(out, found.n_samples(), BATCH, seed=5, epoch=2), parts)


def normal(x, name):
    m, s = NORM[name].mean[0], NORM[name].std[0]
    return f"(({x}) - {m}::DOUBLE) / ({s}::DOUBLE + 1e-6)"


EXAMPLE = f"""{OFFLINE_SQL}, {SAMPLED}, {letterbox_sql(*FITTED)}, {permuted_sql("p", "SELECT id FROM v_ids", "5.2")},
wrist_e AS (SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings),
{letterbox_sql(*FITTED).partition("inside AS")[1].replace("inside", "winside") + letterbox_sql(*FITTED).partition("inside AS")[2].replace("FROM embeddings", "FROM wrist_e").replace("framed", "wframed").replace("JOIN inside", "JOIN winside")},
named AS (SELECT label::INT AS epis_idx, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS step_idx FROM embeddings),
img AS (SELECT epis_idx, step_idx, round(sum(f.value * (f.pos + 1)), 3) AS base_image, round(sum(w.value * (w.pos + 1)), 3) AS wrist_image
  FROM named JOIN framed f USING (vec_id) JOIN wframed w ON w.vec_id = named.vec_id AND w.pos = f.pos GROUP BY epis_idx, step_idx),
n AS (SELECT epis_idx, max(step_idx) AS last FROM v_frames GROUP BY epis_idx),
act AS (SELECT s.id, round(sum((i + 1) * ({normal("f.pixels[3]::DOUBLE - s.pixels[1]::DOUBLE", "actions")}
    + 2 * {normal("f.pixels[4]::DOUBLE", "actions")})), 3) AS actions
  FROM v_ids s JOIN n USING (epis_idx) CROSS JOIN range(16) r(i)
  JOIN v_frames f ON f.epis_idx = s.epis_idx AND f.step_idx = least(s.step_idx + i, n.last) GROUP BY s.id),
v_ex AS (SELECT p.rank // {BATCH} AS batch, (p.rank % {BATCH})::INT AS slot, s.id, s.epis_idx, s.step_idx, s.exec_start, 16 AS horizon,
    32 AS dim, round({normal("pixels[1]::DOUBLE", "state")} + 2 * {normal("pixels[2]::DOUBLE", "state")}, 4) AS state, act.actions,
    base_image, wrist_image, {FITTED[0] * FITTED[1]} AS pixels, '{{"base_0_rgb":true,"left_wrist_0_rgb":true}}' AS cameras,
    md5(list_aggregate(list_transform(string_split('Pick up the cube ' || s.epis_idx, ''), lambda c: ascii(c)), 'string_agg', ',')) AS prompt
  FROM v_ids s JOIN p USING (id) JOIN act USING (id) JOIN img ON img.epis_idx = s.epis_idx AND img.step_idx = s.step_idx
  WHERE p.rank < p.n // {BATCH} * {BATCH})"""


def memory_sql(tokens: str, size: int, left: bool = False) -> str:
    """Weighted sums of a memory of (id, spot, image, pos, state) tokens, padded to ``size`` places; states are normalized
    after padding."""
    spot = f"(spot + {size} - k)" if left else "spot"
    zero = normal("0", "state")
    return f"""t AS ({tokens}), k AS (SELECT id, count(*) AS k FROM t GROUP BY id),
m AS (SELECT id, sum({spot} + 1)::INT AS mask, round(sum(({spot} + 1) * image), 3) AS image_emb, round(sum(({spot} + 1) * pos), 3) AS pos_emb,
    round(sum(({spot} + 1) * (state - 2 * ({zero}))) + 2 * ({zero}) * {size * (size + 1) // 2}, 3) AS state_emb
  FROM t JOIN k USING (id) GROUP BY id)
SELECT v_ex.* EXCLUDE (id, exec_start), {size} AS size, mask, image_emb, pos_emb, state_emb FROM v_ex JOIN m USING (id)"""


STATE_SUM = f"{normal('f.pixels[1]::DOUBLE', 'state')} + {normal('f.pixels[2]::DOUBLE', 'state')}"
CELL = " + ".join(f"f.pixels[(c // 4) * 16 + (c % 4) * 2 + {i}]::DOUBLE" for i in (1, 2, 9, 10))


@query("job06_examples_frames", f"""WITH RECURSIVE {EXAMPLE},
idx AS (SELECT id, epis_idx, i, CASE WHEN step_idx < 4 THEN i WHEN i = 3 THEN step_idx
          ELSE floor(i * (step_idx / 3.0::DOUBLE)) END::INT AS step FROM v_ids, range(4) r(i) WHERE i <= step_idx),
{memory_sql(f"""SELECT id, i * 16 + c AS spot, ({CELL}) / 4 AS image, {pos_sql('idx.step', 'c', 4)} AS pos, {STATE_SUM} AS state
  FROM idx JOIN v_frames f ON f.epis_idx = idx.epis_idx AND f.step_idx = idx.step, range(16) q(c)""", 64)}""")
def job06_frames(spark, sf):
    return examples(spark, sf, "static", per_image=16)


@query("job06_examples_recurrent", f"""WITH RECURSIVE {EXAMPLE},
z AS (SELECT id, epis_idx, exec_start, step_idx, list_concat(CASE WHEN exec_start = 0 THEN [] ELSE [0] END,
    CASE WHEN step_idx - exec_start < 16 THEN [step_idx] ELSE range((step_idx - exec_start) % 16 + exec_start, step_idx + 1, 16) END) AS z FROM v_ids),
y AS (SELECT id, epis_idx, unnest(z) AS step, unnest(range(len(z))) AS i FROM z),
r AS (SELECT y.id, i, f.step_idx, list_sum(f.pixels::DOUBLE[]) AS image, {STATE_SUM} AS state, f.pixels
  FROM y JOIN v_frames f ON f.epis_idx = y.epis_idx AND f.step_idx = y.step),
k AS (SELECT id, count(*) AS k FROM r GROUP BY id),
w AS (SELECT id, round(sum((64 * (i + 64 - k) + c + 1) * pixels[c + 1]::DOUBLE), 3) AS image_emb,
    round(sum((64 * (i + 64 - k) + c + 1) * ({pos_sql('step_idx', 'c', 8)})), 3) AS pos_emb FROM r JOIN k USING (id), range(64) q(c) GROUP BY id),
m AS (SELECT id, sum(i + 64 - k + 1)::INT AS mask, round(sum((i + 64 - k + 1) * (state - 2 * ({normal('0', 'state')})))
    + 2 * ({normal('0', 'state')}) * 2080, 3) AS state_emb FROM r JOIN k USING (id) GROUP BY id)
SELECT v_ex.* EXCLUDE (id, exec_start), 64 AS size, mask, image_emb, pos_emb, state_emb FROM v_ex JOIN m USING (id) JOIN w USING (id)""")
def job06_recurrent(spark, sf):
    return examples(spark, sf, "recur", memory_type="recurrent")


@query("job06_examples_tokens", f"""WITH RECURSIVE {EXAMPLE},
{memory_sql(f"""SELECT s.id, row_number() OVER (PARTITION BY s.id ORDER BY t.step, t.patch) - 1 AS spot, f.pixels[t.patch + 1]::DOUBLE AS image,
    {pos_sql('t.step', 't.patch', 8)} AS pos, {STATE_SUM} AS state
  FROM v_ids s JOIN v_tok t ON t.epis_idx = s.epis_idx AND t.t = s.step_idx JOIN v_frames f ON f.epis_idx = t.epis_idx AND f.step_idx = t.step""", 64)}""")
def job06_tokens(spark, sf):
    return examples(spark, sf, "static", memory_type="tokens")


@query("job06_examples_symbolic", f"""WITH RECURSIVE {EXAMPLE}
SELECT v_ex.* EXCLUDE (id, exec_start) FROM v_ex""")
def job06_symbolic(spark, sf):
    return examples(spark, sf, None, memory_type="symbolic")


@query("job07_benchmark_report", FILLED + "\nSELECT checkpoint, " + ", ".join(
    f"""format('{{:.2f}}', max(mean) FILTER (WHERE score = '{s}')) || ' ± ' || format('{{:.2f}}', max(std) FILTER (WHERE score = '{s}')) AS "{s}\""""
    for s in reports.SCORES) + " FROM summary GROUP BY checkpoint")
def job07(spark, sf):
    return jobs.benchmark_report(reports.success_rates(views.evaluations(spark, sf), ["checkpoint", "seed"]))


@query("job08_pending_episodes", f"""WITH {EVAL}
SELECT task, episode::VARCHAR AS episode FROM v_eval WHERE (status = 'error' OR task = 'MoveCube') AND task <> 'StopCube'""")
def job08_pending(spark, sf):
    progress = views.evaluations(spark, sf)
    return jobs.pending(progress.select("task", "episode"), progress, redo=["MoveCube"], exclude=["StopCube"]).select("task", "episode")


@query("job08_final_rates", f"""WITH {EVAL},
r AS (SELECT task, avg((status = 'true')::INT) AS rate FROM v_eval WHERE status <> 'error' AND task <> 'StopCube' GROUP BY task
      UNION ALL SELECT 'StopCube', 0.0)
SELECT task, round(rate, 9) AS rate, round((SELECT avg(rate) FROM r), 9) AS total_success_rate FROM r""")
def job08_final(spark, sf):
    out = jobs.finalize(views.evaluations(spark, sf), exclude=["StopCube"])
    return out.select("task", F.round("rate", 9).alias("rate"), F.round("total_success_rate", 9).alias("total_success_rate"))


@query("job09_robot_actions", f"""WITH {CHUNK_ROWS}
SELECT epis_idx, step_idx, count(*)::INT AS size, round(sum(a0), 3) AS a0_sum, round(sum(a1), 3) AS a1_sum FROM v_chunk GROUP BY epis_idx, step_idx""")
def job09(spark, sf):
    mask = v.bool_mask(1, -1)
    norm = {"state": stats.NormStats([50.0, 40.0], [30.0, 20.0]), "actions": stats.NormStats([0.5, 40.0], [60.0, 20.0])}
    chunks = windows.action_chunks(views.steps(spark, sf), 20)
    model = stats.normalize(chunks.withColumn("actions", v.shift_actions(F.col("actions"), F.col("state"), mask, -1)), norm)
    out = jobs.postprocess_actions(model, norm, use_quantiles=False, mask=mask)
    return out.select("epis_idx", "step_idx", F.size("actions").alias("size"), F.round(dim_sum("actions", 0), 3).alias("a0_sum"),
                      F.round(dim_sum("actions", 1), 3).alias("a1_sum"))
