"""Memory construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.joining import pos_sql
from stepweave.catalog.registry import FRAMES, query
from stepweave.functions import vectors as v
from stepweave.operators import memory
from stepweave.sources import views

SCORES_SQL = f"""{FRAMES},
sc AS (SELECT epis_idx, step_idx, pixels, lag(pixels) OVER (PARTITION BY epis_idx ORDER BY step_idx) AS prev FROM v_frames
       WHERE step_idx = 0 OR (step_idx + 1) % 8 = 0),
v_scores AS (
  SELECT epis_idx, step_idx, p AS patch, CASE WHEN step_idx = 0 THEN 1000.0::DOUBLE
           ELSE abs(pixels[p + 1]::DOUBLE - prev[p + 1]::DOUBLE) END AS score FROM sc, range(64) r(p)
  WHERE step_idx = 0 OR abs(pixels[p + 1]::DOUBLE - prev[p + 1]::DOUBLE) >= 1e-4)"""

KEPT_SQL = SCORES_SQL + """,
v_kept AS (SELECT *, row_number() OVER (PARTITION BY epis_idx ORDER BY score, step_idx, patch) - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY epis_idx ORDER BY score DESC, step_idx DESC, patch DESC) AS r FROM v_scores)
  WHERE r <= 300)"""

OFFLINE_SQL = KEPT_SQL + """,
v_tok AS (SELECT * FROM (
  SELECT f.epis_idx, f.step_idx AS t, k.step_idx AS step, k.patch,
         row_number() OVER (PARTITION BY f.epis_idx, f.step_idx ORDER BY k.pos DESC) AS q
  FROM v_frames f JOIN v_kept k ON k.epis_idx = f.epis_idx AND k.step_idx <= f.step_idx) WHERE q <= 64)"""


ONLINE_SQL = SCORES_SQL + """,
v_tok AS (SELECT * FROM (
  SELECT f.epis_idx, f.step_idx AS t, k.step_idx AS step, k.patch, row_number() OVER (
           PARTITION BY f.epis_idx, f.step_idx ORDER BY k.score DESC, k.step_idx DESC, k.patch DESC) AS q
  FROM v_frames f JOIN v_scores k ON k.epis_idx = f.epis_idx AND k.step_idx <= f.step_idx) WHERE q <= 64)"""


def scores(spark, sf):
    return memory.token_scores(views.frames(spark, sf))


def kept(spark, sf):
    return memory.top_tokens(scores(spark, sf), keep=300)


def token_text(tokens):
    return F.md5(F.array_join(F.transform(tokens, lambda x: F.concat(
        x["step"].cast("string"), F.lit(":"), x["patch"].cast("string"))), ","))


@query("mem01_token_scores", f"WITH {SCORES_SQL} SELECT epis_idx, step_idx, patch, round(score, 6) AS score FROM v_scores")
def mem01(spark, sf):
    return scores(spark, sf).select("epis_idx", "step_idx", F.col("patch").cast("bigint").alias("patch"),
                                    F.round("score", 6).alias("score"))


@query("mem02_top_tokens", f"WITH {KEPT_SQL} SELECT epis_idx, step_idx, patch, pos FROM v_kept")
def mem02(spark, sf):
    return kept(spark, sf).select("epis_idx", "step_idx", F.col("patch").cast("bigint").alias("patch"),
                                  F.col("pos").cast("bigint").alias("pos"))


@query("mem03_budget_tokens", f"""WITH {OFFLINE_SQL}
SELECT f.epis_idx, f.step_idx, count(t.step)::INT AS size,
       md5(coalesce(string_agg(t.step || ':' || t.patch, ',' ORDER BY t.step, t.patch), '')) AS tokens
FROM v_frames f LEFT JOIN v_tok t ON t.epis_idx = f.epis_idx AND t.t = f.step_idx GROUP BY f.epis_idx, f.step_idx""")
def mem03(spark, sf):
    rows = views.frames(spark, sf).select("epis_idx", "step_idx")
    out = memory.budget_tokens(rows, kept(spark, sf), 64)
    return out.select("epis_idx", "step_idx", F.size("tokens").alias("size"), token_text(F.col("tokens")).alias("tokens"))


@query("mem03_online_tokens", f"""WITH {SCORES_SQL},
o AS (SELECT * FROM (
  SELECT f.epis_idx, f.step_idx AS t, k.step_idx AS step, k.patch, row_number() OVER (
           PARTITION BY f.epis_idx, f.step_idx ORDER BY k.score DESC, k.step_idx DESC, k.patch DESC) AS q
  FROM v_frames f JOIN v_scores k ON k.epis_idx = f.epis_idx AND k.step_idx <= f.step_idx) WHERE q <= 64)
SELECT epis_idx, t AS step_idx, count(*)::INT AS size, md5(string_agg(step || ':' || patch, ',' ORDER BY step, patch)) AS tokens
FROM o GROUP BY epis_idx, t""")
def mem03_online(spark, sf):
    rows = views.frames(spark, sf).select("epis_idx", "step_idx")
    out = memory.online_tokens(rows, scores(spark, sf), budget=64, keep=300)
    return out.select("epis_idx", "step_idx", F.size("tokens").alias("size"), token_text(F.col("tokens")).alias("tokens"))


def features(spark, sf):
    frames = views.frames(spark, sf).withColumn("state", F.slice("pixels", 1, 2))
    return memory.build_features(frames, pos_dim=12)


def deep_sum(column):
    return F.aggregate(F.transform(column, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x.cast("double"))),
                       F.lit(0.0), lambda a, x: a + x)


def on(mask):
    return F.size(F.filter(mask, lambda x: x))


def token_memory_sql(tokens):
    return f"""WITH {tokens}
SELECT s.epis_idx, s.step_idx, 64 AS length, count(t.step)::INT AS used,
       round(coalesce(sum(f.pixels[t.patch + 1]::DOUBLE), 0), 5) AS image,
       round(coalesce(sum(f.pixels[1]::DOUBLE + f.pixels[2]::DOUBLE), 0), 5) AS state,
       round(coalesce(sum({pos_sql('t.step', 't.patch', 8)}), 0), 4) AS pos
FROM v_frames s LEFT JOIN v_tok t ON t.epis_idx = s.epis_idx AND t.t = s.step_idx
LEFT JOIN v_frames f ON f.epis_idx = t.epis_idx AND f.step_idx = t.step GROUP BY s.epis_idx, s.step_idx"""


def shown_tokens(out):
    return out.select("epis_idx", "step_idx", F.size("static_image_emb").alias("length"), on("static_mask").alias("used"),
                      F.round(deep_sum("static_image_emb"), 5).alias("image"),
                      F.round(deep_sum("static_state_emb"), 5).alias("state"),
                      F.round(deep_sum("static_pos_emb"), 4).alias("pos"))


@query("mem04_token_memory", token_memory_sql(OFFLINE_SQL))
def mem04(spark, sf):
    rows = views.frames(spark, sf).select("epis_idx", "step_idx")
    picked = memory.budget_tokens(rows, kept(spark, sf), 64)
    return shown_tokens(memory.assemble_tokens(picked.drop("tokens"), picked, features(spark, sf), 64))


FRAME_MEMORY_SQL = f"""WITH {FRAMES},
idx AS (SELECT epis_idx, step_idx, CASE WHEN step_idx < 4 THEN i WHEN i = 3 THEN step_idx
          ELSE floor(i * (step_idx / 3.0::DOUBLE)) END::INT AS at FROM v_frames, range(4) r(i) WHERE i <= step_idx)
SELECT s.epis_idx, s.step_idx, 64 AS length, (16 * count(*))::INT AS used,
       round(sum(list_sum(f.pixels::DOUBLE[])) / 4, 5) AS image, round(16 * sum(f.pixels[1]::DOUBLE + f.pixels[2]::DOUBLE), 4) AS state
FROM idx s JOIN v_frames f ON f.epis_idx = s.epis_idx AND f.step_idx = s.at GROUP BY s.epis_idx, s.step_idx"""


def shown_frames(out):
    return out.select("epis_idx", "step_idx", F.size("static_image_emb").alias("length"), on("static_mask").alias("used"),
                      F.round(deep_sum("static_image_emb"), 5).alias("image"),
                      F.round(deep_sum("static_state_emb"), 4).alias("state"))


@query("mem05_frame_memory", FRAME_MEMORY_SQL)
def mem05(spark, sf):
    rows = views.frames(spark, sf).select("epis_idx", "step_idx")
    return shown_frames(memory.assemble_frames(rows, features(spark, sf), budget=64, per_image=16))


RECUR = """
z AS (SELECT epis_idx, step_idx, list_concat(
    CASE WHEN e = 0 THEN [] WHEN e <= 8 THEN range(0, e, 2) WHEN e <= 20 THEN range(0, e, 4)
         ELSE list_transform(range(5), lambda i: CASE WHEN i = 4 THEN e - 1 ELSE floor(i * ((e - 1) / 4.0::DOUBLE)) END::BIGINT) END,
    CASE WHEN step_idx - e < 4 THEN [step_idx] ELSE range((step_idx - e) % 4 + e, step_idx + 1, 4) END) AS z
  FROM (SELECT *, epis_idx * 3 AS e FROM v_frames) WHERE step_idx >= e),
y AS (SELECT epis_idx, step_idx, unnest(list_slice(z, greatest(1, len(z) - 7), len(z))) AS at FROM z)"""


RECURRENT_MEMORY_SQL = f"""WITH {FRAMES}, {RECUR}
SELECT y.epis_idx, y.step_idx, 8 AS length, count(*)::INT AS used, round(sum(list_sum(f.pixels::DOUBLE[])), 5) AS image,
       (count(*) = 8) AS full_mask FROM y JOIN v_frames f ON f.epis_idx = y.epis_idx AND f.step_idx = y.at
GROUP BY y.epis_idx, y.step_idx"""


def shown_recurrent(out):
    total = F.aggregate(F.transform("recur_image_emb", deep_sum), F.lit(0.0), lambda a, x: a + x)
    return out.select("epis_idx", "step_idx", F.size("recur_image_emb").alias("length"), on("recur_mask").alias("used"),
                      F.round(total, 5).alias("image"), F.get("recur_mask", F.lit(0)).alias("full_mask"))


@query("mem06_recurrent_memory", RECURRENT_MEMORY_SQL)
def mem06(spark, sf):
    rows = views.frames(spark, sf).select("epis_idx", "step_idx", (F.col("epis_idx") * 3).alias("exec_start"))
    return shown_recurrent(memory.assemble_recurrent(rows.where("step_idx >= exec_start"), features(spark, sf), 4, 8, 5))


@query("mem07_grid_pooling", """
WITH c AS (SELECT vec_id, j, embedding AS e, (j // 4) * 16 + (j % 4) * 2 AS b FROM embeddings, range(16) r(j)),
p AS (SELECT vec_id, j, (e[b + 1]::DOUBLE + e[b + 2]::DOUBLE + e[b + 9]::DOUBLE + e[b + 10]::DOUBLE) / 4 AS mean,
      greatest(e[b + 1], e[b + 2], e[b + 9], e[b + 10])::DOUBLE AS top FROM c)
SELECT vec_id, j AS cell, round(mean, 6) AS mean, round(top, 6) AS top,
       round(avg(mean) OVER (PARTITION BY vec_id, j // 8, (j % 4) // 2), 6) AS coarse FROM p""")
def mem07(spark, sf):
    raw = views.table(spark, sf, "embeddings")
    mid = v.pool_grid(F.col("embedding"), 8, 4)
    pooled = raw.select("vec_id", mid.alias("mid"), v.pool_grid(F.col("embedding"), 8, 4, "max").alias("top"))
    coarse = pooled.withColumn("coarse", v.pool_grid(F.col("mid"), 4, 2))
    rows = coarse.select("vec_id", "coarse", F.posexplode(F.arrays_zip("mid", "top")).alias("cell", "c"))
    block = F.floor(F.col("cell") / 8) * 2 + F.floor(F.col("cell") % 4 / 2)
    return rows.select("vec_id", F.col("cell").cast("bigint").alias("cell"), F.round("c.mid", 6).alias("mean"),
                       F.round(F.col("c.top").cast("double"), 6).alias("top"),
                       F.round(F.get("coarse", block.cast("int")), 6).alias("coarse"))


@query("mem08_patches", """
SELECT vec_id, p AS patch, round(e[b + 1]::DOUBLE, 6) AS first, round(e[b + 10]::DOUBLE, 6) AS last, 4 AS size FROM (
  SELECT vec_id, p, embedding AS e, (p // 4) * 16 + (p % 4) * 2 AS b FROM embeddings, range(16) r(p))""")
def mem08(spark, sf):
    cut = views.table(spark, sf, "embeddings").select("vec_id", F.posexplode(
        v.patchify(F.col("embedding"), 8, 8, 1, 4)).alias("patch", "c"))
    return cut.select("vec_id", F.col("patch").cast("bigint").alias("patch"),
                      F.round(F.element_at("c", 1).cast("double"), 6).alias("first"),
                      F.round(F.element_at("c", -1).cast("double"), 6).alias("last"), F.size("c").alias("size"))


@query("mem09_position_table", f"""WITH {FRAMES}, ts AS (SELECT DISTINCT step_idx AS t FROM v_frames)
SELECT t, p AS patch, round({pos_sql('t', 'p', 4)}, 5) AS total, round(sin(t * 1.0), 6) AS first,
       round(cos(((p % 4) * 4 + 2) * 0.001), 6) AS last FROM ts, range(16) r(p)""")
def mem09(spark, sf):
    times = views.frames(spark, sf).select(F.col("step_idx").alias("t")).distinct()
    table = memory.pos_table(times, 4, dim=12)
    return table.select("t", F.col("patch").cast("bigint").alias("patch"),
                        F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
                        F.round(F.element_at("emb", 1), 6).alias("first"), F.round(F.element_at("emb", -1), 6).alias("last"))


@query("mem10_feature_table", f"""WITH {FRAMES}
SELECT epis_idx, step_idx, round(list_sum(pixels::DOUBLE[]), 5) AS fine, round(list_sum(pixels::DOUBLE[]) / 4, 5) AS mid,
       round(list_sum(pixels::DOUBLE[]) / 16, 5) AS coarse, 64 AS fine_pos, 4 AS coarse_pos,
       round(sin(step_idx * 1.0), 6) AS pos0, round(pixels[1]::DOUBLE, 6) AS state0 FROM v_frames""")
def mem10(spark, sf):
    out = features(spark, sf)
    return out.select("epis_idx", "step_idx", F.round(deep_sum("image_emb_8x8"), 5).alias("fine"),
                      F.round(deep_sum("image_emb_4x4"), 5).alias("mid"), F.round(deep_sum("image_emb_2x2"), 5).alias("coarse"),
                      F.size("pos_emb_8x8").alias("fine_pos"), F.size("pos_emb_2x2").alias("coarse_pos"),
                      F.round(F.get(F.get("pos_emb_8x8", F.lit(0)), F.lit(0)), 6).alias("pos0"),
                      F.round(F.get("state", F.lit(0)).cast("double"), 6).alias("state0"))
