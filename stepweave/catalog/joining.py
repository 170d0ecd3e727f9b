"""Joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.catalog.registry import CHUNK_ROWS, EVAL, FRAMES, STEPS, SUITE_CASE, TASK_LIST, query
from stepweave.functions.indices import even_indices
from stepweave.operators import joins, memory, reports, stats, windows
from stepweave.plans import jobs
from stepweave.sources import views

EVEN_8 = """, idx AS (
  SELECT epis_idx, step_idx, i,
         CASE WHEN step_idx < 8 THEN i WHEN i = 7 THEN step_idx ELSE floor(i * (step_idx / 7.0::DOUBLE)) END::INT AS at
  FROM v_frames, range(8) r(i) WHERE i <= step_idx)"""


@query("join01_history_gather", f"""WITH {FRAMES}{EVEN_8}
SELECT s.epis_idx, s.step_idx, count(*)::INT AS frames, string_agg(s.at::VARCHAR, ',' ORDER BY s.i) AS steps,
       round(sum(f.pixels[1]::DOUBLE), 6) AS first_pixels
FROM idx s JOIN v_frames f ON f.epis_idx = s.epis_idx AND f.step_idx = s.at GROUP BY s.epis_idx, s.step_idx""")
def join01(spark, sf):
    frames = views.frames(spark, sf)
    rows = frames.select("epis_idx", "step_idx").withColumn("indices", even_indices(F.col("step_idx"), 8))
    got = joins.gather_history(rows, frames, "indices", ["pixels"])
    total = F.aggregate("history", F.lit(0.0), lambda acc, h: acc + F.get(h["pixels"], F.lit(0)).cast("double"))
    return got.select("epis_idx", "step_idx", F.size("history").alias("frames"),
                      F.array_join(F.col("history.at").cast("array<string>"), ",").alias("steps"),
                      F.round(total, 6).alias("first_pixels"))


@query("join02_range_filter", f"""WITH {STEPS},
ranges AS (SELECT DISTINCT epis_idx, r.s AS s, r.e AS e FROM v_steps,
           (VALUES (0), (1), (2)) x(i), LATERAL (SELECT i * 20 + epis_idx % 7 AS s, i * 20 + 5 + epis_idx % 7 AS e) r)
SELECT epis_idx, step_idx FROM v_steps t WHERE EXISTS (
  SELECT 1 FROM ranges r WHERE r.epis_idx = t.epis_idx AND t.step_idx >= r.s AND t.step_idx < r.e)""")
def join02(spark, sf):
    steps = views.steps(spark, sf)
    shift = F.col("epis_idx") % 7
    ranges = steps.select("epis_idx").distinct().withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("ep--"), F.col("epis_idx").cast("string")).alias("episode_key"),
        (F.col("i") * 20 + shift).alias("start"), (F.col("i") * 20 + 5 + shift).alias("end"))
    key = F.concat(F.lit("ep--"), F.col("epis_idx").cast("string"))
    return joins.filter_ranges(steps, ranges, key, F.col("step_idx")).select("epis_idx", "step_idx")


@query("join03_task_prompt", """
SELECT n_name, r_regionkey AS task_index, r_name AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey""")
def join03(spark, sf):
    rows = views.table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("task_index"))
    tasks = views.table(spark, sf, "region").select(F.col("r_regionkey").alias("task_index"), F.col("r_name").alias("task"))
    return joins.prompt_from_task(rows, tasks)


LINE_STATS = """s AS (
  SELECT avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_extendedprice) AS m1,
         stddev_pop(l_extendedprice) AS s1, avg(l_tax) AS m3, stddev_pop(l_tax) AS s3 FROM lineitem)"""


@query("join04_stats_to_rows", f"""WITH {LINE_STATS}
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(abs(l_quantity - m0)), 3) AS dev0,
       round(sum(abs((l_extendedprice - m1) / (s1 + 1e-6))), 3) AS dev1
FROM lineitem, s GROUP BY ALL""")
def join04(spark, sf):
    rows = views.vectors(spark, sf)
    found = stats.collect_norm_stats(rows, "x")
    z = stats.normalize(rows, {"x": found})
    first = F.abs(F.get("x", F.lit(0)) * (F.lit(found.std[0]) + 1e-6))
    return z.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(first), 3).alias("dev0"),
        F.round(F.sum(F.abs(F.get("x", F.lit(1)))), 3).alias("dev1"))


@query("join05_resume", f"""WITH {EVAL}
SELECT task, episode::VARCHAR AS episode FROM v_eval WHERE status = 'error' OR task = 'BinFill'""")
def join05(spark, sf):
    progress = views.evaluations(spark, sf)
    return joins.pending_episodes(progress.select("task", "episode"), progress, ["BinFill"]).select("task", "episode")


@query("join06_offset_sequence", f"""WITH {STEPS}
SELECT s.epis_idx, s.step_idx, round(sum(a.value), 6) AS total, count(*) FILTER (WHERE s.step_idx + 2 * k.i > s.n - 1) AS padded
FROM v_steps s CROSS JOIN range(5) k(i)
JOIN v_steps a ON a.epis_idx = s.epis_idx AND a.step_idx = least(s.step_idx + 2 * k.i, s.n - 1) GROUP BY ALL""")
def join06(spark, sf):
    steps = views.steps(spark, sf).withColumn("value", F.get("state", F.lit(0)))
    out = windows.offset_sequence(steps, "value", 5, fps=10, rate=20)
    return out.select("epis_idx", "step_idx", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                      F.size(F.filter("is_pad", lambda x: x)).cast("bigint").alias("padded"))


def pos_sql(t: str, patch: str, grid: int) -> str:
    """Sum of a 12-dim positional vector."""
    cell = 16 // grid
    y, x = f"(floor({patch} / {grid}.0) * {cell} + {cell / 2})", f"(({patch} % {grid}) * {cell} + {cell / 2})"
    terms = []
    for position, base in ((t, 10000.0), (y, 1000.0), (x, 1000.0)):
        for i in range(2):
            w = base ** -i
            terms += [f"sin({position} * {w!r})", f"cos({position} * {w!r})"]
    return " + ".join(terms)


@query("join07_position_join", f"""WITH {FRAMES}
SELECT epis_idx, step_idx, p AS patch, round(({pos_sql('step_idx', 'p', 8)}) + pixels[p + 1], 5) AS total
FROM v_frames, range(64) r(p)""")
def join07(spark, sf):
    frames = views.frames(spark, sf)
    tokens = frames.select("epis_idx", "step_idx", F.lit(0).alias("view"), F.posexplode("pixels").alias("patch", "x"))
    table = memory.pos_table(frames.select(F.col("step_idx").alias("t")).distinct(), 8, dim=12)
    out = joins.attach_pos(tokens, table)
    total = F.aggregate("pos_emb", F.lit(0.0), lambda a, x: a + x) + F.col("x").cast("double")
    return out.select("epis_idx", "step_idx", F.col("patch").cast("bigint").alias("patch"), F.round(total, 5).alias("total"))


@query("join08_suite_lookup", f"WITH {EVAL} SELECT {SUITE_CASE} AS suite, task, count(*) AS n FROM v_eval GROUP BY ALL")
def join08(spark, sf):
    return joins.with_suite(views.evaluations(spark, sf)).groupBy("suite", "task").agg(F.count(F.lit(1)).alias("n"))


VEC = "SELECT unnest(range(4)) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x, l_returnflag FROM lineitem"
MOMENTS = """dim::INT AS dim, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, min(x) AS min, max(x) AS max,
       count(*) AS count"""


def rounded(df):
    return df.select("dim", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "count")


@query("agg01_vector_moments", f"SELECT {MOMENTS} FROM ({VEC}) GROUP BY dim")
def agg01(spark, sf):
    return rounded(stats.vector_moments(views.vectors(spark, sf), "x"))


@query("agg01_embedding_moments", """
SELECT label, dim::INT AS dim, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, count(*) AS n FROM (
  SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim""")
def agg01b(spark, sf):
    found = stats.vector_moments(views.table(spark, sf, "embeddings"), "embedding", ["label"])
    return found.select("label", "dim", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.col("count").alias("n"))


QUANTILES = """, r AS (SELECT dim, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v GROUP BY dim),
b AS (SELECT dim, CASE WHEN hi > lo THEN least(4999, floor((x - lo) / (hi - lo) * 5000)) ELSE 0 END AS bin, lo, hi, n
      FROM v JOIN r USING (dim)),
c AS (SELECT dim, bin, lo, hi, n, sum(count(*)) OVER (PARTITION BY dim ORDER BY bin) AS cum FROM b GROUP BY dim, bin, lo, hi, n)
SELECT dim::INT AS dim, round(min(lo + bin * (hi - lo) / 5000) FILTER (WHERE cum >= 0.01 * n), 6) AS q01,
       round(min(lo + bin * (hi - lo) / 5000) FILTER (WHERE cum >= 0.99 * n), 6) AS q99 FROM c GROUP BY dim"""


@query("agg02_histogram_quantiles", f"""
WITH v AS (SELECT unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings){QUANTILES}""")
def agg02(spark, sf):
    found = stats.hist_quantiles(views.table(spark, sf, "embeddings"), "embedding")
    return found.select("dim", F.round("q01", 6).alias("q01"), F.round("q99", 6).alias("q99"))


@query("agg03_merged_stats", f"SELECT {MOMENTS} FROM ({VEC}) GROUP BY dim")
def agg03(spark, sf):
    rows = views.vectors(spark, sf)
    parts = [stats.partial_stats(rows.where(c), "x") for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R")]
    return rounded(stats.final_stats(stats.merge_stats(*parts)))


RATE = """v_rates AS (
  SELECT checkpoint, seed, task, avg((status = 'true')::INT) AS rate FROM v_eval WHERE status <> 'error'
  GROUP BY checkpoint, seed, task)"""


@query("agg04_success_rates", f"""WITH {EVAL},
r AS (SELECT task, avg((status = 'true')::INT) AS rate FROM v_eval WHERE status <> 'error' GROUP BY task)
SELECT task, round(rate, 9) AS rate, round((SELECT avg(rate) FROM r), 9) AS total FROM r""")
def agg04(spark, sf):
    rates = reports.success_rates(views.evaluations(spark, sf))
    return rates.select("task", F.round("rate", 9).alias("rate"),
                        F.round(reports.total_rate(rates).scalar(), 9).alias("total"))


FILLED = f"""WITH {EVAL}, {RATE},
runs AS (SELECT DISTINCT checkpoint, seed FROM v_rates),
filled AS (
  SELECT checkpoint, seed, t.task, coalesce(rate, 0) * 100 AS rate
  FROM runs CROSS JOIN (SELECT unnest({TASK_LIST}) AS task) t LEFT JOIN v_rates USING (checkpoint, seed, task)),
scores AS (
  SELECT checkpoint, seed, task AS score, rate AS value FROM filled
  UNION ALL SELECT checkpoint, seed, {SUITE_CASE}, avg(rate) FROM filled GROUP BY ALL
  UNION ALL SELECT checkpoint, seed, 'Overall', avg(rate) FROM filled GROUP BY ALL),
summary AS (
  SELECT coalesce(checkpoint, 'ALL') AS checkpoint, score, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS runs
  FROM scores GROUP BY GROUPING SETS ((checkpoint, score), (score)))"""


def filled_rates(spark, sf):
    rates = reports.success_rates(views.evaluations(spark, sf), ["checkpoint", "seed"])
    return reports.fill_tasks(rates)


@query("agg05_run_summary", f"""{FILLED}
SELECT checkpoint, score, round(mean, 6) AS mean, round(std, 6) AS std, runs FROM summary""")
def agg05(spark, sf):
    found = reports.summarize_runs(reports.suite_scores(filled_rates(spark, sf)))
    return found.select("checkpoint", "score", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "runs")


@query("agg06_suite_scores", f"{FILLED} SELECT checkpoint, seed, score, round(value, 6) AS value FROM scores")
def agg06(spark, sf):
    found = reports.suite_scores(filled_rates(spark, sf))
    return found.select("checkpoint", "seed", "score", F.round("value", 6).alias("value"))


@query("agg07_filled_rates", f"{FILLED} SELECT checkpoint, seed, task, round(rate, 6) AS rate FROM filled")
def agg07(spark, sf):
    return filled_rates(spark, sf).withColumn("rate", F.round("rate", 6))


@query("agg08_report_table", FILLED + "\nSELECT checkpoint, " + ", ".join(
    f"round(max(mean) FILTER (WHERE score = '{s}'), 2) AS \"{s}\"" for s in reports.SCORES) + " FROM summary GROUP BY checkpoint")
def agg08(spark, sf):
    rates = reports.success_rates(views.evaluations(spark, sf), ["checkpoint", "seed"])
    table = jobs.benchmark_report(rates, mean_only=True)
    return table.select("checkpoint", *[F.col(s).cast("double").alias(s) for s in reports.SCORES])


@query("agg09_first_execution_step", f"WITH {STEPS} SELECT epis_idx, step_idx, exec_start FROM v_steps")
def agg09(spark, sf):
    return jobs.exec_start(views.steps(spark, sf)).select("epis_idx", "step_idx", "exec_start")


@query("agg10_episode_summary", f"""WITH {STEPS}
SELECT epis_idx, count(*) AS timesteps, max(exec_start) AS exec_start, max(env_id) AS goal FROM v_steps GROUP BY epis_idx""")
def agg10(spark, sf):
    return jobs.episode_summary(views.steps(spark, sf), [F.max("env_id").alias("goal")])


@query("agg12_interval_means", f"""WITH {STEPS}
SELECT epis_idx, ceil(step_idx / 10.0)::INT AS interval, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM v_steps
GROUP BY epis_idx, ceil(step_idx / 10.0)::INT HAVING max(step_idx) = ceil(max(step_idx) / 10.0) * 10""")
def agg12(spark, sf):
    steps = views.steps(spark, sf).withColumn("value", F.get("state", F.lit(0)))
    out = stats.interval_means(steps, ["value", "k"], 10)
    return out.withColumns({"value": F.round("value", 6), "k": F.round("k", 6)})


@query("agg13_masked_mean", f"""WITH {CHUNK_ROWS}
SELECT i::INT AS pos, round(coalesce(avg(a0) FILTER (WHERE step_idx + i < n), 0), 6) AS mean,
       count(*) FILTER (WHERE step_idx + i < n) AS used FROM v_chunk GROUP BY i""")
def agg13(spark, sf):
    chunks = windows.action_chunks(views.steps(spark, sf), 20)
    left = F.col("n") - F.col("step_idx")
    rows = chunks.select(F.transform("actions", lambda a: F.get(a, F.lit(0))).alias("values"),
                         F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i < left).alias("mask"))
    return stats.masked_mean(rows, "values", "mask").withColumn("mean", F.round("mean", 6))
