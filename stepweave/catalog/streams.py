"""Streaming operators, replayed from slices of the given tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from stepweave.catalog.joining import MOMENTS
from stepweave.catalog.memories import (FRAME_MEMORY_SQL, ONLINE_SQL, RECURRENT_MEMORY_SQL, SCORES_SQL, shown_frames, shown_recurrent,
                                        shown_tokens, token_memory_sql)
from stepweave.catalog.registry import CHUNK_ROWS, STEPS, query, work_dir
from stepweave.catalog.windowing import even_sql, joined
from stepweave.operators import memory, stats, windows
from stepweave.operators.ordered import number_rows, order_value
from stepweave.session import cut_lineage
from stepweave.sources import sinks, views
from stepweave.streaming import memory as live
from stepweave.streaming import run

SLICES = 3


@contextmanager
def few_partitions(spark):
    """State partitions are fixed when a stream starts; a single machine needs only a few."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def event_stream(spark, sf, folder):
    """Each event appends one frame; the demonstration length comes with it.

    Chunks carry one sequence number: microseconds, with the last digits of the id to break ties.
    """
    events = views.table(spark, sf, "events")
    ts = F.round(order_value(events, "ts")).cast("bigint")
    rows = events.select(
        F.col("user_id").cast("int").alias("epis_idx"), (ts * 1000 + F.col("event_id") % 1000).alias("seq"),
        F.lit(1).alias("frames"), (F.col("user_id") % 5).cast("int").alias("exec_start"), F.lit(False).alias("reset"))
    run.write_slices(rows, F.col("seq"), f"{folder}/in", SLICES)
    return run.replay(spark, f"{folder}/in")


@query("stm01_episode_memory", f"WITH {STEPS} SELECT epis_idx, step_idx, (epis_idx % 5)::INT AS exec_start FROM v_steps")
def stm01(spark, sf):
    folder = work_dir(spark)
    with few_partitions(spark):
        run.use_state_store(spark)
        out = run.run_to_table(live.episode_memory(event_stream(spark, sf, folder)), folder)
    return out.select("epis_idx", "step_idx", "exec_start")


@query("stm02_online_frames", f"""WITH {STEPS}
SELECT epis_idx, step_idx, list_aggregate({even_sql('step_idx', 16)}, 'string_agg', ',') AS frames FROM v_steps""")
def stm02(spark, sf):
    folder = work_dir(spark)
    with few_partitions(spark):
        run.use_state_store(spark)
        out = run.run_to_table(live.online_selection(event_stream(spark, sf, folder), budget=16), folder)
    return out.select("epis_idx", "step_idx", joined(F.col("indices")).alias("frames"))


@query("stm03_running_stats", f"""
SELECT {MOMENTS} FROM (SELECT unnest(range(4)) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x
                       FROM lineitem) GROUP BY dim""")
def stm03(spark, sf):
    folder = work_dir(spark)
    rows = views.vectors(spark, sf)
    run.write_slices(rows, F.col("l_orderkey"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        out = run.run_complete(live.running_stats(run.replay(spark, f"{folder}/in"), "x"), folder)
    return stats.final_stats(out).select("dim", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min",
                                         "max", "count")


@query("stm04_running_top_tokens", f"""WITH {SCORES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY epis_idx ORDER BY score DESC, step_idx DESC, patch DESC) AS r FROM v_scores)
SELECT epis_idx, step_idx, patch, round(score, 6) AS score FROM k WHERE r <= 300""")
def stm04(spark, sf):
    folder = work_dir(spark)
    frames = views.frames(spark, sf).drop("_blk")
    run.write_slices(frames, F.col("step_idx"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        run.use_state_store(spark)
        out = run.run_to_table(live.running_top_tokens(run.replay(spark, f"{folder}/in"), keep=300), folder)
    latest = out.groupBy("epis_idx").agg(F.max("as_of").alias("as_of"))
    return out.join(latest, ["epis_idx", "as_of"]).select(
        "epis_idx", "step_idx", F.col("patch").cast("bigint").alias("patch"), F.round("score", 6).alias("score"))


@query("stm05_chunk_replay", f"""WITH {CHUNK_ROWS}
SELECT epis_idx, (step_idx + i)::INT AS step_idx, a0, a1 FROM v_chunk WHERE step_idx % 16 = 0 AND i < 16""")
def stm05(spark, sf):
    chunks = windows.action_chunks(views.steps(spark, sf), 20).where(F.col("step_idx") % 16 == 0)
    out = live.expand_chunks(chunks.select("epis_idx", "step_idx", "actions"), 16)
    return out.select("epis_idx", "step_idx", F.get("action", F.lit(0)).alias("a0"), F.get("action", F.lit(1)).alias("a1"))


@query("stm06_step_windows", f"""WITH {STEPS}
SELECT epis_idx, CASE WHEN step_idx <= exec_start THEN 0 ELSE ceil((step_idx - exec_start) / 16.0) END::INT AS window_id,
       count(*) AS frames, min(step_idx) AS first_step, max(step_idx) AS last_step FROM v_steps GROUP BY ALL""")
def stm06(spark, sf):
    return windows.step_windows(views.steps(spark, sf)).groupBy("epis_idx", "window_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"))


@query("snk05_record_sink", """
SELECT event_id AS step, user_id AS "inputs/user_id", value AS "inputs/value", event_type AS "outputs/event_type" FROM events""")
def snk05(spark, sf):
    folder = work_dir(spark)
    rows = views.table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    run.write_slices(rows, F.col("event_id"), f"{folder}/in", SLICES)
    sink = sinks.record_sink(run.replay(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint",
                             ["user_id", "value"], ["event_type"], step="event_id")
    run.run_appends(sink.trigger(availableNow=True).start, spark, folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("stm01_taken_over", f"WITH {STEPS} SELECT epis_idx, step_idx, (epis_idx % 5)::INT AS exec_start FROM v_steps")
def stm01_taken_over(spark, sf):
    """The first half of the events is recorded; the stream goes on from there."""
    folder = work_dir(spark)
    events = views.table(spark, sf, "events")
    ts = F.round(order_value(events, "ts")).cast("bigint")
    rows = cut_lineage(events.select(
        F.col("user_id").cast("int").alias("epis_idx"), (ts * 1000 + F.col("event_id") % 1000).alias("seq"),
        F.lit(1).alias("frames"), (F.col("user_id") % 5).cast("int").alias("exec_start"), F.lit(False).alias("reset")))
    middle = F.lit(rows.agg(F.percentile_approx("seq", 0.5)).first()[0])
    recorded = number_rows(rows.where(F.col("seq") < middle), ["epis_idx"], "seq", "step_idx").select(
        "epis_idx", F.col("step_idx").cast("int").alias("step_idx"), "exec_start")
    run.write_slices(rows.where(F.col("seq") >= middle), F.col("seq"), f"{folder}/in", SLICES)
    with few_partitions(spark):
        run.use_state_store(spark)
        live_rows = run.run_to_table(live.episode_memory(
            run.replay(spark, f"{folder}/in"), initial=live.batch_progress(recorded)), folder)
    return recorded.unionByName(live_rows.select("epis_idx", "step_idx", "exec_start"))


def live_features(spark, sf, folder, **columns):
    """Features of the frames as a stream, in slices of steps."""
    frames = views.frames(spark, sf).drop("_blk").withColumns({"state": F.slice("pixels", 1, 2), **columns})
    run.write_slices(frames, F.col("step_idx"), f"{folder}/in", SLICES)
    return memory.build_features(run.replay(spark, f"{folder}/in"), pos_dim=12,
                                 keep=("epis_idx", "step_idx", "state", "pixels", *columns))


def live_contents(spark, sf, mode, columns=None, **options):
    folder = work_dir(spark)
    with few_partitions(spark):
        run.use_state_store(spark)
        return run.run_to_table(live.online_memory(live_features(spark, sf, folder, **(columns or {})), mode, **options), folder)


@query("stm02_frame_contents", FRAME_MEMORY_SQL)
def stm02_frame_contents(spark, sf):
    return shown_frames(live_contents(spark, sf, "frames", budget=64, per_image=16))


@query("stm02_recurrent_contents", RECURRENT_MEMORY_SQL.replace("epis_idx * 3 AS e", "least(epis_idx * 3, step_idx) AS e"))
def stm02_recurrent_contents(spark, sf):
    out = live_contents(spark, sf, "recurrent", {"exec_start": F.col("epis_idx") * 3}, horizon=4, max_steps=8, max_video=5)
    return shown_recurrent(out)


@query("stm02_token_contents", token_memory_sql(ONLINE_SQL))
def stm02_token_contents(spark, sf):
    return shown_tokens(live_contents(spark, sf, "tokens", budget=64, keep=300))
