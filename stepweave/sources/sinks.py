"""Sinks: samples, features, kept tokens, statistics, chat lines, records, progress, conversations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import ordered as o
from stepweave.operators.shape import flatten
from stepweave.operators.stats import NormStats

EPISODES_PER_BUCKET = 1024


def refuse_collisions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself if its keys are unique; raises otherwise. Reads the key columns only."""
    clash = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if clash:
        raise ValueError(f"collision at {clash[0].asDict()}")
    return df


def write_table(df: DataFrame, path: str, keys: Sequence[str], episode: str = "epis_idx",
                width: int = EPISODES_PER_BUCKET, changed_only: bool = False) -> None:
    """Overwrite a keyed table, in folders of ``width`` episodes so that a lookup reads one folder.

    Rows are dealt by ranges of (folder, keys), so a folder gets few files and a large one several tasks. Keys are checked
    on what was written; a collision raises and leaves the table to be written again. With ``changed_only`` the folders that
    ``df`` has rows for are replaced, and all others stay. For tables that must change together see ``store``.
    """
    bucketed = df.withColumn("epis_bucket", F.floor(F.col(episode) / width))
    dealt = bucketed.repartitionByRange("epis_bucket", *keys)
    mode = "dynamic" if changed_only else "static"
    dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("epis_bucket").parquet(path)
    refuse_collisions(df.sparkSession.read.parquet(path).select(*keys), keys)


def write_samples(df: DataFrame, path: str, changed_only: bool = False) -> None:
    write_table(df.drop(o.BLOCK), path, ["sample_id"], changed_only=changed_only)


def write_features(df: DataFrame, path: str, changed_only: bool = False) -> None:
    write_table(df.drop(o.BLOCK), path, ["epis_idx", "step_idx"], changed_only=changed_only)


def write_kept(df: DataFrame, path: str, changed_only: bool = False) -> None:
    """Kept-token list per episode."""
    write_table(df, path, ["epis_idx"], changed_only=changed_only)


def dataset_stats(steps: DataFrame) -> DataFrame:
    return steps.agg(F.count_if(~F.col("is_demo")).alias("execution_samples"),
                     F.count(F.lit(1)).alias("total_samples"))


def write_stats(steps: DataFrame, path: str) -> None:
    dataset_stats(steps).coalesce(1).write.mode("overwrite").json(path)


def chat_line(record: Sequence[str]) -> Column:
    """One JSON object; null keys are left out."""
    return F.to_json(F.struct(*record))


def write_chat_jsonl(df: DataFrame, path: str, kinds: Sequence[str] = ("simple", "grounded"),
                     columns: Sequence[str] = ("messages", "objects", "images", "videos")) -> None:
    """JSON lines per kind under ``<path>/<kind>_subgoal_train.jsonl``; earlier output is replaced."""
    for kind in kinds:
        part = df.where(F.col("kind") == kind)
        lines = part.select(chat_line([c for c in columns if c in df.columns]).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{kind}_subgoal_train.jsonl")


def norm_stats_json(stats: dict[str, NormStats]) -> str:
    out = {}
    for key, s in stats.items():
        out[key] = {"mean": list(s.mean), "std": list(s.std)}
        if s.q01 is not None and s.q99 is not None:
            out[key] |= {"q01": list(s.q01), "q99": list(s.q99)}
    return json.dumps({"norm_stats": out}, indent=2)


def save_norm_stats(spark: SparkSession, stats: dict[str, NormStats], path: str) -> None:
    """``{"norm_stats": {key: {mean, std, q01?, q99?}}}``; as small as the vectors are long."""
    spark.createDataFrame([(norm_stats_json(stats),)], "value string").coalesce(1).write.mode("overwrite").option(
        "lineSep", "\n").text(path)


def record_sink(stream: DataFrame, path: str, checkpoint: str, inputs: Sequence[str], outputs: Sequence[str],
                step: str = "step_idx"):
    """Streaming sink of {inputs, outputs} records, flattened with ``/`` keys, one row per step."""
    shaped = stream.select(F.col(step).alias("step"), F.struct(*inputs).alias("inputs"), F.struct(*outputs).alias("outputs"))

    def append(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch id: a batch that is retried replaces its own output.
        flatten(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return shaped.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def progress_rows(df: DataFrame) -> DataFrame:
    """Task to {episode: true / false / "error"} as JSON, one row per task."""
    entry = F.struct(F.col("episode").cast("string"), F.col("status"))
    return df.groupBy("task").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("episodes"))


def write_progress(df: DataFrame, path: str) -> None:
    """Progress rows as JSON lines (task, episode, status): flat, so a task with many episodes stays spread."""
    df.select("task", F.col("episode").cast("string").alias("episode"), "status").write.mode("overwrite").json(path)


def log_record(rates: DataFrame) -> DataFrame:
    """One row: success_rate by task (as many entries as tasks) and the macro total."""
    return rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "rate")))).alias("success_rate"),
                     F.avg("rate").alias("total_success_rate"))


def write_log(rates: DataFrame, path: str) -> None:
    log_record(rates).coalesce(1).write.mode("overwrite").json(path)


def conversation_rows(df: DataFrame, episode: str, step: str, query: str, response: str, artifact: str | None = None,
                      kind: str | None = None) -> DataFrame:
    """Turns from 1 in order, with kind, artifact, query and response."""
    numbered = o.number_rows(df, [episode], step, "_turn")
    return numbered.select(
        F.col(episode), (F.col("_turn") + 1).cast("int").alias("turn"),
        (F.col(kind) if kind else F.lit("text")).alias("type"),
        (F.col(artifact) if artifact else F.lit(None).cast("string")).alias("path"),
        F.col(query).alias("query"), F.col(response).alias("response"))


def write_conversation(rows: DataFrame, path: str, episode: str, width: int = EPISODES_PER_BUCKET) -> None:
    """Request and response lines in turn order, in folders of ``width`` episodes."""
    lines = rows.withColumn("epis_bucket", F.floor(F.col(episode) / width))
    (lines.repartitionByRange("epis_bucket", episode, "turn").sortWithinPartitions("epis_bucket", episode, "turn")
     .write.mode("overwrite").partitionBy("epis_bucket").json(path))
