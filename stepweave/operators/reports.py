"""Evaluation bookkeeping: success rates, run summaries, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.constants import SUITES, TASKS
from stepweave.functions.vectors import literal
from stepweave.operators.joins import with_suite

SCORES = [*TASKS, *SUITES, "Overall"]


def success_rates(df: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """Rate per task (per ``by`` group); rows recorded as error do not count."""
    usable = df.where(F.col(status) != "error")
    return usable.groupBy(*by, "task").agg(F.avg((F.col(status) == "true").cast("double")).alias("rate"))


def total_rate(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the task rates."""
    return rates.groupBy(*by).agg(F.avg("rate").alias("total_success_rate"))


def select_tasks(tasks: DataFrame, only: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """``only`` replaces the task list, ``exclude`` removes tasks from it."""
    kept = tasks.where(F.col("task").isin(*only)) if only else tasks
    return kept.where(~F.col("task").isin(*exclude)) if exclude else kept


def with_excluded(progress: DataFrame, exclude: Sequence[str], episodes: int = 50) -> DataFrame:
    """Records where an excluded task counts as 50 failed episodes instead of what was recorded."""
    if not exclude:
        return progress
    spark = progress.sparkSession
    failed = spark.createDataFrame([(t,) for t in exclude], "task string").select(
        "task", F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))).alias("episode"), F.lit("false").alias("status"))
    failed = failed.withColumn("episode", F.col("episode").cast("string"))
    kept = progress.where(~F.col("task").isin(*exclude)).select("task", F.col("episode").cast("string").alias("episode"), "status")
    return kept.unionByName(failed)


def fill_tasks(rates: DataFrame) -> DataFrame:
    """Every run gets all 16 tasks, absent ones with 0; rates become percentages."""
    runs = rates.select("checkpoint", "seed").distinct().withColumn("task", F.explode(literal(TASKS)))
    return (runs.join(rates, ["checkpoint", "seed", "task"], "left")
            .select("checkpoint", "seed", "task", (F.coalesce(F.col("rate"), F.lit(0.0)) * 100).alias("rate")))


def suite_scores(filled: DataFrame) -> DataFrame:
    """Per run the mean of each suite and over all tasks, next to the task rates: (.., score, value)."""
    keys = ["checkpoint", "seed"]
    named = with_suite(filled)
    scores = F.array(F.col("task"), F.col("suite"), F.lit("Overall"))
    return (named.withColumn("score", F.explode(scores)).groupBy(*keys, "score")
            .agg(F.avg("rate").alias("value")))


def summarize_runs(scores: DataFrame) -> DataFrame:
    """Mean and sample std of each score per checkpoint and over all runs (checkpoint ``ALL``)."""
    grouped = scores.groupingSets([["checkpoint", "score"], ["score"]], "checkpoint", "score").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("runs"),
        F.grouping("checkpoint").alias("_all"))
    name = F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("checkpoint"))
    return grouped.select(name.alias("checkpoint"), "score", "mean", "std", "runs")


def two_digits(x: Column) -> Column:
    """Two decimals, rounded from the exact binary value, half to even."""
    return F.call_function("format_number", x, F.lit("0.00"))


def format_cell(mean: Column, std: Column, separator: str = " ± ") -> Column:
    return F.concat(two_digits(mean), F.lit(separator), F.coalesce(two_digits(std), F.lit("nan")))


def report_table(summary: DataFrame, checkpoints: Sequence[str] | None = None, mean_only: bool = False,
                 scores: Sequence[str] = SCORES) -> DataFrame:
    """Scores as columns, checkpoints as rows in the given order, ALL last."""
    cell = two_digits(F.col("mean")) if mean_only else format_cell(F.col("mean"), F.col("std"))
    wide = summary.withColumn("_cell", cell).groupBy("checkpoint").pivot("score", list(scores)).agg(F.first("_cell"))
    if checkpoints is not None:
        wide = wide.where(F.col("checkpoint").isin(*checkpoints, "ALL"))
        place = F.array_position(literal([*checkpoints, "ALL"]), F.col("checkpoint"))
    else:
        place = F.when(F.col("checkpoint") == "ALL", F.lit(1)).otherwise(F.lit(0))
    return wide.orderBy(place, "checkpoint")


def max_frames(samples: DataFrame, memory: str, execution: str) -> DataFrame:
    """Largest number of key plus execution frames of a sample; null counts as 0."""
    return samples.agg(F.max(F.coalesce(F.size(memory) + F.size(execution), F.lit(0))).alias("max_frames"))
