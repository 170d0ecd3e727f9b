"""Sources: step tables, trajectories, samples, run logs, statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.constants import SYMBOLIC_TYPES
from stepweave.operators.stats import NormStats
from stepweave.sources.runlogs import read_logs


def key_number(key: Column) -> Column:
    """Number at the end of a ``name_12`` key, so that keys sort numerically."""
    found = F.regexp_extract(key, r"_(\d+)$", 1)
    return F.when(found != "", found.cast("int"))


def read_steps(spark: SparkSession, path: str, file_column: str = "file") -> DataFrame:
    """A step table: one row per (file, episode, step).

    Group keys such as ``episode_12`` / ``timestep_3`` become numbers; a table without a file column takes
    the name of the file it was read from.
    """
    df = spark.read.parquet(path)
    if file_column not in df.columns:
        df = df.withColumn(file_column, F.col("_metadata.file_name"))
    for source, target in (("episode", "episode_idx"), ("timestep", "step_idx")):
        if source in df.columns and target not in df.columns:
            df = df.withColumn(target, key_number(F.col(source))).drop(source)
    return df


def cap_episodes(df: DataFrame, n: int | None, file: str = "file", episode: str = "episode_idx") -> DataFrame:
    """First ``n`` episodes of each file in numeric order; None keeps all.

    Ranks the distinct (file, episode) pairs, not the rows; the limit is applied before the shuffle.
    """
    if n is None:
        return df
    from pyspark.sql import Window

    episodes = df.select(file, episode).distinct()
    rank = F.row_number().over(Window.partitionBy(file).orderBy(episode))
    kept = episodes.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return df.join(kept, [file, episode], "left_semi")


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories as stored: one row per recording (segment), arrays over its frames."""
    return spark.read.parquet(path)


def trajectory_frames(df: DataFrame, arrays: Sequence[str], t: str = "t", start: str | None = None) -> DataFrame:
    """Struct-of-arrays rows to one row per frame; ``start`` offsets the segments of a long recording."""
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    rest = [c for c in df.columns if c not in arrays and c != start]
    offset = F.col(start) if start else F.lit(0)
    flat = df.select(*rest, *([start] if start else []), F.posexplode(zipped).alias("_i", "_f"))
    return flat.select(*rest, (F.col("_i") + offset).cast("int").alias(t), *[F.col(f"_f.{a}").alias(a) for a in arrays])


def sample(df: DataFrame, sample_id: int) -> DataFrame:
    return df.where(F.col("sample_id") == sample_id)


def n_samples(stats: DataFrame) -> DataFrame:
    """Length of a dataset: the execution samples if counted, else all samples."""
    names = [c for c in ("execution_samples", "total_samples") if c in stats.columns]
    return stats.select(F.coalesce(*names).alias("n_samples"))


def read_run_logs(spark: SparkSession, root: str, model: str, checkpoints: Sequence[str], seeds: Sequence[str],
                  symbolic_type: str = "") -> DataFrame:
    """(checkpoint, seed, task, rate) from ``<root>/<model>/<checkpoint>/<seed>[/<type>]/log.json``.

    Missing and unreadable files are skipped. A model whose name contains ``symbolic`` needs a known type.
    """
    if "symbolic" in model:
        if symbolic_type not in SYMBOLIC_TYPES:
            raise ValueError(f"symbolic type must be one of {SYMBOLIC_TYPES}")
    elif symbolic_type:
        raise ValueError("only symbolic models have a symbolic type")
    return read_logs(spark, f"{root}/{model}", checkpoints, seeds, symbolic_type)


def load_norm_stats(spark: SparkSession, path: str) -> dict[str, NormStats]:
    """Statistics per key; a missing file raises."""
    text = spark.read.text(path, wholetext=True).head()["value"]
    return {k: NormStats(v["mean"], v["std"], v.get("q01"), v.get("q99"))
            for k, v in json.loads(text)["norm_stats"].items()}


def norm_stats_or_none(spark: SparkSession, path: str) -> dict[str, NormStats] | None:
    from pyspark.errors import AnalysisException

    try:
        return load_norm_stats(spark, path)
    except AnalysisException:
        return None


def union_files(*frames: DataFrame) -> DataFrame:
    """Rows of all files in one table; columns a file lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
