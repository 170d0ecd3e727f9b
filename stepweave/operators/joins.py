"""Join operators: history gather, range semi join, checked lookups, resume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.constants import SUITES
from stepweave.operators import ordered as o
from stepweave.session import with_package

RANGE_WIDTH = 1024
#: Histories leave Python about so many bytes at a time.
HISTORY_BYTES = 4 << 20


def gather_history(samples: DataFrame, features: DataFrame, indices: str, payload: Sequence[str],
                   keys: Sequence[str] = ("epis_idx",), step: str = "step_idx", name: str = "history",
                   shared: Sequence[Column] = ()) -> DataFrame:
    """For each sample the feature rows of the listed steps, in list order, as an array of structs.

    Small integer lists are exploded and joined with one narrow feature row each. The step-0 rows that every
    sample asks for make skewed join keys, which adaptive skew handling splits. A missing row raises.

    Long lists write each feature row once for every sample that asks for it. ``shared``, expressions of the step, then
    names groups of samples whose lists overlap: a feature row is sent once to each group that asks for it.
    """
    if shared:
        return _gather_shared(samples, features, indices, payload, list(keys), step, name, shared)
    wanted = samples.select(*keys, step, F.posexplode(indices).alias("_pos", "_at"))
    source = features.select(*keys, F.col(step).alias("_at"), *payload, F.lit(True).alias("_found"))
    joined = wanted.join(source, [*keys, "_at"], "left")
    found = F.when(F.col("_found"), F.col("_at")).otherwise(
        F.raise_error(F.concat(F.lit("no feature row for step "), F.col("_at").cast("string"))).cast("int"))
    lists = joined.groupBy(*keys, step).agg(F.array_sort(F.collect_list(
        F.struct("_pos", found.alias("at"), *payload))).alias(name))
    return samples.join(lists, [*keys, step])


def _gather_shared(samples: DataFrame, features: DataFrame, indices: str, payload: Sequence[str], keys: Sequence[str],
                   step: str, name: str, shared: Sequence[Column]) -> DataFrame:
    """``gather_history`` by groups: a group's feature rows come ahead of its samples, which pick theirs out of them.

    A task holds the rows of one group at a time, and lists exist only as they are handed on: they are neither exchanged
    nor sorted.
    """
    parts = [*keys, *(f"_group{i}" for i in range(len(shared)))]
    # samples without a list have no history, and those without keys meet none
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, step)], F.size(indices) > 0)
    marked = samples.where(known).withColumns({f"_group{i}": c for i, c in enumerate(shared)})
    asked = marked.select(*parts, F.explode(indices).alias("_at")).distinct()
    source = features.select(*keys, F.col(step).alias("_at"), F.struct(*payload).alias("_row"), F.lit(True).alias("_found"))
    found = F.when(F.col("_found"), F.col("_at")).otherwise(
        F.raise_error(F.concat(F.lit("no feature row for step "), F.col("_at").cast("string"))).cast("int"))
    rows = asked.join(source, [*keys, "_at"], "left").select(
        *parts, F.lit(False).alias("_asks"), found.cast("bigint").alias("_order"), "_row")
    asks = marked.select(*parts, F.lit(True).alias("_asks"), F.col(step).cast("bigint").alias("_order"),
                         F.struct(*[F.col(f"`{c}`") for c in samples.columns]).alias("_sample"))
    both = rows.unionByName(asks, allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in both.schema}
    at = samples.schema[indices].dataType.elementType
    entry = T.StructType([T.StructField("_pos", T.IntegerType()), T.StructField("at", at), *[
        T.StructField(f.name, f.dataType) for f in kinds["_row"]]])
    schema = T.StructType([T.StructField("_sample", kinds["_sample"]), T.StructField(name, T.ArrayType(entry))])
    place = samples.columns.index(indices)
    at_type = pa.int64() if isinstance(at, T.LongType) else pa.int32()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows, asks = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = o._begins(batch, [*parts, "_asks"], before)
            before = batch.select([*parts, "_asks"]).slice(batch.num_rows - 1).to_pylist()[0]
            cuts = np.flatnonzero(new[1:]) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                piece = batch.slice(int(a), int(z - a))
                if new[a] and asks:
                    yield from answered(rows, asks)
                    rows, asks = [], []
                (asks if piece.column("_asks")[0].as_py() else rows).append(piece)
        if asks:
            yield from answered(rows, asks)

    def answered(rows: Sequence[pa.RecordBatch], asks: Sequence[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.concatenate([b.column("_order").to_numpy() for b in rows])
        held = pa.concat_arrays([b.column("_row") for b in rows]).flatten()
        sample = pa.concat_arrays([b.column("_sample") for b in asks])
        lists = pc.struct_field(sample, place)
        sizes, wanted = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
        # samples of one step share what they ask for; a step with several rows gives all of them
        run = np.unique(np.concatenate([b.column("_order").to_numpy() for b in asks]), return_inverse=True)[1]
        owner, pos = np.repeat(run, sizes), np.arange(len(wanted)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((wanted, pos, owner))
        owner, pos, wanted = owner[order], pos[order], wanted[order]
        first, past = np.searchsorted(steps, wanted, "left"), np.searchsorted(steps, wanted, "right")
        row, which = spread(first, past - first)
        pos, length = pos[which], np.bincount(owner[which], minlength=run.max() + 1)
        start = np.cumsum(length) - length
        each = sum(c.nbytes for c in held) / len(steps)
        due = np.cumsum(length[run] * each + sample.nbytes / len(sample)) // HISTORY_BYTES
        cuts = np.flatnonzero(np.diff(due)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(run)]):
            taken, of = spread(start[run[a:z]], length[run[a:z]])
            ends = np.append(0, np.cumsum(length[run[a:z]])).astype(np.int32)
            picked = pa.array(row[taken])
            values = pa.StructArray.from_arrays(
                [pa.array(pos[taken], pa.int32()), pa.array(steps[row[taken]], at_type), *[c.take(picked) for c in held]],
                names=entry.names)
            yield pa.RecordBatch.from_arrays([sample.slice(int(a), int(z - a)), pa.ListArray.from_arrays(ends, values)],
                                             names=["_sample", name])

    def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all ranges ``[first, first + count)`` one after another, and which range each is of."""
        which = np.repeat(np.arange(len(count)), count)
        return np.arange(len(which)) + np.repeat(first - (np.cumsum(count) - count), count), which

    dealt = with_package(both).repartition(*parts).sortWithinPartitions(*parts, "_asks", "_order")
    out = dealt.mapInArrow(gather, schema)
    columns = [*keys, step, *(c for c in samples.columns if c not in (*keys, step))]
    return out.select(*[F.col(f"_sample.`{c}`").alias(c, metadata=samples.schema[c].metadata) for c in columns],
                      F.array_sort(name).alias(name))


def filter_ranges(frames: DataFrame, ranges: DataFrame | None, key: Column, t: Column) -> DataFrame:
    """Frames inside some [start, end) range of their key; without ranges all frames.

    A range is entered once per block of RANGE_WIDTH frames it touches, never once per frame, and the join
    is on (key, block): long recordings and keys with many ranges spread over many tasks.
    """
    if ranges is None:
        return frames
    marked = frames.withColumn("_key", key).withColumn("_t", t).withColumn(
        "_block", F.floor(F.col("_t") / RANGE_WIDTH))
    spread = (ranges.where(F.col("start") < F.col("end"))
              .select(F.col("episode_key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"),
                      F.explode(F.sequence(F.floor(F.col("start") / RANGE_WIDTH),
                                           F.floor((F.col("end") - 1) / RANGE_WIDTH))).alias("_block")))
    f, r = marked.alias("f"), spread.alias("r")
    inside = ((F.col("f._key") == F.col("r._key")) & (F.col("f._block") == F.col("r._block"))
              & (F.col("f._t") >= F.col("r._start")) & (F.col("f._t") < F.col("r._end")))
    return f.join(r, inside, "left_semi").drop("_key", "_t", "_block")


def prompt_from_task(df: DataFrame, tasks: DataFrame, index: str = "task_index", task: str = "task") -> DataFrame:
    """Prompt of the row's task index; a missing column or an unknown index raises."""
    if index not in df.columns:
        raise ValueError(f"column {index} is missing")
    lookup = tasks.select(F.col(index), F.col(task).alias("prompt"))
    missing = F.raise_error(F.concat(F.lit("no task for index "), F.col(index).cast("string"))).cast("string")
    return df.join(lookup, index, "left").withColumn("prompt", F.coalesce(F.col("prompt"), missing))


def pending_episodes(all_episodes: DataFrame, progress: DataFrame, redo: Sequence[str] = ()) -> DataFrame:
    """Episodes without a usable record: errors and tasks to be evaluated again do not count as recorded."""
    done = progress.where((F.col("status") != "error") & ~F.col("task").isin(*redo) if redo
                          else F.col("status") != "error")
    keyed = done.select("task", F.col("episode").cast("string").alias("episode"))
    return all_episodes.withColumn("episode", F.col("episode").cast("string")).join(keyed, ["task", "episode"], "left_anti")


def attach_pos(tokens: DataFrame, pos: DataFrame, views: int = 1, step: str = "step_idx") -> DataFrame:
    """Positional rows ``step * V + view`` of the table for each (step, view, patch) token; a missing row raises."""
    table = pos.select(F.col("t").alias("_t"), "patch", F.col("emb").alias("pos_emb"), F.lit(True).alias("_found"))
    joined = tokens.withColumn("_t", F.col(step) * views + F.col("view")).join(table, ["_t", "patch"], "left")
    missing = F.raise_error(F.concat(F.lit("no position row for "), F.col("_t").cast("string")))
    return joined.withColumn("pos_emb", F.when(F.col("_found"), F.col("pos_emb")).otherwise(
        missing.cast(pos.schema["emb"].dataType))).drop("_t", "_found")


def with_suite(df: DataFrame, task: str = "task") -> DataFrame:
    """Suite of a task, by an inline table of the 16 tasks."""
    table = df.sparkSession.createDataFrame([(t, s) for s, ts in SUITES.items() for t in ts], f"{task} string, suite string")
    return df.join(F.broadcast(table), task, "left")


def except_values(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that the other table lacks."""
    return df.select(column).distinct().join(other.select(column).distinct(), column, "left_anti")
