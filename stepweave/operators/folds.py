"""Order-dependent folds, as finite-state scans so that one long episode still runs on many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.vectors import delta_norm
from stepweave.operators import ordered as o

KEYS = ["epis_idx"]
STEP = "step_idx"
FAR = 1_000_000


def _states(count: int, next_state) -> Column:
    return F.array(*[next_state(s).cast("int") for s in range(count)])


def average_merge(df: DataFrame, near: int = 10) -> DataFrame:
    """Sorted distinct steps: one closer than ``near`` to the last kept moves that to their floored mean.

    The state is the distance from a step to the last kept value after it was processed, which is at most
    near / 2, so the moving value needs no sequential pass over the episode. Rows are distinct execution
    steps; the result keeps one row per merged value.
    """
    rows = o.scan(df.where(F.col(STEP) >= F.col("exec_start")), KEYS, STEP, {"_prev": o.lag(F.col(STEP))})
    gap = F.coalesce(F.col(STEP) - F.col("_prev"), F.lit(FAR))
    rows = rows.withColumn("_gap", gap).drop("_prev")

    def after(state):
        reach = F.col("_gap") + state
        return F.when(reach < near, F.floor((reach + 1) / 2)).otherwise(F.lit(0))

    count = near // 2 + 1
    entered = o.finite_scan(rows, KEYS, STEP, count, 0, _states(count, after), "_state")
    reach = F.col("_gap") + F.col("_state")
    kept = F.col(STEP) - F.when(reach < near, F.floor((reach + 1) / 2)).otherwise(F.lit(0))
    valued = o.scan(entered.withColumn("_value", kept.cast("int")).withColumn("_starts", reach >= near), KEYS, STEP,
                    {"_closes": o.lead(F.col("_starts"))})
    done = valued.where(F.coalesce(F.col("_closes"), F.lit(True)))
    return done.withColumn(STEP, F.col("_value")).drop("_gap", "_state", "_value", "_starts", "_closes")


def average_merge_list(items: Column, near: int = 10) -> Column:
    """The same on a short sorted array held in one row."""
    def fold(acc, x):
        top = F.try_element_at(acc, F.lit(-1))
        moved = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.floor((x + top) / 2).cast("int")))
        return F.when(F.size(acc) == 0, F.array(x)).when(x - top < near, moved).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.array().cast("array<int>"), fold)


def local_minima(df: DataFrame, threshold: float = 0.001, min_distance: int = 5) -> DataFrame:
    """Steps where the motion norm is under the threshold and strictly under both neighbours, spaced apart.

    A candidate is kept when it lies ``min_distance`` or more after the last kept one. The state is the
    distance from the last candidate to the last kept one, cut at ``min_distance``.
    """
    moving = df.withColumn("_x", delta_norm(F.col("action"), F.col("state")))
    seen = o.scan(moving, KEYS, STEP, {
        "_left": o.lag(F.struct("_x")), "_right": o.lead(F.struct("_x")),
        "_i": o.running(F.lit(1), inclusive=False)})
    x = F.col("_x")
    dip = (x < threshold) & (x < F.col("_left._x")) & (x < F.col("_right._x"))
    found = o.scan(seen.where(dip).drop("_x", "_left", "_right", "state", "action", "subgoal"), KEYS, STEP,
                   {"_prev": o.lag(F.col("_i"))})
    found = found.withColumn("_gap", F.coalesce(F.col("_i") - F.col("_prev"), F.lit(FAR)))

    def after(state):
        reach = F.col("_gap") + state
        return F.when(reach >= min_distance, F.lit(0)).otherwise(reach)

    entered = o.finite_scan(found, KEYS, STEP, min_distance, 0, _states(min_distance, after), "_state")
    kept = entered.where(F.col("_gap") + F.col("_state") >= min_distance)
    return kept.withColumn(STEP, F.col("_i").cast("int")).drop("_gap", "_state", "_prev", "_i")
