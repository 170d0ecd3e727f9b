"""Window and sequence operators over episode steps (keys ``epis_idx``, order ``step_idx`` by default)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.constants import HOLD_RULES, LONG_FIRST_ACTION_TASKS
from stepweave.functions.indices import interior
from stepweave.operators import ordered as o

KEYS = ("epis_idx",)
STEP = "step_idx"


def action_chunks(df: DataFrame, horizon: int = 20, gaps: bool = False, keys: Sequence[str] = KEYS, step: str = STEP,
                  action: str = "action", name: str = "actions") -> DataFrame:
    """The actions of steps t..t+H-1; past the end (with ``gaps`` also at missing steps) the last seen repeats."""
    def build(window):
        ahead = window.rangeBetween(0, horizon - 1)
        if gaps:
            return {"_chunk": F.collect_list(F.struct(F.col(step).alias("s"), F.col(action).alias("a"))).over(ahead)}
        return {"_chunk": F.collect_list(action).over(ahead)}

    chunked = o.with_neighbours(df, keys, step, 0, horizon - 1, build)
    c = F.col("_chunk")
    if gaps:
        filled = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.element_at(
            F.filter(c, lambda x: x["s"] <= F.col(step) + i), -1)["a"])
    else:
        filled = F.concat(c, F.array_repeat(F.element_at(c, -1), horizon - F.size(c)))
    return chunked.withColumn(name, filled).drop("_chunk")


def traj_chunks(actions: Column, horizon: int) -> Column:
    """Chunks of a trajectory held as one array: index min(t + i, n - 1)."""
    last = F.size(actions) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.get(actions, F.least(t + i, last))))


def carry_forward(df: DataFrame, value: str, name: str, done: Column | None = None, sentinel: str = "complete",
                  raw_first: bool = False, keys: Sequence[str] = KEYS, step: str = STEP) -> DataFrame:
    """Replace the value where ``done`` (or where the text contains the sentinel) by the last one before.

    Without an earlier value the result is null, or the raw text with ``raw_first``.
    """
    done = F.col(value).contains(sentinel) if done is None else done
    out = o.scan(df, keys, step, {name: o.last(F.when(~done, F.col(value)))})
    return out.withColumn(name, F.coalesce(F.col(name), F.col(value))) if raw_first else out


def transitions(df: DataFrame, subgoal: str = "subgoal", sentinel: str = "complete",
                strided_env: str | None = "PatternLock", stride: int = 32) -> DataFrame:
    """Steps where the carried subgoal changes, then the last step (which may repeat): rows (.., step_idx, kind).

    ``kind`` is 0 for a change and 1 for the closing entry. An environment whose id contains
    ``strided_env`` takes every 32nd execution step and the last step once.
    """
    execution = df.where(F.col(STEP) >= F.col("exec_start"))
    value = F.when(~F.col(subgoal).contains(sentinel), F.col(subgoal))
    seen = o.scan(execution, KEYS, STEP, {"_now": o.last(value), "_before": o.last(value, inclusive=False)})
    change = ~F.col("_now").eqNullSafe(F.col("_before"))
    closing = F.col(STEP) == F.col("n") - 1
    if strided_env is not None:
        strided = F.col("env_id").contains(strided_env)
        on_grid = (F.col(STEP) - F.col("exec_start")) % stride == 0
        change = F.when(strided, on_grid).otherwise(change)
        closing = closing & ~(strided & on_grid)
    kinds = F.array_compact(F.array(F.when(change, F.lit(0)), F.when(closing, F.lit(1))))
    return seen.withColumn("kind", F.explode(kinds)).drop("_now", "_before")


def merge_keyframes(df: DataFrame, flag: Column, threshold: int = 10) -> DataFrame:
    """Flagged execution steps; of a run with neighbour gaps up to the threshold only the last."""
    marked = df.where(flag & (F.col(STEP) >= F.col("exec_start")))
    near = o.scan(marked, KEYS, STEP, {"_next": o.lead(F.col(STEP))})
    return near.where(F.col("_next").isNull() | (F.col("_next") - F.col(STEP) > threshold)).drop("_next")


def median_keyframes(df: DataFrame, flag: Column, dist: int = 8) -> DataFrame:
    """Flagged steps; a run with neighbour gaps up to ``dist`` keeps its upper median."""
    marked = o.scan(df.where(flag), KEYS, STEP, {"_prev": o.lag(F.col(STEP))})
    starts = F.col("_prev").isNull() | (F.col(STEP) - F.col("_prev") > dist)
    runs = o.scan(marked, KEYS, STEP, {"_run": o.last(F.when(starts, F.col(STEP)))}).drop("_prev", o.BLOCK)
    placed = o.scan(runs, [*KEYS, "_run"], STEP, {
        "_pos": o.running(F.lit(1), inclusive=False), "_size": o.total(F.lit(1), "sum")})
    return placed.where(F.col("_pos") == F.floor(F.col("_size") / 2)).drop("_run", "_pos", "_size", o.BLOCK)


def select_frames(points: DataFrame, stride: int = 16, slow_env: str = "StopCube", slow_stride: int = 32) -> DataFrame:
    """Segment sampling of :func:`transitions` rows: rows (.., step_idx, duplicates).

    A segment [s, e) of length L gives m = L div stride even points from s; the frame at e, if selected, is
    repeated max(m - 1, 0) times, except the last step. The last step itself is always selected. Points of
    different segments are distinct, so no distinct is needed.
    """
    kinded = points.withColumn("_at", F.col(STEP) * 2 + F.col("kind"))
    placed = o.scan(kinded, KEYS, "_at", {"_end": o.lead(F.col(STEP)), "_from": o.lag(F.col(STEP))})
    width = F.when(F.col("env_id").contains(slow_env), F.lit(slow_stride)).otherwise(F.lit(stride))

    def count(a, b):
        return F.floor((b - a) / width).cast("int")

    s, e = F.col(STEP), F.col("_end")
    m = count(s, e)
    gap = (e - s) / m.cast("double")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda i: (s + i * gap).cast("int"))
    picked = F.when(e.isNull(), F.array(s)).when(m > 0, inner)
    repeats = F.when((F.col("_step") == s) & (s != F.col("n") - 1),
                     F.greatest(F.coalesce(count(F.col("_from"), s), F.lit(0)) - 1, F.lit(0))).otherwise(F.lit(0))
    return (placed.where(e.isNull() | (m > 0)).withColumn("_step", F.explode(picked))
            .withColumn("duplicates", repeats.cast("int")).withColumn(STEP, F.col("_step"))
            .drop("_at", "_end", "_from", "_step", "kind"))


def duplicate_rows(df: DataFrame, count: str = "duplicates", enabled: bool = True) -> DataFrame:
    """Each row 1 + count times, numbered by ``copy``; a switch turns the copies off."""
    times = F.col(count) if enabled else F.lit(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), times)))


def with_changes(df: DataFrame, value: str, keys: Sequence[str] = KEYS, step: str = STEP) -> DataFrame:
    """``changed`` where the value differs from the row before, and ``history_len`` = changes before the row."""
    before = o.scan(df, keys, step, {"_prev": o.lag(F.struct(value))})
    changed = F.col("_prev").isNull() | ~F.col(value).eqNullSafe(F.col(f"_prev.{value}"))
    return o.scan(before.withColumn("changed", changed).drop("_prev"), keys, step,
                  {"history_len": o.running(F.col("changed").cast("int"), inclusive=False)})


def history(df: DataFrame, value: str, name: str = "history", boxes: str | None = None, keys: Sequence[str] = KEYS,
            step: str = STEP) -> DataFrame:
    """Before each row: earlier values with consecutive repeats removed.

    Boxes of a row join ``<name>_boxes`` only when its value was appended. A null value is kept as ``None``.
    """
    marked = with_changes(df, value, keys, step)
    shown = F.when(F.col("changed"), F.coalesce(F.col(value), F.lit("None")))
    out = o.prefix_list(marked, keys, step, shown, name)
    if boxes is not None:
        out = o.prefix_list(out, keys, step, F.when(F.col("changed"), F.col(boxes)), f"{name}_boxes")
        out = out.withColumn(f"{name}_boxes", F.flatten(f"{name}_boxes"))
    return out.drop("changed", "history_len")


def recent_frames(df: DataFrame, value: str, name: str = "recent", count: int = 8, stride: int = 2,
                  keys: Sequence[str] = KEYS, step: str = STEP) -> DataFrame:
    """Values at offsets 0, -stride, ... (``count`` of them, fewer at the start), oldest first."""
    reach = (count - 1) * stride
    listed = o.with_neighbours(df, keys, step, reach, 0, lambda w: {
        name: F.collect_list(value).over(w.rangeBetween(-reach, 0))})
    size = F.size(name)
    return listed.withColumn(name, F.filter(name, lambda _, i: (size - 1 - i) % stride == 0))


def downsample(df: DataFrame, max_n: int = 20, interval: int = 8) -> DataFrame:
    """Every ``interval``-th frame; when these exceed ``max_n``, every (number div max_n)-th of them.

    With 0-based dense steps the number of multiples of the interval below n is a closed form.
    """
    listed = F.floor((F.col("n") - 1) / interval).cast("int") + 1
    thin = F.when(listed > max_n, F.floor(listed / max_n).cast("int")).otherwise(F.lit(1))
    on_grid = F.col(STEP) % interval == 0
    return df.where(on_grid & (F.floor(F.col(STEP) / interval) % thin == 0))


def query_schedule(df: DataFrame, answer: str, env: str = "env_id", every: int = 48, first_hold: int = 75,
                   keep_period: int | None = None, finished: Sequence[str] = ("is complete", "is finished")) -> DataFrame:
    """``query`` where the model is asked, and ``held``: the answer in force.

    Count 0 always asks; tasks with a long first action not before ``first_hold``; else every ``every``
    counts. With ``keep_period`` the rule is: ask beyond the period, keep the first answer up to it. An
    answer that claims completion is replaced by the previous one.
    """
    count = F.col(STEP)
    if keep_period is not None:
        ask = (count == 0) | (count > keep_period)
    else:
        late = F.col(env).isin(LONG_FIRST_ACTION_TASKS) & (count < first_hold)
        ask = (count == 0) | (~late & (count % every == 0))
    claims = F.lit(False)
    for mark in finished:
        claims = claims | F.col(answer).contains(mark)
    asked = df.withColumn("query", ask)
    return o.scan(asked, KEYS, STEP, {"held": o.last(F.when(F.col("query") & ~claims, F.col(answer)))})


def hold_schedule(df: DataFrame, answer: str, env: str = "env_id",
                  rules: Mapping[str, Sequence[tuple[str, int]]] = HOLD_RULES) -> DataFrame:
    """``query`` and ``held`` where the answer in force decides how long it is held.

    A task's rules are (text, period): an answer that contains the text of a rule, the first that fits, is held while the
    count is not above the period; answers without a rule, and tasks without rules, are asked for again at every count
    above 0. Without an answer so far the model is always asked. Which rule the last answer follows is a state of a few
    values, so an episode is a finite-state scan and needs no pass in sequence.
    """
    most = max([len(r) for r in rules.values()], default=0)
    count = F.col(STEP)

    def by_task(value: Callable[[Sequence[tuple[str, int]]], Column], other: Column) -> Column:
        out = F
        for task, own in rules.items():
            out = out.when(F.col(env) == task, value(own))
        return out.otherwise(other) if rules else other

    def rule_of(own: Sequence[tuple[str, int]]) -> Column:
        out = F
        for i, (mark, _) in enumerate(own):
            out = out.when(F.col(answer).contains(mark), F.lit(i + 1))
        return out.otherwise(F.lit(most + 1))

    # 0: no answer yet; i: the answer in force follows the task's i-th rule; most + 1: it follows none
    given = F.when(F.col(answer).isNull(), F.lit(0)).otherwise(by_task(rule_of, F.lit(most + 1)))

    def asks(state: int) -> Column:
        if state == 0:
            return F.lit(True)
        return count > by_task(lambda own: F.lit(own[state - 1][1] if state <= len(own) else 0), F.lit(0))

    states = range(most + 2)
    marked = df.withColumns({"_given": given, **{f"_asks{s}": asks(s) for s in states}})
    moves = F.array(*[F.when(F.col(f"_asks{s}"), F.col("_given")).otherwise(F.lit(s)) for s in states])
    found = o.finite_scan(marked, KEYS, STEP, most + 2, 0, moves, "_state")
    asked = found.withColumn("query", F.element_at(F.array(*[f"_asks{s}" for s in states]), F.col("_state") + 1))
    asked = asked.drop("_given", "_state", *[f"_asks{s}" for s in states])
    held = o.scan(asked, KEYS, STEP, {"held": o.last(F.when(F.col("query"), F.struct(F.col(answer).alias("x"))))})
    return held.withColumn("held", F.col("held.x"))


def rollout_outcome(df: DataFrame, terminal: Column, flag: str, max_steps: int = 1300) -> DataFrame:
    """One row per episode: the first terminal row's flag, ``timeout`` after max_steps, else ``unknown``.

    ``status`` is what the record keeps: ``error`` for unknown, otherwise whether the flag is success. The
    flag of the earliest terminal row comes from one partial aggregation; no window is needed.
    """
    usable = terminal & (F.col(STEP) < max_steps)
    folded = df.groupBy(*KEYS).agg(
        F.min(F.when(usable, F.col(STEP))).alias("stop_step"), F.count(F.lit(1)).alias("n_steps"),
        F.min_by(F.col(flag), F.when(usable, F.col(STEP))).alias("_flag"))
    outcome = (F.when(F.col("stop_step").isNotNull(), F.col("_flag"))
               .when(F.col("n_steps") > max_steps, F.lit("timeout")).otherwise(F.lit("unknown")))
    status = F.when(outcome == "unknown", F.lit("error")).when(outcome == "success", F.lit("true")).otherwise(F.lit("false"))
    return folded.select(*KEYS, "stop_step", outcome.alias("outcome"), status.alias("status"))


def route_clips(df: DataFrame, query: str = "query", held: str = "held", small: int = 3) -> DataFrame:
    """Frames since the last query as clips: up to ``small`` frames are one image (the last), more a video."""
    asked = F.col(query).cast("int")
    clipped = o.scan(df, KEYS, STEP, {"clip": o.running(asked, inclusive=False)})
    return clipped.groupBy(*KEYS, "clip").agg(
        F.count(F.lit(1)).cast("int").alias("frames"), F.max(STEP).alias("last_step"),
        F.max_by(held, STEP).alias("label")).withColumn(
        "kind", F.when(F.col("frames") <= small, F.lit("image")).otherwise(F.lit("video")))


def step_windows(df: DataFrame, horizon: int = 16) -> DataFrame:
    """Count-based windows of execution steps after the initial group (window 0)."""
    past = F.col(STEP) - F.col("exec_start")
    return df.withColumn("window_id", F.when(past <= 0, F.lit(0)).otherwise(F.ceil(past / horizon)).cast("int"))


def offset_sequence(df: DataFrame, value: str, horizon: int, fps: float, rate: float, keys: Sequence[str] = KEYS,
                    step: str = STEP) -> DataFrame:
    """Values at time offsets k/fps for data recorded at ``rate`` Hz: the nearest row, the later one halfway; clamped to
    the last row with ``is_pad``."""
    offsets = [math.floor(k * rate / fps + 0.5) for k in range(horizon)]
    reach = offsets[-1]

    def build(window):
        return {"_ahead": F.collect_list(value).over(window.rangeBetween(0, reach))}

    listed = o.with_neighbours(df, keys, step, 0, reach, build)
    wanted = F.array(*[F.lit(k) for k in offsets])
    top = F.size("_ahead") - 1
    return (listed.withColumn("values", F.transform(wanted, lambda i: F.get("_ahead", F.least(i, top))))
            .withColumn("is_pad", F.transform(wanted, lambda i: i > top)).drop("_ahead"))


def keyframes(df: DataFrame, minima: DataFrame | None = None, **options) -> DataFrame:
    """Keyframe list per episode by environment rule: rows (.., step_idx, pos), pos counted from 0.

    PatternLock and RouteStick average-merge transitions with motion minima; PickHighlight adds a point in
    the first gap; ids that occur inside ``ButtonUnmaskSwap`` add two points in each of the first two gaps.
    Too few keyframes for a rule leave the list as it is. The last keyframe is dropped.
    """
    from stepweave.operators.folds import average_merge, local_minima

    carried = ["env_id", "n", "exec_start"]
    listed = transitions(df, strided_env=None, **options).select(*KEYS, o.BLOCK, *carried, STEP, "kind")
    merging = F.col("env_id").isin("PatternLock", "RouteStick")
    minima = local_minima(df) if minima is None else minima
    both = (listed.where(merging).drop("kind")
            .unionByName(minima.where(merging).select(*KEYS, o.BLOCK, *carried, STEP)).distinct())
    merged = average_merge(both).withColumn("kind", F.lit(0))
    keys = listed.where(~merging).unionByName(merged.select(*listed.columns))
    placed = o.scan(keys.withColumn("_at", F.col(STEP) * 2 + F.col("kind")), KEYS, "_at", {
        "_i": o.running(F.lit(1), inclusive=False), "_size": o.total(F.lit(1), "sum"),
        "_next": o.lead(F.col(STEP))})
    i, size, nxt = F.col("_i"), F.col("_size"), F.col("_next")
    swap = F.lit("ButtonUnmaskSwap").contains(F.col("env_id"))
    own = F.when(nxt.isNotNull(), F.array(F.col(STEP)))
    added = (F.when((F.col("env_id") == "PickHighlight") & (i == 0) & (size >= 2), interior(F.col(STEP), nxt, 1))
             .when(swap & (i < 2) & (size >= 3), interior(F.col(STEP), nxt, 2)))
    empty = F.array().cast("array<int>")
    points = F.concat(F.coalesce(own, empty), F.coalesce(added, empty))
    spread = placed.select(*KEYS, o.BLOCK, *carried, F.posexplode(points).alias("_j", STEP), "_at")
    spread = spread.withColumn("_at", F.struct(F.col(STEP), F.col("_at"), F.col("_j")))
    return (o.scan(spread, KEYS, [STEP, "_at"], {"pos": o.running(F.lit(1), inclusive=False)})
            .withColumn("pos", F.col("pos").cast("int")).drop("_at", "_j"))
