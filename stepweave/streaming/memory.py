"""Structured Streaming twins of the memory operators: state per episode, output equal to the batch forms."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.indices import even_indices, recurrent_indices
from stepweave.operators.memory import FIRST_SCORE, MIN_SCORE, padded_frames, padded_recurrent, padded_tokens
from stepweave.operators.stats import (WIDENING_BINS, _exploded, fixed_histogram, histogram_quantiles, merge_histograms,
                                       widening_histogram)
from stepweave.session import with_package
from stepweave.streaming.run import run_folds

# Progress of an episode: newest step and first execution step.
PROGRESS = "last int, exec_start int"


def number_frames(rows: Iterator[pd.DataFrame], state: tuple[int, int], keys: dict) -> tuple[tuple[int, int], pd.DataFrame]:
    """All frames of one micro-batch of an episode, in ``seq`` order."""
    batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
    frames, reset = batch["frames"].to_numpy(dtype="int64"), batch["reset"].to_numpy(dtype=bool)
    # frames before each chunk since its last reset; without one, since the state
    total = np.concatenate([[0], np.cumsum(frames)])
    run = np.cumsum(reset)
    opened = np.concatenate([[0], np.flatnonzero(reset)])[run]
    first = total[:-1] - total[opened] + np.where(run > 0, 0, state[0] + 1)
    given = pd.to_numeric(batch["exec_start"]).reset_index(drop=True)
    start = given.where(given > 0, pd.Series(np.where(reset, 0.0, np.nan))).ffill().fillna(state[1]).to_numpy().astype("int64")
    at = np.arange(total[-1]) - np.repeat(total[:-1], frames)
    found = pd.DataFrame({"seq": np.repeat(batch["seq"].to_numpy(), frames), "step_idx": np.repeat(first, frames) + at,
                          "exec_start": np.repeat(start, frames), "newest": at == np.repeat(frames - 1, frames)})
    if len(frames):
        state = (int(first[-1] + frames[-1]) - 1, int(start[-1]))
    return state, found.assign(**keys)


def batch_progress(steps: DataFrame, key: str = "epis_idx") -> DataFrame:
    """Progress (key, last, exec_start) of recorded episodes: the state from which ``episode_memory`` goes on."""
    return steps.groupBy(key).agg(F.max("step_idx").cast("int").alias("last"), F.max("exec_start").cast("int").alias("exec_start"))


def episode_memory(stream: DataFrame, key: str = "epis_idx", initial: DataFrame | None = None,
                   idle_ms: int | None = None) -> DataFrame:
    """Step numbers of appended frames: one row per frame (key, seq, step_idx, exec_start, newest).

    Input rows are chunks (key, seq, frames, exec_start, reset) in order of ``seq``. ``exec_start`` changes
    only when given and positive. ``newest`` marks the last frame of a chunk. The state is two integers per
    episode, so its size does not depend on the episode's length.

    A stream may take over recorded episodes: ``initial`` (see ``batch_progress``) is where they stand. With ``idle_ms`` an
    episode without frames for so long is forgotten, and its next frame is a new episode's first.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    seq = stream.schema["seq"].dataType.simpleString()
    kind = stream.schema[key].dataType.simpleString()

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.progress = handle.getValueState("progress", PROGRESS, *([] if idle_ms is None else [idle_ms]))

        def handleInitialState(self, ident, rows, timerValues) -> None:
            self.progress.update((int(rows["last"].iloc[0]), int(rows["exec_start"].iloc[0])))

        def handleInputRows(self, ident, rows, timerValues):
            state = tuple(self.progress.get()) if self.progress.exists() else (-1, 0)
            state, found = number_frames(rows, state, {key: ident[0]})
            self.progress.update((int(state[0]), int(state[1])))
            yield found[[key, "seq", "step_idx", "exec_start", "newest"]]

        def close(self) -> None:
            pass

    schema = f"`{key}` {kind}, seq {seq}, step_idx int, exec_start int, newest boolean"
    return with_package(stream).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Memory(), outputStructType=schema, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime", initialState=None if initial is None else initial.groupBy(key))


def online_selection(stream: DataFrame, mode: str = "frames", key: str = "epis_idx", budget: int = 32, horizon: int = 16,
                     max_steps: int = 64, max_video: int = 40, keep: int | None = None) -> DataFrame:
    """After each appended chunk, the step indices that memory uses at the newest step.

    The indices are column expressions of the newest step, so only the numbering keeps state. In mode ``tokens`` the input
    are frames as for ``running_top_tokens`` and the result its best ``budget`` tokens after each micro-batch.
    """
    if mode == "tokens":
        return running_top_tokens(stream, key=key, budget=budget, **({"keep": keep} if keep else {}))
    newest = episode_memory(stream, key).where("newest")
    if mode == "frames":
        chosen = even_indices(F.col("step_idx"), budget)
    elif mode == "recurrent":
        # a step of the demonstration is its own start, so that no later step is asked for
        start = F.least("exec_start", "step_idx")
        chosen = recurrent_indices(F.col("step_idx"), start, horizon, max_steps, max_video)
    else:
        raise ValueError(f"unknown mode {mode}")
    return newest.withColumn("indices", chosen)


def even_steps(t: int, budget: int) -> list[int]:
    """The steps of frame memory at step ``t``, as ``even_indices`` has them."""
    if t < budget:
        return list(range(t + 1))
    return [*(int(i * (t / (budget - 1))) for i in range(budget - 1)), t]


def recurrent_steps(t: int, start: int, horizon: int, max_steps: int, max_video: int) -> list[int]:
    """The steps of recurrent memory at step ``t``, as ``recurrent_indices`` has them."""
    execution = [t] if t - start < horizon else list(range((t - start) % horizon + start, t + 1, horizon))
    if start <= 2 * horizon:
        video = list(range(0, start, max(horizon // 2, 1)))
    elif start <= max_video * horizon:
        video = list(range(0, start, horizon))
    else:
        video = [*(int(i * ((start - 1) / (max_video - 1))) for i in range(max_video - 1)), start - 1]
    return [*video, *execution][-max_steps:]


#: Feature rows of ``BLOCK`` consecutive steps are one entry of the state; ``HELD_BLOCKS`` of them are kept at hand.
BLOCK, HELD_BLOCKS, EMIT_ROWS = 32, 8, 64
VECTORS = "steps array<int>, image array<array<double>>, pos array<array<double>>, state array<array<double>>"


class _Features:
    """Feature rows (image, pos, state) by step: those of this append, and blocks of a map state."""

    def __init__(self, blocks) -> None:
        self.blocks, self.fresh, self.held = blocks, {}, OrderedDict()

    def block(self, number: int) -> dict[int, tuple]:
        if number not in self.held:
            found = self.blocks.getValue((number,)) if self.blocks.containsKey((number,)) else ([], [], [], [])
            self.held[number] = {s: tuple(np.asarray(x, dtype="float64") for x in row) for s, *row in zip(*found)}
            if len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]

    def add(self, step: int, row: tuple) -> None:
        if step in self.block(step // BLOCK):
            raise ValueError(f"step {step} was added twice")
        self.fresh[step] = row

    def at(self, step: int) -> tuple:
        return self.fresh[step] if step in self.fresh else self.block(step // BLOCK)[step]

    def settle(self, used: set[int] | None = None) -> None:
        """Put the append into the state; with ``used``, forget the rows of all other steps."""
        new = {}
        for step in self.fresh:
            if used is None or step in used:
                new.setdefault(step // BLOCK, []).append(step)
        known = set() if used is None else {n for (n,) in list(self.blocks.keys())}
        for number in sorted(known | set(new)):
            before = self.block(number)
            rows = {s: row for s, row in before.items() if used is None or s in used}
            if number not in new and len(rows) == len(before):
                continue
            rows |= {s: self.fresh[s] for s in new.get(number, [])}
            if rows:
                self.blocks.updateValue((number,), (list(rows), *[[row[k].tolist() for row in rows.values()] for k in range(3)]))
            else:
                self.blocks.removeKey((number,))


def online_memory(stream: DataFrame, mode: str = "frames", key: str = "epis_idx", budget: int = 512, per_image: int = 16,
                  horizon: int = 16, max_steps: int = 64, max_video: int = 40, keep: int = 2048, stride: int = 8) -> DataFrame:
    """The contents of memory after every appended frame: the arrays that ``assemble_frames``, ``assemble_recurrent`` or
    ``assemble_tokens`` give for the same step.

    Input rows are features (key, step_idx, state, image_emb_*, pos_emb_*), in mode ``recurrent`` with ``exec_start`` and in
    mode ``tokens`` with ``pixels`` (flat, 8 x 8). The state maps blocks of steps to their feature rows; in mode ``tokens`` it
    holds the kept tokens and the rows of the steps they come from, and forgets the others.

    Vectors go to and from the Python workers flat: a worker of a partition without rows gets an empty batch, and pyarrow
    crashes on an empty batch with nested arrays. Results leave in pieces of ``EMIT_ROWS``; beside these a worker holds the
    rows that one append brings to an episode and a few blocks, never an episode.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    side = int(per_image ** 0.5) if mode == "frames" else 8
    cells = side * side
    payload = [f"image_emb_{side}x{side}", f"pos_emb_{side}x{side}", "state"]
    kind = stream.schema[key].dataType.simpleString()
    extra = {"frames": [], "recurrent": ["exec_start"], "tokens": ["pixels"]}[mode]
    read = stream.select(key, "step_idx", *extra, *[F.flatten(F.col(c).cast("array<array<double>>")).alias(name) for c, name in
                                                    zip(payload, ("image", "pos"))],
                         F.col("state").cast("array<double>").alias("state"))
    frames_max = budget // per_image

    class Contents(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.blocks = handle.getMapState("blocks", "number int", VECTORS)
            self.scored = handle.getValueState("scored", "pixels array<double>")
            self.tokens = handle.getListState("tokens", "score double, step int, view int, patch int")

        def handleInputRows(self, ident, rows, timerValues):
            arrived = sorted(((int(row.step_idx), row) for batch in rows for row in batch.itertuples(index=False)), key=lambda x: x[0])
            features = _Features(self.blocks)
            kept = np.zeros((0, 4))
            previous = None
            if mode == "tokens":
                known = [tuple(t) for t in self.tokens.get()] if self.tokens.exists() else []
                kept = np.array(known, dtype="float64").reshape(-1, 4)
                previous = np.asarray(self.scored.get()[0]) if self.scored.exists() else None
            found = []

            def given() -> pd.DataFrame:
                return pd.DataFrame({key: [ident[0]] * len(found), **{name: [x[i] for x in found] for i, name in enumerate(
                    ("step_idx", "_at", "_image", "_pos", "_state"))}})

            for t, row in arrived:
                features.add(t, tuple(np.asarray(x, dtype="float64") for x in (row.image, row.pos, row.state)))
                if mode == "tokens":
                    kept, previous = merge_tokens(kept, np.array([t]), np.stack([row.pixels]).astype("float64"), previous, stride, keep)
                    best = kept[-budget:]
                    picked = sorted((int(s), int(w), int(p)) for s, w, p in best[:, 1:].tolist())
                    steps = [s for s, _, _ in picked]
                    parts = [[features.at(s)[k].reshape(cells, -1)[p] for s, _, p in picked] for k in (0, 1)]
                else:
                    steps = even_steps(t, frames_max) if mode == "frames" else recurrent_steps(
                        t, min(int(row.exec_start), t), horizon, max_steps, max_video)
                    parts = [[features.at(s)[k] for s in steps] for k in (0, 1)]
                parts.append([features.at(s)[2] for s in steps])
                found.append((t, np.array(steps, dtype="int32"), *[np.concatenate(p) if p else np.zeros(0) for p in parts]))
                if len(found) == EMIT_ROWS:
                    yield given()
                    found = []
            if mode == "tokens":
                if previous is not None:
                    self.scored.update((previous.tolist(),))
                if len(kept):
                    self.tokens.put([(float(a), int(b), int(c), int(d)) for a, b, c, d in kept.tolist()])
            features.settle({int(s) for s in kept[:, 1]} if mode == "tokens" else None)
            if found:
                yield given()

        def close(self) -> None:
            pass

    out = with_package(read).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Contents(), outputMode="Append", timeMode="None",
        outputStructType=f"`{key}` {kind}, step_idx int, _at array<int>, _image array<double>, _pos array<double>, _state array<double>")
    n = F.size("_at")

    def cut(values: str, i: Column, parts: Column) -> Column:
        """Part ``i`` of the equal ``parts`` of an array."""
        width = (F.size(values) / parts).cast("int")
        return F.slice(values, i * width + 1, width)

    def grid(values: str, i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda p: cut(values, i * cells + p, n * cells))

    vectors = ["_at", "_image", "_pos", "_state"]
    if mode == "tokens":
        out = out.withColumn("_m", F.transform("_at", lambda s, i: F.struct(
            i.alias("_pos"), *[cut(f"_{name}", i, n).alias(name) for name in ("image", "pos", "state")]))).drop(*vectors)
        first = F.get("_m", F.lit(0))
        widths = F.struct(*[F.size(first[c]).alias(c) for c in ("image", "pos", "state")])
        return padded_tokens(out, budget, widths)
    out = out.withColumn("history", F.transform("_at", lambda s, i: F.struct(
        i.alias("_pos"), s.alias("at"), grid("_image", i).alias(payload[0]), grid("_pos", i).alias(payload[1]),
        cut("_state", i, n).alias("state")))).drop(*vectors)
    return padded_frames(out, payload, per_image, 1, frames_max) if mode == "frames" else padded_recurrent(out, payload, max_steps)


def running_stats(stream: DataFrame, column: str) -> DataFrame:
    """Moments per dimension of all vectors so far; use output mode ``complete`` (one row per dimension)."""
    return _exploded(stream, column).groupBy("dim").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("mean_sq"),
        F.min("x").alias("min"), F.max("x").alias("max"))


def running_histogram(stream: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per (dim, bin) on fixed edges so far, outer bins included; output mode ``complete``."""
    return fixed_histogram(stream, column, lo, hi, bins)


def running_quantiles(stream: DataFrame, column: str, folder: str, bins: int = WIDENING_BINS) -> DataFrame:
    """Per dimension the quantiles of all vectors after each micro-batch (``as_of``), from a histogram that widens with the
    range. A micro-batch is counted by one aggregation, its state of a few thousand rows is merged with the one before."""
    states = run_folds(stream, folder, lambda batch, before: merge_histograms(
        *([] if before is None else [before]), widening_histogram(batch, column, bins), bins=bins))
    return each_quantiles(states)


def each_quantiles(states: DataFrame) -> DataFrame:
    """Quantiles of every version of a state."""
    keyed = states.withColumn("dim", F.struct("as_of", "dim"))
    return histogram_quantiles(keyed).select("dim.as_of", "dim.dim", "count", "q01", "q99")


def merge_tokens(kept: np.ndarray, steps: np.ndarray, pixels: np.ndarray, previous: np.ndarray | None, stride: int,
                 keep: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Kept tokens (score, step, view, patch) with those of new frames, and the frame that the next is scored against.

    ``pixels`` holds one row per frame, in order of step. Scored frames are compared with the scored frame before, all at
    once; of all tokens the greatest remain, as many as ``keep`` or as frame 0 has.
    """
    scored = (steps == 0) | ((steps + 1) % stride == 0)
    steps, pixels = steps[scored], pixels[scored]
    if not len(steps):
        return kept, previous
    base = pixels[:1] if previous is None else previous[None]
    score = np.abs(np.diff(np.vstack([base, pixels]), axis=0))
    score[steps == 0] = FIRST_SCORE
    frame, patch = np.nonzero(score >= MIN_SCORE)
    new = np.stack([score[frame, patch], steps[frame], np.zeros(len(frame)), patch], axis=1)
    merged = np.vstack([kept, new])
    most = max(keep, int((merged[:, 1] == 0).sum()))
    order = np.lexsort(merged.T[::-1])[-most:]
    return merged[order], pixels[-1]


def running_top_tokens(stream: DataFrame, keep: int = 2048, stride: int = 8, key: str = "epis_idx",
                       budget: int | None = None) -> DataFrame:
    """Kept tokens of each episode after each micro-batch: (key, as_of, step_idx, view, patch, score).

    With ``budget`` only the greatest so many are given out; all kept ones stay in the state.

    Input rows are frames (key, step_idx, pixels) of one value per patch. The state is the last scored frame
    and a heap of at most ``keep`` tokens (frame 0 alone may exceed it).
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kind = stream.schema[key].dataType.simpleString()

    class Heap(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.scored = handle.getValueState("scored", "pixels array<double>")
            self.tokens = handle.getListState("tokens", "score double, step int, view int, patch int")

        def handleInputRows(self, ident, rows, timerValues):
            batch = pd.concat(list(rows), ignore_index=True).sort_values("step_idx", kind="stable")
            held = [tuple(t) for t in self.tokens.get()] if self.tokens.exists() else []
            previous = np.asarray(self.scored.get()[0]) if self.scored.exists() else None
            kept, previous = merge_tokens(np.array(held, dtype="float64").reshape(-1, 4), batch["step_idx"].to_numpy(),
                                          np.stack(batch["pixels"].to_numpy()).astype("float64"), previous, stride, keep)
            if previous is not None:
                self.scored.update((previous.tolist(),))
            if len(kept):
                self.tokens.put([(float(a), int(b), int(c), int(d)) for a, b, c, d in kept.tolist()])
            shown = kept if budget is None else kept[-budget:]
            found = pd.DataFrame(shown, columns=["score", "step_idx", "view", "patch"]).astype(
                {"step_idx": "int32", "view": "int32", "patch": "int32"})
            yield found.assign(**{key: ident[0], "as_of": int(batch["step_idx"].iloc[-1])})[
                [key, "as_of", "step_idx", "view", "patch", "score"]]

        def close(self) -> None:
            pass

    schema = f"`{key}` {kind}, as_of int, step_idx int, view int, patch int, score double"
    return with_package(stream).groupBy(key).transformWithStateInPandas(
        statefulProcessor=Heap(), outputStructType=schema, outputMode="Append", timeMode="None")


def expand_chunks(df: DataFrame, horizon: int = 16, actions: str = "actions", step: str = "step_idx") -> DataFrame:
    """The first ``horizon`` actions of each inference, one per step; stateless, for batch and stream alike."""
    rest = [c for c in df.columns if c not in (actions, step)]
    spread = df.select(*rest, F.col(step).alias("_t0"), F.posexplode(F.slice(actions, 1, horizon)).alias("_pos", "action"))
    return spread.withColumn(step, (F.col("_t0") + F.col("_pos")).cast("int")).drop("_t0", "_pos")
