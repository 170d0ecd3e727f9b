"""Composite jobs: sample building, chat sets, statistics, trajectories, examples, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import images, rng, text, vectors
from stepweave.operators import joins, memory, reports, sampling, shape, stats, windows
from stepweave.operators import ordered as o
from stepweave.session import cut_lineage
from stepweave.sources import store

KEYS = ["epis_idx"]


# Samples

def episode_summary(steps: DataFrame, extra: Sequence = ()) -> DataFrame:
    """Per episode: timesteps, first execution step (an all-demo episode raises), then ``extra`` aggregates."""
    first = F.min(F.when(~F.col("is_demo"), F.col("step_idx")))
    return steps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("timesteps"), first.alias("_first"), *extra).withColumn(
        "exec_start", F.coalesce("_first", F.raise_error(F.lit("episode has only demo steps")).cast("int"))).drop("_first")


def with_kept_tokens(summary: DataFrame, kept: DataFrame) -> DataFrame:
    """The summary with ``kept_tokens``, the number of kept tokens of each episode."""
    counts = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kept_tokens"))
    return summary.join(counts, KEYS, "left").withColumn("kept_tokens", F.coalesce("kept_tokens", F.lit(0)))


def exec_start(steps: DataFrame) -> DataFrame:
    """First execution step on every row of its episode."""
    found = o.scan(steps.drop("exec_start"), KEYS, "step_idx", {
        "exec_start": o.total(F.when(~F.col("is_demo"), F.col("step_idx")), "min")})
    return found.withColumn("exec_start", F.coalesce(
        "exec_start", F.raise_error(F.lit("episode has only demo steps")).cast("int")))


def number_samples(steps: DataFrame, file: str | None = None, episode: str = "epis_idx") -> DataFrame:
    """Consecutive numbers: ``epis_number`` over (file, episode), ``total_id`` over rows, ``sample_id`` over
    execution rows (null on demo rows).

    Only one row per episode is numbered globally; buckets of episodes are numbered in parallel and
    shifted by broadcast offsets. Rows then add their own step.
    """
    group = [file, episode] if file else [episode]
    sizes = steps.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(~F.col("is_demo")).alias("_exec"),
                                      F.min(F.when(~F.col("is_demo"), F.col("step_idx"))).alias("_start"))
    # One row per episode, read three times below: written once instead of recomputed from the steps.
    sizes = cut_lineage(sizes)
    bucket, order = o.quantile_bucket(sizes, group), group
    numbered = o.number_all(sizes, bucket, order, {
        "epis_number": F.lit(1), "_total0": F.col("_rows"), "_sample0": F.col("_exec")})
    offsets = numbered.select(*group, "epis_number", "_total0", "_sample0", "_start")
    joined = steps.join(offsets, group)
    sample_id = F.when(~F.col("is_demo"), F.col("_sample0") + F.col("step_idx") - F.col("_start"))
    return (joined.withColumn("total_id", F.col("_total0") + F.col("step_idx")).withColumn("sample_id", sample_id)
            .drop("_total0", "_sample0", "_start"))


def build_samples(steps: DataFrame, horizon: int = 20, subgoals: Sequence[str] = ("subgoal",)) -> DataFrame:
    """Execution samples with action chunks, carried subgoals and ids, ready for the sample sink.

    The chunk and carry windows share one exchange by episode; numbering joins one row per episode.
    """
    out = windows.action_chunks(steps, horizon)
    for name in subgoals:
        out = windows.carry_forward(out, name, name, done=F.col("completed"))
        out = out.withColumn(name, F.lower(name))
    return shape.execution_only(number_samples(out))


def build_memory(frames: DataFrame, stride: int = 8, keep: int = 2048, encoder=memory.identity_encoder,
                 pos_dim: int = 768) -> tuple[DataFrame, DataFrame]:
    """Step features and kept tokens of the episodes."""
    return (memory.build_features(frames, encoder, pos_dim),
            memory.top_tokens(memory.token_scores(frames, stride), keep))


def build_dataset(path: str, steps: DataFrame, frames: DataFrame | None = None, horizon: int = 20,
                  subgoals: Sequence[str] = ("subgoal",), stride: int = 8, keep: int = 2048,
                  encoder=memory.identity_encoder, pos_dim: int = 768, rows_per_bucket: int = store.ROWS_PER_BUCKET) -> store.Store:
    """Samples, step features and kept-token lists of all episodes, committed together as one version of a store.

    ``steps`` are numbered and cut into samples; ``frames`` (the steps with ``pixels``; by default ``steps`` itself) give
    features and kept tokens. Counts are observed while the tables are written, a repeated key stops the commit.
    """
    features, kept = build_memory(steps if frames is None else frames, stride, keep, encoder, pos_dim)
    return store.build(path, build_samples(steps, horizon, subgoals), features, memory.kept_lists(kept), rows_per_bucket)


# Chat records

def _carried_texts(rows: DataFrame, columns: Sequence[str], sentinel: str) -> DataFrame:
    for c in columns:
        rows = windows.carry_forward(rows, c, c, sentinel=sentinel)
    return rows


def chat_selection(steps: DataFrame, sentinel: str = "complete", stride: int = 16, slow_stride: int = 32,
                   subgoal: str = "subgoal") -> DataFrame:
    """Selected steps with duplicate counts and the texts of those steps."""
    found = windows.transitions(steps, subgoal, sentinel)
    picked = windows.select_frames(found, stride, slow_stride=slow_stride)
    chosen = picked.select(*KEYS, "step_idx", "duplicates")
    return steps.join(chosen, [*KEYS, "step_idx"])


def build_chat_single(steps: DataFrame, goal: str = "goal", simple: str = "subgoal", grounded: str = "grounded",
                      sentinel: str = "complete", duplicate: bool = True, noise_seed: int | None = 0,
                      stride: int = 16, slow_stride: int = 32) -> DataFrame:
    """Single-image chat records, two rows (simple, grounded) per selected step and copy."""
    lowered = steps.withColumns({simple: F.lower(simple), grounded: F.lower(grounded)})
    chosen = _carried_texts(chat_selection(lowered, sentinel, stride, slow_stride, simple), [simple, grounded], sentinel)
    shown = F.coalesce(F.col(grounded), F.lit("None"))
    chosen = chosen.withColumns({"_boxes": text.points(shown), "_masked": text.mask_points(shown)})
    rows = windows.history(chosen, simple, "_simple_history")
    rows = windows.history(rows, "_masked", "_grounded_history", boxes="_boxes")
    has_video = F.col("exec_start") > 0
    boxes = F.concat("_grounded_history_boxes", "_boxes")
    if noise_seed is not None:
        rows = rows.withColumn("_key", F.concat_ws(":", "epis_idx", "step_idx"))
        boxes = text.jitter_boxes(boxes, noise_seed, F.col("_key"))
    # below the copies and the records, so that the boxes of a step are drawn once
    rows = rows.withColumn("_shown_boxes", boxes)
    prefix = F.concat(F.col("env_id"), F.lit("_ep"), F.col("epis_idx").cast("string"))
    video = F.when(has_video, F.array(F.concat(prefix, F.lit("_video.mp4"))))
    goal_text = F.lower(F.col(goal))

    def record(kind, history, answer, objects):
        messages = F.array(text.message("system", F.lit(text.SYSTEM_TEXTS[kind])),
                           text.message("user", text.single_user_text(goal_text, history, has_video, kind == "grounded")),
                           text.message("assistant", answer))
        return F.struct(F.lit(kind).alias("kind"), messages.alias("messages"), objects.alias("objects"))

    no_objects = F.lit(None).cast("struct<ref:array<string>,bbox:array<array<int>>>")
    objects = F.struct(F.array().cast("array<string>").alias("ref"), F.col("_shown_boxes").alias("bbox"))
    records = F.array(record("simple", F.col("_simple_history"), F.col(simple), no_objects),
                      record("grounded", F.col("_grounded_history"), F.col("_masked"), objects))
    out = windows.duplicate_rows(rows, enabled=duplicate).withColumn("_r", F.explode(records))
    return out.select(*KEYS, "step_idx", "copy", "_r.kind", "_r.messages", "_r.objects",
                      F.array(F.concat(prefix, F.lit("_step"), F.col("step_idx").cast("string"), F.lit(".png"))).alias("images"),
                      video.alias("videos"))


def match_keyframes(keys: DataFrame) -> DataFrame:
    """Keyframes that become candidates: (.., group, position, frame_step).

    Every second execution step is a frame; group 0 is the first frame, later groups hold eight. A keyframe
    matches the frames less than two steps away, which lie in at most two adjacent groups a <= b. It is
    taken in the first of them after the group of the keyframe before; if there is none, it stays at the
    head of the list and blocks all later ones. So the state is: before was taken in its a, in its b, or
    blocked.
    """
    from stepweave.operators.folds import _states

    e, k, n = F.col("exec_start"), F.col("step_idx"), F.col("n")
    frames = F.floor((n - e + 1) / 2)
    offset = k - e
    f1 = F.floor(offset / 2)
    f2 = F.when((offset % 2 == 1) & (f1 + 1 < frames), f1 + 1).otherwise(f1)
    rows = keys.withColumns({"_f1": f1.cast("int"), "_f2": f2.cast("int")})
    rows = rows.withColumns({"_a": F.ceil(F.col("_f1") / 8).cast("int"), "_b": F.ceil(F.col("_f2") / 8).cast("int")})
    rows = o.scan(rows, KEYS, "pos", {"_before": o.lag(F.struct("_a", "_b"))})
    a, b = F.col("_a"), F.col("_b")

    def taken(state):
        if state == 2:
            return F.lit(2)
        free = F.coalesce(F.col("_before._a") if state == 0 else F.col("_before._b"), F.lit(-1))
        return F.when(free < a, F.lit(0)).when(free < b, F.lit(1)).otherwise(F.lit(2))

    narrow = rows.withColumns({f"_m{s}": taken(s) for s in range(3)}).drop("_before")
    entered = o.finite_scan(narrow, KEYS, "pos", 3, 0, F.array("_m0", "_m1", "_m2"), "_state")
    result = F.element_at(F.array("_m0", "_m1", "_m2"), F.col("_state") + 1)
    hit = entered.withColumn("_hit", result).where(F.col("_hit") < 2)
    frame = F.when(F.col("_hit") == 0, F.col("_f1")).otherwise(F.col("_f2"))
    group = F.when(F.col("_hit") == 0, a).otherwise(b)
    position = F.when(group == 0, F.lit(1)).otherwise(frame - (group - 1) * 8)
    return hit.select(*KEYS, o.BLOCK, group.alias("group"), position.cast("int").alias("position"),
                      (e + frame * 2).cast("int").alias("frame_step"))


def keyframe_samples(steps: DataFrame, keys: DataFrame, texts: Sequence[str] = ("subgoal",),
                     sentinel: str = "complete") -> DataFrame:
    """One row per emitted sample: group, emission step, execution frames, candidate, memory frames, texts."""
    execution = steps.where((F.col("step_idx") >= F.col("exec_start"))
                            & ((F.col("step_idx") - F.col("exec_start")) % 2 == 0))
    carried = _carried_texts(execution, texts, sentinel)
    frame = F.floor((F.col("step_idx") - F.col("exec_start")) / 2)
    grouped = carried.withColumn("group", F.ceil(frame / 8).cast("int"))
    block = [F.min(o.BLOCK).alias(o.BLOCK)] if o.is_split(carried) else []
    samples = grouped.groupBy(*KEYS, "group").agg(
        F.array_sort(F.collect_list("step_idx")).alias("execution"), F.max("step_idx").alias("step_idx"),
        *[F.max_by(c, "step_idx").alias(c) for c in texts],
        *[F.first(c).alias(c) for c in ("env_id", "exec_start", *(["goal"] if "goal" in steps.columns else []))], *block)
    matched = match_keyframes(keys).select(*KEYS, "group", "position", "frame_step")
    joined = samples.join(matched, [*KEYS, "group"], "left")
    if not block:
        joined = joined.withColumn(o.BLOCK, F.lit(None).cast("int").alias(o.BLOCK, metadata=o.WHOLE))
    return o.prefix_list(joined, KEYS, "group", F.col("frame_step"), "memory").withColumnRenamed("position", "candidate")


def build_chat_keyframes(steps: DataFrame, keys: DataFrame, goal: str = "goal", simple: str = "subgoal",
                         grounded: str = "grounded", sentinel: str = "complete", noise_seed: int | None = 0) -> DataFrame:
    """Keyframe chat records, two rows (simple, grounded) per emitted sample."""
    lowered = steps.withColumns({simple: F.lower(simple), grounded: F.lower(grounded), "goal": F.lower(F.col(goal))})
    rows = keyframe_samples(lowered, keys, [simple, grounded], sentinel)
    has_video = F.col("exec_start") > 0
    user = text.keyframe_user_text(F.col("goal"), F.size("memory"), F.size("execution"), has_video)
    shown = F.coalesce(F.col(grounded), F.lit("None"))
    boxes = text.points(shown)
    if noise_seed is not None:
        boxes = text.jitter_boxes(boxes, noise_seed, F.concat_ws(":", "epis_idx", "step_idx"))
    prefix = F.concat(F.col("env_id"), F.lit("_ep"), F.col("epis_idx").cast("string"))
    shown_images = F.transform(F.concat("memory", "execution"), lambda s: F.concat(prefix, F.lit("_step"), s.cast("string"), F.lit(".png")))

    def record(kind, answer, objects):
        messages = F.array(text.message("system", F.lit(text.SYSTEM_TEXTS["keyframe"])), text.message("user", user),
                           text.message("assistant", text.keyframe_answer(answer, F.col("candidate"))))
        return F.struct(F.lit(kind).alias("kind"), messages.alias("messages"), objects.alias("objects"))

    no_objects = F.lit(None).cast("struct<ref:array<string>,bbox:array<array<int>>>")
    objects = F.struct(F.array().cast("array<string>").alias("ref"), boxes.alias("bbox"))
    records = F.array(record("simple", F.col(simple), no_objects), record("grounded", text.mask_points(shown), objects))
    return rows.withColumn("_r", F.explode(records)).select(
        *KEYS, "group", "step_idx", "candidate", "_r.kind", "_r.messages", "_r.objects", shown_images.alias("images"),
        F.when(has_video, F.array(F.concat(prefix, F.lit("_video.mp4")))).alias("videos"))


# Statistics

DELTA_MASK = vectors.bool_mask(7, -1)


def compute_norm_stats(samples: DataFrame, structure: dict | None = None, profile: str = "history_arm",
                       mask: Sequence[bool] = tuple(DELTA_MASK), columns: Sequence[str] = ("state", "actions"),
                       ) -> dict[str, stats.NormStats]:
    """Statistics of state and delta actions over all samples: one pass for moments and ranges, one for quantiles.

    ``structure`` repacks the samples, ``profile`` then adapts them as for training.
    """
    data = shape.repack(samples, structure) if structure else samples
    data = shape.adapt_inputs(data, profile) if structure else data
    data = data.withColumn("actions", vectors.shift_actions(F.col("actions"), F.col("state"), mask, -1))
    data = shape.drop_strings(data.select(*columns))
    return stats.collect_all_stats(data, list(columns))


# Trajectories

def trajectory_frames(frames: DataFrame, ranges: DataFrame | None = None, horizon: int = 16, seed: int = 0,
                      epoch: int = 0, action_space: str = "joint_position", images: Sequence[str] = ()) -> DataFrame:
    """Training frames of successful trajectories: picked instruction, picked image, action chunk, range filter.

    Chunks need the frames after them, so the filter comes after the chunk window. The draws are per trajectory and epoch;
    one of the columns ``images`` becomes ``image``. ``trajectory_batches`` shuffles the result into batches.
    """
    ok = shape.success_only(frames)
    acted = ok.withColumn("action", F.concat(action_space, "gripper_position"))
    chunked = windows.action_chunks(acted, horizon, keys=["traj"], step="t")
    key = F.concat_ws("--", "recording_folderpath", "file_path")
    kept = joins.filter_ranges(chunked, ranges, key, F.col("t"))
    index = rng.below(3, f"{seed}.{epoch}", F.col("recording_folderpath"), F.col("file_path"))
    if images:
        view = rng.below(len(images), f"{seed}.{epoch}.image", F.col("recording_folderpath"), F.col("file_path"))
        kept = kept.withColumn("image", F.element_at(F.array(*images), view + 1))
    return kept.withColumn("prompt", F.element_at("instructions", index + 1)).withColumn(
        "step_id", text.frame_key(F.col("recording_folderpath"), F.col("file_path"), F.col("t")))


def trajectory_batches(frames: DataFrame, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """The frames of an epoch with ``rank``, ``batch`` and ``slot``; the incomplete last batch is dropped.

    Frames are numbered by (recording, file, frame) in buckets and ranked by a keyed permutation of the numbers, so the
    epoch is neither sorted nor shuffled as a whole.
    """
    order = ["recording_folderpath", "file_path", "t"]
    frames = cut_lineage(frames)
    numbered = o.number_all(frames, o.quantile_bucket(frames, order), order, {"_number": F.lit(1)})
    return sampling.epoch_batches(numbered, "_number", frames.count(), size, seed, epoch).drop("_number")


# Training examples

#: The samples' columns as the adapter reads them, next to the memory columns and the keys.
SAMPLE_STRUCTURE = {"observation": {"image": "image", "wrist_image": "wrist_image", "state": "state"}, "actions": "actions",
                    "prompt": "prompt"}


def _adapted(df: DataFrame, structure: Mapping, profile: str, keys: Sequence[str]) -> DataFrame:
    """Repack and adapt; memory columns, symbolic texts and keys pass through."""
    passed = {c: c for c in (*keys, *shape.OPTIONAL) if c in df.columns and c != "prompt"}
    return shape.adapt_inputs(shape.repack(df, {**structure, **passed}), profile)


def _sample_prompt(samples: DataFrame, structure: Mapping | None) -> Column:
    """The prompt that the adapted samples will have; null where they have no such column."""
    path = "prompt" if structure is None else structure["prompt"]
    found = samples.columns if structure is None else [*samples.columns, *shape.leaf_paths(samples.schema)]
    return shape._leaf(samples, path).cast("string") if path in found else F.lit(None).cast("string")


def _resized(df: DataFrame, shape_of: tuple[int, int, int], size: tuple[int, int]) -> DataFrame:
    """Every camera slot fitted into ``size`` (height, width)."""
    slots = [f.name for f in df.schema["image"].dataType.fields]
    return df.withColumn("image", F.struct(*[images.resize_with_pad(
        F.col(f"image.{s}"), shape_of, *size).alias(s) for s in slots]))


def training_batches(examples: DataFrame, n: int, size: int, seed: int = 0, epoch: int = 0, workers: int = 1,
                     worker: int = 0) -> DataFrame:
    """Examples of an epoch with ``rank``, ``batch`` and ``slot``: ranks follow from ``sample_id``, nothing is sorted."""
    return sampling.epoch_batches(examples, "sample_id", n, size, seed, epoch, workers, worker)


def training_examples(samples: DataFrame, features: DataFrame | None = None, kept: DataFrame | None = None,
                      norm: dict[str, stats.NormStats] | None = None, use_quantiles: bool = True, memory_type: str = "frames",
                      horizon: int = 16, action_dim: int = 32, max_len: int = 64, seed: int = 0, budget: int = 512,
                      per_image: int = 16, mask: Sequence[bool] = tuple(DELTA_MASK), default_prompt: str | None = None,
                      tokenizer=None, structure: Mapping | None = None, profile: str = "history_arm",
                      image_shape: tuple[int, int, int] | None = None, image_size: tuple[int, int] = (224, 224),
                      keys: Sequence[str] = ("sample_id", "epis_idx", "step_idx")) -> DataFrame:
    """Model-ready rows: cut and delta actions, memory, normalization, prompt tokens, padded dims.

    With ``structure`` (see ``SAMPLE_STRUCTURE``) the rows are repacked and adapted to the robot ``profile``; with
    ``image_shape`` the adapted camera images are resized into ``image_size``. ``keys`` pass through both.

    ``memory_type`` is frames, tokens, recurrent, symbolic or none. Memory states are normalized after
    padding, so padded rows are not zero; only the mask marks them.
    """
    from stepweave.functions.tokens import byte_tokenizer, with_tokens

    def given(prompt):
        return prompt if default_prompt is None else F.coalesce(prompt, F.lit(default_prompt))

    out = samples.withColumn("actions", vectors.cut(F.col("actions"), horizon))
    # tokens come ahead of the memory: rows wait in a queue while their texts are in Python, the longer the larger
    ids = ["tokenized_prompt", "tokenized_prompt_mask"]
    prompt = _sample_prompt(out, structure)
    out = out.withColumn("_text", text.build_prompt(text.require_prompt(given(prompt)), "plain"))
    out = with_tokens(out, "_text", tokenizer or byte_tokenizer, max_len, ids[0]).drop("_text")
    symbolic = memory_type == "symbolic"
    key = [F.col("epis_idx"), F.col("step_idx")]
    if symbolic:
        present = [c for c in ("simple_subgoal", "grounded_subgoal") if f"{c}_online" in out.columns]
        out = sampling.swap_online(out, seed, "epis_idx", "step_idx", columns=present)
        for c in ("grounded_subgoal", "simple_subgoal"):
            if c in out.columns:
                out = out.withColumn(c, text.augment_points(F.col(c), seed, F.concat_ws(":", *key)))
    if memory_type == "frames":
        out = memory.assemble_frames(out, features, budget, per_image)
    elif memory_type == "tokens":
        picked = memory.budget_tokens(out.select(*KEYS, "step_idx"), kept, budget)
        out = memory.assemble_tokens(out, picked, features, budget)
    elif memory_type == "recurrent":
        out = memory.assemble_recurrent(out, features)
    if norm is not None and memory_type in ("frames", "tokens", "recurrent"):
        name = "recur_state_emb" if memory_type == "recurrent" else "static_state_emb"
        out = stats.normalize(out, {name: norm["state"]}, use_quantiles)
    out = shape.ensure_columns(out)
    if structure is not None:
        out = _adapted(out, structure, profile, [*keys, *ids])
    out = out.withColumn("actions", vectors.shift_actions(F.col("actions"), F.col("state"), mask, -1))
    out = stats.normalize(out, norm, use_quantiles)
    out = out.select(*[c for c in out.columns if c not in ids], *ids)
    if symbolic:
        goal = F.coalesce(F.col("grounded_subgoal"), F.col("simple_subgoal"), F.lit(""))
        out = out.withColumn("_text", text.build_prompt(given(F.col("prompt")), "subgoal", subgoal=goal))
        out = with_tokens(out, "_text", tokenizer or byte_tokenizer, 2 * max_len, "symbolic_tokenized_prompt").drop("_text")
    if image_shape is not None:
        out = _resized(out, image_shape, image_size)
    pad = F.lit(0.0)
    return out.withColumns({
        "state": vectors.pad_right(F.col("state"), action_dim, pad),
        "actions": F.transform("actions", lambda a: vectors.pad_right(a, action_dim, pad))})


# Evaluation

def benchmark_report(logs: DataFrame, checkpoints: Sequence[str] | None = None, mean_only: bool = False) -> DataFrame:
    """Report table of (checkpoint, seed, task, rate) rows."""
    summary = reports.summarize_runs(reports.suite_scores(reports.fill_tasks(logs)))
    return reports.report_table(summary, checkpoints, mean_only)


def pending(all_episodes: DataFrame, progress: DataFrame, redo: Sequence[str] = (), only: Sequence[str] | None = None,
            exclude: Sequence[str] = ()) -> DataFrame:
    """Episodes still to be run."""
    return joins.pending_episodes(reports.select_tasks(all_episodes, only, exclude), progress, redo)


def finalize(progress: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rate per task, excluded tasks counting as failed, next to the macro total."""
    rates = reports.success_rates(reports.with_excluded(progress, exclude))
    total = reports.total_rate(rates).scalar()
    return rates.withColumn("total_success_rate", total)


def postprocess_actions(df: DataFrame, norm: dict[str, stats.NormStats], profile: str = "history_arm",
                        use_quantiles: bool = True, mask: Sequence[bool] = tuple(DELTA_MASK),
                        tokens: str | None = None, horizon: int = 16, dim: int = 32) -> DataFrame:
    """Model outputs to robot actions: token decode if needed, unnormalize state and actions, absolute, cut dims."""
    if tokens is not None:
        df = df.withColumn("actions", vectors.bins_to_actions(F.col(tokens), horizon, dim))
    out = stats.unnormalize(df, norm, use_quantiles)
    out = out.withColumn("actions", vectors.shift_actions(F.col("actions"), F.col("state"), mask, 1))
    return shape.adapt_outputs(out, profile)
