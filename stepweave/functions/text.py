"""Prompt, chat and answer shaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave import constants as c
from stepweave.constants import (DEMO_QUERY, DEMO_TASKS, GROUNDED_SYSTEM, IMAGE_QUERY, KEYFRAME_SYSTEM, SIMPLE_SYSTEM,
                                 VIDEO_QUERY)
from stepweave.functions import rng
from stepweave.functions.vectors import discretize

# Fixed patterns of grounded texts.
POINT = r"at <(\d+), (\d+)>"
ANGLE = r"<(\d+), (\d+)>"
BOX = r"<\|box_start\|>\((\d+),(\d+)\)<\|box_end\|>"
FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)\s*```"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_prompt(text: Column, mode: str = "space") -> Column:
    """``space``: strip, ``_`` and newline to space; ``lower``: lower-case, strip, ``_`` to space."""
    if mode == "lower":
        return F.translate(strip(F.lower(text)), "_", " ")
    return F.translate(strip(text), "_\n", "  ")


def state_text(state: Column, clip: bool) -> Column:
    return F.array_join(F.transform(discretize(state, clip), lambda v: v.cast("string")), " ")


def build_prompt(prompt: Column, fmt: str, state: Column | None = None, subgoal: Column | None = None) -> Column:
    """Prompt formats: state_comma, state, prefix, subgoal, subgoal_state, plain."""
    if fmt == "prefix":
        return F.concat(F.lit("Task: "), clean_prompt(prompt, "lower"), F.lit(", State: "), state_text(state, False),
                        F.lit(";\n"))
    text = clean_prompt(prompt)
    if fmt == "plain":
        return text
    if fmt in ("state", "state_comma"):
        mark = F.lit(", State: " if fmt == "state_comma" else "; State: ")
        return F.concat(F.lit("Task: "), text, mark, state_text(state, True), F.lit(";\nAction: "))
    goal = clean_prompt(subgoal)
    if fmt == "subgoal":
        return F.concat(F.lit("Task: "), text, F.lit(";\nCurrent Subgoal: "), goal, F.lit(";\nAction: "))
    if fmt == "subgoal_state":
        return F.concat(F.lit("Task: "), text, F.lit("\nCurrent Subgoal: "), goal, F.lit(".\nAction: "))
    raise ValueError(f"unknown prompt format {fmt}")


def require_prompt(prompt: Column) -> Column:
    return F.coalesce(prompt, F.raise_error(F.lit("Prompt is required")).cast("string"))


def number_list(items: Column) -> Column:
    """``1. a; 2. b``."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "; ")


def _pairs(text: Column, pattern: str) -> Column:
    left = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    right = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(left, right, lambda a, b: F.array(a.cast("int"), b.cast("int")))


def points(text: Column) -> Column:
    """All ``at <y, x>`` as [y, x] pairs."""
    return _pairs(text, POINT)


def mask_points(text: Column) -> Column:
    return F.regexp_replace(text, POINT, "at <bbox>")


def box_points(text: Column, size: int = 256) -> Column:
    """Model boxes on a 0..1000 grid as pixel pairs."""
    return F.transform(_pairs(text, BOX), lambda p: F.transform(p, lambda v: F.floor(v * size / 1000.0).cast("int")))


def rescale_boxes(text: Column, mode: str = "scaled_coords", size: int = 256) -> Column:
    """Replace each model box by ``<y, x>`` in pixels or by ``<bbox>``."""
    if mode == "bbox":
        return F.regexp_replace(text, BOX, "<bbox>")
    if mode != "scaled_coords":
        raise ValueError(f"unknown mode {mode}")
    marks = F.transform(box_points(text, size), lambda p: F.concat(
        F.lit("<"), F.get(p, F.lit(0)).cast("string"), F.lit(", "), F.get(p, F.lit(1)).cast("string"), F.lit(">")))
    parts = F.split(text, BOX, -1)
    return F.array_join(F.zip_with(parts, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def rescale_angles(text: Column, size: int = 256) -> Column:
    """Replace every ``<y, x>`` on the 0..1000 grid by clipped pixels, one match after the other."""
    def pixel(v):
        return F.greatest(F.lit(0), F.least(F.lit(size), F.floor(v.cast("int") * size / 1000.0).cast("int")))

    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(ANGLE), F.lit(1)).alias("y"),
                         F.regexp_extract_all(text, F.lit(ANGLE), F.lit(2)).alias("x"))
    return F.aggregate(found, text, lambda acc, m: F.replace(
        acc, F.concat(F.lit("<"), m["y"], F.lit(", "), m["x"], F.lit(">")),
        F.concat(F.lit("<"), pixel(m["y"]).cast("string"), F.lit(", "), pixel(m["x"]).cast("string"), F.lit(">"))))


def augment_points(text: Column, seed: int, key: Column, limit: int = 8) -> Column:
    """Add clamped Gaussian noise to the point of a text that has exactly one; others stay."""
    def noise(axis):
        raw = rng.gauss(f"{seed}{axis}", key) * (limit / 2.5)
        return F.bround(F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), raw))).cast("int")

    def mark(y, x):
        return F.concat(F.lit("at <"), y.cast("string"), F.lit(", "), x.cast("string"), F.lit(">"))

    found = points(text)
    y, x = F.get(F.get(found, F.lit(0)), F.lit(0)), F.get(F.get(found, F.lit(0)), F.lit(1))
    return F.when(F.size(found) == 1, F.replace(text, mark(y, x), mark(y + noise("y"), x + noise("x")))).otherwise(text)


def jitter_boxes(boxes: Column, seed: int, key: Column, low: int = -2, high: int = 2, top: int = 255) -> Column:
    """Each coordinate plus an integer in [low, high), clamped to 0..top."""
    def move(v, i, axis):
        step = rng.below(high - low, seed, key, i, F.lit(axis)) + low
        return F.least(F.greatest(v + step, F.lit(0)), F.lit(top))

    return F.transform(boxes, lambda p, i: F.array(move(F.get(p, F.lit(0)), i, 0), move(F.get(p, F.lit(1)), i, 1)))


def fenced_json(text: Column) -> Column:
    """Body of the first fenced block, or the whole text, stripped."""
    return strip(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


ANSWER = "struct<current_subtask:string,keyframe_positions:array<int>>"


def parse_answer(text: Column, frames: Column) -> Column:
    """Subtask and the frame ids at its 1-based positions; null when the answer or a position is bad.

    A position counts back from the end when it is zero or negative.
    """
    answer = F.from_json(text, ANSWER)
    size = F.size(frames)

    def frame(p):
        index = p - 1
        return F.get(frames, F.when(index < 0, index + size).otherwise(index))

    ids = F.transform(answer["keyframe_positions"], frame)
    usable = is_json(text) & answer["current_subtask"].isNotNull() & ids.isNotNull() & ~F.exists(ids, F.isnull)
    return F.when(usable, F.struct(answer["current_subtask"].alias("subtask"), ids.alias("frame_ids")))


# Chat records.

def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def single_user_text(goal: Column, history: Column, has_video: Column, grounded: bool) -> Column:
    kind = "grounded language subgoal" if grounded else "language subgoal"
    middle = F.when(F.size(history) == 0, F.lit(c.FIRST_TURN)).otherwise(F.concat(
        F.lit(c.HISTORY_LEAD.format(kind=kind)), number_list(history), F.lit("\n")))
    return F.concat(F.when(has_video, F.lit(c.VIDEO_MARK)).otherwise(F.lit("")), F.lit(c.GOAL_LEAD), goal, F.lit("\n"), middle,
                    F.lit(c.NEXT_QUESTION.format(kind=kind)))


def image_list(n: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("<image>"), n), ", "), F.lit("]"))


def keyframe_user_text(goal: Column, n_key: Column, n_exec: Column, has_video: Column) -> Column:
    prefix = F.when(has_video, F.lit(c.SETUP_VIDEO)).otherwise(F.lit(""))
    return F.concat(prefix, F.lit(c.GOAL_LEAD), goal, F.lit(c.KEYFRAMES_LEAD), image_list(n_key), F.lit(c.CURRENT_LEAD),
                    image_list(n_exec), F.lit(c.KEYFRAME_QUESTION))


def keyframe_answer(subgoal: Column, candidate: Column) -> Column:
    """Answer JSON; the text form differs by one space between a hit and no hit."""
    shown = F.coalesce(subgoal, F.lit("None"))
    lead, middle, end = map(F.lit, c.ANSWER_WITH_KEYFRAME)
    bare, rest = map(F.lit, c.ANSWER_WITHOUT_KEYFRAME)
    return F.when(candidate.isNotNull(), F.concat(lead, shown, middle, candidate.cast("string"), end)).otherwise(
        F.concat(bare, shown, rest))


SYSTEM_TEXTS = {"simple": SIMPLE_SYSTEM, "grounded": GROUNDED_SYSTEM, "keyframe": KEYFRAME_SYSTEM}


def query_text(count: Column, task: Column, goal: Column) -> Column:
    """First query by task class with the goal filled in, later queries with the clip text."""
    first = F.when(task.isin(DEMO_TASKS), F.lit(DEMO_QUERY)).otherwise(F.lit(IMAGE_QUERY))
    return F.when(count == 0, F.replace(first, F.lit("{task_goal}"), goal)).otherwise(F.lit(VIDEO_QUERY))


# Names.

def env_id(name: Column) -> Column:
    """Last ``_`` token of the part before the first dot."""
    return F.element_at(F.split(F.split_part(name, F.lit("."), F.lit(1)), "_"), -1)


def image_name(env: Column, episode: Column, step: Column) -> Column:
    return F.format_string("%s_ep%d_step%d.png", env, episode, step)


def rollout_name(env: Column, episode: Column, flag: Column, goal: Column, difficulty: Column) -> Column:
    return F.format_string("%s_ep%d_%s_%s_%s.mp4", env, episode, flag, goal, difficulty)


def frame_key(folder: Column, file: Column, t: Column) -> Column:
    return F.concat_ws("--", folder, file, t.cast("string"))


def step_of(name: Column) -> Column:
    """Step number of a ``step_<n>_image.png`` path; null for other names."""
    found = F.regexp_extract(name, r"step_(\d+)_image.png", 1)
    return F.when(found != "", found.cast("int"))
