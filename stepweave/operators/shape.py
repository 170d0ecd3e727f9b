"""Projections, filters and schema operators on (nested) records."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.functions import text
from stepweave.functions.vectors import decode_state, encode_actions_inv, keep_dims
from stepweave.session import with_package

SEP = "/"


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """``/``-joined paths of the leaves of a nested schema."""
    out = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += leaf_paths(field.dataType, path + SEP)
        else:
            out.append(path)
    return out


def _leaf(df: DataFrame, path: str) -> Column:
    """Column of a leaf, whether the frame is nested or already flat."""
    if path in df.columns:
        return F.col(f"`{path}`")
    return F.col(".".join(f"`{part}`" for part in path.split(SEP)))


def flatten(df: DataFrame) -> DataFrame:
    """Nested record to flat columns named by their path."""
    return df.select(*[_leaf(df, p).alias(p) for p in leaf_paths(df.schema)])


def _tree(paths: Mapping[str, Column]) -> dict:
    tree: dict = {}
    for path, value in paths.items():
        node, parts = tree, path.split(SEP)
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} lies under a leaf")
        if parts[-1] in node:
            raise ValueError(f"{path} is both a leaf and a node")
        node[parts[-1]] = value
    return tree


def _structs(tree: Mapping) -> list[Column]:
    return [(F.struct(*_structs(value)) if isinstance(value, Mapping) else value).alias(name)
            for name, value in tree.items()]


def unflatten(df: DataFrame) -> DataFrame:
    """Flat ``/`` columns to a nested record."""
    return df.select(*_structs(_tree({c: F.col(f"`{c}`") for c in df.columns})))


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """New record whose leaves name source paths; a missing path raises."""
    known = set(leaf_paths(df.schema))

    def build(node: Mapping) -> dict:
        out = {}
        for name, value in node.items():
            if isinstance(value, Mapping):
                out[name] = build(value)
            elif value in known:
                out[name] = _leaf(df, value)
            else:
                raise KeyError(value)
        return out

    return df.select(*_structs(build(structure)))


def rename_by_pattern(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Rename or drop (``None``) leaves; the first pattern that matches the whole path decides."""
    out: dict[str, Column] = {}
    for path in leaf_paths(df.schema):
        target: str | None = path
        for pattern, replacement in patterns.items():
            match = re.fullmatch(pattern, path)
            if match:
                target = None if replacement is None else match.expand(replacement)
                break
        if target is None:
            continue
        if target in out:
            raise ValueError(f"key {target} already exists")
        out[target] = _leaf(df, path)
    return df.select(*_structs(_tree(out)))


def inject_default(df: DataFrame, column: str = "prompt", value: str | None = None) -> DataFrame:
    if value is None or column in df.columns:
        return df
    return df.withColumn(column, F.lit(value))


def drop_strings(df: DataFrame) -> DataFrame:
    """Remove string leaves; null-typed leaves stay."""
    def numeric(schema: T.StructType, prefix: str = "") -> dict:
        tree = {}
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                tree[f.name] = numeric(f.dataType, f"{prefix}{f.name}{SEP}")
            elif not isinstance(f.dataType, T.StringType):
                tree[f.name] = _leaf(df, prefix + f.name)
        return {k: v for k, v in tree.items() if not (isinstance(v, dict) and not v)}

    return df.select(*_structs(numeric(df.schema)))


# Optional columns of a training example, null when absent.
OPTIONAL = {
    "static_image_emb": "array<array<float>>", "static_pos_emb": "array<array<float>>",
    "static_state_emb": "array<array<float>>", "static_mask": "array<boolean>",
    "recur_image_emb": "array<array<array<float>>>", "recur_pos_emb": "array<array<array<float>>>",
    "recur_state_emb": "array<array<float>>", "recur_mask": "array<boolean>",
    "simple_subgoal": "string", "grounded_subgoal": "string", "prompt": "string",
}


def ensure_columns(df: DataFrame, names: Mapping[str, str] = OPTIONAL, suffix: str = "_online") -> DataFrame:
    """Drop the consumed ``*_online`` columns and add absent optional columns as null."""
    kept = df.drop(*[c for c in df.columns if c.endswith(suffix)])
    return kept.select(*kept.columns, *[F.lit(None).cast(t).alias(n) for n, t in names.items() if n not in kept.columns])


# Robot profiles: camera slots as (slot, source path or None). A slot without a source, or whose source is an
# absent optional camera, is a zero image with mask false; the token model does not mask padding images.
_TWO_CAMERAS = [("base_0_rgb", "observation/image"), ("left_wrist_0_rgb", "observation/wrist_image")]
PROFILES = {
    "history_arm": {"cameras": _TWO_CAMERAS, "state": ["observation/state"], "dims": 8},
    "single_arm": {"cameras": [*_TWO_CAMERAS, ("right_wrist_0_rgb", None)], "state": ["observation/state"], "dims": 7},
    "joint_arm": {"cameras": [("base_0_rgb", "observation/exterior_image_1_left"),
                              ("left_wrist_0_rgb", "observation/wrist_image_left"), ("right_wrist_0_rgb", None)],
                  "token_cameras": [("base_0_rgb", "observation/exterior_image_1_left"), ("base_1_rgb", None),
                                    ("wrist_0_rgb", "observation/wrist_image_left")],
                  "state": ["observation/joint_position", "observation/gripper_position"], "dims": 8},
    "two_arms": {"cameras": [("base_0_rgb", "images/cam_high"), ("left_wrist_0_rgb", "images/cam_left_wrist"),
                             ("right_wrist_0_rgb", "images/cam_right_wrist")],
                 "optional": True, "allowed": ["cam_high", "cam_low", "cam_left_wrist", "cam_right_wrist"],
                 "state": ["state"], "dims": 14},
}


def adapt_inputs(df: DataFrame, profile: str, token_model: bool = False, convert: bool = False) -> DataFrame:
    """Observation columns to {state, image{..}, image_mask{..}} plus actions and prompt when present.

    Images are flat value arrays. ``convert`` applies the fourteen-joint conversions of ``two_arms``.
    """
    spec = PROFILES[profile]
    known = set(leaf_paths(df.schema))
    cameras = spec.get("token_cameras", spec["cameras"]) if token_model else spec["cameras"]
    if "allowed" in spec:
        extra = {p.split(SEP)[1] for p in known if p.startswith("images/")} - set(spec["allowed"])
        if extra:
            raise ValueError(f"unexpected cameras {sorted(extra)}")
    base = _leaf(df, cameras[0][1])
    images, masks = [], []
    for slot, source in cameras:
        present = source is not None and (source in known or not spec.get("optional"))
        images.append((_leaf(df, source) if present else F.transform(base, lambda v: v * 0)).alias(slot))
        masks.append(F.lit(present or (token_model and source is None)).alias(slot))
    parts = []
    for path in spec["state"]:
        value = _leaf(df, path)
        kind = df.select(value.alias("c")).schema["c"].dataType
        parts.append(value if isinstance(kind, T.ArrayType) else F.array(value))
    state = F.concat(*parts) if len(parts) > 1 else parts[0]
    out = [(decode_state(state) if convert else state).alias("state"), F.struct(*images).alias("image"),
           F.struct(*masks).alias("image_mask")]
    if "actions" in df.columns:
        out.append((encode_actions_inv(F.col("actions")) if convert else F.col("actions")).alias("actions"))
    if "prompt" in df.columns:
        out.append(F.col("prompt").cast("string").alias("prompt"))
    if profile == "history_arm":
        out += [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
                for c, t in OPTIONAL.items() if c != "prompt"]
    used = {"actions", "prompt", "state", "images", "observation", *(OPTIONAL if profile == "history_arm" else ())}
    keys = [F.col(f"`{c}`") for c in df.columns if c not in used and not c.startswith(("observation/", "images/"))]
    return df.select(*keys, *out)


def adapt_outputs(df: DataFrame, profile: str, actions: str = "actions") -> DataFrame:
    return df.withColumn(actions, keep_dims(F.col(actions), PROFILES[profile]["dims"]))


def with_env_id(df: DataFrame, path_column: str, suffix: str = ".h5") -> DataFrame:
    """Rows of files with the suffix, with the environment id from the file name."""
    name = F.element_at(F.split(F.col(path_column), "/"), -1)
    return df.where(name.endswith(suffix)).withColumn("env_id", text.env_id(name))


def execution_only(df: DataFrame) -> DataFrame:
    """Rows from exec_start on; a demo flag that is not a prefix raises."""
    holds = F.col("is_demo") == (F.col("step_idx") < F.col("exec_start"))
    checked = F.when(holds, F.col("is_demo")).otherwise(F.raise_error(F.lit("is_demo is not a prefix")).cast("boolean"))
    return df.withColumn("is_demo", checked).where(~F.col("is_demo"))


def success_only(df: DataFrame, column: str = "file_path", token: str = "success") -> DataFrame:
    """Rows whose path contains the token."""
    return df.where(F.col(column).rlike(f"^.*{token}.*$"))


def check_contract(df: DataFrame, contract: T.StructType, dims: Mapping[str, Sequence[str | int]] | None = None,
                   paired: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Same structure and types, agreeing symbolic array sizes, paired columns given together.

    Structure is checked on the schema; sizes per row (``dims``: column -> one size or symbol per axis).
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    for field in contract.fields:
        if field.name not in found:
            raise ValueError(f"column {field.name} is missing")
        if found[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(f"column {field.name} is {found[field.name].simpleString()}")
    for group in paired:
        if len({c in found for c in group}) > 1:
            raise ValueError(f"columns {list(group)} must be given together")
    bound: dict[str, Column] = {}
    holds = F.lit(True)
    for name, axes in (dims or {}).items():
        value = F.col(name)
        for axis in axes:
            size = F.size(value)
            if isinstance(axis, int):
                holds = holds & (value.isNull() | (size == axis))
            elif axis in bound:
                holds = holds & (value.isNull() | (size == bound[axis]))
            else:
                bound[axis] = size
            value = F.get(value, F.lit(0))
    if not dims:
        return df
    first = next(iter(dims))
    checked = F.when(holds, F.col(first)).otherwise(
        F.raise_error(F.lit("array sizes disagree")).cast(found[first]))
    return df.withColumn(first, checked)


Transform = Callable[[DataFrame], DataFrame]


class Group:
    """Input and output transforms; a later push appends inputs and prepends outputs."""

    def __init__(self, inputs: Sequence[Transform] = (), outputs: Sequence[Transform] = ()):
        self.inputs, self.outputs = tuple(inputs), tuple(outputs)

    def push(self, inputs: Sequence[Transform] = (), outputs: Sequence[Transform] = ()) -> "Group":
        return Group((*self.inputs, *inputs), (*outputs, *self.outputs))

    def apply_inputs(self, df: DataFrame) -> DataFrame:
        return compose(*self.inputs)(df)

    def apply_outputs(self, df: DataFrame) -> DataFrame:
        return compose(*self.outputs)(df)


def compose(*transforms: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for transform in transforms:
            df = df.transform(transform)
        return df
    return run


def python_rows(fn: Callable[[dict], dict], schema: T.StructType | str) -> Transform:
    """A record-to-record Python function as a transform, run over Arrow batches."""
    import pandas as pd

    def batches(frames):
        for pdf in frames:
            yield pd.DataFrame([fn(r) for r in pdf.to_dict("records")])

    return lambda df: with_package(df).mapInPandas(batches, schema)
