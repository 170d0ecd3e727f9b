"""Episode-step views over the given tables, so that every operator runs on real rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.constants import TASKS
from stepweave.functions.vectors import literal
from stepweave.operators import ordered as o

SENTINEL = "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_of(key: Column) -> Column:
    return F.element_at(literal(TASKS), (F.pmod(key, F.lit(len(TASKS))) + 1).cast("int"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a user's events in time order are an episode. Keeps ``_blk``."""
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("epis_idx"), "ts", "event_id", F.col("event_type").alias("subgoal"),
        F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double")).alias("state"))
    numbered = o.scan(raw, ["epis_idx"], ["ts", "event_id"], {
        "step_idx": o.running(F.lit(1), inclusive=False),
        "n": o.total(F.lit(1), "sum"),
        "_next": o.lead(F.struct("state")),
    })
    start = F.least(F.col("epis_idx") % 5, F.col("n") - 1).cast("int")
    return numbered.select(
        "epis_idx", F.col("step_idx").cast("int").alias("step_idx"), F.col("n").cast("int").alias("n"), "subgoal",
        (F.col("subgoal") == SENTINEL).alias("completed"), (F.col("subgoal") == "purchase").alias("boundary"),
        start.alias("exec_start"), (F.col("step_idx") < start).alias("is_demo"),
        F.get("state", F.lit(1)).cast("int").alias("k"), "state",
        F.coalesce(F.col("_next.state"), F.col("state")).alias("action"),
        task_of(F.col("epis_idx")).alias("env_id"), o.BLOCK)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as 8 x 8 one-value images; a label's rows in id order are an episode."""
    raw = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("epis_idx"), "vec_id", F.col("embedding").alias("pixels"))
    return o.number_rows(raw, ["epis_idx"], "vec_id", "step_idx").select(
        "epis_idx", F.col("step_idx").cast("int").alias("step_idx"), "pixels", o.BLOCK)


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; a customer's orders in date order are a trajectory. Keeps ``_blk``."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("int").alias("traj"), "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority",
        "o_orderstatus")
    numbered = o.scan(raw, ["traj"], ["o_orderdate", "o_orderkey"], {
        "t": o.running(F.lit(1), inclusive=False), "traj_len": o.total(F.lit(1), "sum")})
    flag = F.when(F.col("traj") % 4 == 0, F.lit("failure")).otherwise(F.lit("success"))
    return numbered.select(
        "traj", F.col("t").cast("int").alias("t"), F.col("traj_len").cast("int").alias("traj_len"),
        F.concat(F.lit("/data/"), flag, F.lit("/traj_"), F.col("traj").cast("string")).alias("file_path"),
        F.concat(F.lit("/rec/"), (F.col("traj") % 10).cast("string")).alias("recording_folderpath"),
        F.array(F.concat(F.lit("reach "), F.col("traj").cast("string")),
                F.concat(F.lit("pick "), F.col("traj").cast("string")),
                F.concat(F.lit("place "), F.col("traj").cast("string"))).alias("instructions"),
        F.array("o_totalprice").alias("joint_position"),
        F.array((F.col("o_totalprice") / 1000.0)).alias("joint_velocity"),
        F.array((F.col("o_orderkey") % 2).cast("double")).alias("gripper_position"), o.BLOCK)


THRESHOLD = 250000.0


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rollout: (checkpoint, seed, task, episode, status, success)."""
    status = (F.when(F.col("o_orderkey") % 50 == 0, F.lit("error"))
              .when(F.col("o_totalprice") > THRESHOLD, F.lit("true")).otherwise(F.lit("false")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("checkpoint"), F.col("o_orderstatus").alias("seed"),
        task_of(F.col("o_custkey")).alias("task"), F.col("o_orderkey").alias("episode"), status.alias("status"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as 4-vectors."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"))
