"""Registry of queries over the given tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.constants import SUITES, TASKS
from stepweave.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def work_dir(spark: SparkSession) -> str:
    """A new folder for one query's written tables, in the shared folder."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


TASK_LIST = "[" + ", ".join(f"'{t}'" for t in TASKS) + "]"
SUITE_CASE = "CASE " + " ".join(
    f"WHEN task IN ({', '.join(repr(t) for t in ts)}) THEN '{s}'" for s, ts in SUITES.items()) + " END"


def rnd(seed: str | int, *key: str) -> str:
    """SQL text of the 32-bit draw."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8))::BIGINT"


STEPS = f"""
v0 AS (
  SELECT user_id::INT AS epis_idx, (row_number() OVER w - 1)::INT AS step_idx,
         (count(*) OVER (PARTITION BY user_id))::INT AS n, event_type AS subgoal, value,
         regexp_extract(props, '"k": (\\d+)', 1)::INT AS k,
         lead(value) OVER w AS v1, lead(regexp_extract(props, '"k": (\\d+)', 1)::INT) OVER w AS k1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v_steps AS (
  SELECT epis_idx, step_idx, n, subgoal, subgoal = 'error' AS completed, subgoal = 'purchase' AS boundary,
         least(epis_idx % 5, n - 1)::INT AS exec_start, step_idx < least(epis_idx % 5, n - 1) AS is_demo, k, value,
         coalesce(v1, value) AS a0, coalesce(k1, k)::DOUBLE AS a1, {TASK_LIST}[epis_idx % 16 + 1] AS env_id
  FROM v0)"""

FRAMES = """
v_frames AS (
  SELECT label::INT AS epis_idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS step_idx,
         embedding AS pixels FROM embeddings)"""

TRAJ = """
v_traj AS (
  SELECT o_custkey::INT AS traj,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS t,
         (count(*) OVER (PARTITION BY o_custkey))::INT AS traj_len,
         '/data/' || CASE WHEN o_custkey % 4 = 0 THEN 'failure' ELSE 'success' END || '/traj_' || o_custkey AS file_path,
         '/rec/' || (o_custkey % 10) AS recording_folderpath, o_totalprice AS position,
         o_totalprice / 1000.0 AS velocity, (o_orderkey % 2)::DOUBLE AS gripper
  FROM orders)"""

EVAL = f"""
v_eval AS (
  SELECT o_orderpriority AS checkpoint, o_orderstatus AS seed, {TASK_LIST}[o_custkey % 16 + 1] AS task,
         o_orderkey AS episode,
         CASE WHEN o_orderkey % 50 = 0 THEN 'error' WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END AS status
  FROM orders)"""

# Chunks of 20 actions as long rows: position i of the chunk of each step.
CHUNK_ROWS = STEPS + """,
v_chunk AS (
  SELECT s.epis_idx, s.step_idx, s.n, s.is_demo, i.i, a.a0, a.a1, s.value AS s0, s.k::DOUBLE AS s1
  FROM v_steps s CROSS JOIN range(20) i(i)
  JOIN v_steps a ON a.epis_idx = s.epis_idx AND a.step_idx = least(s.step_idx + i.i, s.n - 1))"""
