"""Streaming memory: hand-over, expiry, contents after each append; run logs as a data source; hold rules."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stepweave.functions import indices
from stepweave.operators import windows
from stepweave.sources import runlogs
from stepweave.streaming import memory as live
from stepweave.streaming import run

CHUNKS = "epis_idx int, seq bigint, frames int, exec_start int, reset boolean"


def test_step_lists_equal_the_column_forms(spark):
    rows = spark.createDataFrame([(t, e) for e in (0, 1, 5, 9, 30, 200) for t in range(e, e + 90, 3)], "t int, e int")
    out = rows.select("t", "e", indices.even_indices(F.col("t"), 5).alias("even"),
                      indices.recurrent_indices(F.col("t"), F.col("e"), 4, 12, 7).alias("recurrent"))
    for r in out.collect():
        assert live.even_steps(r.t, 5) == r.even and live.recurrent_steps(r.t, r.e, 4, 12, 7) == r.recurrent


def test_stream_takes_over_recorded_episodes(spark, tmp_path):
    recorded = spark.createDataFrame([(0, s, 2) for s in range(5)] + [(1, 0, 0)], "epis_idx int, step_idx int, exec_start int")
    chunks = spark.createDataFrame([(0, 7, 2, None, False), (1, 7, 1, 3, False), (2, 7, 1, None, False), (0, 9, 1, None, True)], CHUNKS)
    run.write_slices(chunks, F.col("seq"), f"{tmp_path}/in", 2)
    run.use_state_store(spark)
    out = run.run_to_table(live.episode_memory(run.replay(spark, f"{tmp_path}/in"), initial=live.batch_progress(recorded)), str(tmp_path))
    got = sorted((r.epis_idx, r.seq, r.step_idx, r.exec_start) for r in out.collect())
    assert got == [(0, 7, 5, 2), (0, 7, 6, 2), (0, 9, 0, 0), (1, 7, 1, 3), (2, 7, 0, 0)]


def test_idle_episodes_are_forgotten(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 1, 3, None, False), (0, 2, 2, None, False)], CHUNKS)
    run.use_state_store(spark)
    for idle, folder, want in ((1, "a", [0, 1, 2, 0, 1]), (10 ** 8, "b", [0, 1, 2, 3, 4])):
        run.write_slices(chunks, F.col("seq"), f"{tmp_path}/{folder}/in", 2)
        out = run.run_to_table(live.episode_memory(run.replay(spark, f"{tmp_path}/{folder}/in"), idle_ms=idle), f"{tmp_path}/{folder}")
        assert [r.step_idx for r in out.orderBy("seq", "step_idx").collect()] == want


def test_a_step_added_twice_raises(spark, tmp_path):
    row = (0, 0, [0.0], [[0.0]] * 16, [[0.0]] * 16)
    frames = spark.createDataFrame([row, row], "epis_idx int, step_idx int, state array<double>, image_emb_4x4 array<array<double>>, "
                                               "pos_emb_4x4 array<array<double>>")
    run.write_slices(frames.withColumn("n", F.monotonically_increasing_id()), F.col("n"), f"{tmp_path}/in", 2)
    run.use_state_store(spark)
    with pytest.raises(PySparkException):
        run.run_to_table(live.online_memory(run.replay(spark, f"{tmp_path}/in"), budget=32), str(tmp_path))


def test_contents_with_partitions_without_rows(spark, tmp_path, monkeypatch):
    """One episode on several partitions: the others get no rows. A small cache and small pieces give the same rows."""
    monkeypatch.setattr(live, "EMIT_ROWS", 3)
    monkeypatch.setattr(live, "BLOCK", 2)
    monkeypatch.setattr(live, "HELD_BLOCKS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    rows = [(0, t, [float(t)], [[t + p / 16] for p in range(16)], [[p / 16, float(t)] for p in range(16)]) for t in range(11)]
    frames = spark.createDataFrame(rows, "epis_idx int, step_idx int, state array<double>, image_emb_4x4 array<array<double>>, "
                                         "pos_emb_4x4 array<array<double>>")
    run.write_slices(frames, F.col("step_idx"), f"{tmp_path}/in", 2)
    run.use_state_store(spark)
    try:
        out = run.run_to_table(live.online_memory(run.replay(spark, f"{tmp_path}/in"), budget=64), str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r.step_idx for r in out) == list(range(11))
    for r in out:
        steps = live.even_steps(r.step_idx, 4)
        n = 16 * len(steps)
        assert r.static_image_emb == [x for s in steps for x in rows[s][3]] + [[0.0]] * (64 - n)
        assert r.static_pos_emb == [x for s in steps for x in rows[s][4]] + [[0.0, 0.0]] * (64 - n)
        assert r.static_state_emb == [[float(s)] for s in steps for _ in range(16)] + [[0.0]] * (64 - n)
        assert r.static_mask == [True] * n + [False] * (64 - n)


def test_run_logs_round_trip_and_push_down(spark, tmp_path):
    rows = [(c, s, t, i / 7) for i, (c, s, t) in enumerate((c, s, t) for c in ("1-A", "b/c", "d é") for s in ("s0", "s1") for t in ("T1", "T2"))]
    rates = spark.createDataFrame(rows, runlogs.SCHEMA)
    path = f"{tmp_path}/m"
    runlogs.write_logs(rates, path, tail="oracle")
    runlogs.write_logs(rates, path, tail="oracle")  # replaces
    got = runlogs.read_logs(spark, path, ["1-A", "b/c", "absent"], ["s1"], tail="oracle")
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[0] != "d é" and r[1] == "s1"]
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert len(files) == 6 and all(f.endswith("/oracle/log.json") for f in files)
    held = json.loads((tmp_path / files[0]).read_text())
    assert held["total_success_rate"] == sum(held["success_rate"].values()) / 2
    (tmp_path / files[0]).write_text("{broken")
    assert runlogs.read_logs(spark, path, ["1-A"], ["s0", "s1"], tail="oracle").count() == 2
    source = runlogs.run_logs()({"path": path, "tail": "oracle"})
    reader = source.reader(None)
    from pyspark.sql.datasource import EqualTo, In, IsNotNull
    given = [IsNotNull(("seed",)), EqualTo(("seed",), "s0"), In(("checkpoint",), ("d é", "x"))]
    assert list(reader.pushFilters(given)) == given[:1]
    assert [(len(p.runs), p.runs[0][1]) for p in reader.partitions()] == [(1, "s0")]


def test_hold_rules(either):
    rng = random.Random(4)
    rules = {"A": [("x", 9), ("y", 30)], "B": [("", 12)]}
    rows, want = [], {}
    for e, env in enumerate(["A", "A", "B", "C"]):
        period, last = 0, None
        for t in range(60):
            text = rng.choice(["x one", "y two", "z", None])
            rows.append((e, t, env, text))
            asked = last is None or t > period
            if asked:
                last = text
                period = next((n for mark, n in rules.get(env, []) if text is not None and mark in text), 0)
            want[e, t] = (asked, last)
    df = either.createDataFrame(rows, "epis_idx int, step_idx int, env_id string, answer string")
    got = {(r.epis_idx, r.step_idx): (r.query, r.held) for r in windows.hold_schedule(df, "answer", rules=rules).collect()}
    assert got == want
