"""Registered queries against their DuckDB counterparts on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
# One query per family; tools/check.py compares all of them.
NAMES = ["src03_episode_cap", "proj07_input_adapter", "flt03_task_lists", "join01_history_gather", "join02_range_filter", "agg02_histogram_quantiles",
         "agg05_run_summary", "win01_action_chunks", "win05_transitions", "win14_selected_frames", "win17_numbers_over_files",
         "mem03_budget_tokens", "arr09_scalar_quantization", "str09_structured_answers", "srt02_batches", "job01_training_samples",
         "job05_trajectory_frames", "job07_benchmark_report"]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_executors_get_the_package_from_any_folder(tmp_path):
    """Python functions run where neither the working folder nor the environment names the package."""
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    root = Path(__file__).resolve().parents[1]
    code = (f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; "
            "from stepweave.session import local_session; spark = local_session(2, '2g', partitions=2); "
            f"print('rows', e.queries()['win09_motion_minima'](spark, {SF!r}).count())")
    name = next(n for n in entry.queries() if n.startswith("win09"))
    done = subprocess.run([sys.executable, "-c", code.replace("win09_motion_minima", name)], cwd=tmp_path, text=True,
                          capture_output=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
