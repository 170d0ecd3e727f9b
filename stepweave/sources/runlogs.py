"""Run logs as a Python data source: one ``log.json`` per run folder ``<path>/<checkpoint>/<seed>[/<tail>]``.

    spark.dataSource.register(run_logs())
    rates.write.format("run_logs").mode("append").save(path)
    spark.read.format("run_logs").load(path).where("checkpoint IN ('a', 'b')")

Reading plans one partition per few run folders; conditions on checkpoint and seed choose the folders before anything is
opened. Missing and unreadable logs are skipped. Writing puts every run's log beside its place in the tasks and names it
in the commit, so a failed or repeated task leaves nothing behind; rows of one run must be in one task (see ``write_logs``).
Files are reached through ``pyarrow.fs``, so a folder can be local or in an object store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "checkpoint string, seed string, task string, rate double"
FOLDERS_PER_PARTITION = 32


def run_logs() -> type:
    """The data source class. It is made here, so that it travels by value and needs no package on executors."""
    import json
    import uuid
    from dataclasses import dataclass
    from urllib.parse import quote, unquote

    from pyarrow import fs
    from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                        WriterCommitMessage)

    schema, per_partition = SCHEMA, FOLDERS_PER_PARTITION

    def opened(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)

    def folders(store: fs.FileSystem, base: str) -> list[str]:
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    @dataclass
    class Runs(InputPartition):
        runs: list[tuple[str, str]]

    class Reader(DataSourceReader):
        def __init__(self, path: str, tail: str) -> None:
            self.path, self.tail, self.wanted = path, tail, {}

        def pushFilters(self, filters):
            for f in filters:
                name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
                if name not in ("checkpoint", "seed"):
                    yield f
                    continue
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values

        def partitions(self):
            store, base = opened(self.path)

            def chosen(column: str, names: list[str]) -> list[str]:
                return [n for n in names if column not in self.wanted or unquote(n) in self.wanted[column]]
            runs = [(c, s) for c in chosen("checkpoint", folders(store, base)) for s in chosen("seed", folders(store, f"{base}/{c}"))]
            return [Runs(runs[i:i + per_partition]) for i in range(0, len(runs), per_partition)] or [Runs([])]

        def read(self, partition):
            store, base = opened(self.path)
            for checkpoint, seed in partition.runs:
                try:
                    with store.open_input_stream("/".join(x for x in (base, checkpoint, seed, self.tail, "log.json") if x)) as held:
                        rates = json.loads(held.read())["success_rate"]
                    rows = [(unquote(checkpoint), unquote(seed), str(task), float(rate)) for task, rate in rates.items()]
                except (OSError, ValueError, KeyError, TypeError, AttributeError):
                    continue
                yield from rows

    @dataclass
    class Staged(WriterCommitMessage):
        files: list[tuple[str, str]]

    class Writer(DataSourceWriter):
        def __init__(self, path: str, tail: str) -> None:
            self.path, self.tail = path, tail

        def write(self, iterator):
            store, base = opened(self.path)
            runs: dict[tuple, dict] = {}
            for row in iterator:
                runs.setdefault((row.checkpoint, row.seed), {})[row.task] = row.rate
            files = []
            for (checkpoint, seed), rates in runs.items():
                folder = "/".join(x for x in (base, quote(checkpoint, safe=" "), quote(seed, safe=" "), self.tail) if x)
                store.create_dir(folder, recursive=True)
                staged = f"{folder}/.log.{uuid.uuid4().hex}"
                body = {"success_rate": dict(sorted(rates.items())), "total_success_rate": sum(rates.values()) / len(rates)}
                with store.open_output_stream(staged) as out:
                    out.write(json.dumps(body).encode())
                files.append((staged, f"{folder}/log.json"))
            return Staged(files)

        def commit(self, messages):
            store, _ = opened(self.path)
            for message in messages:
                for staged, place in message.files if message else ():
                    store.move(staged, place)

        def abort(self, messages):
            store, _ = opened(self.path)
            for message in messages:
                for staged, _ in message.files if message else ():
                    store.delete_file(staged)

    class RunLogs(DataSource):
        @classmethod
        def name(cls) -> str:
            return "run_logs"

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(self.options["path"], self.options.get("tail", ""))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], self.options.get("tail", ""))

    return RunLogs


def write_logs(rates: DataFrame, path: str, tail: str = "") -> None:
    """Write the logs of all runs in ``rates`` (checkpoint, seed, task, rate), each run in one task: a run has as many rows
    as there are tasks to evaluate. A log that is there already is replaced."""
    rates.sparkSession.dataSource.register(run_logs())
    runs = rates.select("checkpoint", "seed", "task", F.col("rate").cast("double").alias("rate")).repartition("checkpoint", "seed")
    runs.write.format("run_logs").option("tail", tail).mode("append").save(path)


def read_logs(spark: SparkSession, path: str, checkpoints: Sequence[str], seeds: Sequence[str], tail: str = "") -> DataFrame:
    """(checkpoint, seed, task, rate) of the runs there are among the given checkpoints and seeds."""
    spark.dataSource.register(run_logs())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    logs = spark.read.format("run_logs").option("tail", tail).load(path)
    return logs.where(F.col("checkpoint").isin(*checkpoints) & F.col("seed").isin(*seeds))
