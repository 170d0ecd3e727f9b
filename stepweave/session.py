"""Session defaults and the reliable checkpoint folder."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "stepweave",
                  partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (builder.config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stepweave"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that Python functions can import it.

    The archive goes through the shared folder, not through the driver's own disk.
    """
    context = spark.sparkContext
    if getattr(context, "_stepweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/stepweave.zip"
    jvm = context._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    stream.write(held.getvalue())
    stream.close()
    context.addPyFile(place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString())
    # streams with state start one Python process beside the driver, which sees no added file
    context.environment.setdefault("PYTHONPATH", os.path.dirname(root))
    context._stepweave_shipped = True


def with_package(df: DataFrame) -> DataFrame:
    """The frame, after the package was sent to the executors: for operators that run Python functions."""
    ship_package(df.sparkSession)
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
