"""Running a streaming query over what is available and reading its table back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Custom state needs the RocksDB provider. Nothing here waits for a watermark, so batches without data, which a state
    with an expiry would ask for without end, are switched off."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def write_slices(df: DataFrame, order: Column, folder: str, slices: int) -> None:
    """Write a table once, with its rows dealt to ``slices`` consecutive slices by an even split of ``order``.

    The slices become appends of the stream on ``folder`` one after another, when the stream is run.
    """
    keyed = df.withColumn("_order", order.cast("double"))
    lo, hi = keyed.agg(F.min("_order"), F.max("_order")).head()
    at = F.floor((F.col("_order") - lo) / ((hi - lo) / slices or 1.0)) if lo is not None else F.lit(0)
    (keyed.withColumn("_slice", F.least(at, F.lit(slices - 1)).cast("int")).drop("_order")
     .write.mode("overwrite").partitionBy("_slice").parquet(f"{folder}-slices"))


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """The sliced table as a stream on ``folder``; each slice is one micro-batch, however many files it has."""
    schema = spark.read.parquet(f"{folder}-slices").drop("_slice").schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def run_appends(start: Callable[[], StreamingQuery], spark: SparkSession, folder: str) -> None:
    """Append the slices in order and run the query to the end of what is there after each."""
    source = spark.read.parquet(f"{folder}/in-slices")
    for (number,) in sorted(source.select("_slice").distinct().collect()):  # as many rows as slices
        source.where(F.col("_slice") == number).drop("_slice").write.mode("append").parquet(f"{folder}/in")
        start().awaitTermination()


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append query to the end of the available input and return its table."""
    use_state_store(stream.sparkSession)
    writer = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
              .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True))
    run_appends(writer.start, stream.sparkSession, folder)
    return stream.sparkSession.read.parquet(f"{folder}/out")


def run_complete(stream: DataFrame, folder: str, columns: Sequence[str] = ()) -> DataFrame:
    """Run an aggregation in complete mode; the table holds the last result."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    writer = (stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
              .outputMode("complete").trigger(availableNow=True))
    run_appends(writer.start, stream.sparkSession, folder)
    table = stream.sparkSession.read.parquet(f"{folder}/out")
    return table.select(*columns) if columns else table


def run_folds(stream: DataFrame, folder: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """Fold micro-batches into a state table and return its versions, ``as_of`` numbering the micro-batches.

    ``fold`` merges a micro-batch with the state before it (None at first). Version n is written from version n - 1 and
    micro-batch n alone, so a micro-batch that is run again replaces its own version.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/state/as_of={batch_id - 1}") if batch_id else None
        held = batch.persist()
        fold(held, before).write.mode("overwrite").parquet(f"{folder}/state/as_of={batch_id}")
        held.unpersist()

    writer = (stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint")
              .outputMode("append").trigger(availableNow=True))
    run_appends(writer.start, spark, folder)
    return spark.read.parquet(f"{folder}/state")
