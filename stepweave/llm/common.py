"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.session import shared_dir

CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
SPARE = 4
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with ``place``: range-sorted, its upper bits number the range and the lower 33 the row within it.

    ``order`` should tell all rows apart, or ties meet in one range. The table is written, so places stay as they are.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("place", F.monotonically_increasing_id()), name)


def _offsets(placed: DataFrame, amount: "F.Column") -> DataFrame:
    """What lies before each range: one row per range, so the window and the broadcast are bounded by their number."""
    sums = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.sum(amount).alias("amount"))
    before = F.sum("amount").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("range", F.coalesce(before, F.lit(0)).alias("offset")))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with ``position`` (long, from 0) in the given order (nulls first)."""
    placed = ranged(df, name, *order)
    rows = placed.withColumn("range", F.shiftright("place", 33)).join(_offsets(placed, F.lit(1)), "range", "left")
    position = F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1)
    return rows.select(*df.columns, position.alias("position"))


def running(df: DataFrame, name: str, amount: str, *order: str) -> DataFrame:
    """The rows with ``before``, the sum of ``amount`` over all rows ahead in the given order (nulls first)."""
    placed = ranged(df, name, *order)
    window = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = (placed.withColumn("range", F.shiftright("place", 33))
            .withColumn("inside", F.coalesce(F.sum(amount).over(window), F.lit(0)))
            .join(_offsets(placed, F.col(amount)), "range", "left"))
    return rows.select(*df.columns, (F.col("offset") + F.col("inside")).alias("before"))


def id_text() -> "F.Column":
    """doc_id as text; a missing id reads as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def text_key() -> "F.Column":
    """128-bit hash of the text; a missing text reads as the empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the ``rows`` (doc_id, text_key); missing ids equal each other."""
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("bigint").alias("row_id"), text_key().alias("row_key"))
    rows = rows.select(F.col("doc_id").alias("judged_id"), F.col("text_key").alias("judged_key"))
    return keyed.join(rows, F.col("row_id").eqNullSafe(F.col("judged_id")) & (F.col("row_key") == F.col("judged_key")),
                      how).select("row.*")


def whole_row(docs: DataFrame) -> "F.Column":
    """All columns in one struct ``row``, beside which an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def fold(of: int, held: int) -> "F.Column":
    """True where crc32(doc_id as text) mod ``of`` is ``held``; a row without an id is never learned from."""
    return (F.crc32(id_text().cast("binary")) % of == held) | F.col("doc_id").isNull()


def drawn(df: DataFrame, hashed: "F.Column", n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of least hash. Rows are counted first, and only about SPARE * n of least hash are sorted, so what
    tasks send on does not grow with their number. ``hashed`` is a 64-bit hash that spreads the rows evenly."""
    total = df.count()
    if total > SPARE * n:
        df = df.where(hashed <= int(-(1 << 63) + SPARE * n / total * (1 << 64)))
    return df.orderBy(hashed, *ties).limit(n)


def _trim() -> None:
    """Give back what the allocators keep of freed memory, so that an idle Python worker is small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most about ``BATCH_BYTES`` on either side, and workers trimmed after each task.

    The batch size is a setting of the session, read when the frame is computed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _trim()
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts as bytes (null: empty).

    A single longer text makes a slice of its own; texts are never cut.
    """
    def texts(part: pa.RecordBatch) -> list[bytes]:
        return [t or b"" for t in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
        first, held = 0, 0
        for at, size in enumerate(sizes):
            if held and held + size > limit:
                part = batch.slice(first, at - first)
                yield part, texts(part)
                first, held = at, 0
            held += size + 16
        if first < len(sizes):
            part = batch.slice(first)
            yield part, texts(part)


def to_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
         for f in schema for x in [columns[f.name]]], schema=schema)
