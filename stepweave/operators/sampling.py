"""Seeded shuffles, batches, shards and picks; every draw is a hash of the row's own key."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import rng
from stepweave.operators import ordered as o


def shuffle(df: DataFrame, seed: int, key: str, rank: str = "rank") -> DataFrame:
    """A permutation by (md5(seed:key), key), as a 0-based ``rank``.

    The first 16 bits of the hash are the bucket: 65536 even buckets are sorted independently and shifted by
    the broadcast bucket counts, so no task sees all rows.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    return o.number_all(hashed, bucket, ["_h", key], {rank: F.lit(1)}).drop("_h")


# A keyed permutation of row numbers: ranks are computed, not sorted for.

ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """Sides of a rectangle that holds ``n`` numbers and few more."""
    side = math.isqrt(max(n - 1, 0)) + 1
    return min(((-(-n // b), b) for b in range(side, side + 4096)), key=lambda s: s[0] * s[1])


def _turned(x: Column, n: int, key: str, back: bool) -> Column:
    """One pass of Feistel rounds over the rectangle, or its inverse."""
    a, b = _sides(n)
    sign = -1 if back else 1

    def turn(acc: Column, k: Column) -> Column:
        other = F.when(k % 2 == 0, acc["r"]).otherwise(acc["l"])
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(key), k.cast("string"), other.cast("string"))), 1, 15), 16, 10)
        drawn = drawn.cast("bigint")
        return F.struct(F.when(k % 2 == 0, F.pmod(acc["l"] + sign * (drawn % a), F.lit(a))).otherwise(acc["l"]).alias("l"),
                        F.when(k % 2 == 1, F.pmod(acc["r"] + sign * (drawn % b), F.lit(b))).otherwise(acc["r"]).alias("r"))

    order = range(ROUNDS)[::-1] if back else range(ROUNDS)
    start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, turn, lambda acc: acc["l"] * b + acc["r"])


def _walked(x: Column, n: int, key: str, back: bool) -> Column:
    """Passes until the number lies below ``n``; only as many numbers as lie above can be met on the way."""
    a, b = _sides(n)
    once = _turned(x.cast("bigint"), n, key, back)
    if a * b == n:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once,
                       lambda acc, _: F.when(acc < n, acc).otherwise(_turned(acc, n, key, back)))


def permuted(index: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """Rank of a row number in 0..n-1 in the epoch's permutation: a keyed bijection, so nothing is sorted or shuffled."""
    return _walked(index, n, f"{seed}.{epoch}", False)


def unpermuted(rank: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """Row number of a rank."""
    return _walked(rank, n, f"{seed}.{epoch}", True)


def epoch_batches(df: DataFrame, index: str, n: int, size: int, seed: int, epoch: int = 0, workers: int = 1,
                  worker: int = 0) -> DataFrame:
    """``rank``, ``batch`` and ``slot`` of the rows of one worker in an epoch, computed row by row.

    ``index`` numbers the rows of ``df`` from 0 to n - 1. A worker takes every ``workers``-th rank; the tails of shards and
    of batches are dropped, and a dataset smaller than a batch raises.
    """
    own = n // workers
    if own < size:
        raise ValueError("dataset is smaller than one batch")
    ranked = df.withColumn("rank", permuted(F.col(index), n, seed, epoch))
    at = F.floor(F.col("rank") / workers)
    mine = ranked.where((F.col("rank") % workers == worker) & (F.col("rank") < own * workers) & (at < own // size * size))
    return mine.withColumns({"batch": F.floor(at / size).cast("bigint"), "slot": (at % size).cast("int")})


def resumed(spark: SparkSession, n: int, size: int, seed: int, cursor: int, count: int, index: str = "index") -> DataFrame:
    """The next ``count`` batches behind a cursor, the number of batches delivered before: (draw, epoch, slot, index).

    Row numbers follow from ranks by the inverse permutation; past the end of an epoch the next one begins. Join the result
    with a table by ``index`` to fetch the rows.
    """
    each = n // size
    if not each:
        raise ValueError("dataset is smaller than one batch")
    parts = []
    for epoch in range(cursor // each, (cursor + count - 1) // each + 1):
        first, last = max(cursor, epoch * each), min(cursor + count, (epoch + 1) * each)
        ranks = spark.range((first - epoch * each) * size, (last - epoch * each) * size).withColumnRenamed("id", "rank")
        parts.append(ranks.select((F.floor(F.col("rank") / size) + epoch * each).alias("draw"), F.lit(epoch).alias("epoch"),
                                  (F.col("rank") % size).cast("int").alias("slot"),
                                  unpermuted(F.col("rank"), n, seed, epoch).alias(index)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def batches(df: DataFrame, size: int, rank: str = "rank") -> DataFrame:
    """``batch`` and ``slot`` of ranked rows; the incomplete last batch is dropped, too few rows raise."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    batch = F.floor(F.col(rank) / size).cast("bigint")
    checked = F.when(n < size, F.raise_error(F.lit("dataset is smaller than one batch")).cast("bigint")).otherwise(batch)
    return (df.withColumn("batch", checked).where(F.col("batch") < F.floor(n / size))
            .withColumn("slot", (F.col(rank) % size).cast("int")))


def stack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a batch as arrays in slot order (a batch has a fixed size)."""
    rows = F.array_sort(F.collect_list(F.struct("slot", *columns)))
    packed = df.groupBy("batch").agg(rows.alias("_rows"))
    return packed.select("batch", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def take_batches(df: DataFrame, size: int, count: int, rank: str = "rank") -> DataFrame:
    """``count`` batches; past the end they start over. ``draw`` numbers the delivered batches."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = batches(df, size, rank).where(F.col("batch") < count)
    draws = F.sequence(F.col("batch"), F.lit(count - 1).cast("bigint"), F.floor(n / size).cast("bigint"))
    return cut.withColumn("draw", F.explode(draws))


def shard(df: DataFrame, workers: int, worker: int, rank: str = "rank") -> DataFrame:
    """Every ``workers``-th row of the permutation for one worker; shards are equal, the tail is dropped."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.where((F.col(rank) % workers == worker) & (F.col(rank) < F.floor(n / workers) * workers))


def map_batched(df: DataFrame, fn: Callable[[DataFrame], DataFrame], columns: Sequence[str],
                out: Sequence[str] | None = None) -> DataFrame:
    """Batched columns to rows, a row transform, and back to batches of the same size."""
    rows = df.select("batch", F.posexplode(F.arrays_zip(*[F.col(c) for c in columns])).alias("slot", "_r"))
    flat = rows.select("batch", "slot", *[F.col(f"_r.{c}").alias(c) for c in columns])
    return stack(fn(flat), list(out or columns))


def pick(df: DataFrame, column: str, count: int, seed: int, *key: str, name: str) -> DataFrame:
    """One element of an array of ``count``, one draw per key."""
    index = rng.below(count, seed, *[F.col(k) for k in key])
    return df.withColumn(name, F.element_at(F.col(column), index + 1))


def swap_online(df: DataFrame, seed: int, *key: str, p: float = 0.5, symbolic: bool = True,
                columns: Sequence[str] = ("simple_subgoal", "grounded_subgoal"), suffix: str = "_online") -> DataFrame:
    """With probability p use the online texts, all columns together; only for symbolic memory."""
    if not symbolic:
        return df
    u = rng.uniform(seed, *[F.col(k) for k in key])
    return df.withColumns({c: F.when(u < p, F.col(f"{c}{suffix}")).otherwise(F.col(c)) for c in columns})


def fake_dataset(source: SparkSession | DataFrame, spec: Mapping[str, tuple[str, int]], n: int | None = None,
                 seed: int = 0, index: str = "index") -> DataFrame:
    """Rows seeded by their index: ``float`` columns in [-1, 1), ``int`` in [0, 2048), others zero.

    ``spec`` maps a ``/`` path to (kind, length). The source is a session (``n`` rows) or a frame whose
    ``index`` column names the rows.
    """
    from stepweave.operators.shape import _structs, _tree

    rows = source.range(n).withColumnRenamed("id", index) if isinstance(source, SparkSession) else source.select(index)

    def values(path: str, kind: str, length: int) -> Column:
        slots = F.sequence(F.lit(0), F.lit(length - 1))
        if kind == "float":
            return F.transform(slots, lambda i: (rng.uniform(seed, F.col(index), F.lit(path), i) * 2 - 1).cast("float"))
        if kind == "int":
            return F.transform(slots, lambda i: rng.below(2048, seed, F.col(index), F.lit(path), i))
        return F.transform(slots, lambda i: F.lit(0))

    return rows.select(index, *_structs(_tree({p: values(p, k, n_) for p, (k, n_) in spec.items()})))
