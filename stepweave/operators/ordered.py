"""Ordered computations over groups of any size.

An episode is a group of rows with an order. Plain windows put one episode into one task, which fails when
one episode holds a large share of all rows. Here a group that is larger than a limit is cut into
consecutive *blocks*; its windows are partitioned by ``(keys, _blk)``, and what crosses a block border
travels in a small summary table (one row per block of an oversized group).

The limit is ``max(splitRows, rows / MAX_SPLITS)``. Hence at most ``MAX_SPLITS`` groups exceed it and the
blocks of all of them together number at most ``2 * MAX_SPLITS``: the tables that are broadcast below have
that proven bound. The group sizes are checked first (one narrow, map-side combined count); when no group
is oversized, which the metadata of ``_blk`` records, the plan is the plain window and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stepweave.session import cut_lineage, with_package

BLOCK = "_blk"
SPLIT_ROWS = "spark.stepweave.splitRows"
DEFAULT_SPLIT_ROWS = 1 << 16
MAX_SPLITS = 1 << 16
MAX_BUCKETS, SAMPLED = 4096, 16
WHOLE = {"stepweave": "no group is split"}


def order_value(df: DataFrame, order: str) -> Column:
    """Order column as a double, monotone in the column; times in microseconds whatever the session zone."""
    kind, value = df.schema[order].dataType.typeName(), F.col(order)
    if kind == "timestamp":
        return F.unix_micros(value).cast("double")
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind == "timestamp_ntz":
        whole = F.unix_date(value.cast("date")) * 86400.0 + F.hour(value) * 3600 + F.minute(value) * 60
        return (whole + F.extract(F.lit("SECOND"), value).cast("double")) * 1e6
    return value.cast("double")


def split_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SPLIT_ROWS, str(DEFAULT_SPLIT_ROWS)))


def oversized(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """Block borders of each group above the limit (``_edges``, ascending order values); None when there is none.

    Borders are quantiles of the group's order values, so blocks hold about as many rows each however the values
    are spread; rows of one order value stay together. By the choice of the limit there are at most MAX_SPLITS
    groups and 2 * MAX_SPLITS borders, so the table may pass through the driver.
    """
    floor = split_rows(df)
    value = order_value(df, order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # one pass over the keys, and no more where no group is oversized
    rows, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(floor, -(-(rows or 0) // MAX_SPLITS))
    if (most or 0) <= limit:
        return None
    large = sizes.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_nb"))
    found = large.collect()
    table = df.sparkSession.createDataFrame(found, large.schema)
    finest = max(r["_nb"] for r in found)
    shares = [i / finest for i in range(1, finest)]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rows_of = df.select(*keys, value.alias("_v")).alias("l").join(F.broadcast(table.alias("r")), same)
    cuts = F.percentile_approx("_v", F.array(*[F.lit(s) for s in shares]), F.lit(8 * finest))
    nth = F.sequence(F.lit(1), F.col("_nb") - 1)
    picked = F.transform(nth, lambda i: F.get(F.col("_cuts"), F.round(i * finest / F.col("_nb")).cast("int") - 1))
    edges = (rows_of.groupBy(*[f"l.{k}" for k in keys], "_nb").agg(cuts.alias("_cuts"))
             .select(*keys, F.coalesce(F.array_distinct(picked), F.array().cast("array<double>")).alias("_edges")))
    return df.sparkSession.createDataFrame(edges.collect(), edges.schema)


def _halvings(n: int) -> Column:
    return F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])


def _reached(value: Column, edges: Column, most: int) -> Column:
    """How many of the ascending ``edges`` (at most ``most``) are not above the value, by halving."""
    return F.aggregate(_halvings(most), F.lit(0), lambda at, jump: F.when(
        (at + jump <= F.size(edges)) & (F.get(edges, at + jump - 1) <= value), at + jump).otherwise(at))


def _position(value: Column) -> Column:
    """Block of an order value; monotone in the value. Null order values sort first, so block 0."""
    return F.coalesce(_reached(value, F.col("_edges"), MAX_SPLITS), F.lit(0))


def split(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``_blk`` (null for groups under the limit). A frame that already has it is returned as it is."""
    if BLOCK in df.columns:
        return df
    large = oversized(df, keys, order)
    if large is None:
        return df.withColumn(BLOCK, F.lit(None).cast("int").alias(BLOCK, metadata=WHOLE))
    value = order_value(df, order)
    joined = df.join(F.broadcast(large), list(keys), "left")
    return joined.withColumn(BLOCK, F.when(F.col("_edges").isNotNull(), _position(value))).drop("_edges")


def is_split(df: DataFrame) -> bool:
    """Whether some group may be cut into blocks."""
    return BLOCK in df.columns and df.schema[BLOCK].metadata != WHOLE


def _settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A split frame that is about to be read more than once, and how often its plan was doubled since the
    last checkpoint. A frame that was doubled before is checkpointed, so a chain of scans stays linear."""
    depth = df.schema[BLOCK].metadata.get("depth", 0)
    return (cut_lineage(df), 0) if depth else (df, depth)


def group_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*keys, BLOCK] if is_split(df) else list(keys)


@dataclass(frozen=True)
class Spec:
    """One output of :func:`scan`; build it with the functions below."""

    kind: str
    value: Column
    inclusive: bool = True
    how: str = ""


def last(value: Column, inclusive: bool = True) -> Spec:
    """Last non-null value up to the row (or before it)."""
    return Spec("last", value, inclusive)


def following(value: Column, inclusive: bool = False) -> Spec:
    """First non-null value after the row (or from it on)."""
    return Spec("next", value, inclusive)


def lead(value: Column) -> Spec:
    """Value of the next row; the value must never be null (wrap it in a struct otherwise)."""
    return Spec("lead", value, False)


def lag(value: Column) -> Spec:
    """Value of the row before; the value must never be null (wrap it in a struct otherwise)."""
    return Spec("lag", value, False)


def running(value: Column, inclusive: bool = True) -> Spec:
    """Running sum up to the row (or before it)."""
    return Spec("sum", value, inclusive)


def total(value: Column, how: str) -> Spec:
    """``sum``, ``min`` or ``max`` over the whole group, on every row."""
    return Spec("total", value, True, how)


_SHIFT = {"lead": F.lead, "lag": F.lag}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def scan(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    """Add one column per spec, computed over each group in ``order``; keeps ``_blk`` for the next step.

    ``order`` must be unique within a group; its first column decides the blocks.
    """
    order = [order] if isinstance(order, str) else list(order)
    df = split(df, keys, order[0])
    parts = group_keys(df, keys)
    joined, block = df, F.col(BLOCK)
    if is_split(df):
        df, depth = _settled(df)
        joined = df.join(F.broadcast(_context(df, keys, order, specs)), parts, "left")
        block = block.alias(BLOCK, metadata={"depth": depth + 1})

    ordered = Window.partitionBy(*parts).orderBy(*order)
    group = Window.partitionBy(*parts)
    out = [block if c == BLOCK else F.col(c) for c in df.columns if c not in specs]
    for name, spec in specs.items():
        carry = F.col(f"_c_{name}") if is_split(df) else F.lit(None)
        up_to = ordered.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        if spec.kind == "last":
            value = F.coalesce(F.last(spec.value, ignorenulls=True).over(up_to), carry)
        elif spec.kind == "next":
            # The same frame over the reverse order: a growing frame costs one step per row.
            back = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
            back = back.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
            value = F.coalesce(F.last(spec.value, ignorenulls=True).over(back), carry)
        elif spec.kind in ("lead", "lag"):
            value = F.coalesce(_SHIFT[spec.kind](spec.value).over(ordered), carry)
        elif spec.kind == "sum":
            value = F.coalesce(F.sum(spec.value).over(up_to), F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            value = F.coalesce(carry, _AGG[spec.how](spec.value).over(group))
        out.append(value.alias(name))
    return joined.select(*out)


def _context(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    """What each block of an oversized group receives from the others (at most 2 * MAX_SPLITS rows)."""
    position = F.struct(*order)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    summaries, carried = [], []
    for name, spec in specs.items():
        s, c = f"_s_{name}", f"_c_{name}"
        at = F.when(spec.value.isNotNull(), position)
        if spec.kind in ("last", "lag"):
            summaries.append(F.max_by(spec.value, at).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(earlier).alias(c))
        elif spec.kind in ("next", "lead"):
            summaries.append(F.min_by(spec.value, at).alias(s))
            carried.append(F.first(s, ignorenulls=True).over(later).alias(c))
        elif spec.kind == "sum":
            summaries.append(F.sum(spec.value).alias(s))
            carried.append(F.sum(s).over(earlier).alias(c))
        else:
            summaries.append(_AGG[spec.how](spec.value).alias(s))
            carried.append(_AGG[spec.how](s).over(whole).alias(c))
    blocks = df.where(F.col(BLOCK).isNotNull()).groupBy(*keys, BLOCK).agg(*summaries)
    return blocks.select(*keys, BLOCK, *carried)


def number_rows(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str) -> DataFrame:
    """0-based position of each row in its group."""
    return scan(df, keys, order, {name: running(F.lit(1), inclusive=False)})


def over_earlier_blocks(blocks: DataFrame, keys: Sequence[str], column: str,
                        merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Replace ``column`` by what all earlier blocks of the group hold together; null in the first block.

    ``blocks`` has one row per (keys, ``_blk``); ``merge(earlier, later)`` must be associative. Blocks are merged by
    doubling, a join per round on (keys, number), so no task sees more than two values of a group at a time. Rounds are
    the logarithm of the number of blocks in the largest group; each is checkpointed.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)) - 1
    state = cut_lineage(blocks.select(*keys, BLOCK, number.alias("_number"), column))
    most = (state.agg(F.max("_number")).first()[0] or 0) + 1
    reach = 1
    while reach < most - 1:
        earlier = state.select(*keys, (F.col("_number") + reach).alias("_number"), F.col(column).alias("_earlier"))
        merged = F.when(F.col("_earlier").isNull(), F.col(column)).otherwise(merge(F.col("_earlier"), F.col(column)))
        state = cut_lineage(state.join(earlier, [*keys, "_number"], "left").withColumn(column, merged).drop("_earlier"))
        reach *= 2
    moved = state.select(*keys, (F.col("_number") + 1).alias("_number"), column)
    return state.drop(column).join(moved, [*keys, "_number"], "left").drop("_number")


def prefix_list(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """List of the non-null values before each row.

    Within a block the list grows by a window over the block's rows. What earlier blocks hold is sent to every later
    block and gathered by (keys, block), so a task holds the history of one block at a time, never a whole oversized
    group. The lists are as long as the history, so the work is linear in the output.
    """
    df = split(df, keys, order)
    if is_split(df):
        df = cut_lineage(df)
    parts = group_keys(df, keys)
    window = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.collect_list(value).over(window)
    if not is_split(df):
        return df.withColumn(name, own)
    blocks = df.where(F.col(BLOCK).isNotNull())
    last = blocks.groupBy(*keys).agg(F.max(BLOCK).alias("_last"))
    held = F.array_sort(F.collect_list(F.struct(order, value.alias("_v"))))
    sent = (blocks.where(value.isNotNull()).groupBy(*keys, BLOCK).agg(F.transform(held, lambda x: x["_v"]).alias("_held"))
            .join(last, list(keys)).where(F.col(BLOCK) < F.col("_last"))
            .select(*keys, F.explode(F.sequence(F.col(BLOCK) + 1, F.col("_last"))).alias("_to"),
                    F.struct(F.col(BLOCK).alias("from"), F.col("_held").alias("held")).alias("_part")))
    gathered = F.array_sort(F.collect_list("_part"))
    before = sent.groupBy(*keys, F.col("_to").alias(BLOCK)).agg(
        F.flatten(F.transform(gathered, lambda x: x["held"])).alias("_before"))
    listed = df.withColumn(name, own).join(before, parts, "left")
    return listed.withColumn(name, F.when(F.col("_before").isNull(), F.col(name)).otherwise(
        F.concat("_before", name))).drop("_before").select(*df.columns, name)


OWN = "_own"


def with_neighbours(df: DataFrame, keys: Sequence[str], step: str, before: int, after: int,
                    build: Callable[[WindowSpec], Mapping[str, Column]]) -> DataFrame:
    """Window columns that look at most ``before``/``after`` steps away.

    Rows near a block border of an oversized group are copied into the neighbouring block, so there is one
    exchange and no second pass over the rows; the copies are dropped after the windows. ``build`` gets the
    window spec and must use ``rangeBetween`` within the announced bounds.
    """
    base = df.drop(BLOCK) if is_split(df) else df
    large = oversized(base, keys, step) if BLOCK not in base.columns else None
    if large is None:
        columns = build(Window.partitionBy(*keys).orderBy(step))
        kept = [F.col(c) for c in base.columns if c not in columns]
        return base.select(*kept, *[c.alias(n) for n, c in columns.items()])
    value = order_value(base, step)
    joined = base.join(F.broadcast(large), list(keys), "left")
    home = F.when(F.col("_edges").isNotNull(), _position(value))
    blocks = F.when(F.col("_edges").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
        F.sequence(_position(value - after), _position(value + before)))
    copied = (joined.withColumn(OWN, home).withColumn(BLOCK, F.explode(blocks))
              .withColumn(OWN, F.col(OWN).eqNullSafe(F.col(BLOCK))).drop("_edges"))
    columns = build(Window.partitionBy(*keys, BLOCK).orderBy(step))
    kept = [F.col(c) for c in base.columns if c not in columns]
    return (copied.select(*kept, BLOCK, OWN, *[c.alias(n) for n, c in columns.items()])
            .where(F.col(OWN)).drop(OWN))


def number_all(df: DataFrame, bucket: Column, order: Sequence[str | Column],
               weights: Mapping[str, Column]) -> DataFrame:
    """Running weight before each row, over all rows, without a single-task window; weight 1 numbers rows.

    ``bucket`` is monotone in ``order`` and takes a bounded number of values (at most MAX_SPLITS), so the
    table of bucket offsets is broadcast with a proven bound. See ``quantile_bucket``.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy("_bucket").agg(*[F.sum(w).alias(f"_size_{n}") for n, w in weights.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", *[
        F.coalesce(F.sum(f"_size_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in weights])
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.select(*marked.columns, *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(n)
                                                for n, w in weights.items()])
    joined = numbered.join(F.broadcast(offsets), "_bucket")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_offset_{n}")).alias(n) for n in weights])


def quantile_bucket(df: DataFrame, columns: Sequence[str]) -> Column:
    """Bucket of a row by its place in the order of ``columns``: at most MAX_BUCKETS, of about equal numbers of rows.

    Borders come from a sample of the rows of least hash, SAMPLED per border, which bounds what the driver sees; they
    only balance the buckets.
    """
    buckets = min(MAX_BUCKETS, -(-df.count() // split_rows(df)))
    if buckets < 2:
        return F.lit(0)
    drawn = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SAMPLED * buckets).orderBy(*columns).collect()
    kinds = [df.schema[c].dataType for c in columns]
    edges = [drawn[i * len(drawn) // buckets] for i in range(1, buckets)]
    borders = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(e, kinds, columns)]) for e in edges])
    return _reached(F.struct(*columns), borders, buckets)


def _begins(batch: pa.RecordBatch, keys: Sequence[str], before: dict | None) -> np.ndarray:
    """True at rows that begin a group; ``before`` is the row ahead of the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None or any(batch.column(k)[0].as_py() != before[k] for k in keys)
    for k in keys:
        later, earlier = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(later, earlier), False).to_numpy(zero_copy_only=False)
        null = pc.xor(pc.is_null(later), pc.is_null(earlier)).to_numpy(zero_copy_only=False)
        new[1:] |= differ | null
    return new


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], order: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of a sorted partition and where groups begin in them; rows out of order raise."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _begins(batch, keys, before)
        at = batch.column(order).to_numpy(zero_copy_only=False)
        ahead = at[:1] if before is None else np.array([before[order]], at.dtype)
        if (np.diff(at, prepend=ahead) < 0)[~new].any():
            raise ValueError(f"rows arrived out of {order} order")
        before = batch.slice(batch.num_rows - 1).to_pylist()[0]
        yield batch, new


def composed(moves: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where each state leads from the first row of a row's run through the row itself: a segmented scan by doubling.

    ``moves`` is (rows, states). A run starts at the first row and wherever ``begins`` is true.
    """
    rows = np.arange(len(moves))
    at = rows - np.maximum.accumulate(np.where(begins, rows, 0))
    maps, reach = moves.copy(), 1
    while reach <= at.max():
        later = np.flatnonzero(at >= reach)
        maps[later] = np.take_along_axis(maps[later], maps[later - reach], axis=1)
        reach *= 2
    return maps


def finite_scan(df: DataFrame, keys: Sequence[str], order: str, states: int, start: int, moves: Column,
                name: str) -> DataFrame:
    """Entry state of a finite-state machine at each row, for groups of any size.

    ``moves`` is an array of ``states`` next states, indexed by the current state. Moves compose associatively, so an
    Arrow batch of a sorted partition is scanned by doubling over all its groups at once, and carries one state on. The
    blocks of an oversized group are evaluated independently, and their ``states``-long compositions are combined by
    doubling too. No group is held in memory; pass a narrow frame.
    """
    keys, steps = list(keys), [f"_move{s}" for s in range(states)]
    df = split(df, keys, order)
    kept = list(df.columns)
    df = df.withColumn("_moves", moves).select(*kept, *[F.col("_moves")[s].cast("int").alias(m) for s, m in enumerate(steps)])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(m).to_numpy(zero_copy_only=False) for m in steps], 1).astype(np.int64)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ident = None, None
        for batch, new in _runs(batches, [*keys, BLOCK], order):
            maps = composed(matrix(batch), new)
            ends = np.append(np.flatnonzero(new[1:]), batch.num_rows - 1)
            found = maps[ends]
            if not new[0]:
                found[0] = found[0][held]
            elif held is not None:
                yield with_map(ident, [held])
            ident, held = batch.select([*keys, BLOCK]).slice(batch.num_rows - 1), found[-1]
            if len(ends) > 1:
                yield with_map(batch.select([*keys, BLOCK]).take(pa.array(ends[:-1])), found[:-1])
        if held is not None:
            yield with_map(ident, [held])

    def with_map(ident: pa.RecordBatch, maps: Sequence[np.ndarray]) -> pa.RecordBatch:
        maps = pa.array([m.tolist() for m in maps], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*ident.columns, maps], names=[*ident.schema.names, "_map"])

    def replay(parts: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch, new in _runs(batches, parts, order):
            rows = np.arange(batch.num_rows)
            maps = composed(matrix(batch), new)
            first = np.maximum.accumulate(np.where(new, rows, 0))
            entry = pc.fill_null(batch.column("_entry"), start).to_numpy(zero_copy_only=False).astype(np.int64)
            if not new[0]:
                entry[0] = state
            entry = entry[first]
            seen = np.where(rows == first, entry, maps[rows - 1, entry])
            state = int(maps[-1, entry[-1]])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(seen, pa.int32())], names=[*kept, name])

    if is_split(df):
        df = cut_lineage(df)
        hot = df.where(F.col(BLOCK).isNotNull()).select(*keys, BLOCK, order, *steps)
        ident = _ddl(df, [*keys, BLOCK])
        maps = _arranged(hot, [*keys, BLOCK], order).mapInArrow(effects, f"{ident}, _map array<int>")
        entered = over_earlier_blocks(maps, keys, "_map", lambda a, b: F.transform(a, lambda x: F.element_at(b, x + 1)))
        entry = entered.select(*keys, BLOCK, F.element_at("_map", start + 1).alias("_entry"))
        # one row per block of an oversized group, at most 2 * MAX_SPLITS
        marked = df.join(F.broadcast(entry), [*keys, BLOCK], "left").select(*kept, *steps, "_entry")
    else:
        marked = df.withColumn("_entry", F.lit(None).cast("int"))
    parts = group_keys(df, keys)
    out = _arranged(marked, parts, order).mapInArrow(lambda batches: replay(parts, batches),
                                                     f"{_ddl(marked, kept)}, `{name}` int")
    if not is_split(df):
        out = out.withColumn(BLOCK, F.lit(None).cast("int").alias(BLOCK, metadata=WHOLE))
    return out


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _arranged(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows of a group in one partition, contiguous and in order, for a Python function."""
    return with_package(df).repartition(*keys).sortWithinPartitions(*keys, order)
