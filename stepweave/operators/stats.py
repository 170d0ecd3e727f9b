"""Vector statistics: moments, histogram quantiles, mergeable state, masked means."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions import vectors as v

BINS = 5000


def _exploded(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(dim, x) per vector element; arrays of vectors are flattened to vectors first."""
    narrow = df.select(*by, F.col(column).alias("_v"))
    while narrow.schema["_v"].dataType.elementType.typeName() == "array":
        narrow = narrow.select(*by, F.explode("_v").alias("_v"))
    return narrow.select(*by, F.posexplode("_v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def vector_moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per dimension: mean, population std, min, max, count (partial aggregation before the shuffle)."""
    return _exploded(df, column, by).groupBy(*by, "dim").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.count("x").alias("count"))


def vector_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The same as arrays in one row; fewer than two vectors or vectors of different lengths raise."""
    rows = vector_moments(df, column, by)
    names = ["mean", "std", "min", "max"]
    sorted_rows = F.array_sort(F.collect_list(F.struct("dim", *names)))
    packed = rows.groupBy(*by).agg(sorted_rows.alias("_r"), F.min("count").alias("count"), F.max("count").alias("_most"))
    checked = (F.when(F.col("count") < 2, F.raise_error(F.lit("fewer than 2 vectors")).cast("bigint"))
               .when(F.col("count") != F.col("_most"), F.raise_error(F.lit("vectors differ in length")).cast("bigint"))
               .otherwise(F.col("count")))
    return packed.select(*by, *[F.col(f"_r.{n}").alias(n) for n in names], checked.alias("count"))


def hist_quantiles(df: DataFrame, column: str, qs: Sequence[float] = (0.01, 0.99), bins: int = BINS,
                   exact_bins: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """One row per dimension with a column ``q01``-like per quantile: the left edge of the first bin whose
    cumulative count reaches q * n. Two passes: range, then counts per (dim, bin).

    ``exact_bins=False`` uses Spark's approximate percentile in one pass instead. The range table has one
    row per dimension of a vector and is broadcast; pass it as ``ends`` (dim, lo, hi, n) when it is known.
    """
    names = [f"q{round(q * 100):02d}" for q in qs]
    cells = _exploded(df, column)
    if not exact_bins:
        return cells.groupBy("dim").agg(*[F.percentile_approx("x", q, 10000).alias(n) for q, n in zip(qs, names)])
    if ends is None:
        ends = cells.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    return _bin_quantiles(cells, ends, qs, bins)


def _bin_quantiles(cells: DataFrame, ends: DataFrame, qs: Sequence[float], bins: int) -> DataFrame:
    """Quantile columns per ``dim`` of the values ``x``; ``ends`` has the range and number of each."""
    names = [f"q{round(q * 100):02d}" for q in qs]
    width = F.col("hi") - F.col("lo")
    raw = F.when(width > 0, F.floor((F.col("x") - F.col("lo")) / width * bins)).otherwise(F.lit(0))
    counts = (cells.join(F.broadcast(ends), "dim")
              .groupBy("dim", F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                   F.first("n").alias("n")))
    running = Window.partitionBy("dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("cum", F.sum("c").over(running))
    edges = [(F.first("lo") + F.min(F.when(F.col("cum") >= q * F.col("n"), F.col("bin")))
              * (F.first("hi") - F.first("lo")) / float(bins)).alias(n) for q, n in zip(qs, names)]
    return reached.groupBy("dim").agg(*edges)


def partial_stats(df: DataFrame, column: str) -> DataFrame:
    """Mergeable state per dimension: count, mean, mean of squares, min, max."""
    return _exploded(df, column).groupBy("dim").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("mean_sq"),
        F.min("x").alias("min"), F.max("x").alias("max"))


def merge_stats(*parts: DataFrame) -> DataFrame:
    """States folded with weights count / total."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    n = F.sum("count")
    return merged.groupBy("dim").agg(
        (F.sum(F.col("mean") * F.col("count")) / n).alias("mean"),
        (F.sum(F.col("mean_sq") * F.col("count")) / n).alias("mean_sq"),
        F.min("min").alias("min"), F.max("max").alias("max"), n.alias("count"))


def final_stats(state: DataFrame) -> DataFrame:
    spread = F.greatest(F.lit(0.0), F.col("mean_sq") - F.col("mean") * F.col("mean"))
    return state.select("dim", "mean", F.sqrt(spread).alias("std"), "min", "max", "count")


def fixed_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per (dim, bin) on given edges; histograms of parts add up.

    Values below ``lo`` are bin -1 and values above ``hi`` are bin ``bins``, so no value is lost.
    """
    return _exploded(df, column).groupBy("dim", bin_of(F.col("x"), lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of a value on equal edges; -1 below them, ``bins`` above them."""
    inner = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return F.when(x < lo, F.lit(-1)).when(x > hi, F.lit(bins)).otherwise(inner)


# Histograms whose bins widen with the range. Bin k of exponent e holds [k * 2**e, (k + 1) * 2**e), so two bins of one
# exponent are exactly one bin of the next, and states of any ranges merge without splitting a bin.

WIDENING_BINS = 8192
LEAST_EXPONENT = -900


def bin_exponent(lo: Column, hi: Column, bins: int = WIDENING_BINS) -> Column:
    """Least exponent at which the range needs about ``bins`` bins, and bin numbers are exact in a double."""
    by_width = F.when(hi > lo, F.ceil(F.round(F.log2((hi - lo) / F.lit(float(bins))), 9)))
    size = F.greatest(F.abs(lo), F.abs(hi))
    by_size = F.when(size > 0, F.floor(F.round(F.log2(size), 9)) - 50)
    return F.greatest(by_width, by_size, F.lit(LEAST_EXPONENT)).cast("int")


def widening_histogram(df: DataFrame, column: str, bins: int = WIDENING_BINS) -> DataFrame:
    """Mergeable state (dim, exponent, bin, count, lo, hi) of the vectors: at most about ``bins`` rows per dimension.

    Two passes over these rows, range and counts; what is merged later is never read again. The range table has one row
    per dimension of a vector and is broadcast.
    """
    cells = _exploded(df, column).where("x IS NOT NULL")
    ends = cells.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.withColumn("exponent", bin_exponent(F.col("lo"), F.col("hi"), bins))
    number = F.floor(F.col("x") * F.pow(F.lit(2.0), -F.col("exponent"))).cast("bigint")
    return (cells.join(F.broadcast(ends), "dim").groupBy("dim", "exponent", number.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))


def merge_histograms(*parts: DataFrame, bins: int = WIDENING_BINS) -> DataFrame:
    """One state of several: their bins are widened to the exponent of the common range and added up.

    The result does not depend on how rows were dealt to the parts, nor on the order of merges.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ends = rows.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = ends.withColumn("wide", bin_exponent(F.col("lo"), F.col("hi"), bins))
    number = F.floor(F.col("bin") * F.pow(F.lit(2.0), F.col("exponent") - F.col("wide"))).cast("bigint")
    return (rows.drop("lo", "hi").join(F.broadcast(ends), "dim").groupBy("dim", F.col("wide").alias("exponent"), number.alias("bin"))
            .agg(F.sum("count").alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))


def histogram_quantiles(state: DataFrame, qs: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """Per dimension ``count`` and, per quantile, the left edge of the first bin whose cumulative count reaches q * count,
    but not under the least value."""
    names = [f"q{round(q * 100):02d}" for q in qs]
    upto = Window.partitionBy("dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("count").over(Window.partitionBy("dim"))
    reached = state.withColumn("cum", F.sum("count").over(upto)).withColumn("n", whole)
    edge = F.greatest(F.col("lo"), F.col("bin") * F.pow(F.lit(2.0), F.col("exponent")))
    return reached.groupBy("dim").agg(
        F.first("n").alias("count"), *[F.min(F.when(F.col("cum") >= q * F.col("n"), edge)).alias(n) for q, n in zip(qs, names)])


def masked_mean(df: DataFrame, values: str, mask: str, leading: bool = False) -> DataFrame:
    """Mean per position over rows whose mask is true; 0 when none. ``leading`` averages an outer axis first."""
    x = F.col(values)
    if leading:
        x = F.transform(F.get(x, F.lit(0)), lambda _, i: F.aggregate(
            F.transform(F.col(values), lambda row: F.get(row, i).cast("double")), F.lit(0.0), lambda a, b: a + b)
            / F.size(values))
    pairs = df.select(F.posexplode(F.arrays_zip(x.alias("v"), F.col(mask).alias("m"))).alias("pos", "p"))
    kept = F.avg(F.when(F.col("p.m"), F.col("p.v").cast("double")))
    return pairs.groupBy("pos").agg(F.coalesce(kept, F.lit(0.0)).alias("mean"),
                                    F.count_if(F.col("p.m")).alias("used"))


def interval_means(df: DataFrame, metrics: Sequence[str], interval: int, keys: Sequence[str] = ("epis_idx",),
                   step: str = "step_idx") -> DataFrame:
    """Mean of each metric per log interval: {0}, then (k-1)I+1..kI; an unfinished tail is not logged."""
    log = F.ceil(F.col(step) / interval).cast("int")
    means = df.groupBy(*keys, log.alias("interval")).agg(
        *[F.avg(m).alias(m) for m in metrics], F.max(step).alias("_last"))
    return means.where(F.col("_last") == F.col("interval") * interval).drop("_last")


@dataclass(frozen=True)
class NormStats:
    """Statistics of one vector column; as long as a vector, so they travel as literals."""

    mean: list[float]
    std: list[float]
    q01: list[float] | None = None
    q99: list[float] | None = None


def collect_norm_stats(df: DataFrame, column: str) -> NormStats:
    """Moments and quantiles of a vector column; see ``collect_all_stats``."""
    return collect_all_stats(df, [column])[column]


def collect_all_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, NormStats]:
    """Moments and quantiles of vector columns, or of columns of vectors, in two passes for all of them together: moments
    and range, then histograms. A row per dimension comes to the driver."""
    def cells(name: str) -> Column:
        def of(vector: Column) -> Column:
            return F.transform(vector, lambda x, i: F.struct(
                F.lit(columns.index(name)).alias("c"), i.alias("d"), x.cast("double").alias("x")))
        value, kind = F.col(name), df.schema[name].dataType.elementType
        if kind.typeName() != "array":
            return of(value)
        while kind.elementType.typeName() == "array":
            value, kind = F.flatten(value), kind.elementType
        return F.flatten(F.transform(value, of))

    rows = df.select(F.explode(F.concat(*[cells(c) for c in columns])).alias("_e")).select(
        F.struct("_e.c", "_e.d").alias("dim"), F.col("_e.x").alias("x"))
    moments = rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"),
                                      F.max("x").alias("hi"), F.count("x").alias("n")).collect()
    if {r["dim"].c for r in moments} != set(range(len(columns))) or min(r["n"] for r in moments) < 2:
        raise ValueError("cannot compute statistics for fewer than 2 vectors")
    ends = df.sparkSession.createDataFrame([(r["dim"], r["lo"], r["hi"], r["n"]) for r in moments],
                                           "dim struct<c:int,d:int>, lo double, hi double, n bigint")
    edges = {tuple(r["dim"]): r for r in _bin_quantiles(rows, ends, (0.01, 0.99), BINS).collect()}
    out = {}
    for c, name in enumerate(columns):
        own = sorted((r for r in moments if r["dim"].c == c), key=lambda r: r["dim"].d)
        out[name] = NormStats(*[[float(r[n]) for r in own] for n in ("mean", "std")],
                              *[[float(edges[tuple(r["dim"])][n]) for r in own] for n in ("q01", "q99")])
    return out


def _apply(df: DataFrame, stats: dict[str, NormStats] | None, use_quantiles: bool, by_z, by_q) -> DataFrame:
    if stats is None:
        return df
    for name, s in stats.items():
        if name not in df.columns:
            raise ValueError(f"column {name} named in the stats is missing")
        if use_quantiles and (s.q01 is None or s.q99 is None):
            raise ValueError(f"quantile stats of {name} are missing")
        a, b = (s.q01, s.q99) if use_quantiles else (s.mean, s.std)
        fn = by_q if use_quantiles else by_z
        args = v.literal([float(x) for x in a]), v.literal([float(x) for x in b])
        nested = df.schema[name].dataType.elementType.typeName() == "array"
        value = F.transform(F.col(name), lambda row: fn(row, *args)) if nested else fn(F.col(name), *args)
        df = df.withColumn(name, value)
    return df


def normalize(df: DataFrame, stats: dict[str, NormStats] | None, use_quantiles: bool = False) -> DataFrame:
    """Normalize every column named in the stats (each must exist); null stats change nothing."""
    return _apply(df, stats, use_quantiles, v.zscore, v.quantile_scale)


def unnormalize(df: DataFrame, stats: dict[str, NormStats] | None, use_quantiles: bool = False) -> DataFrame:
    return _apply(df, stats, use_quantiles, v.un_zscore, v.un_quantile)
