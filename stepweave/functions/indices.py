"""Step-index lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty() -> Column:
    return F.array().cast("array<int>")


def span(start: Column, stop: Column, stride: int = 1) -> Column:
    """``range(start, stop, stride)``; empty when start >= stop."""
    return F.when(start < stop, F.sequence(start, stop - 1, F.lit(stride))).otherwise(_empty())


def interior(a: Column, b: Column, num: int) -> Column:
    """``num`` evenly spaced points strictly between a and b, truncated."""
    return F.transform(F.sequence(F.lit(1), F.lit(num)),
                       lambda i: (a + i * ((b - a) / F.lit(float(num + 1)))).cast("int"))


def even_indices(step: Column, budget: int) -> Column:
    """All steps 0..step while they fit the budget, else ``budget`` even points ending exactly at step."""
    gap = step.cast("double") / F.lit(float(budget - 1))
    points = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)),
                         lambda i: F.when(i == budget - 1, step.cast("int")).otherwise(F.floor(i * gap).cast("int")))
    return F.when(step < budget, F.sequence(F.lit(0), step.cast("int"))).otherwise(points)


def tail(items: Column, n: int) -> Column:
    """Last n items (all when fewer)."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - (n - 1)), n)


def recurrent_indices(step: Column, exec_start: Column, horizon: int = 16, max_steps: int = 64,
                      max_video: int = 40) -> Column:
    """Strided steps for recurrent memory: demonstration part, then execution part ending at ``step``."""
    step, e = step.cast("int"), exec_start.cast("int")
    done = step - e
    execution = F.when(done < horizon, F.array(step)).otherwise(
        F.sequence(done % horizon + e, step, F.lit(horizon)))
    gap = (e - 1).cast("double") / F.lit(float(max_video - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(max_video - 1)),
                         lambda i: F.when(i == max_video - 1, e - 1).otherwise(F.floor(i * gap).cast("int")))
    video = (F.when(e == 0, _empty()).when(e <= 2 * horizon, span(F.lit(0), e, horizon // 2))
             .when(e <= max_video * horizon, span(F.lit(0), e, horizon)).otherwise(spread))
    return tail(F.concat(video, execution), max_steps)


def merge_indices(a: Column, b: Column, exec_start: Column) -> Column:
    """Sorted distinct union, execution steps only."""
    return F.filter(F.array_sort(F.array_union(a, b)), lambda x: x >= exec_start)
