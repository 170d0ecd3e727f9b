"""Letterbox resampling of flat images (height, width, channel) in column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def taps(size: int, target: int) -> list[list[tuple[int, float]]]:
    """For each of ``target`` points the source points it blends and their weights, which sum to 1.

    Linear interpolation between centres; when shrinking the reach is widened so that every source point counts.
    """
    scale = target / size
    reach = max(1.0, 1.0 / scale)
    out = []
    for i in range(target):
        centre = (i + 0.5) / scale - 0.5
        near = range(max(0, math.ceil(centre - reach)), min(size - 1, math.floor(centre + reach)) + 1)
        found = [(j, 1.0 - abs(centre - j) / reach) for j in near if abs(centre - j) < reach]
        total = sum(w for _, w in found)
        out.append([(j, w / total) for j, w in found])
    return out


def fitted(height: int, width: int, to_height: int, to_width: int) -> tuple[int, int]:
    """Size of an image scaled into a frame."""
    ratio = max(width / to_width, height / to_height)
    return int(height / ratio), int(width / ratio)


def _blend(values: Column, table: list[list[tuple[int, float]]], length: int) -> Column:
    """For each entry of the table the weighted sum of slices of ``length`` values, as an array of arrays."""
    points = F.array(*[F.array(*[F.struct(F.lit(j * length + 1).alias("at"), F.lit(w).alias("w")) for j, w in row])
                       for row in table])
    zero = F.array_repeat(F.lit(0.0), length)
    return F.transform(points, lambda row: F.aggregate(row, zero, lambda acc, tap: F.zip_with(
        acc, F.slice(values, tap["at"], length), lambda a, x: a + x.cast("double") * tap["w"])))


def resize_with_pad(pixels: Column, shape: tuple[int, int, int], height: int, width: int, byte: bool = False) -> Column:
    """A flat image of ``shape`` (h, w, c) fitted into height x width; padding is 0 for bytes and -1 for floats.

    The interpolation is separable and its weights are literals, so rows are blended first, then columns, in the JVM.
    Bytes are rounded half to even and cut to 0..255, floats are cut to [-1, 1]. An odd padding point goes right and bottom.
    """
    h, w, c = shape
    if (h, w) == (height, width):
        return pixels
    new_h, new_w = fitted(h, w, height, width)
    top, left = (height - new_h) // 2, (width - new_w) // 2

    def settle(x: Column) -> Column:
        low, high = (0.0, 255.0) if byte else (-1.0, 1.0)
        x = F.bround(x) if byte else x
        return F.greatest(F.lit(low), F.least(F.lit(high), x))

    def bar(n: int) -> Column:
        return F.array_repeat(F.lit(0.0 if byte else -1.0), n)

    columns = taps(w, new_w)
    rows = F.transform(_blend(pixels, taps(h, new_h), w * c), lambda row: F.concat(
        bar(left * c), F.transform(F.flatten(_blend(row, columns, c)), settle), bar((width - new_w - left) * c)))
    return F.concat(bar(top * width * c), F.flatten(rows), bar((height - new_h - top) * width * c))


def letterbox(df: DataFrame, pixels: str, shape: tuple[int, int, int], height: int, width: int) -> DataFrame:
    """Resize the flat images of a column from ``shape`` (h, w, c) into height x width; the element type stays."""
    kind = df.schema[pixels].dataType
    byte = kind.elementType.simpleString() in INTEGERS
    return df.withColumn(pixels, resize_with_pad(F.col(pixels), shape, height, width, byte).cast(kind))
