"""Seeded draws that do not depend on partitioning: a hash of (seed, key) instead of a generator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *key: Column) -> Column:
    """Integer in [0, 2**32)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *key: Column) -> Column:
    """Double in [0, 1)."""
    return draw(seed, *key) / F.lit(float(1 << 32))


def below(n: int, seed: int | str, *key: Column) -> Column:
    """Integer in [0, n)."""
    return (draw(seed, *key) % n).cast("int")


def gauss(seed: int | str, *key: Column) -> Column:
    """Standard normal draw (Box-Muller)."""
    u1 = (draw(f"{seed}a", *key) + 1) / F.lit(float((1 << 32) + 1))
    u2 = uniform(f"{seed}b", *key)
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
