"""Reproducible draws: the same seed and key give the same number on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def keyed_hash(seed: int, *keys: Column | int | str) -> Column:
    """Uniform 60-bit number from the seed and the keys."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def draw_below(bound: Column, seed: int, *keys: Column | int | str) -> Column:
    """Uniform integer in ``[0, bound)``."""
    return keyed_hash(seed, *keys) % bound
