"""Equi-joins of a large table with one that has few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_salted(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """``large.join(small, on, how)`` with every key of ``large`` spread over ``salts`` groups.

    The rows of ``small`` are repeated once per salt, so it should be the much
    smaller table. ``large`` is read and shuffled once. What is still too big in
    one partition is split again at run time by the adaptive skew join, which can
    cut the left side of these kinds: inner, left, left_semi, left_anti. Where
    ``small`` is small enough with all its copies, Spark broadcasts it instead.
    The copies come from a join, whose size Spark takes as the product of both
    sides. It takes an exploded table to be as large as before, and would hold
    all copies of a table below the broadcast limit in the memory of each task.
    """
    keys = [*on, "__salt"]
    spread = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    numbers = small.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("__salt"))
    repeated = small.crossJoin(F.broadcast(numbers))
    return spread.join(repeated, keys, how).drop("__salt")
