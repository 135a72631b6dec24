"""A random order of numbered rows that is computed, not sorted.

``place_of`` and ``row_at`` are a keyed permutation of ``0 .. total - 1`` and its
inverse, as column expressions. A row finds its place without seeing the others,
and a batch finds its rows without an order of the whole epoch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.draws import keyed_hash
from packetlake.operators.ordered import DEFAULT_WIDTH, row_index
from packetlake.sources.indexed import PER_SEGMENT, gather_rows

ROUNDS = 4
#: Steps of a walk back into the range. The grid has fewer than sqrt(total) places too many, so
#: a longer walk is impossible up to a total of 256 and has odds below total ** -7 beyond.
WALK = 16


def grid(total: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least ``total`` places."""
    side = math.isqrt(total - 1) + 1
    return side, -(-total // side)


def _round(at: Column, number: int, sides: tuple[int, int], seed: int, sign: int) -> Column:
    """One Feistel round: a coordinate moves by a keyed hash of the other one."""
    turned = number % 2
    moving, fixed = (at["y"], at["x"]) if turned else (at["x"], at["y"])
    side = F.lit(sides[turned]).cast("long")
    moved = F.pmod(moving + F.lit(sign) * (keyed_hash(seed, number, fixed) % side), side)
    x, y = (at["x"], moved) if turned else (moved, at["y"])
    return F.struct(x.alias("x"), y.alias("y"))


def _scrambled(value: Column, sides: tuple[int, int], seed: int, inverse: bool) -> Column:
    wide = F.lit(sides[0]).cast("long")
    start = F.struct((value % wide).alias("x"), F.floor(value / wide).cast("long").alias("y"))
    numbers = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    # A fold over the rounds, so that a round's result stands once in the expression.
    cases = F.array(*[F.lit(n) for n in numbers])

    def step(at: Column, number: Column) -> Column:
        chosen = _round(at, ROUNDS - 1, sides, seed, -1 if inverse else 1)
        for n in range(ROUNDS - 1):
            chosen = F.when(number == n, _round(at, n, sides, seed, -1 if inverse else 1)).otherwise(chosen)
        return chosen

    return F.aggregate(cases, start, step, lambda at: at["x"] + at["y"] * wide)


def _walked(value: Column, total: int, seed: int, inverse: bool) -> Column:
    if total < 1:
        raise ValueError("an order needs at least one row")
    sides = grid(total)
    first = _scrambled(value.cast("long"), sides, seed, inverse)
    walk = F.array_repeat(F.lit(0), WALK)
    settled = F.aggregate(walk, first, lambda at, _: F.when(at < total, at).otherwise(_scrambled(at, sides, seed, inverse)))
    return F.aggregate(
        F.array(settled), F.lit(0).cast("long"), lambda _, at: F.when(at < total, at).otherwise(F.raise_error(F.lit("no place found; take another seed")).cast("long"))
    )


def place_of(index: Column, total: int, seed: int) -> Column:
    """Place of row ``index`` in the order of ``seed``; both in ``0 .. total - 1``.

    A place outside the range that the grid adds is permuted again until it lies
    within (cycle walking), which keeps the whole a permutation.
    """
    return _walked(index, total, seed, inverse=False)


def row_at(place: Column, total: int, seed: int) -> Column:
    """The row that ``place_of`` puts at ``place``."""
    return _walked(place, total, seed, inverse=True)


def permuted_batches(rows: DataFrame, key: str, size: int, seed: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``batch_id``, ``pos`` and ``key`` of every row: one epoch, the last batch possibly shorter.

    ``key`` is a unique integer; its order gives the row numbers. The shuffled
    order itself takes no exchange. An empty table gives no rows.
    """
    placed = row_index(rows.select(key), key, "__idx", width)
    place = place_of(F.col("__idx"), max(1, rows.count()), seed)
    return placed.withColumn("__place", place).select(
        F.floor(F.col("__place") / size).cast("long").alias("batch_id"), (F.col("__place") % size).cast("int").alias("pos"), key
    )


def drawn_positions(spark, total: int, size: int, seed: int, first: int, count: int = 1) -> DataFrame:
    """``batch_id``, ``pos`` and the position ``row_idx`` of each row of ``count`` batches from ``first`` on."""
    if first < 0 or count < 0 or size < 1:
        raise ValueError("batches begin at 0 and hold at least one row")
    places = spark.range(min(first * size, total), min((first + count) * size, total))
    return places.select(
        F.floor(F.col("id") / size).cast("long").alias("batch_id"),
        (F.col("id") % size).cast("int").alias("pos"),
        row_at(F.col("id"), max(1, total), seed).alias("row_idx"),
    )


def drawn_batches(
    spark, path: str, total: int, size: int, seed: int, first: int, count: int = 1, per_segment: int = PER_SEGMENT
) -> DataFrame:
    """The rows of some batches of an epoch, from a table stored by position (``write_indexed``).

    The epoch is not ordered for it: the rows come from the inverse permutation,
    and only folders that hold one of them are read.
    """
    return gather_rows(drawn_positions(spark, total, size, seed, first, count), path, per_segment)
