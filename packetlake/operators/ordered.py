"""Running computations over ordered groups, whatever the size of a group.

A plain window sorts a whole group in one task, which fails once one key holds a
large share of the rows. Here each group is cut into segments along its order:

1. every (group, segment) is reduced to one partial row (map-side combined);
2. a window over those few partial rows gives what each segment inherits;
3. the inherited value enters the segment as one extra *carry* row, and the
   window then runs inside (group, segment) only.

The rows are shuffled once, by (group, segment), with no join. The results are
the same as those of the plain window.

``balanced`` makes the segments: groups above a number of rows are cut at
quantiles of their order, whatever its values look like; all others are one
segment. ``segment_of`` cuts an order without gaps at fixed widths, with no pass
over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"
CARRY = "__carry"

# Rows of one segment, and of a unique, dense integer order that share one.
DEFAULT_WIDTH = 1 << 20
# Quantiles at which a group is cut in one step, size of the sketch they come from,
# and groups that are cut in one step at most (which bounds what is broadcast).
CUTS, SKETCH, MOST_CUT = 64, 2048, 16_384


def segment_of(order: str, width: int = DEFAULT_WIDTH) -> Column:
    """Segment of a unique integer order: at most ``width`` rows each."""
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def balanced(rows: DataFrame, keys: Sequence[str], order: str, target: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds SEGMENT, which does not decrease along the integer ``order`` within a group.

    Groups of more than ``target`` rows are cut at CUTS quantiles of a mergeable
    sketch, and what is still larger again, so segments have about equal numbers
    of rows however ``order`` is spread. Equal values of ``order`` share a
    segment. The cuts of at most MOST_CUT groups are broadcast, 8 MiB of numbers
    in all; above MOST_CUT times ``target`` rows the segments grow instead.
    """
    spark = rows.sparkSession
    cut = rows.withColumn(SEGMENT, F.lit(0).cast("long"))
    number = F.col(order).cast("long")
    while True:
        group = F.xxhash64(*keys, SEGMENT)  # groups of one hash share cuts, which changes no result
        sizes = cut.groupBy(group.alias("__group")).agg(F.count(number).alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"))
        total, most = sizes.agg(F.sum("n"), F.max(F.when(F.col("lo") < F.col("hi"), F.col("n")))).first()
        limit = max(target, (total or 0) // MOST_CUT)
        if (most or 0) <= limit:
            return cut
        large = sizes.filter((F.col("n") > limit) & (F.col("lo") < F.col("hi"))).select("__group", "hi")
        narrow = cut.select(group.alias("__group"), number.alias("__order"))
        sketch = F.kll_sketch_agg_bigint("__order", F.lit(SKETCH))
        ranks = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
        sketched = narrow.join(F.broadcast(large), "__group").groupBy("__group").agg(F.max("hi").alias("hi"), sketch.alias("s"))
        # The greatest value apart from all others: the cuts never leave a group whole.
        places = F.array_distinct(F.array_append(F.kll_sketch_get_quantile_bigint("s", ranks), F.col("hi") - 1))
        found = sketched.select("__group", places.alias("__cuts")).toArrow()
        cuts = F.broadcast(spark.createDataFrame(found, "__group long, __cuts array<long>"))
        passed = F.coalesce(F.size(F.filter("__cuts", lambda c: c < number)), F.lit(0))
        placed = cut.withColumn("__group", group).join(cuts, "__group", "left")
        cut = placed.withColumn(SEGMENT, F.col(SEGMENT) * (CUTS + 1) + passed).drop("__group", "__cuts")


def before_segment(keys: Sequence[str]):
    """Window over all earlier segments of the group."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows plus the carry rows of their segments, told apart by ``__carry``."""
    return rows.withColumn(CARRY, F.lit(1)).unionByName(
        carry.withColumn(CARRY, F.lit(0)), allowMissingColumns=True
    )


def within_segment(keys: Sequence[str], order: Sequence[str]):
    """Window inside one segment, the carry row first."""
    return Window.partitionBy(*keys, SEGMENT).orderBy(CARRY, *order)


def drop_carry(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CARRY) == 1).drop(CARRY, SEGMENT)


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """Adds the 0-based position within the group, and the group's row count if asked.

    ``segment`` must not decrease along ``order``.
    """
    rows = rows.withColumn(SEGMENT, segment)
    counts = rows.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("__n"))
    inherited = {"__step": F.coalesce(F.sum("__n").over(before_segment(keys)), F.lit(0))}
    added = ["__step"]
    if total:
        inherited["__group_rows"] = F.sum("__n").over(Window.partitionBy(*keys))
        added.append("__group_rows")
    carry = counts.withColumns(inherited).select(*keys, SEGMENT, *added)
    steps = rows.withColumn("__step", F.lit(1).cast("long"))
    if total:
        steps = steps.withColumn("__group_rows", F.lit(None).cast("long"))
    window = within_segment(keys, order)
    result = with_carry(steps, carry).withColumn(
        name, F.sum("__step").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1
    )
    if total:
        result = result.withColumn(
            total, F.first("__group_rows").over(window.rowsBetween(Window.unboundedPreceding, 0))
        )
    return drop_carry(result).drop("__step", "__group_rows")


def row_index(rows: DataFrame, order: str, name: str = "row_idx", width: int = DEFAULT_WIDTH) -> DataFrame:
    """0-based position of every row along a unique integer column.

    No task sorts much more than ``width`` rows, also where the column has large
    gaps; the only unpartitioned step runs over one count per segment.
    """
    return numbered(balanced(rows, [], order, width), [], [order], F.col(SEGMENT), name)


def previous_value(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    value: str,
    name: str,
    last_value: Column | None = None,
) -> DataFrame:
    """Adds ``value`` of the row before this one in the group (NULL for the first).

    ``last_value`` is the aggregate that gives the last value of a segment. It
    may be passed where a plain one does, which then needs no sort.
    """
    rows = rows.withColumn(SEGMENT, segment)
    if last_value is None:
        last_value = F.max_by(value, F.struct(*order) if len(order) > 1 else order[0])
    last = rows.groupBy(*keys, SEGMENT).agg(last_value.alias("__last"))
    by_segment = Window.partitionBy(*keys).orderBy(SEGMENT)
    carry = (
        last.withColumn("__value", F.lag("__last").over(by_segment))
        .filter(F.col("__value").isNotNull())
        .select(*keys, SEGMENT, "__value")
    )
    valued = rows.withColumn("__value", F.col(value))
    result = with_carry(valued, carry).withColumn(
        name, F.lag("__value").over(within_segment(keys, order))
    )
    return drop_carry(result).drop("__value")
