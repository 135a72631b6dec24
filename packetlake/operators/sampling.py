"""Reproducible samples of labelled packets.

Every draw is a row, so sampling is a chain of equi-joins on positions: no label
or flow is collected, and the wide columns are joined last, for drawn rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.functions.draws import HASH_BITS, draw_below, keyed_hash
from packetlake.operators.ordered import DEFAULT_WIDTH, numbered, segment_of
from packetlake.operators.sequences import FLOW

# Segments of the shuffled order; each holds an even share of the rows.
SHUFFLE_BITS = 12
# Drawn positions are broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 500_000


def epoch_batches(rows: DataFrame, key: str, size: int, seed: int, bits: int = SHUFFLE_BITS) -> DataFrame:
    """A random order of all rows cut into batches, the last one possibly shorter.

    The order is that of a hash, whose leading bits are the segment; choose
    ``bits`` so that one in ``2 ** bits`` of the rows fits a task.
    """
    hashed = rows.select(key, keyed_hash(seed, F.col(key)).alias("__hash"))
    segment = F.shiftright(F.col("__hash"), HASH_BITS - bits)
    shuffled = numbered(hashed, [], ["__hash", key], segment, "__idx")
    return shuffled.select(
        F.floor(F.col("__idx") / size).cast("long").alias("batch_id"),
        (F.col("__idx") % size).cast("int").alias("pos"),
        key,
    )


def broadcast_if_bounded(small: DataFrame, bound: int) -> DataFrame:
    """Marks the side for broadcast where its number of rows is known to be small."""
    return F.broadcast(small) if bound <= BROADCAST_ROWS else small


def gather(batches: DataFrame, rows: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """The rows a batch lists.

    ``bound`` is the most rows ``batches`` can have, if that is known; a small
    one spares the shuffle of the wide table.
    """
    return (batches if bound is None else broadcast_if_bounded(batches, bound)).join(rows, key)


def label_dictionary(packets: DataFrame) -> DataFrame:
    """Labels with their row counts, numbered in order; one row per label."""
    counts = packets.groupBy("AttackLabel").agg(F.count(F.lit(1)).alias("label_rows"))
    number = F.row_number().over(Window.orderBy("AttackLabel")) - 1
    return counts.withColumn("label_no", number.cast("long"))


def _drawn_labels(packets: DataFrame, draws: int, seed: int) -> DataFrame:
    """``draws`` rows, each with a label taken uniformly over the labels."""
    labels = label_dictionary(packets)
    total = labels.agg(F.count(F.lit(1))).scalar()
    numbers = packets.sparkSession.range(draws).withColumnRenamed("id", "draw_id")
    return numbers.withColumn("label_no", draw_below(total, seed, "label", F.col("draw_id"))).join(labels, "label_no")


def _window_of(drawn: DataFrame, rows: str, k: int, seed: int) -> DataFrame:
    """Positions of a random run of ``k`` rows out of ``rows``; all rows if fewer."""
    start = F.when(F.col(rows) < k, F.lit(0)).otherwise(
        draw_below(F.greatest(F.col(rows) - k + 1, F.lit(1)), seed, "start", F.col("draw_id"))
    )
    placed = drawn.withColumn("__start", start)
    last = F.least(F.lit(k), F.col(rows)) - 1
    return placed.withColumn("pos", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn(
        "__place", F.col("__start") + F.col("pos")
    )


def even_sample(packets: DataFrame, draws: int, k: int, seed: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Runs of ``k`` packets, label uniform with replacement, start uniform in the label."""
    narrow = packets.select("AttackLabel", "packet_no")
    placed = numbered(narrow, ["AttackLabel"], ["packet_no"], segment_of("packet_no", width), "__place")
    drawn = _window_of(_drawn_labels(packets, draws, seed), "label_rows", k, seed)
    found = placed.join(broadcast_if_bounded(drawn, draws * k), ["AttackLabel", "__place"])
    return found.select("draw_id", "pos", "AttackLabel", "packet_no")


def random_windows(packets: DataFrame, k: int, seed: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """One random run of ``k`` packets out of every flow."""
    placed = _flow_places(packets, width)
    flows = packets.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("flow_rows"))
    keyed = flows.withColumn("draw_id", F.concat_ws("/", *FLOW))
    drawn = _window_of(keyed, "flow_rows", k, seed)
    return drawn.join(placed, [*FLOW, "__place"]).select(*FLOW, "pos", "packet_no")


def _flow_places(packets: DataFrame, width: int) -> DataFrame:
    narrow = packets.select(*FLOW, "packet_no")
    return numbered(narrow, FLOW, ["packet_no"], segment_of("packet_no", width), "__place")


def sample_flow_even(packets: DataFrame, draws: int, k: int, seed: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Runs of ``k`` packets inside one flow; the flow is that of a uniform row of the label."""
    narrow = packets.select(*FLOW, "packet_no")
    in_label = numbered(narrow, ["AttackLabel"], ["packet_no"], segment_of("packet_no", width), "__row")
    picked = _drawn_labels(packets, draws, seed).withColumn(
        "__row", draw_below(F.col("label_rows"), seed, "row", F.col("draw_id"))
    )
    flows = in_label.join(broadcast_if_bounded(picked, draws), ["AttackLabel", "__row"])
    sizes = packets.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("flow_rows"))
    chosen = broadcast_if_bounded(flows.select("draw_id", *FLOW), draws)
    drawn = broadcast_if_bounded(_window_of(sizes.join(chosen, FLOW), "flow_rows", k, seed), draws * k)
    found = _flow_places(packets, width).join(drawn, [*FLOW, "__place"])
    return found.select("draw_id", "pos", *FLOW, "packet_no")
