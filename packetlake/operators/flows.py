"""Bidirectional flow statistics over packets.

A packet row has ``packet_no`` (unique arrival order), ``ts``, ``src_ip`` and
``dst_ip`` (BINARY), ``src_port``, ``dst_port``, ``protocol`` and ``size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlake.functions.flowkey import with_normalised_key
from packetlake.operators.ordered import (
    DEFAULT_WIDTH,
    SEGMENT,
    balanced,
    before_segment,
    drop_carry,
    with_carry,
    within_segment,
)
from packetlake.schemas import FLOW_KEY

SECOND_US = 1_000_000
SESSION_GAP_US = 300 * SECOND_US


def _measures() -> dict[str, Column]:
    return {
        "ts_us": F.unix_micros("ts"),
        "bytes": F.col("size").cast("long"),
        "fwd": F.when(F.col("is_fwd"), 1).otherwise(0).cast("long"),
    }


def partial_flow_aggregates() -> list[Column]:
    """Fixed-width aggregates of one flow; they combine before the shuffle."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("fwd").alias("fwd_n"),
        F.sum("bytes").alias("all_bytes"),
        F.sum(F.col("bytes") * F.col("fwd")).alias("fwd_bytes"),
        F.min_by("ts_us", "packet_no").alias("first_us"),
        F.max_by("ts_us", "packet_no").alias("last_us"),
        F.min_by("bytes", "packet_no").alias("first_size"),
        F.min("bytes").alias("min_size"),
        F.max("bytes").alias("max_size"),
    ]


def flow_measures(packets: DataFrame) -> DataFrame:
    return with_normalised_key(packets).withColumns(_measures())


def finish_flow_stats(aggregated: DataFrame, keep: list[str]) -> DataFrame:
    """Named statistics from the partial aggregates.

    Rates stay at one packet and the first packet's size until a flow spans a
    whole second; ``avg_bps`` is in bytes per second.
    """
    duration = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(0).cast("long"))
    spans_second = F.col("duration_us") >= SECOND_US
    micros = F.lit(float(SECOND_US))
    return (
        aggregated.withColumn("duration_us", duration)
        .select(
            *keep,
            F.col("fwd_n").alias("fwd_packet_count"),
            (F.col("n") - F.col("fwd_n")).alias("bwd_packet_count"),
            F.col("fwd_bytes").alias("fwd_byte_count"),
            (F.col("all_bytes") - F.col("fwd_bytes")).alias("bwd_byte_count"),
            F.col("first_us").alias("first_seen_us"),
            F.col("last_us").alias("last_seen_us"),
            "duration_us",
            (F.col("last_us") < F.col("first_us")).alias("clock_went_back"),
            F.col("min_size").alias("min_packet_size"),
            F.col("max_size").alias("max_packet_size"),
            average_packet_size(F.col("all_bytes"), F.col("n")).alias("avg_packet_size"),
            F.when(spans_second, F.col("n") * micros / F.col("duration_us")).otherwise(1.0).alias("avg_pps"),
            F.when(spans_second, F.col("all_bytes") * micros / F.col("duration_us"))
            .otherwise(F.col("first_size").cast("double"))
            .alias("avg_bps"),
        )
    )


def average_packet_size(total_bytes: Column, packets: Column) -> Column:
    """Bytes per packet, 0 where there are no packets."""
    return F.coalesce(F.try_divide(total_bytes, packets), F.lit(0.0))


def flow_stats(packets: DataFrame) -> DataFrame:
    """One row per normalised flow."""
    aggregated = flow_measures(packets).groupBy(*FLOW_KEY).agg(*partial_flow_aggregates())
    return finish_flow_stats(aggregated, FLOW_KEY)


def flow_duration(flows: DataFrame) -> DataFrame:
    """Whole seconds and whole milliseconds between first and last packet."""
    return flows.select(
        *FLOW_KEY,
        F.expr("duration_us div 1000000").alias("duration_s"),
        F.expr("duration_us div 1000").alias("duration_ms"),
    )


def new_flow_flags(packets: DataFrame) -> DataFrame:
    """Every packet with ``is_new_flow``, true on the first packet of its flow.

    The first packet numbers come from an aggregate, and the join back is on the
    unique packet number, so a hot flow never meets in one task.
    """
    first = with_normalised_key(packets).groupBy(*FLOW_KEY).agg(F.min("packet_no").alias("packet_no"))
    flags = first.select("packet_no", F.lit(True).alias("is_new_flow"))
    return packets.join(flags, "packet_no", "left").withColumn(
        "is_new_flow", F.coalesce("is_new_flow", F.lit(False))
    )


def running_flow_stats(packets: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The statistics of a packet's flow right after that packet."""
    state = ["n", "fwd_n", "all_bytes", "fwd_bytes", "first_us", "first_size", "min_size", "max_size"]
    rows = balanced(flow_measures(packets), FLOW_KEY, "packet_no", width)
    rows = rows.select(*FLOW_KEY, SEGMENT, "packet_no", "ts_us", "bytes", "fwd")
    partial = rows.groupBy(*FLOW_KEY, SEGMENT).agg(*partial_flow_aggregates())
    earlier = before_segment(FLOW_KEY)
    carry = (
        partial.select(
            *FLOW_KEY,
            SEGMENT,
            *[F.sum(c).over(earlier).alias(c) for c in ("n", "fwd_n", "all_bytes", "fwd_bytes")],
            *[F.first(c).over(earlier).alias(c) for c in ("first_us", "first_size")],
            F.min("min_size").over(earlier).alias("min_size"),
            F.max("max_size").over(earlier).alias("max_size"),
        )
        .filter(F.col("n").isNotNull())
    )
    steps = rows.select(
        *FLOW_KEY,
        SEGMENT,
        "packet_no",
        "ts_us",
        F.lit(1).cast("long").alias("n"),
        F.col("fwd").alias("fwd_n"),
        F.col("bytes").alias("all_bytes"),
        (F.col("bytes") * F.col("fwd")).alias("fwd_bytes"),
        F.col("ts_us").alias("first_us"),
        *[F.col("bytes").alias(c) for c in ("first_size", "min_size", "max_size")],
    )
    so_far = within_segment(FLOW_KEY, ["packet_no"]).rowsBetween(Window.unboundedPreceding, 0)
    combine = {"first_us": F.first, "first_size": F.first, "min_size": F.min, "max_size": F.max}
    running = with_carry(steps, carry).select(
        *FLOW_KEY,
        SEGMENT,
        "__carry",
        "packet_no",
        F.col("ts_us").alias("last_us"),
        *[combine.get(c, F.sum)(c).over(so_far).alias(c) for c in state],
    )
    return finish_flow_stats(drop_carry(running), [*FLOW_KEY, "packet_no"])


def flow_sessions(packets: DataFrame, gap_us: int = SESSION_GAP_US) -> DataFrame:
    """Flows cut where no packet came for longer than ``gap_us``.

    Packets of a flow in one slot of that width are always one session, so they
    are combined first; only one row per flow and slot meets in the window.
    """
    slots = (
        flow_measures(packets)
        .withColumn("slot", F.floor(F.col("ts_us") / F.lit(gap_us)))
        .groupBy(*FLOW_KEY, "slot")
        .agg(
            F.min("ts_us").alias("slot_first"),
            F.max("ts_us").alias("slot_last"),
            F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("b"),
        )
    )
    by_slot = Window.partitionBy(*FLOW_KEY).orderBy("slot")
    idle = F.col("slot_first") - F.lag("slot_last").over(by_slot)
    started = slots.withColumn("starts", F.when(idle > gap_us, 1).otherwise(0))
    return (
        started.withColumn("session_no", F.sum("starts").over(by_slot))
        .groupBy(*FLOW_KEY, "session_no")
        .agg(
            F.min("slot_first").alias("first_seen_us"),
            F.max("slot_last").alias("last_seen_us"),
            F.sum("n").alias("packets"),
            F.sum("b").alias("bytes"),
        )
    )


def seen_ips(packets: DataFrame) -> DataFrame:
    """Distinct endpoint addresses."""
    return packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("address")).distinct()


def unique_ip_count(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct endpoint addresses, exact unless a sketch is asked for."""
    if approximate:
        both = packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("address"))
        return both.agg(F.approx_count_distinct("address").alias("unique_ips"))
    return seen_ips(packets).agg(F.count(F.lit(1)).alias("unique_ips"))


def flow_count(flows: DataFrame) -> DataFrame:
    """Number of flows and whether there are none."""
    return flows.agg(F.count(F.lit(1)).alias("flows")).withColumn("is_empty", F.col("flows") == 0)


def contains_flow(keys: DataFrame, flows: DataFrame) -> DataFrame:
    """The normalised keys that are in the flow table."""
    return keys.join(flows.select(*FLOW_KEY), FLOW_KEY, "left_semi")


def has_seen_ip(addresses: DataFrame, seen: DataFrame) -> DataFrame:
    """The addresses that were an endpoint of any packet."""
    return addresses.join(seen, "address", "left_semi")


def lookup_flows(keys: DataFrame, flows: DataFrame) -> DataFrame:
    """Statistics of the given normalised keys; unknown keys give no row."""
    return flows.join(keys.select(*FLOW_KEY).distinct(), FLOW_KEY, "inner")
