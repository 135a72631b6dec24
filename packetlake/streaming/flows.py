"""Flow statistics and graph edges kept up to date from a packet stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.functions.flowkey import with_normalised_key
from packetlake.operators.flows import finish_flow_stats, flow_measures, partial_flow_aggregates
from packetlake.operators.graph import flow_edges
from packetlake.schemas import FLOW_KEY
from packetlake.streaming.edgetable import EdgeTable


def flow_updates(packets: DataFrame) -> DataFrame:
    """Statistics of the flows each micro-batch touched (update mode).

    One state row of fixed width per flow; packets of a busy flow are combined
    before the shuffle.
    """
    return finish_flow_stats(flow_measures(packets).groupBy(*FLOW_KEY).agg(*partial_flow_aggregates()), FLOW_KEY)


def new_flows(packets: DataFrame) -> DataFrame:
    """One packet of every flow not seen before (append mode)."""
    return with_normalised_key(packets).dropDuplicates(FLOW_KEY)


def session_updates(packets: DataFrame, gap: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Flows closed by an idle gap; for batch input too."""
    if packets.isStreaming:
        packets = packets.withWatermark("ts", delay)
    measured = flow_measures(packets)
    return (
        measured.groupBy(F.session_window("ts", gap), *FLOW_KEY)
        .agg(
            F.min("ts_us").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("bytes").alias("bytes"),
        )
        .drop("session_window")
    )


def _run(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def write_flow_updates(packets: DataFrame, path: str, checkpoint: str) -> None:
    """Drains the stream; a repeated batch replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(flow_updates(packets), checkpoint, "update", each)


def latest_flows(spark: SparkSession, path: str) -> DataFrame:
    """Last written statistics of every flow."""
    updates = spark.read.parquet(path)
    stats = [c for c in updates.columns if c not in (*FLOW_KEY, "batch")]
    newest = updates.groupBy(*FLOW_KEY).agg(F.max_by(F.struct(*stats), "batch").alias("s"))
    return newest.select(*FLOW_KEY, "s.*")


def upsert_graph(packets: DataFrame, path: str, checkpoint: str) -> None:
    """Keeps one edge per flow current; every micro-batch writes the buckets it changes."""

    def each(batch: DataFrame, number: int) -> None:
        EdgeTable(batch.sparkSession, path).upsert(flow_edges(batch), number)

    _run(flow_updates(packets), checkpoint, "update", each)


def latest_graph(spark: SparkSession, path: str) -> DataFrame:
    """One edge per flow as it is now."""
    return EdgeTable(spark, path).view()
