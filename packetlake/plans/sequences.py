"""Labelled packets to flow sequences for validation and training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.functions.ids import host_pair_id
from packetlake.operators.sampling import gather, sample_flow_even
from packetlake.operators.sequences import assemble_sequences, batches_of, flow_sequences


def with_flow_id(packets: DataFrame) -> DataFrame:
    """Adds the host-pair id as ``FlowID``."""
    return packets.withColumn("FlowID", host_pair_id(F.col("data"), F.col("mask")))


def validation_batches(packets: DataFrame, k: int, batch_size: int, placement: str = "EOS") -> DataFrame:
    """All sequences of all flows, encoded, padded and numbered in batches."""
    whole = assemble_sequences(flow_sequences(packets, k), k, placement=placement)
    return batches_of(whole, "first_packet_no", batch_size)


def training_batch(packets: DataFrame, draws: int, k: int, seed: int, placement: str = "EOS") -> DataFrame:
    """A label-balanced batch of runs inside flows, encoded and padded."""
    drawn = sample_flow_even(packets, draws, k, seed).select("draw_id", "pos", "packet_no")
    rows = gather(drawn, packets, "packet_no", bound=draws * k)
    return assemble_sequences(rows, k, keys=["draw_id"], placement=placement)
