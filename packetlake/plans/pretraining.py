"""Packet table to shuffled, masked and corrupted token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.functions.tokens import corrupt_tokens, encode_tokens, masked_labels
from packetlake.operators.metrics import class_dictionary, with_class_index
from packetlake.operators.sampling import SHUFFLE_BITS, epoch_batches, gather
from packetlake.schemas import ENDPOINT


def pretraining_batches(
    packets: DataFrame,
    batch_size: int,
    seed: int,
    placement: str = "EOS",
    overflow: str = "error",
    bits: int = SHUFFLE_BITS,
) -> DataFrame:
    """One epoch: ``batch_id, pos``, token rows, corrupted rows, their labels and the class.

    ``packets`` has ``packet_no, data, mask, proto_hierarchy``. Tokens are made
    after the shuffle, which moves the bytes and not the four times larger rows.
    """
    if overflow == "drop":
        packets = packets.filter(F.length("data") <= (1518 if placement == "SOS" else 1519))
    batches = epoch_batches(packets, "packet_no", batch_size, seed, bits)
    rows = gather(batches, packets.select("packet_no", "data", "mask", "proto_hierarchy"), "packet_no")
    classed = with_class_index(rows, class_dictionary(packets))
    tokens = classed.withColumn("tokens", encode_tokens(F.col("data"), F.col("mask"), ENDPOINT, placement, overflow))
    corrupted = tokens.withColumn("corrupted", corrupt_tokens(F.col("tokens"), F.col("packet_no"), seed))
    return corrupted.select(
        "batch_id",
        "pos",
        "packet_no",
        "tokens",
        "corrupted",
        masked_labels(F.col("tokens"), F.col("corrupted")).alias("masked_labels"),
        "proto_hierarchy",
        "class_index",
    )
