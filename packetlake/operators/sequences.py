"""Fixed-length packet sequences per flow, queues, and batches.

Labelled packets have ``packet_no`` (unique order), ``data``, ``mask``,
``AttackLabel`` and ``FlowID``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.functions.tokens import _masked, check_options, token_rows
from packetlake.operators.ordered import DEFAULT_WIDTH, SEGMENT, balanced, numbered, row_index
from packetlake.schemas import PAD, TOKENS_PER_PACKET
from packetlake.session import small_batches

FLOW = ["AttackLabel", "FlowID"]
SEQUENCE = [*FLOW, "seq_no"]
# Sequences turned into token matrices at a time.
CHUNK = 64


def rows_of(packets: DataFrame, label: str | None = None, flow: int | None = None) -> DataFrame:
    """The packets of one label, of one flow, or of one flow under one label; a filter that reaches the scan."""
    for column, value in (("AttackLabel", label), ("FlowID", flow)):
        if value is not None:
            packets = packets.filter(F.col(column) == value)
    return packets


def flow_sequences(packets: DataFrame, k: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``seq_no`` and ``pos``: runs of ``k`` packets, the rest of a flow left out.

    A flow with fewer than ``k`` packets is one short run.
    """
    cut = balanced(packets, FLOW, "packet_no", width)
    placed = numbered(cut, FLOW, ["packet_no"], F.col(SEGMENT), "__rn", "__total")
    whole = F.floor(F.col("__total") / k) * k
    kept = placed.filter((F.col("__total") < k) | (F.col("__rn") < whole))
    return kept.withColumns(
        {"seq_no": F.floor(F.col("__rn") / k).cast("long"), "pos": (F.col("__rn") % k).cast("int")}
    ).drop("__rn", "__total")


def assemble_sequences(
    sequences: DataFrame,
    k: int,
    keys: list[str] = SEQUENCE,
    mask_value: int = 0,
    placement: str = "EOS",
    overflow: str = "error",
    pad_rows: bool = True,
) -> DataFrame:
    """One row per sequence: label of its first packet, true length, token rows.

    With ``pad_rows`` there are always ``k + 1`` rows; the last stays free for a
    class token of the sequence. At most ``k`` packets meet in one group.
    """
    check_options(placement, overflow)
    if overflow == "drop":
        raise ValueError("a sequence cannot drop single packets")
    small_batches(sequences.sparkSession)
    packet = F.struct("pos", "data", "mask")
    grouped = sequences.groupBy(*keys).agg(
        F.min_by("AttackLabel", "pos").alias("label"),
        F.min("packet_no").alias("first_packet_no"),
        F.array_sort(F.collect_list(packet)).alias("__packets"),
    )
    flat = grouped.select(
        *keys,
        "label",
        "first_packet_no",
        F.size("__packets").alias("length"),
        F.col("__packets.data").alias("__data"),
        F.col("__packets.mask").alias("__mask"),
    )
    kept = [c for c in flat.columns if c not in ("__data", "__mask")]
    schema = flat.select(*kept).withColumn("tokens", F.lit(None).cast("array<array<int>>")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                tokens = _token_matrices(part["__data"], part["__mask"], k, mask_value, placement, overflow, pad_rows)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), tokens], names=[*kept, "tokens"])

    return flat.mapInArrow(encode, schema)


def _token_matrices(data, mask, k, mask_value, placement, overflow, pad_rows) -> pa.Array:
    sizes = np.asarray(data.value_lengths()).astype(np.int64)
    rows, _ = token_rows(*_masked(data.flatten(), mask.flatten(), mask_value), placement, overflow)
    if pad_rows:
        full = np.full((len(sizes), k + 1, TOKENS_PER_PACKET), PAD, np.int32)
        full[np.arange(k + 1) < sizes[:, None]] = rows
        rows, sizes = full.reshape(-1, TOKENS_PER_PACKET), np.full(len(sizes), k + 1)
    inner = pa.ListArray.from_arrays(
        pa.array((np.arange(len(rows) + 1) * TOKENS_PER_PACKET).astype(np.int32)), pa.array(rows.ravel())
    )
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), inner)


def batches_of(rows: DataFrame, order: str, size: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``batch_id`` and ``batch_pos`` along a unique integer column."""
    indexed = row_index(rows, order, "__idx", width)
    return indexed.withColumns(
        {"batch_id": F.floor(F.col("__idx") / size).cast("long"), "batch_pos": (F.col("__idx") % size).cast("int")}
    ).drop("__idx")


def validation_batch(batched: DataFrame, number: int) -> DataFrame:
    """One batch; numbers past the last start again at the first."""
    last = batched.agg((F.max("batch_id") + 1).alias("n")).scalar()
    return batched.filter(F.col("batch_id") == F.lit(number) % last)


def batch_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("batches"))


def payload_queues(packets: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every payload with its place in the queue of its flow, the newest at 0.

    One row per payload: the queue of a busy flow has no bound.
    """
    cut = balanced(packets, ["flow_key"], "packet_no", width)
    placed = numbered(cut, ["flow_key"], ["packet_no"], F.col(SEGMENT), "__rn", "__total")
    return placed.withColumn("queue_pos", F.col("__total") - 1 - F.col("__rn")).drop("__rn", "__total")


def drain_batches(packets: DataFrame, size: int = 100, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Queues emptied from the oldest end, at most ``size`` payloads per row."""
    cut = balanced(packets, ["flow_key"], "packet_no", width)
    placed = numbered(cut, ["flow_key"], ["packet_no"], F.col(SEGMENT), "__rn")
    return (
        placed.withColumn("drain_no", F.floor(F.col("__rn") / size).cast("long"))
        .groupBy("flow_key", "drain_no")
        .agg(F.array_sort(F.collect_list(F.struct("packet_no", "payload"))).alias("messages"))
    )
