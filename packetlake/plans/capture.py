"""Captures to packet, flow, graph and queue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from packetlake.functions.flowkey import flow_key_text
from packetlake.operators.decode import decode_packets, split_errors
from packetlake.operators.dns import with_retransmissions
from packetlake.operators.features import flatten_features
from packetlake.operators.flows import flow_stats
from packetlake.operators.graph import (
    as_nodes,
    device_controls,
    device_nodes,
    edges_between,
    flow_edges,
    ip_nodes,
    merge_nodes,
)
from packetlake.sources.pcap import read_frames
from packetlake.sources.sinks import append_payloads, write_graph, write_packet_table

__all__ = ["read_frames", "run_capture_job"]


def run_capture_job(
    frames: DataFrame,
    out: str,
    devices: DataFrame | None = None,
    cache_payloads: bool = False,
    parity: bool = False,
    features: bool = False,
) -> dict[str, int]:
    """Decodes once, stores the packets, and derives all other tables from the store.

    With ``features`` the flat table of all fields is one of them. It has the DNS
    retransmissions, which need all packets. Its payload column holds what the
    frames hold from ``header_len`` on only where the decoder stored it, so the
    payload is stored then. Returns the numbers of frames and of frames that gave no packet.
    """
    spark = frames.sparkSession
    counts = Observation()
    decoded = decode_packets(frames, parity=parity, counts=counts)
    if not features:
        # The payload is part of the frame, so it is not stored a second time.
        decoded = decoded.drop("payload")
    decoded.write.mode("overwrite").parquet(f"{out}/decoded")
    totals = counts.get
    # Later steps read the columns they need from the stored packets.
    packets, errors = split_errors(spark.read.parquet(f"{out}/decoded"))
    write_packet_table(packets, f"{out}/packets", mode="overwrite")
    errors.write.mode("overwrite").parquet(f"{out}/errors")
    flows = flow_stats(packets)
    flows.write.mode("overwrite").parquet(f"{out}/flows")
    flows = spark.read.parquet(f"{out}/flows")
    nodes = ip_nodes(packets)
    if features:
        flatten_features(with_retransmissions(packets)).write.mode("overwrite").parquet(f"{out}/features")
    if devices is not None:
        controls = device_controls(devices)
        nodes = merge_nodes(as_nodes(controls.select("address")), nodes)
        device_nodes(devices).write.mode("overwrite").parquet(f"{out}/devices")
        controls.write.mode("overwrite").parquet(f"{out}/controls")
    write_graph(nodes, edges_between(flow_edges(flows), nodes), out)
    if cache_payloads:
        key = flow_key_text(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")])
        append_payloads(packets.select(key.alias("flow_key"), "packet_no", F.col("data").alias("payload")), f"{out}/queues")
    return totals
