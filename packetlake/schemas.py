"""Fixed schemas of the packet, flow, graph and sequence tables."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType(
    [
        T.StructField("packet_no", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("orig_len", T.LongType(), False),
        T.StructField("data", T.BinaryType(), False),
    ]
)

PACKET_TABLE = T.StructType(
    [
        T.StructField("proto_hierarchy", T.StringType()),
        T.StructField("flow_key", T.StringType()),
        T.StructField("timestamp_s", T.LongType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("mask", T.BinaryType()),
        T.StructField("header_len", T.IntegerType()),
    ]
)

LABELLED_PACKETS = T.StructType(
    [
        T.StructField("packet_no", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("mask", T.BinaryType()),
        T.StructField("proto_hierarchy", T.StringType()),
        T.StructField("AttackLabel", T.StringType()),
        T.StructField("FlowID", T.LongType()),
    ]
)

DEVICE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("ip_addresses", T.ArrayType(T.StringType())),
    ]
)

TOPOLOGY = T.StructType([T.StructField("devices", T.ArrayType(DEVICE))])

# Columns that identify one bidirectional flow.
FLOW_KEY = ["ip_lo", "ip_hi", "port_lo", "port_hi", "protocol"]

# Columns of one directional endpoint pair, as found on a packet.
ENDPOINTS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

# Token ids (fixed values): bytes are 0-255, then the special ids.
PAD, END, CLS, MASK, ENDPOINT, BOS = 256, 257, 258, 259, 260, 261
VOCABULARY = 262
TOKENS_PER_PACKET = 1520
