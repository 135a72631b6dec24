"""The decode job: frames in, one nested packet row per frame out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from packetlake.functions.clock import micros_part, seconds_part
from packetlake.functions.flowkey import flow_key_text
from packetlake.operators.decode import layers
from packetlake.operators.decode.applications import APPLICATION, dns, http, modbus, mqtt
from packetlake.operators.decode.light import decode_light
from packetlake.operators.decode.sqltext import case, step

PROFILES = ("full", "light")


def decode_packets(
    frames: DataFrame,
    profile: str = "full",
    parity: bool = False,
    counts: Observation | None = None,
    dns_records: bool = False,
) -> DataFrame:
    """Decodes ``frames(packet_no, ts, data)``; no row is dropped.

    A frame that gives no packet has ``decode_error`` set and no protocol fields.
    The ``light`` profile gives mask, header length and hierarchy only. ``counts``
    receives the numbers of frames and of failed frames once an action has run.
    ``dns_records`` reads DNS messages to their end, in Arrow batches, and adds
    their ``dns_records`` and the ``dns_fault`` that stopped the reading.

    Counting is also what keeps the plan small: a filter on a decoded field stops
    at the counters. Pushed further down it would be rewritten in terms of the raw
    bytes, and the frames would be decoded twice.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    located = layers.transport(layers.network(layers.ethernet(frames)))
    if profile == "light":
        return _counted(decode_light(located), counts)
    checked = step(step(located, decode_error=layers.DECODE_ERROR), mask=layers.ENDPOINT_MASK)
    applied = _with_applications(layers.protocols(_counted(checked, counts)), parity, dns_records)
    packets = _assemble(applied, parity, dns_records)
    return packets.observe(f"packets-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("packets"))


def _counted(rows: DataFrame, counts: Observation | None) -> DataFrame:
    """Counts frames, and those with a ``decode_error``, as the job runs."""
    name = counts or f"decode-{uuid.uuid4().hex}"
    return rows.observe(name, F.count(F.lit(1)).alias("frames"), F.count("decode_error").alias("issues"))


def _with_applications(packets: DataFrame, parity: bool, dns_records: bool) -> DataFrame:
    ported = step(
        packets,
        _app=APPLICATION,
        payload="IF(_src_port IS NOT NULL, substring(data, _payload_at + 1, _payload_size), NULL)",
    )
    return modbus(mqtt(http(dns(ported, dns_records), parity)))


READERS = ("dns", "mqtt", "modbus", "http")


def _assemble(decoded: DataFrame, parity: bool, dns_records: bool) -> DataFrame:
    any_named = " OR ".join(f"coalesce(_{r}_named, false)" for r in READERS)
    app_header = case([(f"_{r}_named", f"_{r}_header") for r in READERS], "0")
    # An MQTT segment without payload counts wholly as header.
    header = f"""CASE WHEN _ether = 'ARP' THEN {layers.ARP_END}
        WHEN _app = 'MQTT' AND length(payload) = 0 THEN _size
        WHEN _ether IS NOT NULL THEN 14 + _ip_header + _l4_header + {app_header} END"""
    hierarchy = f"""IF(_ether IS NOT NULL, concat_ws('->', 'Ethernet', _ether, _transport,
        IF({any_named} OR coalesce(_app = 'SSH', false), _app, NULL)), NULL)"""
    size = "_size % 65536" if parity else "_size"
    nested = decoded.select(
        "packet_no",
        "ts",
        "data",
        "mask",
        F.expr(header).alias("header_len"),
        F.expr(hierarchy).alias("proto_hierarchy"),
        "decode_error",
        F.expr(f"IF(_ether IS NOT NULL, {size}, NULL)").alias("size"),
        "payload",
        *layers.PROTOCOL_FIELDS,
        F.expr("IF(_dns_named, _dns_fields, NULL)").alias("dns"),
        *[F.col(f"_{r}_fields").alias(r) for r in READERS[1:]],
        *([F.col("_dns_walk.records").alias("dns_records"), F.col("_dns_walk.fault").alias("dns_fault")] if dns_records else []),
    )
    return with_endpoints(nested)


def with_endpoints(packets: DataFrame) -> DataFrame:
    """Directional flow key of decoded packets: ARP, then IP; ports only of TCP and UDP."""
    zero = F.when(F.col("decode_error").isNull(), F.lit(0))
    return packets.withColumns(
        {
            "src_ip": F.coalesce("arp.src_proto_ipv4", "ip.src_host"),
            "dst_ip": F.coalesce("arp.dst_proto_ipv4", "ip.dst_host"),
            "src_port": F.coalesce("tcp.srcport", "udp.port_src", zero),
            "dst_port": F.coalesce("tcp.dstport", "udp.port_dst", zero),
            "protocol": F.col("proto_hierarchy"),
        }
    )


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets with a flow key, and the frames that gave none with their reason."""
    good = decoded.filter(F.col("decode_error").isNull())
    errors = decoded.filter(F.col("decode_error").isNotNull()).select("packet_no", "ts", "data", "decode_error")
    return good, errors


def packet_table(packets: DataFrame, *others: str) -> DataFrame:
    """The seven columns of the stored packet table, behind ``others`` that are asked for."""
    return packets.select(
        *others,
        "proto_hierarchy",
        flow_key_text(*[F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]).alias("flow_key"),
        seconds_part(F.col("ts")).alias("timestamp_s"),
        micros_part(F.col("ts")).alias("timestamp_us"),
        "data",
        "mask",
        "header_len",
    )


def decode_summary(decoded: DataFrame) -> DataFrame:
    """Frames per outcome; the empty reason counts decoded packets."""
    reason = F.coalesce("decode_error", F.lit(""))
    return decoded.groupBy(reason.alias("decode_error")).agg(F.count(F.lit(1)).alias("frames"))
