"""Flat feature tables: one dotted column per decoded field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.net import ip_text

ZERO_ADDRESS = "0.0.0.0"


def _hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def _feature_columns(packets: DataFrame) -> dict[str, Column]:
    columns = {
        "frame.time": F.lit(None).cast("string"),
        "ip_set": F.col("ip").isNotNull(),
        "ip.src_host": ip_text(F.col("ip.src_host")),
        "ip.dst_host": ip_text(F.col("ip.dst_host")),
        "arp_set": F.col("arp").isNotNull(),
        "arp.dst.proto_ipv4": ip_text(F.col("arp.dst_proto_ipv4")),
        "arp.opcode": F.col("arp.opcode"),
        "arp.hw.size": F.col("arp.hw_size"),
        "arp.src.proto_ipv4": ip_text(F.col("arp.src_proto_ipv4")),
        "icmp.checksum": F.col("icmp.checksum"),
        "icmp.seq_le": F.col("icmp.seq_le"),
        "icmp.transmit_timestamp": F.col("icmp.transmit_time"),
        "icmp.unused": _hex_text(F.col("icmp.unused")),
        "http.file_data": F.lit(None).cast("string"),
        "http.content_length": F.col("http.content_length"),
        "http.request.uri.query": F.col("http.request_uri_query"),
        "http.request.method": F.col("http.request_method"),
        "http.referer": F.col("http.referer"),
        "http.request.full_uri": F.col("http.request_full_uri"),
        "http.request.version": F.col("http.request_version"),
        "http.response": F.col("http.response"),
        "tcp_set": F.col("tcp").isNotNull(),
        "tcp.ack": F.lit(None).cast("int"),
        "tcp.ack_raw": F.col("tcp.ack_raw"),
        "tcp.checksum": F.when(F.col("tcp").isNotNull(), F.format_string("0x%08x", F.col("tcp.checksum"))),
        "tcp.connection.fin": F.col("tcp.connection_fin"),
        "tcp.connection.rst": F.col("tcp.connection_rst"),
        "tcp.connection.syn": F.col("tcp.connection_syn"),
        "tcp.connection.synack": F.col("tcp.connection_synack"),
        "tcp.dstport": F.col("tcp.dstport"),
        "tcp.flags": F.col("tcp.flags"),
        "tcp.len": F.col("tcp.len"),
        "tcp.options": _hex_text(F.col("tcp.options")),
        "tcp.payload": _hex_text(F.when(F.col("tcp").isNotNull(), F.col("payload"))),
        "tcp.seq": F.col("tcp.seq"),
        "tcp.srcport": F.col("tcp.srcport"),
        "udp_set": F.col("udp").isNotNull(),
        "udp.port": F.col("udp.port_src"),
        "udp.stream": F.col("udp.stream_id"),
        "udp.time_delta": F.col("udp.time_delta"),
        "dns.qry.name": F.col("dns.qry_name"),
        "dns.qry.name.len": F.col("dns.qry_name_len"),
        "dns.qry.qu": F.col("dns.qry_qu"),
        "dns.qry.type": F.col("dns.qry_type"),
        "dns.retransmission": F.lit(None).cast("boolean"),
        "dns.retransmit_request_in": F.lit(None).cast("long"),
        "mqtt.conack.flags": F.col("mqtt.conack_flags"),
        "mqtt.conflag.cleansess": F.col("mqtt.conflag_cleansess"),
        "mqtt.conflags": F.col("mqtt.conflags"),
        "mqtt.hdrflags": F.col("mqtt.hdrflags"),
        "mqtt.len": F.col("mqtt.len"),
        "mqtt.msg_decoded_as": F.lit(None).cast("string"),
        "mqtt.msg": F.lit(None).cast("string"),
        "mqtt.msgtype": F.col("mqtt.msgtype"),
        "mqtt.proto_len": F.col("mqtt.proto_len"),
        "mqtt.protoname": F.col("mqtt.protoname"),
        "mqtt.topic": F.col("mqtt.topic"),
        "mqtt.topic_len": F.col("mqtt.topic_len"),
        "mqtt.ver": F.col("mqtt.ver"),
        "mbtcp.len": F.col("modbus.len"),
        "mbtcp.trans_id": F.col("modbus.trans_id"),
        "mbtcp.unit_id": F.col("modbus.unit_id"),
    }
    # Retransmission columns are present once packets went through the DNS operator.
    for flat, name in (("dns.retransmission", "dns_retransmit"), ("dns.retransmit_request_in", "dns_retransmit_request_in")):
        if name in packets.columns:
            columns[flat] = F.col(name)
    return columns


def flatten_features(packets: DataFrame) -> DataFrame:
    """Nested packets as the flat table the feature consumer writes; names, not positions."""
    return packets.select("packet_no", *[c.alias(n) for n, c in _feature_columns(packets).items()])


# Order of the feature file's columns (fixed values).
CSV_COLUMNS = (
    "frame.time ip.src_host ip.dst_host arp.dst.proto_ipv4 arp.opcode arp.hw.size arp.src.proto_ipv4 "
    "icmp.checksum icmp.seq_le icmp.transmit_timestamp icmp.unused http.file_data http.content_length "
    "http.request.uri.query http.request.method http.referer http.request.full_uri http.request.version "
    "http.response http.tls_port tcp.ack tcp.ack_raw tcp.checksum tcp.connection.fin tcp.connection.rst "
    "tcp.connection.syn tcp.connection.synack tcp.dstport tcp.flags tcp.flags.ack tcp.len tcp.options "
    "tcp.payload tcp.seq tcp.srcport udp.port udp.stream udp.time_delta dns.qry.name dns.qry.name.len "
    "dns.qry.qu dns.qry.type dns.retransmission dns.retransmit_request dns.retransmit_request_in "
    "mqtt.conack.flags mqtt.conflag.cleansess mqtt.conflags mqtt.hdrflags mqtt.len mqtt.msg_decoded_as "
    "mqtt.msg mqtt.msgtype mqtt.proto_len mqtt.protoname mqtt.topic mqtt.topic_len mqtt.ver mbtcp.len "
    "mbtcp.trans_id mbtcp.unit_id Attack_label Attack_type"
).split()

# Columns the packets do not carry, with the constant the file holds instead.
CSV_CONSTANTS = {
    "frame.time": "Not_in_Data",
    "http.tls_port": 0,
    "tcp.ack": 1,
    "tcp.flags.ack": 1,
    "dns.retransmit_request": False,
    "Attack_label": "",
    "Attack_type": "",
}


def csv_projection(packets: DataFrame) -> DataFrame:
    """The 63-column feature file; absent protocols hold zero values instead of NULL."""
    features = {
        **_feature_columns(packets),
        **{name: F.lit(value) for name, value in CSV_CONSTANTS.items()},
        # The file has the plain checksum and the destination port of UDP.
        "tcp.checksum": F.col("tcp.checksum"),
        "udp.port": F.col("udp.port_dst"),
    }
    flat = packets.select(*[features[name].alias(name) for name in CSV_COLUMNS])
    types = dict(flat.dtypes)
    columns = []
    for name in CSV_COLUMNS:
        column = F.col(f"`{name}`")
        if name in ("ip.src_host", "ip.dst_host", "arp.dst.proto_ipv4", "arp.src.proto_ipv4"):
            column = F.coalesce(column, F.lit(ZERO_ADDRESS))
        elif types[name] == "string":
            column = F.coalesce(column, F.lit(""))
        elif types[name] == "boolean":
            column = F.coalesce(column, F.lit(False))
        else:
            column = F.coalesce(column, F.lit(0))
        columns.append(column.alias(name))
    return flat.select(*columns)
