"""The light decoding profile: mask, header length and hierarchy only.

It looks at the destination port alone, joins names with spaces around the
arrow, and measures application headers on all bytes behind the transport header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators.decode.applications import blank_line_bytes, by_ports, mqtt_head
from packetlake.operators.decode.layers import (
    ARP_END,
    ENDPOINT_MASK,
    IS_IP,
    NO_TRANSPORT,
    NOT_SLICEABLE,
    TOO_SHORT,
    UNKNOWN_ETHERTYPE,
)
from packetlake.operators.decode.sqltext import case, step, u16

# Application names by destination port (fixed values).
LIGHT_TCP_PORTS = {"HTTP": [80, 8080], "HTTPS": [443], "MQTT": [1883, 8883], "MBTCP": [502]}
LIGHT_UDP_PORTS = {"DNS": [53, 5353]}

# Variable header bytes by MQTT message type (fixed values); PUBLISH adds its
# topic and, with a quality of service, a packet id.
MQTT_VARIABLE = """CASE WHEN _mq_kind = 1 THEN 10 WHEN _mq_kind = 2 THEN 2
    WHEN _mq_kind = 3 THEN 2 + _topic_size + IF(_mq_first & 6 <> 0, 2, 0)
    WHEN _mq_kind BETWEEN 4 AND 11 THEN 2 WHEN _mq_kind BETWEEN 12 AND 14 THEN 0
    WHEN _mq_kind = 15 THEN _mq_len END"""

LIGHT_ERROR = case(
    [
        ("_ethertype IS NULL", f"'{TOO_SHORT}'"),
        (f"_ether IS NULL OR NOT ({IS_IP} OR _ether = 'ARP')", UNKNOWN_ETHERTYPE),
        (f"{IS_IP} AND NOT (_ip_ok AND _l4_ok)", f"'{NOT_SLICEABLE}'"),
        (f"{IS_IP} AND _transport IS NULL", f"'{NO_TRANSPORT}'"),
    ]
)


def decode_light(located: DataFrame) -> DataFrame:
    """Finishes frames whose layers are located; see ``decode_packets``."""
    whole_arp = f"_ether = 'ARP' AND _size >= {ARP_END}"
    placed = step(
        located,
        decode_error=LIGHT_ERROR,
        _app=f"""CASE _transport WHEN 'TCP' THEN {by_ports(LIGHT_TCP_PORTS, '_dst_port')}
            WHEN 'UDP' THEN {by_ports(LIGHT_UDP_PORTS, '_dst_port')} END""",
        _head=f"CASE WHEN {whole_arp} THEN {ARP_END} WHEN {IS_IP} THEN 14 + _ip_header + _l4_header ELSE 14 END",
    )
    rest = step(
        placed,
        _mq="IF(_app = 'MQTT', substring(data, _head + 1), NULL)",
        _web_text="IF(_app IN ('HTTP', 'HTTPS'), make_valid_utf8(cast(substring(data, _head + 1) as string)), NULL)",
    )
    lines = step(rest, _web_lines="split(_web_text, R'\\r?\\n')")
    headed = mqtt_head(step(lines, _web_blank="array_position(_web_lines, '')"), "_mq")
    topics = step(headed, _topic_size=f"IF(length(_mq) >= _mq_at + 2, {u16('_mq', '_mq_at')}, NULL)")
    measured = step(
        topics,
        _app_header=f"""CASE WHEN _app = 'MQTT' THEN _mq_at + {MQTT_VARIABLE}
            WHEN _app IN ('HTTP', 'HTTPS') THEN
              IF(_web_blank > 0 AND _web_blank < size(_web_lines), {blank_line_bytes('_web_lines', '_web_blank')}, NULL)
            WHEN _app = 'DNS' THEN IF(_size >= 12 + _head, 12, NULL)
            WHEN _app = 'MBTCP' THEN IF(_size >= 8 + _head, 8, NULL) END""",
    )
    hierarchy = f"""concat_ws('', 'Ethernet -> ', CASE WHEN {whole_arp} THEN 'ARP' WHEN {IS_IP} THEN concat(_ether, ' -> ') END,
        IF(_transport IN ('TCP', 'UDP'), concat(_transport, ' -> '), _transport), IF(_app_header IS NOT NULL, _app, NULL))"""
    # An MQTT payload that is empty or unreadable counts as header, unnamed.
    header = "IF(_app = 'MQTT' AND _app_header IS NULL, _size, _head + coalesce(_app_header, 0))"

    def when_good(sql: str) -> F.Column:
        return F.expr(f"IF(decode_error IS NULL, {sql}, NULL)")

    return measured.select(
        "packet_no",
        "ts",
        "data",
        when_good(ENDPOINT_MASK).alias("mask"),
        when_good(header).alias("header_len"),
        when_good(hierarchy).alias("proto_hierarchy"),
        "decode_error",
    )
