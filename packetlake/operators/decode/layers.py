"""Ethernet, ARP, IP and transport layers.

Each step adds helper columns (leading underscore) that later steps read, so a
value is computed once per frame. Layer lengths come from the length fields of
the headers, which leaves Ethernet padding out of the payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators.decode.sqltext import any_of, case, piece, step, u8, u16, u32

ETHERNET_HEADER = 14
ARP_END = ETHERNET_HEADER + 28

# EtherType names (fixed values).
ETHERTYPES = {
    0x0800: "IPv4",
    0x86DD: "IPv6",
    0x0806: "ARP",
    0x8100: "VLAN (802.1Q)",
    0x88A8: "Provider Bridging (802.1ad/Q-in-Q)",
    0x8847: "MPLS Unicast",
    0x8848: "MPLS Multicast",
    0x8863: "PPPoE Discovery",
    0x8864: "PPPoE Session",
    0x8808: "IEEE Std 802.3 - Ethernet Passive Optical Network (EPON)",
    0x88CC: "LLDP (Link Layer Discovery Protocol)",
    0x88E5: "MACsec (IEEE 802.1AE)",
    0x8915: "ROCEv2 (RDMA over Converged Ethernet v2)",
    0x8906: "Fibre Channel over Ethernet (FCoE)",
    0x880B: "PPP",
    0x8137: "IPX",
    0x88E3: "MRP (medium redundancy protocol)",
    0x8892: "Profinet RT",
}

# IP protocol numbers (fixed values).
TRANSPORTS = {6: "TCP", 17: "UDP", 1: "ICMPv4", 58: "ICMPv6"}
# Extension headers: hop-by-hop, routing, fragment, authentication, destination
# options, mobility, host identity, shim6 (fixed values).
EXTENSIONS = [0, 43, 44, 51, 60, 135, 139, 140]
FRAGMENT, AUTHENTICATION = 44, 51
# Bytes of the shortest extension header, so the bytes present bound their number.
LEAST_EXTENSION = 8

# Values of decode_error.
TOO_SHORT = "ethernet_too_short"
NOT_SLICEABLE = "slice_error"
NOT_IMPLEMENTED = "ethertype_not_implemented"
NO_TRANSPORT = "no_transport_header"
NO_FLOW_KEY = "no_flow_key"
UNKNOWN_ETHERTYPE = "format_string('unknown_ethertype(0x%04X)', _ethertype)"

IS_IP = "_ether IN ('IPv4', 'IPv6')"


def ethernet(frames: DataFrame) -> DataFrame:
    typed = step(frames, _size="length(data)", _ethertype=f"IF(length(data) >= {ETHERNET_HEADER}, {u16('data', 12)}, NULL)")
    return step(typed, _ether=case((f"_ethertype = {n}", f"'{t}'") for n, t in ETHERTYPES.items()))


def _extension_walk() -> str:
    """Protocol and offset behind the extension headers of an IP packet."""
    length = case(
        [
            (f"s.proto = {FRAGMENT}", "8"),
            (f"s.proto = {AUTHENTICATION}", f"({u8('data', 's.at + 1')} + 2) * 4"),
        ],
        f"({u8('data', 's.at + 1')} + 1) * 8",
    )
    fragmented = f"(s.proto = {FRAGMENT} AND {u16('data', 's.at + 2')} & {0xFFF9} <> 0)"
    following = f"named_struct('proto', {u8('data', 's.at')}, 'at', s.at + {length}, 'fragmented', {fragmented})"
    begin = "named_struct('proto', _ip_proto, 'at', _ip_header + 14, 'fragmented', false)"
    known = any_of(EXTENSIONS)
    return f"""CASE WHEN _ip_ok AND _ip_proto IN ({known}) THEN aggregate(
        sequence(1, greatest(0, _ip_end - _ip_header - 14) div {LEAST_EXTENSION} + 1), {begin},
        (s, i) -> IF(s.proto IN ({known}) AND NOT s.fragmented, {following}, s)) END"""


def network(frames: DataFrame) -> DataFrame:
    """IP header sizes, where the transport header starts and the IP payload ends.

    Two 32-bit words hold all fields needed: bytes 14-17 (version, IPv4 header
    and total length), and bytes 20-23 of IPv4 (fragment, protocol) or 18-21 of
    IPv6 (payload length, next header).
    """
    words = step(
        frames,
        _ip_word=f"IF({IS_IP}, {u32('data', 14)}, NULL)",
        _ip_word2=f"CASE _ether WHEN 'IPv4' THEN {u32('data', 20)} WHEN 'IPv6' THEN {u32('data', 18)} END",
    )
    # An IPv6 payload length of 0 means "up to the end of the frame".
    bounds = step(
        words,
        _ip_version="_ip_word >> 28",
        _ip_header="CASE _ether WHEN 'IPv4' THEN cast(_ip_word >> 24 & 15 as int) * 4 WHEN 'IPv6' THEN 40 END",
        _ip_end="""cast(CASE _ether WHEN 'IPv4' THEN (_ip_word & 65535) + 14
            WHEN 'IPv6' THEN IF(_ip_word2 >> 16 = 0, _size, (_ip_word2 >> 16) + 54) END as int)""",
        _ip_proto="cast(CASE _ether WHEN 'IPv4' THEN _ip_word2 & 255 WHEN 'IPv6' THEN _ip_word2 >> 8 & 255 END as int)",
        _v4_fragment=f"coalesce(_ether = 'IPv4' AND _ip_word2 >> 16 & {0x3FFF} <> 0, false)",
    )
    checked = step(
        bounds,
        _ip_ok="""coalesce(CASE _ether
            WHEN 'IPv4' THEN _size >= 34 AND _ip_version = 4 AND _ip_header >= 20
              AND _ip_end >= _ip_header + 14 AND _ip_end <= _size
            WHEN 'IPv6' THEN _size >= 54 AND _ip_version = 6 AND _ip_end <= _size END, false)""",
    )
    walked = step(checked, _walk=_extension_walk())
    placed = step(
        walked,
        _l4_at="IF(_ip_ok, coalesce(_walk.at, _ip_header + 14), NULL)",
        _l4_proto="IF(_ip_ok AND NOT _v4_fragment AND NOT coalesce(_walk.fragmented, false), coalesce(_walk.proto, _ip_proto), NULL)",
    )
    return step(
        placed,
        _transport=case((f"_l4_proto = {n}", f"'{t}'") for n, t in TRANSPORTS.items()),
        _l4_room="_ip_end - _l4_at",
    )


def transport(packets: DataFrame) -> DataFrame:
    """Transport header length, payload bounds, ports, and whether it is well formed.

    The first 32-bit word has both ports, or the ICMP type and code; one more
    16-bit word has the TCP offset and flags, or the UDP length.
    """
    words = step(
        packets,
        _l4_word=f"IF(_transport IS NOT NULL, {u32('data', '_l4_at')}, NULL)",
        _l4_word2=f"CASE _transport WHEN 'TCP' THEN {u16('data', '_l4_at + 12')} WHEN 'UDP' THEN {u16('data', '_l4_at + 4')} END",
    )
    fields = step(
        words,
        _src_port="IF(_transport IN ('TCP', 'UDP'), cast(_l4_word >> 16 as int), NULL)",
        _dst_port="IF(_transport IN ('TCP', 'UDP'), cast(_l4_word & 65535 as int), NULL)",
        _icmp_type="IF(_transport IN ('ICMPv4', 'ICMPv6'), cast(_l4_word >> 24 as int), NULL)",
        _l4_header="CASE WHEN _transport = 'TCP' THEN (_l4_word2 >> 12) * 4 WHEN _transport IS NOT NULL THEN 8 END",
        _l4_end="IF(_transport = 'UDP' AND _l4_word2 > 0, _l4_at + _l4_word2, _ip_end)",
        # An ICMPv4 timestamp message; it has exactly 20 bytes.
        _icmp_stamp="coalesce(_transport = 'ICMPv4' AND _l4_word >> 16 IN (3328, 3584), false)",
    )
    return step(
        fields,
        _l4_ok="""_transport IS NULL OR coalesce(CASE _transport
            WHEN 'TCP' THEN _l4_room >= 20 AND _l4_header >= 20 AND _l4_header <= _l4_room
            WHEN 'UDP' THEN _l4_room >= 8 AND (_l4_word2 = 0 OR _l4_word2 BETWEEN 8 AND _l4_room)
            ELSE _l4_room >= 8 AND (NOT _icmp_stamp OR _l4_room = 20) END, false)""",
        _payload_at="_l4_at + _l4_header",
        _payload_size="_l4_end - _l4_at - _l4_header",
    )


# First reason, in decoding order, why a frame gives no packet.
DECODE_ERROR = case(
    [
        ("_ethertype IS NULL", f"'{TOO_SHORT}'"),
        ("_ether IS NULL", UNKNOWN_ETHERTYPE),
        (f"{IS_IP} AND NOT (_ip_ok AND _l4_ok)", f"'{NOT_SLICEABLE}'"),
        (f"NOT ({IS_IP} OR _ether = 'ARP')", f"'{NOT_IMPLEMENTED}'"),
        (f"{IS_IP} AND _transport IS NULL", f"'{NO_TRANSPORT}'"),
        (f"_ether = 'ARP' AND _size < {ARP_END}", f"'{NO_FLOW_KEY}'"),
    ]
)


def _bytes(*runs: tuple[int, int]) -> str:
    return "X'" + "".join(f"{value:02X}" * count for value, count in runs) + "'"


# One byte per frame byte: 1 over MAC and IP addresses, else 0.
_MACS = (1, 12)
_MASK_HEAD = case(
    [
        (f"_ether = 'ARP' AND _size >= {ARP_END}", _bytes(_MACS, (0, 10), (1, 20))),
        ("_ether = 'IPv4'", _bytes(_MACS, (0, 14), (1, 8))),
        ("_ether = 'IPv6'", _bytes(_MACS, (0, 10), (1, 32))),
    ],
    _bytes(_MACS),
)
ENDPOINT_MASK = f"IF(decode_error IS NULL, rpad({_MASK_HEAD}, _size, X'00'), NULL)"

# Protocol structs. A failed frame has no ``_ether`` and no ``_transport`` any more.
ARP_FIELDS = f"""IF(_ether = 'ARP', named_struct(
    'dst_proto_ipv4', {piece('data', 38, 4)}, 'src_proto_ipv4', {piece('data', 28, 4)},
    'opcode', cast(_arp_word & 65535 as int), 'hw_size', cast(_arp_word >> 24 as int)), NULL)"""

IP_FIELDS = f"""CASE _ether
    WHEN 'IPv4' THEN named_struct('src_host', {piece('data', 26, 4)}, 'dst_host', {piece('data', 30, 4)})
    WHEN 'IPv6' THEN named_struct('src_host', {piece('data', 22, 16)}, 'dst_host', {piece('data', 38, 16)}) END"""

# Bits of the TCP flag word (fixed values): FIN 1, SYN 2, RST 4, PSH 8, ACK 16,
# URG 32, ECE 64, CWR 128, NS 256.
TCP_FIELDS = f"""IF(_transport = 'TCP', named_struct(
    'ack_raw', {u32('data', '_l4_at + 8')}, 'checksum', {u16('data', '_l4_at + 16')},
    'connection_fin', _l4_word2 & 1 <> 0, 'connection_rst', _l4_word2 & 4 <> 0,
    'connection_syn', _l4_word2 & 2 <> 0, 'connection_synack', _l4_word2 & 18 = 18,
    'dstport', _dst_port, 'flags', _l4_word2 & 511, 'len', _payload_size,
    'options', {piece('data', '_l4_at + 20', '_l4_header - 20')},
    'seq', {u32('data', '_l4_at + 4')}, 'srcport', _src_port), NULL)"""

UDP_FIELDS = """IF(_transport = 'UDP', named_struct(
    'port_dst', _dst_port, 'port_src', _src_port, 'stream_id', 0, 'time_delta', cast(0 as double)), NULL)"""

ICMP_FIELDS = f"""IF(_transport IN ('ICMPv4', 'ICMPv6'), named_struct(
    'checksum', {u16('data', '_l4_at + 2')},
    'seq_le', IF(IF(_transport = 'ICMPv4', _icmp_type IN (0, 8), _icmp_type IN (128, 129)),
                 {u16('data', "_l4_at + IF(_transport = 'ICMPv4', 6, 4)")}, 0),
    'transmit_time', IF(_icmp_stamp, {u32('data', '_l4_at + 16')}, cast(0 as bigint)),
    'unused', {piece('data', '_l4_at + IF(_icmp_stamp, 20, 8)', '_ip_end - _l4_at - IF(_icmp_stamp, 20, 8)')}), NULL)"""

# Struct columns of the packet record, in order.
PROTOCOL_FIELDS = {"arp": ARP_FIELDS, "ip": IP_FIELDS, "tcp": TCP_FIELDS, "udp": UDP_FIELDS, "icmp": ICMP_FIELDS}


def protocols(packets: DataFrame) -> DataFrame:
    """Protocol structs of the frames that decoded."""
    kept = packets.withColumns(
        {c: F.when(F.col("decode_error").isNull(), F.col(c)) for c in ("_ether", "_transport", "_src_port", "_dst_port")}
    )
    worded = step(kept, _arp_word=f"IF(_ether = 'ARP', {u32('data', 18)}, NULL)")
    return step(worded, **PROTOCOL_FIELDS)
