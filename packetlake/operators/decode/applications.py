"""Application headers behind TCP and UDP: DNS, MQTT, Modbus/TCP, HTTP.

Every reader sits behind the port test, so other packets do not pay for it. It
leaves three columns: the decoded fields, the header length to add, and whether
the protocol name is added to the hierarchy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators.decode.dnsmessage import walk_messages
from packetlake.operators.decode.sqltext import any_of, case, piece, step, u8, u16

# Application names by port, first match wins (fixed values).
TCP_PORTS = {
    "HTTP": [80, 8080, 8888, 3000, 8000, 8008],
    "HTTPS": [443],
    "MQTT": [1883, 8883],
    "ModbusTCP": [502],
    "DNS": [53],
    "MDNS": [5353],
    "SSH": [22],
}
UDP_PORTS = {"DNS": [53], "MDNS": [5353]}


def by_ports(table: dict[str, list[int]], *ports: str) -> str:
    """Name of the first application one of whose ports is used."""
    return case(
        (" OR ".join(f"{port} IN ({any_of(numbers)})" for port in ports), f"'{name}'") for name, numbers in table.items()
    )


# Application suggested by the ports of either side.
APPLICATION = f"""CASE _transport WHEN 'TCP' THEN {by_ports(TCP_PORTS, '_src_port', '_dst_port')}
    WHEN 'UDP' THEN {by_ports(UDP_PORTS, '_src_port', '_dst_port')} END"""


# --- DNS -------------------------------------------------------------------

# Question classes a resolver knows (fixed values): IN, CS, CH, HS, NONE, ANY.
DNS_CLASSES = [1, 2, 3, 4, 254, 255]
DNS_HEADER, DNS_MAX_LABELS, DNS_MAX_NAME = 12, 128, 255


def _question_name() -> str:
    """First question name, walking the labels from byte 12.

    Gives the name, the offset behind it, and ``ok``, which stays NULL until the
    closing zero byte or an unreadable label is met. A compression pointer cannot
    point anywhere sensible here and makes the message unreadable.
    """
    size = u8("_dns_message", "s.at")
    label = f"make_valid_utf8(cast({piece('_dns_message', 's.at + 1', size)} as string))"
    longer = f"concat(s.name, IF(s.name = '', '', '.'), {label})"
    forward = f"named_struct('name', {longer}, 'at', s.at + 1 + {size}, 'ok', cast(NULL as boolean))"
    advance = case(
        [
            ("s.ok IS NOT NULL", "s"),
            (f"{size} = 0", "named_struct('name', s.name, 'at', s.at + 1, 'ok', true)"),
            (f"{size} <= 63 AND s.at + 1 + {size} < length(_dns_message)", forward),
        ],
        "named_struct('name', s.name, 'at', s.at, 'ok', false)",
    )
    # A label takes two bytes or more, which bounds the steps by the message size.
    steps = f"sequence(1, least({DNS_MAX_LABELS}, greatest(1, (length(_dns_message) - {DNS_HEADER}) div 2 + 1)))"
    begin = f"named_struct('name', '', 'at', {DNS_HEADER}, 'ok', cast(NULL as boolean))"
    return f"IF(_dns_message IS NOT NULL, aggregate({steps}, {begin}, (s, i) -> {advance}), NULL)"


# The four counts of a message with one question and nothing else.
ONE_QUESTION = "X'0001000000000000'"


def dns(packets: DataFrame, records: bool = False) -> DataFrame:
    """DNS or multicast DNS question.

    Not named where there is no question or it asks for a unicast answer;
    ``rfc_compatible`` is false where the question cannot be read. Over TCP the
    message follows a two-byte length. With ``records`` messages that hold more
    than one question are read to their end, and a fault anywhere makes the
    message unreadable.
    """
    messages = step(
        packets, _dns_message="IF(_app IN ('DNS', 'MDNS'), IF(_transport = 'TCP', substring(payload, 3), payload), NULL)"
    )
    walked = step(messages, _dns_name=_question_name(), _dns_questions=u16("_dns_message", 4))
    tail = step(
        walked, _dns_type=u16("_dns_message", "_dns_name.at"), _dns_class=u16("_dns_message", "_dns_name.at + 2")
    )
    sound = "true"
    if records:
        more = F.expr(f"IF(substring(_dns_message, 5, 8) <> {ONE_QUESTION}, _dns_message, NULL)")
        tail = tail.withColumn("_dns_walk", walk_messages(more))
        sound = "_dns_walk.fault IS NULL"
    judged = step(
        tail,
        _dns_readable=f"""coalesce({sound} AND _dns_name.ok AND length(_dns_message) >= _dns_name.at + 4
            AND _dns_name.at <= {DNS_HEADER + DNS_MAX_NAME} AND _dns_class & {0x7FFF} IN ({any_of(DNS_CLASSES)}), false)""",
    )
    return step(
        judged,
        _dns_named=f"""_dns_message IS NOT NULL
            AND NOT (length(_dns_message) >= {DNS_HEADER} AND _dns_questions = 0)
            AND NOT (_dns_readable AND _dns_class & {0x8000} <> 0)""",
        _dns_header=str(DNS_HEADER),
        _dns_fields="""IF(_dns_message IS NOT NULL, named_struct(
            'rfc_compatible', _dns_readable, 'mdns', _app = 'MDNS',
            'qry_name', IF(_dns_readable, _dns_name.name, ''),
            'qry_name_len', IF(_dns_readable, octet_length(_dns_name.name), 0),
            'qry_qu', false,
            'qry_type', IF(_dns_readable, _dns_type, 0),
            'qry_class', IF(_dns_readable, _dns_class & 32767, 0)), NULL)""",
    )


# --- MQTT ------------------------------------------------------------------


def mqtt_head(packets: DataFrame, message: str) -> DataFrame:
    """First byte, remaining length and size of the fixed header (``_mq_at``).

    The length is base-128, at most four bytes; it is NULL if it does not end.
    """
    digit = u8(message, "i")
    following = f"""named_struct('len', s.len + ({digit} & 127) * cast(pow(128, i - 1) as int),
        'at', IF({digit} < 128, i + 1, NULL))"""
    begin = "named_struct('len', 0, 'at', cast(NULL as int))"
    walk = f"aggregate(sequence(1, 4), {begin}, (s, i) -> IF(s.at IS NULL, {following}, s))"
    read = step(packets, _mq_walk=f"IF(length({message}) > 0, {walk}, NULL)", _mq_first=u8(message, 0))
    return step(
        read,
        _mq_len="IF(_mq_walk.at IS NOT NULL, _mq_walk.len, NULL)",
        _mq_at="_mq_walk.at",
        _mq_kind="_mq_first >> 4",
    )


def mqtt(packets: DataFrame) -> DataFrame:
    """MQTT fixed header and the variable header of CONNECT (1), CONNACK (2), PUBLISH (3).

    Fields read before a failure stay, others are NULL; a failure leaves the
    packet unnamed. An empty payload counts as all header. PUBLISH is read to the
    end of the payload.
    """
    messages = step(packets, _mq="IF(_app = 'MQTT', payload, NULL)")
    headed = mqtt_head(messages, "_mq")
    sized = step(headed, _mq_text_size=f"IF(_mq_kind IN (1, 3) AND length(_mq) >= _mq_at + 2, {u16('_mq', '_mq_at')}, NULL)")
    raw = piece("_mq", "_mq_at + 2", "_mq_text_size")
    texts = step(
        sized,
        _mq_after="_mq_at + 2 + _mq_text_size",
        _mq_text=f"""IF(length(_mq) >= _mq_at + 2 + _mq_text_size AND is_valid_utf8(cast({raw} as string)),
            cast({raw} as string), NULL)""",
    )
    rest = step(
        texts,
        _mq_ver=f"IF(_mq_kind = 1 AND _mq_text IS NOT NULL, {u8('_mq', '_mq_after')}, NULL)",
        _mq_flags=f"IF(_mq_kind = 1 AND _mq_text IS NOT NULL, {u8('_mq', '_mq_after + 1')}, NULL)",
        _mq_ack=f"IF(_mq_kind = 2, {u8('_mq', '_mq_at')}, NULL)",
    )
    ended = step(
        rest,
        _mq_end="""CASE _mq_kind WHEN 1 THEN IF(_mq_flags IS NOT NULL, _mq_after + 2, NULL)
            WHEN 2 THEN IF(_mq_ack IS NOT NULL, _mq_at + 1, NULL)
            WHEN 3 THEN IF(_mq_text IS NOT NULL, length(_mq), NULL)
            ELSE _mq_at END""",
    )
    return step(
        ended,
        _mqtt_named="coalesce(length(_mq) = 0, false) OR _mq_end IS NOT NULL",
        _mqtt_header="coalesce(_mq_end, 0)",
        _mqtt_fields="""IF(length(_mq) > 0, named_struct(
            'conack_flags', _mq_ack, 'conflag_cleansess', _mq_flags & 2 <> 0, 'conflags', _mq_flags,
            'hdrflags', _mq_first & 15, 'len', _mq_len, 'msgtype', _mq_kind,
            'proto_len', IF(_mq_kind = 1 AND _mq_text IS NOT NULL, _mq_text_size, NULL),
            'protoname', IF(_mq_kind = 1, _mq_text, NULL),
            'topic', IF(_mq_kind = 3, _mq_text, NULL),
            'topic_len', IF(_mq_kind = 3 AND _mq_text IS NOT NULL, _mq_text_size, NULL),
            'ver', _mq_ver), NULL)""",
    )


# --- Modbus/TCP ------------------------------------------------------------

MODBUS_HEADER = 7


def modbus(packets: DataFrame) -> DataFrame:
    """Transaction, length and unit of the 7-byte Modbus/TCP header."""
    return step(
        packets,
        _modbus_named=f"coalesce(_app = 'ModbusTCP' AND length(payload) >= {MODBUS_HEADER}, false)",
        _modbus_header=str(MODBUS_HEADER),
        _modbus_fields=f"""IF(_app = 'ModbusTCP' AND length(payload) >= {MODBUS_HEADER}, named_struct(
            'len', {u16('payload', 4)}, 'trans_id', {u16('payload', 0)}, 'unit_id', {u8('payload', 6)}), NULL)""",
    )


# --- HTTP ------------------------------------------------------------------

# Limits of the HTTP reader, in bytes or lines (fixed values).
HTTP_MIN, HTTP_MAX = 16, 10 * 1024 * 1024
LINE_MAX, QUERY_MAX, METHOD_MAX = 8192, 4096, 20
HEADER_LINES, HEADER_BYTES = 200, 65536
METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT"]
# Characters with the Unicode White_Space property (fixed values).
WHITE_SPACE = "".join(
    chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def blank_line_bytes(lines: str, blank: str) -> str:
    """Bytes of the first ``blank`` lines, two counted for the end of each."""
    return f"aggregate(slice({lines}, 1, cast({blank} as int)), 0, (total, line) -> total + octet_length(line) + 2)"


def http(packets: DataFrame, parity: bool = False) -> DataFrame:
    """HTTP start line and header length; ``parse_error`` says which check failed.

    A request keeps what was read before its URI or version failed. The header
    ends with the first empty line; a line feed at the very end starts no line.
    ``query_cut`` marks queries above QUERY_MAX bytes, which are kept whole unless
    ``parity`` asks for the cut, and ``header_cut`` headers that go on past
    HEADER_LINES or HEADER_BYTES, whose length is not known.
    """
    texts = step(
        packets,
        _web_text=f"""IF(_app IN ('HTTP', 'HTTPS') AND length(payload) BETWEEN {HTTP_MIN} AND {HTTP_MAX},
            make_valid_utf8(cast(payload as string)), NULL)""",
    )
    lines = step(texts, _web_line=f"trim(BOTH '{WHITE_SPACE}' FROM substring_index(_web_text, '\\r\\n', 1))")
    split = step(lines, _web_parts="split(_web_line, R'(?U)\\s+', 4)", _web_line_bytes="octet_length(_web_line)")
    named = step(
        split,
        _web_1="try_element_at(_web_parts, 1)",
        _web_2="try_element_at(_web_parts, 2)",
        _web_3="try_element_at(_web_parts, 3)",
        _web_response="startswith(try_element_at(_web_parts, 1), 'HTTP/')",
    )

    def good_version(part: str) -> str:
        return f"startswith({part}, 'HTTP/') AND octet_length({part}) BETWEEN 8 AND 12"

    bad_method = f"_web_1 NOT IN ({any_of(METHODS)}) AND octet_length(_web_1) > {METHOD_MAX}"
    judged = step(
        named,
        _web_error="IF(_app IN ('HTTP', 'HTTPS'), "
        + case(
            [
                (f"length(payload) < {HTTP_MIN}", "'HTTP payload too small'"),
                (f"length(payload) > {HTTP_MAX}", "'HTTP payload too large'"),
                (f"_web_line_bytes = 0 OR _web_line_bytes > {LINE_MAX}", "'Invalid HTTP first line length'"),
                ("size(_web_parts) < 3", "'Invalid HTTP first line format'"),
                (f"_web_response AND NOT ({good_version('_web_1')})", "'Invalid HTTP version format'"),
                (f"NOT _web_response AND {bad_method}", "'Invalid HTTP method'"),
                (f"NOT _web_response AND octet_length(_web_2) > {LINE_MAX}", "'HTTP URI too long'"),
                (f"NOT _web_response AND NOT ({good_version('_web_3')})", "'Invalid HTTP version format'"),
            ]
        )
        + ", NULL)",
    )
    sorted_out = step(
        judged,
        _web_ok="_web_text IS NOT NULL AND _web_error IS NULL",
        _web_method="IF(NOT _web_response AND coalesce(_web_error IN ('HTTP URI too long', 'Invalid HTTP version format'), true), _web_1, NULL)",
        _web_uri="IF(NOT _web_response AND coalesce(_web_error = 'Invalid HTTP version format', true), _web_2, NULL)",
    )
    headed = step(
        sorted_out,
        _web_lines=f"IF(_web_ok, split(_web_text, R'\\r?\\n', {HEADER_LINES + 1}), NULL)",
        _web_query="IF(_web_ok AND instr(_web_uri, '?') > 0, substring(_web_uri, instr(_web_uri, '?') + 1), NULL)",
    )
    found = step(headed, _web_blank="array_position(_web_lines, '')")
    measured = step(
        found,
        _web_bytes=f"""IF(_web_blank > 0 AND _web_blank < size(_web_lines) AND _web_blank <= {HEADER_LINES},
            {blank_line_bytes('_web_lines', '_web_blank')}, 0)""",
    )
    short_query = f"make_valid_utf8(cast(substring(cast(_web_query as binary), 1, {QUERY_MAX}) as string))"
    return step(
        measured,
        _http_named="coalesce(_app IN ('HTTP', 'HTTPS'), false)",
        _http_header=f"IF(_web_bytes <= {HEADER_BYTES}, coalesce(_web_bytes, 0), 0)",
        _http_fields=f"""IF(_app IN ('HTTP', 'HTTPS'), named_struct(
            'content_length', cast(NULL as bigint),
            'request_uri_query', {f"IF(octet_length(_web_query) > {QUERY_MAX}, {short_query}, _web_query)" if parity else "_web_query"},
            'request_method', _web_method, 'referer', cast(NULL as string), 'request_full_uri', _web_uri,
            'request_version', IF(_web_ok, IF(_web_response, _web_1, _web_3), NULL),
            'response', coalesce(_web_response, false) AND _web_ok,
            'parse_error', _web_error,
            'query_cut', coalesce(octet_length(_web_query) > {QUERY_MAX}, false),
            'header_cut', coalesce(_web_ok AND ((size(_web_lines) > {HEADER_LINES} AND NOT _web_blank BETWEEN 1 AND {HEADER_LINES})
                OR _web_bytes > {HEADER_BYTES}), false)), NULL)""",
    )
