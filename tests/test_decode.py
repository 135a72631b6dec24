"""Decoder edge cases on hand-made frames."""

import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from packetlake.operators.decode import decode_packets, decode_summary
from packetlake.operators.features import CSV_COLUMNS, csv_projection

MACS = bytes(range(12))
SRC, DST = bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])
TS = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ipv4(proto, body, total=None, options=b"", flags=0x4000):
    size = 20 + len(options)
    head = struct.pack(">BBHHHBBH", 0x40 | size // 4, 0, size + len(body) if total is None else total, 1, flags, 64, proto, 0)
    return MACS + b"\x08\x00" + head + SRC + DST + options + body


def tcp(payload, sport=40000, dport=80, flags=0x18, options=b"", offset=None):
    word = (offset if offset is not None else (20 + len(options)) // 4) << 12 | flags
    return struct.pack(">HHIIHHHH", sport, dport, 4_000_000_000, 7, word, 1, 2, 0) + options + payload


def udp(payload, sport=40000, dport=53, length=None):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if length is None else length, 9) + payload


def decode(spark, frames, **options):
    rows = [(i, TS, bytearray(f)) for i, f in enumerate(frames)]
    return decode_packets(spark.createDataFrame(rows, "packet_no long, ts timestamp, data binary"), **options)


def rows_of(frame):
    return [r.asDict(recursive=True) for r in frame.orderBy("packet_no").collect()]


def test_layers_and_errors(spark):
    frames = [
        b"\x00" * 13,
        MACS + b"\x99\x99",
        MACS + b"\x88\xcc" + b"\x00" * 30,
        ipv4(6, tcp(b""), total=10),
        ipv4(6, tcp(b"", offset=4)),
        ipv4(6, tcp(b"", offset=15)),
        ipv4(17, udp(b"", length=7)),
        ipv4(2, b"\x00" * 8),
        ipv4(6, tcp(b""), flags=0x2000),
        ipv4(6, tcp(b"abc", sport=1, dport=2, flags=0x112), options=b"\x01" * 8) + b"\x00" * 9,
        ipv4(17, udp(b"xyz", sport=1, dport=2, length=0)),
    ]
    got = rows_of(decode(spark, frames))
    assert [r["decode_error"] for r in got] == [
        "ethernet_too_short", "unknown_ethertype(0x9999)", "ethertype_not_implemented", "slice_error", "slice_error",
        "slice_error", "slice_error", "no_transport_header", "no_transport_header", None, None,
    ]
    last = got[9]
    assert last["tcp"]["len"] == 3 and last["payload"] == b"abc" and last["header_len"] == 14 + 28 + 20
    assert last["tcp"]["flags"] == 0x112 and last["tcp"]["connection_synack"] and last["tcp"]["seq"] == 4_000_000_000
    assert last["proto_hierarchy"] == "Ethernet->IPv4->TCP" and len(last["mask"]) == len(frames[9])
    assert got[10]["payload"] == b"xyz"


def test_counts_are_observed(spark):
    counts = Observation()
    decode(spark, [b"\x00" * 5, ipv4(6, tcp(b""))], counts=counts).write.format("noop").mode("overwrite").save()
    assert counts.get == {"frames": 2, "issues": 1}
    summary = {r.decode_error: r.frames for r in decode_summary(decode(spark, [b"", b"", ipv4(6, tcp(b""))])).collect()}
    assert summary == {"ethernet_too_short": 2, "": 1}


def dns_name(*labels):
    return b"".join(bytes([len(x)]) + x for x in labels) + b"\x00"


def test_dns(spark):
    head = struct.pack(">HHHHHH", 5, 0x0100, 1, 0, 0, 0)
    question = struct.pack(">HH", 28, 1)
    messages = [
        head + dns_name(b"a", b"bc", b"example") + question,
        head + b"\x00" + question,
        head + dns_name(*[b"x"] * 127) + question,
        head + b"\xc0\x0c" + question,
        head + dns_name(b"y" * 64) + question,
        head + b"\x05ab",
        head + dns_name(b"a") + struct.pack(">HH", 1, 99),
        b"",
    ]
    frames = [ipv4(17, udp(m)) for m in messages] + [ipv4(6, tcp(struct.pack(">H", len(messages[0])) + messages[0], dport=5353))]
    got = [r["dns"] for r in rows_of(decode(spark, frames))]
    assert [g["rfc_compatible"] for g in got] == [True, True, True, False, False, False, False, False, True]
    assert [g["qry_name"] for g in got[:3]] == ["a.bc.example", "", ".".join("x" * 127)]
    assert got[0]["qry_type"] == 28 and got[8]["mdns"] and got[8]["qry_name"] == "a.bc.example"


def test_dns_messages(spark):
    def head(questions=1, answers=0, authority=0, additional=0):
        return struct.pack(">HHHHHH", 5, 0x8180, questions, answers, authority, additional)

    def record(owner, kind, data, size=None):
        return owner + struct.pack(">HHIH", kind, 1, 60, len(data) if size is None else size) + data

    ask = dns_name(b"a", b"example") + struct.pack(">HH", 1, 1)
    root, back = b"\x00", b"\xc0\x0c"
    chain = b"".join(record(struct.pack(">H", 0xC000 | 12 + len(ask) + 16 * i), 1, b"\x01\x02\x03\x04") for i in range(900))
    long = dns_name(*[b"x" * 63] * 3, b"y" * 60)
    messages = {
        head(1, 1) + ask + record(back, 1, b"\x01\x02\x03\x04"): None,
        head(1, 1) + ask + record(root, 41, b""): None,
        head(1, 0, 0, 1) + ask + record(back, 15, b"\x00\x05" + back): None,
        head(2) + ask + back + struct.pack(">HH", 1, 1): None,
        head(2) + ask: "name beyond the end",
        head(1, 1) + ask + record(back, 5, back + b"\x00"): "name beyond its record",
        head(1, 1) + ask + record(back, 15, b"\x00\x05"): "name beyond its record",
        head(1, 1) + ask + b"\xc0": "name beyond the end",
        head(1, 1) + ask + record(b"\x80", 1, b""): "label type",
        head(1, 1) + ask + back + b"\x00\x01": "record beyond the end",
        head(1, 1) + ask + record(b"\x02ab\x00", 1, b"\xff"): "address size",
        head(2) + long + struct.pack(">HH", 1, 1) + b"\x01z\xc0\x0c" + struct.pack(">HH", 1, 1): "name too long",
        # Each name is a pointer to the one before it: walked once, not once a record.
        head(1, 901) + ask + record(back, 1, b"\x01\x02\x03\x04") + chain: None,
    }
    got = rows_of(decode(spark, [ipv4(17, udp(m)) for m in messages], dns_records=True))
    assert [g["dns_fault"] for g in got] == list(messages.values())
    assert [g["dns"]["rfc_compatible"] for g in got] == [fault is None for fault in messages.values()]
    assert got[0]["dns_records"] == [
        {"section": "answer", "name": "a.example", "type": 1, "class": 1, "ttl": 60, "value": "1.2.3.4", "data": bytearray(b"\x01\x02\x03\x04")}
    ]
    assert got[2]["dns_records"][0]["value"] == "a.example"
    assert {r["name"] for r in got[12]["dns_records"]} == {"a.example"} and len(got[12]["dns_records"]) == 901


def test_mqtt(spark):
    payloads = [
        b"\x30\xff\xff\xff\x7f\x00\x01t",
        b"\x30\x80\x80\x80\x80\x01",
        b"\x10\x06\x00\x04MQ",
        b"\x10\x07\x00\x02MQ\x05\xc2",
        b"\x30\x05\x00\x02\xff\xfe",
        b"\xc0\x00",
        b"",
    ]
    got = rows_of(decode(spark, [ipv4(6, tcp(p, dport=1883)) for p in payloads]))
    assert [r["proto_hierarchy"].endswith("MQTT") for r in got] == [True, False, False, True, False, True, True]
    assert got[0]["mqtt"]["len"] == 268435455 and got[0]["mqtt"]["topic"] == "t"
    assert got[1]["mqtt"]["len"] is None and got[1]["mqtt"]["msgtype"] == 3
    assert got[3]["mqtt"]["ver"] == 5 and got[3]["mqtt"]["conflags"] == 0xC2 and got[3]["mqtt"]["conflag_cleansess"]
    assert got[6]["mqtt"] is None and got[6]["header_len"] == 54


def test_http(spark):
    many = b"GET / HTTP/1.1\r\n" + b"A: b\r\n" * 250 + b"\r\n"
    payloads = [
        b"GET /a?b=c?d HTTP/1.1\r\n\r\nrest",
        b"   GET /pad HTTP/1.1  \r\nX: y\r\n\r\n",
        b"HTTP/1.1234567890 200 OK\r\n\r\n",
        b"X" * 21 + b" / HTTP/1.1\r\n\r\n",
        b"GET /no-version-at-all\r\n\r\n",
        many,
        b"GET /open HTTP/1.1\r\nA: b\r\n",
        b"GET /" + b"q" * 9000 + b" HTTP/1.1\r\n\r\n",
        b"\xff\xfe\xfd GET \xff HTTP/1.1\r\n\r\n",
    ]
    got = rows_of(decode(spark, [ipv4(6, tcp(p)) for p in payloads]))
    web = [r["http"] for r in got]
    assert [w["parse_error"] for w in web] == [
        None, None, "Invalid HTTP version format", "Invalid HTTP method", "Invalid HTTP first line format", None, None,
        "Invalid HTTP first line length", "Invalid HTTP version format",
    ]
    assert web[0]["request_uri_query"] == "b=c?d" and web[1]["request_full_uri"] == "/pad"
    assert [r["header_len"] - 54 for r in got[:2]] == [len(payloads[0]) - 4, len(payloads[1])]
    assert got[5]["header_len"] == 54 and got[6]["header_len"] == 54
    assert web[3]["request_method"] is None and web[8]["request_full_uri"] == "GET"


def test_light_profile(spark):
    frames = [
        ipv4(6, tcp(b"", sport=80, dport=1000)),
        ipv4(6, tcp(b"\x32\x07\x00\x01t\x00\x01", dport=1883)),
        ipv4(6, tcp(b"", dport=1883)),
        ipv4(6, tcp(b"\x00\x01", dport=1883)),
        ipv4(6, tcp(b"\x01" * 7, dport=502)),
        ipv4(1, b"\x08\x00\x00\x00\x00\x01\x00\x02"),
        MACS + b"\x08\x06" + b"\x00" * 10,
        MACS + b"\x81\x00" + b"\x00" * 30,
    ]
    got = rows_of(decode(spark, frames, profile="light"))
    base = "Ethernet -> IPv4 -> TCP -> "
    assert [r["proto_hierarchy"] for r in got] == [
        base, base + "MQTT", base, base, base, "Ethernet -> IPv4 -> ICMPv4", "Ethernet -> ", None,
    ]
    assert [r["header_len"] for r in got[:7]] == [54, 54 + 2 + 2 + 1 + 2, 54, 56, 54, 42, 14]
    with pytest.raises(ValueError):
        decode(spark, frames, profile="other")


def test_parity_size_and_csv_width(spark):
    big = ipv4(6, tcp(b"", sport=1, dport=2)) + b"\x00" * 70_000
    assert rows_of(decode(spark, [big]))[0]["size"] == len(big)
    assert rows_of(decode(spark, [big], parity=True))[0]["size"] == len(big) % 65536
    assert len(CSV_COLUMNS) == 63
    assert csv_projection(decode(spark, [big])).columns == CSV_COLUMNS


def test_a_filter_does_not_decode_twice(spark):
    filtered = decode(spark, [ipv4(6, tcp(b""))]).filter(F.col("tcp.dstport") == 80)
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("CollectMetrics")


def test_any_number_of_extension_headers(spark):
    body = tcp(b"x")
    for count in (0, 1, 16, 17, 40):
        # Each destination options header names the next one; the last one names TCP.
        options = b"".join(bytes([60 if i + 1 < count else 6, 0, 1, 4, 0, 0, 0, 0]) for i in range(count))
        header = struct.pack(">IHBB", 6 << 28, len(options) + len(body), 60 if count else 6, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02"
        frame = bytes(12) + b"\x86\xdd" + header + options + body
        (row,) = decode(spark, [frame]).select("decode_error", "src_port", "dst_port").collect()
        assert tuple(row) == (None, 40000, 80), count


def test_http_limits_are_flagged(spark):
    long_query = b"GET /a?" + b"q" * 5000 + b" HTTP/1.1\r\nA: b\r\n\r\n"
    many_lines = b"GET /a?b HTTP/1.1\r\n" + b"A: b\r\n" * 250 + b"\r\n"
    exact = b"GET /a?" + b"q" * 4096 + b" HTTP/1.1\r\n" + b"A: b\r\n" * 198 + b"\r\n"
    frames = [ipv4(6, tcp(p)) for p in (long_query, many_lines, exact)]
    whole, cut = ([r["http"] for r in rows_of(decode(spark, frames, **options))] for options in ({}, {"parity": True}))
    assert [(len(h["request_uri_query"]), h["query_cut"], h["header_cut"]) for h in whole] == [(5000, True, False), (1, False, True), (4096, False, False)]
    assert [len(h["request_uri_query"]) for h in cut] == [4096, 1, 4096] and [h["query_cut"] for h in cut] == [True, False, False]
