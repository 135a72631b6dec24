"""Decode queries: frames are built from table columns, and the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.fixtures import VARIANTS, application_frames, dns_answer_frames, synth_frames
from packetlake.functions.net import ip_text, mac_text
from packetlake.functions.binary import piece
from packetlake.operators.decode import decode_packets, decode_summary, packet_table
from packetlake.operators.dns import with_retransmissions
from packetlake.operators.features import CSV_COLUMNS, CSV_CONSTANTS, csv_projection, flatten_features
from packetlake.operators.flows import flow_stats
from packetlake.queries.base import PACKETS_CTE, query, sql_ip
from packetlake.schemas import FLOW_KEY

V = VARIANTS
BAD = [V[k] for k in ("vlan", "truncated", "unknown_ethertype", "fragment", "overlong", "igmp", "short_arp")]
BAD_SQL = ", ".join(str(v) for v in BAD)
V6_SQL = f"variant IN ({V['ipv6']}, {V['icmpv6_echo']}, {V['ipv6_extension']})"
ICMP_SQL = f"variant IN ({V['icmp_echo']}, {V['icmp_timestamp']}, {V['icmpv6_echo']})"

# Every frame with what it was built from.
FRAMES_CTE = f"""{PACKETS_CTE},
frames AS (
  SELECT *, packet_no % 17 AS variant, length(props) AS body,
         lpad(hex(src_ip), 8, '0') AS src4, lpad(hex(dst_ip), 8, '0') AS dst4,
         CASE WHEN packet_no % 5 = 0 THEN 24 ELSE 20 END AS tcp_header
  FROM packets),
kinds AS (
  SELECT *, CASE WHEN {V6_SQL} THEN 'FD' || repeat('00', 11) || src4 ELSE src4 END AS src_hex,
         CASE WHEN {V6_SQL} THEN 'FD' || repeat('00', 11) || dst4 ELSE dst4 END AS dst_hex,
         CASE WHEN variant IN ({BAD_SQL}) THEN 'bad' WHEN variant = {V['arp']} THEN 'arp'
              WHEN {ICMP_SQL} THEN 'icmp' WHEN protocol = 'UDP' THEN 'udp' ELSE 'tcp' END AS kind,
         CASE WHEN {V6_SQL} THEN 40 ELSE 20 END AS ip_header,
         CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'purchase' THEN 'HTTPS' WHEN 'error' THEN 'ModbusTCP'
              WHEN 'signup' THEN 'DNS' ELSE 'MQTT' END AS app,
         CASE event_type WHEN 'error' THEN 7 WHEN 'signup' THEN 12 WHEN 'view' THEN 2 ELSE 0 END AS app_header
  FROM frames),
named AS (
  SELECT *, CASE kind WHEN 'arp' THEN 42 WHEN 'icmp' THEN 14 + ip_header + 8
              WHEN 'udp' THEN 14 + ip_header + 8 + app_header ELSE 14 + ip_header + tcp_header + app_header END AS header_len,
         CASE kind WHEN 'arp' THEN 'Ethernet->ARP'
              WHEN 'icmp' THEN CASE WHEN {V6_SQL} THEN 'Ethernet->IPv6->ICMPv6' ELSE 'Ethernet->IPv4->ICMPv4' END
              ELSE 'Ethernet->' || CASE WHEN {V6_SQL} THEN 'IPv6' ELSE 'IPv4' END || '->' || upper(kind) || '->' || app
         END AS proto_hierarchy
  FROM kinds WHERE kind <> 'bad')
"""


@query(
    "decode_eth_ip_tcp",
    f"""WITH {FRAMES_CTE} SELECT packet_no, src_hex AS src_host, dst_hex AS dst_host, src_port, dst_port,
      packet_no % 4294967296 AS seq, (packet_no * 3) % 4294967296 AS ack_raw, packet_no % 512 AS flags,
      packet_no % 65536 AS checksum, body AS len, CASE WHEN packet_no % 5 = 0 THEN '020405B4' ELSE '' END AS options,
      header_len
    FROM named WHERE kind = 'tcp'""",
)
def decode_eth_ip_tcp(spark, sf_dir):
    return (
        decode_packets(synth_frames(spark, sf_dir))
        .filter("tcp IS NOT NULL")
        .select(
            "packet_no",
            F.hex("ip.src_host").alias("src_host"),
            F.hex("ip.dst_host").alias("dst_host"),
            F.col("tcp.srcport").alias("src_port"),
            F.col("tcp.dstport").alias("dst_port"),
            *[f"tcp.{c}" for c in ("seq", "ack_raw", "flags", "checksum", "len")],
            F.hex("tcp.options").alias("options"),
            "header_len",
        )
    )


@query(
    "tcp_flags",
    f"""WITH {FRAMES_CTE} SELECT packet_no, packet_no & 1 = 1 AS fin, packet_no & 2 = 2 AS syn, packet_no & 4 = 4 AS rst,
      packet_no & 18 = 18 AS synack FROM named WHERE kind = 'tcp'""",
)
def tcp_flags(spark, sf_dir):
    tcp = decode_packets(synth_frames(spark, sf_dir)).filter("tcp IS NOT NULL")
    return tcp.select(
        "packet_no", *[F.col(f"tcp.connection_{c}").alias(c) for c in ("fin", "syn", "rst", "synack")]
    )


@query(
    "decode_udp",
    f"""WITH {FRAMES_CTE} SELECT packet_no, src_hex AS src_host, dst_hex AS dst_host, src_port AS port_src, dst_port AS port_dst,
      0 AS stream_id, header_len FROM named WHERE kind = 'udp'""",
)
def decode_udp(spark, sf_dir):
    udp = decode_packets(synth_frames(spark, sf_dir)).filter("udp IS NOT NULL")
    return udp.select(
        "packet_no",
        F.hex("ip.src_host").alias("src_host"),
        F.hex("ip.dst_host").alias("dst_host"),
        "udp.port_src",
        "udp.port_dst",
        "udp.stream_id",
        "header_len",
    )


@query(
    "decode_arp",
    f"""WITH {FRAMES_CTE} SELECT packet_no, {sql_ip('src_ip')} AS sender, {sql_ip('dst_ip')} AS target, 1 AS opcode, 6 AS hw_size
    FROM named WHERE kind = 'arp'""",
)
def decode_arp(spark, sf_dir):
    arp = decode_packets(synth_frames(spark, sf_dir)).filter("arp IS NOT NULL")
    return arp.select(
        "packet_no",
        ip_text(F.col("arp.src_proto_ipv4")).alias("sender"),
        ip_text(F.col("arp.dst_proto_ipv4")).alias("target"),
        "arp.opcode",
        "arp.hw_size",
    )


@query(
    "decode_icmp",
    f"""WITH {FRAMES_CTE} SELECT packet_no, packet_no % 65536 AS checksum,
      CASE variant WHEN {V['icmp_echo']} THEN packet_no % 65536 WHEN {V['icmpv6_echo']} THEN (packet_no + 1) % 65536 ELSE 0 END AS seq_le,
      CASE variant WHEN {V['icmp_timestamp']} THEN packet_no + 7 ELSE 0 END AS transmit_time,
      CASE variant WHEN {V['icmp_timestamp']} THEN '' ELSE props END AS unused
    FROM named WHERE kind = 'icmp'""",
)
def decode_icmp(spark, sf_dir):
    icmp = decode_packets(synth_frames(spark, sf_dir)).filter("icmp IS NOT NULL")
    return icmp.select(
        "packet_no", "icmp.checksum", "icmp.seq_le", "icmp.transmit_time", F.decode("icmp.unused", "UTF-8").alias("unused")
    )


@query(
    "proto_hierarchy",
    f"WITH {FRAMES_CTE} SELECT packet_no, proto_hierarchy, header_len FROM named",
)
def proto_hierarchy(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL")
    return decoded.select("packet_no", "proto_hierarchy", "header_len")


@query(
    "app_by_port",
    f"""WITH {FRAMES_CTE} SELECT app, count(*) AS packets FROM named WHERE kind IN ('tcp', 'udp') GROUP BY app""",
)
def app_by_port(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("tcp IS NOT NULL OR udp IS NOT NULL")
    app = F.element_at(F.split("proto_hierarchy", "->"), -1)
    return decoded.groupBy(app.alias("app")).agg(F.count(F.lit(1)).alias("packets"))


@query(
    "endpoint_mask",
    f"""WITH {FRAMES_CTE}, lengths AS (
      SELECT *, CASE kind WHEN 'arp' THEN 42 ELSE 14 + ip_header + CASE variant WHEN {V['icmp_timestamp']} THEN 20
          WHEN {V['ipv6_extension']} THEN 8 ELSE 0 END
        + CASE WHEN variant = {V['icmp_timestamp']} THEN 0 WHEN kind = 'icmp' OR kind = 'udp' THEN 8 + body ELSE tcp_header + body END
        + CASE variant WHEN {V['padded']} THEN 6 ELSE 0 END END AS frame_bytes,
        repeat('01', 12) || CASE WHEN kind = 'arp' THEN repeat('00', 10) || repeat('01', 20)
          WHEN {V6_SQL} THEN repeat('00', 10) || repeat('01', 32) ELSE repeat('00', 14) || repeat('01', 8) END AS head
      FROM named)
    SELECT packet_no, rpad(head, CAST(2 * frame_bytes AS INTEGER), '0') AS mask FROM lengths""",
)
def endpoint_mask(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL")
    return decoded.select("packet_no", F.hex("mask").alias("mask"))


@query(
    "decode_errors",
    f"""WITH {FRAMES_CTE} SELECT CASE variant WHEN {V['vlan']} THEN 'ethertype_not_implemented'
        WHEN {V['truncated']} THEN 'ethernet_too_short' WHEN {V['unknown_ethertype']} THEN 'unknown_ethertype(0x1234)'
        WHEN {V['fragment']} THEN 'no_transport_header' WHEN {V['igmp']} THEN 'no_transport_header'
        WHEN {V['overlong']} THEN 'slice_error' WHEN {V['short_arp']} THEN 'no_flow_key' ELSE '' END AS decode_error,
      count(*) AS frames FROM frames GROUP BY 1""",
)
def decode_errors(spark, sf_dir):
    return decode_summary(decode_packets(synth_frames(spark, sf_dir)))


@query(
    "packet_table",
    f"""WITH {FRAMES_CTE} SELECT packet_no, proto_hierarchy, header_len, ts_us // 1000000 AS timestamp_s, ts_us % 1000000 AS timestamp_us,
      CASE kind WHEN 'arp' THEN 12 + 20 ELSE 12 + CASE WHEN {V6_SQL} THEN 32 ELSE 8 END END AS masked_bytes,
      CASE WHEN kind IN ('tcp', 'udp') THEN src_port ELSE 0 END AS src_port
    FROM named""",
)
def packet_table_query(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL")
    table = packet_table(decoded.withColumn("proto_hierarchy", F.concat_ws("#", "packet_no", "proto_hierarchy")))
    parts = F.split("proto_hierarchy", "#")
    return table.select(
        F.element_at(parts, 1).cast("long").alias("packet_no"),
        F.element_at(parts, 2).alias("proto_hierarchy"),
        "header_len",
        "timestamp_s",
        "timestamp_us",
        F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit(""))).alias("masked_bytes"),
        F.regexp_extract("flow_key", r":(\d+) -> ", 1).cast("int").alias("src_port"),
    ).withColumn("masked_bytes", F.expr("masked_bytes div 2"))


@query(
    "decoded_flow_stats",
    f"""WITH {FRAMES_CTE}, sized AS (
      SELECT *, CASE WHEN kind IN ('tcp', 'udp') THEN src_port ELSE 0 END AS sp,
             CASE WHEN kind IN ('tcp', 'udp') THEN dst_port ELSE 0 END AS dp FROM named),
    ends AS (SELECT *, src_hex < dst_hex OR (src_hex = dst_hex AND sp < dp) AS fwd FROM sized)
    SELECT CASE WHEN fwd THEN src_hex ELSE dst_hex END AS ip_lo, CASE WHEN fwd THEN dst_hex ELSE src_hex END AS ip_hi,
      CASE WHEN fwd THEN sp ELSE dp END AS port_lo, CASE WHEN fwd THEN dp ELSE sp END AS port_hi, proto_hierarchy AS protocol,
      count(*) FILTER (WHERE fwd) AS fwd_packet_count, count(*) FILTER (WHERE NOT fwd) AS bwd_packet_count,
      arg_min(ts_us, packet_no) AS first_seen_us
    FROM ends GROUP BY 1, 2, 3, 4, 5""",
)
def decoded_flow_stats(spark, sf_dir):
    flows = flow_stats(decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL"))
    return flows.select(
        F.hex("ip_lo").alias("ip_lo"),
        F.hex("ip_hi").alias("ip_hi"),
        *FLOW_KEY[2:],
        "fwd_packet_count",
        "bwd_packet_count",
        "first_seen_us",
    )


# --- applications ----------------------------------------------------------

APPS_CTE = f"""{PACKETS_CTE},
apps AS (SELECT *, packet_no % 5 AS turn, CASE WHEN packet_no % 5 = 0 THEN 24 ELSE 20 END AS tcp_header FROM packets)"""


@query(
    "decode_http",
    f"""WITH {APPS_CTE} SELECT packet_no,
      CASE turn WHEN 0 THEN 'GET' WHEN 2 THEN 'POST' WHEN 4 THEN 'GET' END AS method,
      CASE turn WHEN 0 THEN '/e?id=' || packet_no WHEN 2 THEN '/form' WHEN 4 THEN '/plain/' || packet_no END AS uri,
      CASE turn WHEN 0 THEN 'id=' || packet_no END AS uri_query,
      CASE turn WHEN 0 THEN 'HTTP/1.1' WHEN 1 THEN 'HTTP/1.1' WHEN 4 THEN 'HTTP/1.0' END AS version,
      turn = 1 AS response,
      CASE turn WHEN 2 THEN 'Invalid HTTP version format' WHEN 3 THEN 'HTTP payload too small' END AS parse_error,
      34 + tcp_header + CASE WHEN turn IN (0, 4) THEN 32 + length(packet_no::VARCHAR) WHEN turn = 1 THEN 30
        ELSE 0 END AS header_len,
      CASE event_type WHEN 'click' THEN 'Ethernet->IPv4->TCP->HTTP' ELSE 'Ethernet->IPv4->TCP->HTTPS' END AS proto_hierarchy
    FROM apps WHERE event_type IN ('click', 'purchase')""",
)
def decode_http(spark, sf_dir):
    web = decode_packets(application_frames(spark, sf_dir)).filter("http IS NOT NULL")
    return web.select(
        "packet_no",
        F.col("http.request_method").alias("method"),
        F.col("http.request_full_uri").alias("uri"),
        F.col("http.request_uri_query").alias("uri_query"),
        F.col("http.request_version").alias("version"),
        "http.response",
        "http.parse_error",
        "header_len",
        "proto_hierarchy",
    )


@query(
    "decode_mqtt",
    f"""WITH {APPS_CTE}, sizes AS (SELECT *, 't/' || user_id AS name, 2 + length('t/' || user_id) + length(props) AS publish FROM apps)
    SELECT packet_no,
      CASE WHEN packet_no % 9 = 0 THEN NULL ELSE CASE turn WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END END AS msgtype,
      CASE WHEN packet_no % 9 = 0 THEN NULL ELSE CASE turn WHEN 3 THEN 2 ELSE 0 END END AS hdrflags,
      CASE WHEN packet_no % 9 = 0 THEN NULL ELSE CASE turn WHEN 0 THEN 12 WHEN 1 THEN 2 WHEN 2 THEN publish WHEN 3 THEN publish + 200 END END AS len,
      CASE WHEN packet_no % 9 <> 0 AND turn = 0 THEN 'MQTT' END AS protoname,
      CASE WHEN packet_no % 9 <> 0 AND turn = 0 THEN 4 END AS ver,
      CASE WHEN packet_no % 9 <> 0 AND turn = 0 THEN true END AS cleansess,
      CASE WHEN packet_no % 9 <> 0 AND turn = 1 THEN 1 END AS ack,
      CASE WHEN packet_no % 9 <> 0 AND turn IN (2, 3) THEN name END AS topic,
      34 + tcp_header + CASE WHEN packet_no % 9 = 0 THEN 0 ELSE CASE turn WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 2 THEN 2 + publish
        WHEN 3 THEN 3 + publish + 200 ELSE 0 END END AS header_len,
      'Ethernet->IPv4->TCP' || CASE WHEN packet_no % 9 <> 0 AND turn = 4 THEN '' ELSE '->MQTT' END AS proto_hierarchy
    FROM sizes WHERE event_type = 'view'""",
)
def decode_mqtt(spark, sf_dir):
    decoded = decode_packets(application_frames(spark, sf_dir))
    messages = decoded.filter((F.col("src_port") == 1883) | (F.col("dst_port") == 1883))
    return messages.select(
        "packet_no",
        *[f"mqtt.{c}" for c in ("msgtype", "hdrflags", "len", "protoname", "ver")],
        F.col("mqtt.conflag_cleansess").alias("cleansess"),
        F.col("mqtt.conack_flags").alias("ack"),
        "mqtt.topic",
        "header_len",
        "proto_hierarchy",
    )


@query(
    "decode_modbus",
    f"""WITH {APPS_CTE} SELECT packet_no, packet_no % 65536 AS trans_id, 6 AS len, user_id % 256 AS unit_id,
      34 + tcp_header + 7 AS header_len, 'Ethernet->IPv4->TCP->ModbusTCP' AS proto_hierarchy
    FROM apps WHERE event_type = 'error'""",
)
def decode_modbus(spark, sf_dir):
    decoded = decode_packets(application_frames(spark, sf_dir)).filter("modbus IS NOT NULL")
    return decoded.select("packet_no", "modbus.trans_id", "modbus.len", "modbus.unit_id", "header_len", "proto_hierarchy")


@query(
    "decode_dns",
    f"""WITH {APPS_CTE}, q AS (
      SELECT *, CASE WHEN packet_no % 7 = 0 THEN 'none' WHEN packet_no % 13 = 0 THEN 'cut'
                     WHEN packet_no % 11 = 0 THEN 'unicast' ELSE 'ok' END AS state FROM apps)
    SELECT packet_no, CASE state WHEN 'ok' THEN true WHEN 'cut' THEN false END AS rfc_compatible,
      CASE state WHEN 'ok' THEN 'user' || user_id || '.example' WHEN 'cut' THEN '' END AS qry_name,
      CASE state WHEN 'ok' THEN length('user' || user_id || '.example') WHEN 'cut' THEN 0 END AS qry_name_len,
      CASE state WHEN 'ok' THEN CASE WHEN packet_no % 3 = 0 THEN 28 ELSE 1 END WHEN 'cut' THEN 0 END AS qry_type,
      CASE WHEN state IN ('ok', 'cut') THEN 54 ELSE 42 END AS header_len,
      'Ethernet->IPv4->UDP' || CASE WHEN state IN ('ok', 'cut') THEN '->DNS' ELSE '' END AS proto_hierarchy
    FROM q WHERE event_type = 'signup'""",
)
def decode_dns(spark, sf_dir):
    decoded = decode_packets(application_frames(spark, sf_dir)).filter("udp IS NOT NULL")
    return decoded.select(
        "packet_no",
        *[f"dns.{c}" for c in ("rfc_compatible", "qry_name", "qry_name_len", "qry_type")],
        "header_len",
        "proto_hierarchy",
    )


ANSWERS_CTE = f"""{APPS_CTE}, asked AS (
      SELECT *, packet_no % 8 AS form, 'user' || user_id || '.example' AS host, packet_no % 1000 AS ttl,
        '10.' || (packet_no >> 16) % 256 || '.' || (packet_no >> 8) % 256 || '.' || packet_no % 256 AS v4,
        'fd' || repeat('00', 11) || '0a' || lpad(lower(hex(packet_no % 16777216)), 6, '0') AS v6
      FROM apps WHERE event_type = 'signup')"""


@query(
    "dns_faults",
    f"""WITH {ANSWERS_CTE} SELECT packet_no, form IN (0, 1, 7) AS rfc_compatible,
      CASE WHEN form IN (0, 1, 7) THEN host ELSE '' END AS qry_name, form <> 7 AS answered,
      CASE form WHEN 2 THEN 'record beyond the end' WHEN 3 THEN 'pointer forward' WHEN 4 THEN 'name beyond the end'
        WHEN 5 THEN 'address size' WHEN 6 THEN 'name loops' END AS fault,
      CASE form WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS records
    FROM asked""",
)
def dns_faults(spark, sf_dir):
    decoded = decode_packets(dns_answer_frames(spark, sf_dir), dns_records=True).filter("dns IS NOT NULL")
    return decoded.select(
        "packet_no",
        "dns.rfc_compatible",
        "dns.qry_name",
        F.expr("substring(payload, 7, 2) <> X'0000'").alias("answered"),
        F.col("dns_fault").alias("fault"),
        F.size("dns_records").alias("records"),
    )


@query(
    "dns_records",
    f"""WITH {ANSWERS_CTE}
    SELECT packet_no, 0 AS pos, CASE form WHEN 7 THEN 'authority' ELSE 'answer' END AS section,
      CASE form WHEN 7 THEN 'example' ELSE host END AS name,
      CASE form WHEN 1 THEN 5 WHEN 7 THEN 2 ELSE 1 END AS type, 1 AS class, ttl,
      CASE form WHEN 1 THEN 'w.example' WHEN 7 THEN 'ns.example' ELSE v4 END AS value
    FROM asked WHERE form IN (0, 1, 4, 7)
    UNION ALL
    SELECT packet_no, 1, CASE form WHEN 7 THEN 'additional' ELSE 'answer' END,
      CASE form WHEN 7 THEN 'ns.example' ELSE 'w.example' END, CASE form WHEN 7 THEN 1 ELSE 28 END, 1, ttl,
      CASE form WHEN 7 THEN v4 ELSE v6 END
    FROM asked WHERE form IN (1, 7)""",
)
def dns_records(spark, sf_dir):
    decoded = decode_packets(dns_answer_frames(spark, sf_dir), dns_records=True)
    rows = decoded.select("packet_no", F.posexplode("dns_records").alias("pos", "r")).select("packet_no", "pos", "r.*")
    # IPv6 addresses as plain hexadecimal digits.
    value = F.when(F.col("type") == 28, F.lower(F.hex("data"))).otherwise(F.col("value"))
    return rows.withColumn("value", value).drop("data")


@query(
    "decode_light",
    f"""WITH {APPS_CTE}, sizes AS (
      SELECT *, length('t/' || user_id) AS topic, 2 + length('t/' || user_id) + length(props) AS publish,
        CASE event_type WHEN 'signup' THEN 42 ELSE 34 + tcp_header END AS base,
        CASE WHEN NOT to_server THEN NULL WHEN event_type = 'click' THEN 'HTTP' WHEN event_type = 'purchase' THEN 'HTTPS'
             WHEN event_type = 'signup' THEN 'DNS' WHEN event_type = 'error' THEN 'MBTCP' ELSE 'MQTT' END AS app
      FROM (SELECT *, packet_no % 2 = 0 AS to_server FROM apps)),
    measured AS (
      SELECT *, CASE WHEN app IS NULL THEN NULL
          WHEN app = 'DNS' THEN 12
          WHEN app = 'MBTCP' THEN 8
          WHEN app = 'MQTT' THEN CASE WHEN packet_no % 9 = 0 OR turn = 4 THEN NULL WHEN turn = 0 THEN 12 WHEN turn = 1 THEN 4
               WHEN turn = 2 THEN 4 + topic ELSE 7 + topic END
          ELSE CASE turn WHEN 0 THEN 32 + length(packet_no::VARCHAR) WHEN 1 THEN 30 WHEN 2 THEN 30
               WHEN 3 THEN NULL ELSE 32 + length(packet_no::VARCHAR) END END AS extra
      FROM sizes)
    SELECT packet_no,
      base + coalesce(extra, CASE WHEN app = 'MQTT' AND packet_no % 9 <> 0 THEN 2 ELSE 0 END) AS header_len,
      'Ethernet -> IPv4 -> ' || protocol || ' -> ' || CASE WHEN extra IS NULL THEN '' ELSE app END AS proto_hierarchy
    FROM measured""",
)
def decode_light(spark, sf_dir):
    decoded = decode_packets(application_frames(spark, sf_dir), profile="light").filter("decode_error IS NULL")
    return decoded.select("packet_no", "header_len", "proto_hierarchy")


@query(
    "mac_text",
    f"""WITH {PACKETS_CTE} SELECT packet_no,
      '02:00:' || regexp_replace(lpad(hex(dst_ip), 8, '0'), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4') AS receiver,
      '02:00:' || regexp_replace(lpad(hex(src_ip), 8, '0'), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4') AS sender FROM packets""",
)
def mac_text_query(spark, sf_dir):
    data = F.col("data")
    frames = synth_frames(spark, sf_dir, variants=False)
    return frames.select("packet_no", mac_text(piece(data, 0, 6)).alias("receiver"), mac_text(piece(data, 6, 6)).alias("sender"))


@query(
    "address_text",
    f"""WITH {PACKETS_CTE} SELECT packet_no, {sql_ip('src_ip')} AS v4,
      'fd00::' || lower(hex(src_ip >> 16)) || ':' || lower(hex(src_ip & 65535)) AS v6 FROM packets""",
)
def address_text(spark, sf_dir):
    from packetlake.fixtures import ipv6_of, synth_packets

    packets = synth_packets(spark, sf_dir)
    return packets.select("packet_no", ip_text(F.col("src_ip")).alias("v4"), ip_text(ipv6_of("src_ip")).alias("v6"))


FLAT_SQL = f"""WITH {FRAMES_CTE} SELECT packet_no AS "packet_no", kind <> 'arp' AS "ip_set", kind = 'arp' AS "arp_set", kind = 'tcp' AS "tcp_set",
  kind = 'udp' AS "udp_set",
  CASE kind WHEN 'tcp' THEN '0x' || lpad(lower(hex(packet_no % 65536)), 8, '0') END AS "tcp_checksum",
  CASE kind WHEN 'tcp' THEN CASE WHEN packet_no % 5 = 0 THEN '020405b4' ELSE '' END END AS "tcp_options",
  CASE kind WHEN 'tcp' THEN lower(hex(encode(props))) END AS "tcp_payload",
  CASE kind WHEN 'udp' THEN src_port END AS "udp_port"
FROM named"""


@query("flatten_features", FLAT_SQL)
def flatten(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL")
    flat = flatten_features(decoded)
    return flat.select(
        "packet_no",
        "ip_set",
        "arp_set",
        "tcp_set",
        "udp_set",
        F.col("`tcp.checksum`").alias("tcp_checksum"),
        F.col("`tcp.options`").alias("tcp_options"),
        F.col("`tcp.payload`").alias("tcp_payload"),
        F.col("`udp.port`").alias("udp_port"),
    )


@query(
    "csv_features",
    f"""WITH {FRAMES_CTE} SELECT 'Not_in_Data' AS frame_time, CASE WHEN kind = 'arp' THEN '0.0.0.0' WHEN {V6_SQL} THEN NULL ELSE {sql_ip('src_ip')} END AS src_host,
      1 AS tcp_ack, CASE kind WHEN 'tcp' THEN packet_no % 65536 ELSE 0 END AS tcp_checksum, CASE kind WHEN 'udp' THEN dst_port ELSE 0 END AS udp_port, count(*) AS rows
    FROM named GROUP BY ALL""",
)
def csv_features(spark, sf_dir):
    projected = csv_projection(decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL"))
    host = F.col("`ip.src_host`")
    return projected.groupBy(
        F.col("`frame.time`").alias("frame_time"),
        F.when(~host.contains(":"), host).alias("src_host"),
        F.col("`tcp.ack`").alias("tcp_ack"),
        F.col("`tcp.checksum`").alias("tcp_checksum"),
        F.col("`udp.port`").alias("udp_port"),
    ).agg(F.count(F.lit(1)).alias("rows"))


# --- all columns -----------------------------------------------------------


def _hex_number(value: str, digits: int) -> str:
    return f"lpad(lower(hex({value})), {digits}, '0')"


def _hex_text(value: str) -> str:
    return f"lower(hex(encode({value})))"


_END, _FEED = "chr(13) || chr(10)", "chr(10)"
# Payloads of the application frames, as hexadecimal text, and what is read from them.
MESSAGES_CTE = f"""{APPS_CTE},
parts AS (
  SELECT *, {_hex_number("length('t/' || user_id)", 4)} || {_hex_text("'t/' || user_id")} || {_hex_text("props")} AS publish,
    'user' || user_id || '.example' AS host,
    CASE WHEN packet_no % 7 = 0 THEN 'none' WHEN packet_no % 13 = 0 THEN 'cut' WHEN packet_no % 11 = 0 THEN 'unicast' ELSE 'ok' END AS state,
    CASE WHEN packet_no % 3 = 0 THEN 28 ELSE 1 END AS qtype,
    event_type IN ('click', 'purchase') AS web, event_type = 'view' AND packet_no % 9 <> 0 AS mqtt, event_type = 'signup' AS udp
  FROM apps),
messages AS (
  SELECT *, CASE
      WHEN web THEN CASE turn WHEN 0 THEN {_hex_text(f"'GET /e?id=' || packet_no || ' HTTP/1.1' || {_END} || 'Host: h' || {_END} || {_END} || 'body'")}
        WHEN 1 THEN {_hex_text(f"'HTTP/1.1 200 OK' || {_END} || 'Server: s' || {_END} || {_END} || props")}
        WHEN 2 THEN {_hex_text(f"'POST /form HTTP/1.10000000' || {_END} || {_END}")} WHEN 3 THEN {_hex_text("'short'")}
        ELSE {_hex_text(f"'GET  /plain/' || packet_no || '  HTTP/1.0' || {_FEED} || 'A: b' || {_FEED} || {_FEED}")} END
      WHEN mqtt THEN CASE turn WHEN 0 THEN '100c00044d5154540402003c0000' WHEN 1 THEN '20020100'
        WHEN 2 THEN '30' || {_hex_number("length(publish) // 2", 2)} || publish
        WHEN 3 THEN '32' || {_hex_number("(length(publish) // 2 + 200) % 128 + 128", 2)} || {_hex_number("(length(publish) // 2 + 200) // 128", 2)}
          || publish || repeat('78', 200) ELSE '3080' END
      WHEN event_type = 'error' THEN {_hex_number("packet_no % 65536", 4)} || '00000006' || {_hex_number("user_id % 256", 2)} || '0300000001'
      ELSE '' END AS payload,
    CASE WHEN udp AND state = 'ok' THEN ts_us - lag(ts_us) OVER (PARTITION BY udp AND state = 'ok', host, qtype ORDER BY ts_us, packet_no) END AS since
  FROM parts)"""

# Column of the flat table, its type, and its value over ``messages``.
FLAT_COLUMNS = {
    "packet_no": ("BIGINT", "packet_no"),
    "frame.time": ("VARCHAR", "NULL"),
    "ip_set": ("BOOLEAN", "true"),
    "ip.src_host": ("VARCHAR", sql_ip("src_ip")),
    "ip.dst_host": ("VARCHAR", sql_ip("dst_ip")),
    "arp_set": ("BOOLEAN", "false"),
    "arp.dst.proto_ipv4": ("VARCHAR", "NULL"),
    "arp.opcode": ("INTEGER", "NULL"),
    "arp.hw.size": ("INTEGER", "NULL"),
    "arp.src.proto_ipv4": ("VARCHAR", "NULL"),
    "icmp.checksum": ("INTEGER", "NULL"),
    "icmp.seq_le": ("INTEGER", "NULL"),
    "icmp.transmit_timestamp": ("BIGINT", "NULL"),
    "icmp.unused": ("VARCHAR", "NULL"),
    "http.file_data": ("VARCHAR", "NULL"),
    "http.content_length": ("BIGINT", "NULL"),
    "http.request.uri.query": ("VARCHAR", "CASE WHEN web AND turn = 0 THEN 'id=' || packet_no END"),
    "http.request.method": ("VARCHAR", "CASE WHEN web THEN CASE turn WHEN 0 THEN 'GET' WHEN 2 THEN 'POST' WHEN 4 THEN 'GET' END END"),
    "http.referer": ("VARCHAR", "NULL"),
    "http.request.full_uri": ("VARCHAR", "CASE WHEN web THEN CASE turn WHEN 0 THEN '/e?id=' || packet_no WHEN 2 THEN '/form' WHEN 4 THEN '/plain/' || packet_no END END"),
    "http.request.version": ("VARCHAR", "CASE WHEN web THEN CASE turn WHEN 0 THEN 'HTTP/1.1' WHEN 1 THEN 'HTTP/1.1' WHEN 4 THEN 'HTTP/1.0' END END"),
    "http.response": ("BOOLEAN", "CASE WHEN web THEN turn = 1 END"),
    "tcp_set": ("BOOLEAN", "NOT udp"),
    "tcp.ack": ("INTEGER", "NULL"),
    "tcp.ack_raw": ("BIGINT", "CASE WHEN NOT udp THEN (packet_no * 3) % 4294967296 END"),
    "tcp.checksum": ("VARCHAR", f"CASE WHEN NOT udp THEN '0x' || {_hex_number('packet_no % 65536', 8)} END"),
    "tcp.connection.fin": ("BOOLEAN", "CASE WHEN NOT udp THEN packet_no & 1 = 1 END"),
    "tcp.connection.rst": ("BOOLEAN", "CASE WHEN NOT udp THEN packet_no & 4 = 4 END"),
    "tcp.connection.syn": ("BOOLEAN", "CASE WHEN NOT udp THEN packet_no & 2 = 2 END"),
    "tcp.connection.synack": ("BOOLEAN", "CASE WHEN NOT udp THEN packet_no & 18 = 18 END"),
    "tcp.dstport": ("INTEGER", "CASE WHEN NOT udp THEN dst_port END"),
    "tcp.flags": ("INTEGER", "CASE WHEN NOT udp THEN packet_no % 512 END"),
    "tcp.len": ("INTEGER", "CASE WHEN NOT udp THEN length(payload) // 2 END"),
    "tcp.options": ("VARCHAR", "CASE WHEN NOT udp THEN CASE WHEN packet_no % 5 = 0 THEN '020405b4' ELSE '' END END"),
    "tcp.payload": ("VARCHAR", "CASE WHEN NOT udp THEN payload END"),
    "tcp.seq": ("BIGINT", "CASE WHEN NOT udp THEN packet_no % 4294967296 END"),
    "tcp.srcport": ("INTEGER", "CASE WHEN NOT udp THEN src_port END"),
    "udp_set": ("BOOLEAN", "udp"),
    "udp.port": ("INTEGER", "CASE WHEN udp THEN src_port END"),
    "udp.stream": ("INTEGER", "CASE WHEN udp THEN 0 END"),
    "udp.time_delta": ("DOUBLE", "CASE WHEN udp THEN 0 END"),
    "dns.qry.name": ("VARCHAR", "CASE WHEN udp THEN CASE state WHEN 'ok' THEN host WHEN 'cut' THEN '' END END"),
    "dns.qry.name.len": ("INTEGER", "CASE WHEN udp THEN CASE state WHEN 'ok' THEN length(host) WHEN 'cut' THEN 0 END END"),
    "dns.qry.qu": ("BOOLEAN", "CASE WHEN udp AND state IN ('ok', 'cut') THEN false END"),
    "dns.qry.type": ("INTEGER", "CASE WHEN udp THEN CASE state WHEN 'ok' THEN qtype WHEN 'cut' THEN 0 END END"),
    "dns.retransmission": ("BOOLEAN", "CASE WHEN udp AND state = 'ok' THEN coalesce(since > 0 AND since <= 60000000, false) END"),
    "dns.retransmit_request_in": ("BIGINT", "CASE WHEN since > 0 AND since <= 60000000 THEN since END"),
    "mqtt.conack.flags": ("INTEGER", "CASE WHEN mqtt AND turn = 1 THEN 1 END"),
    "mqtt.conflag.cleansess": ("BOOLEAN", "CASE WHEN mqtt AND turn = 0 THEN true END"),
    "mqtt.conflags": ("INTEGER", "CASE WHEN mqtt AND turn = 0 THEN 2 END"),
    "mqtt.hdrflags": ("INTEGER", "CASE WHEN mqtt THEN CASE turn WHEN 3 THEN 2 ELSE 0 END END"),
    "mqtt.len": ("BIGINT", "CASE WHEN mqtt THEN CASE turn WHEN 0 THEN 12 WHEN 1 THEN 2 WHEN 2 THEN length(publish) // 2 WHEN 3 THEN length(publish) // 2 + 200 END END"),
    "mqtt.msg_decoded_as": ("VARCHAR", "NULL"),
    "mqtt.msg": ("VARCHAR", "NULL"),
    "mqtt.msgtype": ("INTEGER", "CASE WHEN mqtt THEN CASE turn WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END END"),
    "mqtt.proto_len": ("INTEGER", "CASE WHEN mqtt AND turn = 0 THEN 4 END"),
    "mqtt.protoname": ("VARCHAR", "CASE WHEN mqtt AND turn = 0 THEN 'MQTT' END"),
    "mqtt.topic": ("VARCHAR", "CASE WHEN mqtt AND turn IN (2, 3) THEN 't/' || user_id END"),
    "mqtt.topic_len": ("INTEGER", "CASE WHEN mqtt AND turn IN (2, 3) THEN length('t/' || user_id) END"),
    "mqtt.ver": ("INTEGER", "CASE WHEN mqtt AND turn = 0 THEN 4 END"),
    "mbtcp.len": ("INTEGER", "CASE WHEN event_type = 'error' THEN 6 END"),
    "mbtcp.trans_id": ("INTEGER", "CASE WHEN event_type = 'error' THEN packet_no % 65536 END"),
    "mbtcp.unit_id": ("INTEGER", "CASE WHEN event_type = 'error' THEN user_id % 256 END"),
}


def _plain_name(name: str) -> str:
    return name.replace(".", "_")


def _plain_names(rows):
    return rows.toDF(*[_plain_name(c) for c in rows.columns])


FLAT_ALL_SQL = f"WITH {MESSAGES_CTE} SELECT " + ", ".join(f"CAST({value} AS {kind}) AS {_plain_name(name)}" for name, (kind, value) in FLAT_COLUMNS.items()) + " FROM messages"


@query("flat_features_all", FLAT_ALL_SQL)
def flat_features_all(spark, sf_dir):
    """Every column of the flat table over application frames, retransmissions among them."""
    decoded = decode_packets(application_frames(spark, sf_dir)).filter("decode_error IS NULL")
    return _plain_names(flatten_features(with_retransmissions(decoded)))


def _csv_value(name: str) -> str:
    """The SQL value of a column of the feature file: constants, and zero values for what is absent."""
    if name in CSV_CONSTANTS:
        value = CSV_CONSTANTS[name]
        return str(value).lower() if isinstance(value, (bool, int)) else f"'{value}'"
    kind, value = FLAT_COLUMNS[name]
    if name == "tcp.checksum":
        kind, value = "INTEGER", "CASE WHEN NOT udp THEN packet_no % 65536 END"
    if name == "udp.port":
        value = "CASE WHEN udp THEN dst_port END"
    zero = {"VARCHAR": "''", "BOOLEAN": "false"}.get(kind, "0")
    if name.endswith(("_host", "proto_ipv4")):
        zero = "'0.0.0.0'"
    return f"coalesce(CAST({value} AS {kind}), {zero})"


@query("csv_features_all", f"WITH {MESSAGES_CTE} SELECT " + ", ".join(f"{_csv_value(name)} AS {_plain_name(name)}" for name in CSV_COLUMNS) + " FROM messages")
def csv_features_all(spark, sf_dir):
    """Every column of the feature file over application frames."""
    decoded = decode_packets(application_frames(spark, sf_dir)).filter("decode_error IS NULL")
    return _plain_names(csv_projection(with_retransmissions(decoded)))
