"""Flow queries over one packet per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.fixtures import events, synth_packets
from packetlake.functions.clock import duration_us, from_parts, micros_part, seconds_part
from packetlake.functions.flowkey import flow_key_text, with_normalised_key
from packetlake.functions.net import address_scope, ipv4_from_long
from packetlake.operators import flows as ops
from packetlake.queries.base import DERIVED_SQL, FLOW_COLUMNS, FLOW_TEXT, FLOWS_CTE, PACKETS_CTE, as_text, query, sql_ip
from packetlake.schemas import FLOW_KEY

SCOPE_SQL = """CASE WHEN (a >> 24) = 10 OR (a >> 20) = 2753 OR (a >> 16) = 49320
  OR (a >> 24) = 127 OR (a >> 16) = 43518 THEN 'internal' ELSE 'external' END"""


@query("flow_stats", f"WITH {FLOWS_CTE} SELECT * REPLACE ({sql_ip('ip_lo')} AS ip_lo, {sql_ip('ip_hi')} AS ip_hi) FROM flows")
def flow_stats(spark, sf_dir):
    return as_text(ops.flow_stats(synth_packets(spark, sf_dir)), "ip_lo", "ip_hi")


@query(
    "flow_durations",
    f"WITH {FLOWS_CTE} SELECT {FLOW_TEXT}, duration_us // 1000000 AS duration_s, duration_us // 1000 AS duration_ms FROM flows",
)
def flow_durations(spark, sf_dir):
    return as_text(ops.flow_duration(ops.flow_stats(synth_packets(spark, sf_dir))), "ip_lo", "ip_hi")


@query(
    "flow_keys",
    f"""WITH {PACKETS_CTE} SELECT packet_no, is_fwd, {FLOW_TEXT},
    {sql_ip('src_ip')} || ':' || src_port || ' -> ' || {sql_ip('dst_ip')} || ':' || dst_port || ' (' || protocol || ')' AS flow_key,
    {sql_ip('ip_lo')} || ':' || port_lo || ' -> ' || {sql_ip('ip_hi')} || ':' || port_hi || ' (' || protocol || ')' AS flow_key_norm
    FROM keyed""",
)
def flow_keys(spark, sf_dir):
    keyed = with_normalised_key(synth_packets(spark, sf_dir))
    direct = [F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    normal = [F.col(c) for c in FLOW_KEY]
    named = keyed.select(
        "packet_no",
        "is_fwd",
        *FLOW_KEY,
        flow_key_text(*direct).alias("flow_key"),
        flow_key_text(*normal).alias("flow_key_norm"),
    )
    return as_text(named, "ip_lo", "ip_hi")


@query(
    "flow_new_flag",
    f"""WITH {PACKETS_CTE} SELECT packet_no,
    row_number() OVER (PARTITION BY {FLOW_COLUMNS} ORDER BY packet_no) = 1 AS is_new_flow FROM keyed""",
)
def flow_new_flag(spark, sf_dir):
    return ops.new_flow_flags(synth_packets(spark, sf_dir)).select("packet_no", "is_new_flow")


@query(
    "flow_running_stats",
    f"""WITH {PACKETS_CTE}, running AS (
    SELECT {FLOW_COLUMNS}, packet_no,
      count(*) FILTER (WHERE is_fwd) OVER w AS fwd_packet_count,
      count(*) FILTER (WHERE NOT is_fwd) OVER w AS bwd_packet_count,
      CAST(coalesce(sum(size) FILTER (WHERE is_fwd) OVER w, 0) AS BIGINT) AS fwd_byte_count,
      CAST(coalesce(sum(size) FILTER (WHERE NOT is_fwd) OVER w, 0) AS BIGINT) AS bwd_byte_count,
      first_value(ts_us) OVER w AS first_seen_us, ts_us AS last_seen_us,
      min(size) OVER w AS min_packet_size, max(size) OVER w AS max_packet_size,
      count(*) OVER w AS n, CAST(sum(size) OVER w AS BIGINT) AS total, first_value(size) OVER w AS first_size
    FROM keyed WINDOW w AS (PARTITION BY {FLOW_COLUMNS} ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT {FLOW_TEXT}, packet_no, {DERIVED_SQL} FROM running""",
)
def flow_running_stats(spark, sf_dir):
    return as_text(ops.running_flow_stats(synth_packets(spark, sf_dir)), "ip_lo", "ip_hi")


@query(
    "flow_sessions_300s",
    f"""WITH {PACKETS_CTE}, gaps AS (
      SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {FLOW_COLUMNS} ORDER BY ts_us) > 300000000 THEN 1 ELSE 0 END AS starts
      FROM keyed),
    islands AS (SELECT *, sum(starts) OVER (PARTITION BY {FLOW_COLUMNS} ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
    SELECT {FLOW_TEXT}, CAST(s AS BIGINT) AS session_no, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
      count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes
    FROM islands GROUP BY {FLOW_COLUMNS}, s""",
)
def flow_sessions_300s(spark, sf_dir):
    return as_text(ops.flow_sessions(synth_packets(spark, sf_dir)), "ip_lo", "ip_hi")


@query("flow_count", f"WITH {FLOWS_CTE} SELECT count(*) AS flows, count(*) = 0 AS is_empty FROM flows")
def flow_count(spark, sf_dir):
    return ops.flow_count(ops.flow_stats(synth_packets(spark, sf_dir)))


@query(
    "unique_ips",
    f"WITH {PACKETS_CTE} SELECT count(DISTINCT a) AS unique_ips FROM (SELECT src_ip a FROM packets UNION ALL SELECT dst_ip FROM packets)",
)
def unique_ips(spark, sf_dir):
    return ops.unique_ip_count(synth_packets(spark, sf_dir))


@query(
    "seen_ips",
    f"WITH {PACKETS_CTE} SELECT {sql_ip('a')} AS address, {SCOPE_SQL} AS scope FROM (SELECT src_ip a FROM packets UNION SELECT dst_ip FROM packets)",
)
def seen_ips(spark, sf_dir):
    seen = ops.seen_ips(synth_packets(spark, sf_dir))
    return as_text(seen.withColumn("scope", address_scope(F.col("address"))), "address")


@query(
    "seen_ip_semi",
    f"""WITH {PACKETS_CTE}, probes AS (SELECT c_custkey, 167772160 + c_custkey AS a FROM customer)
    SELECT c_custkey, {sql_ip('a')} AS address FROM probes
    WHERE a IN (SELECT src_ip FROM packets UNION SELECT dst_ip FROM packets)""",
)
def seen_ip_semi(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", ipv4_from_long(F.lit(167772160) + F.col("c_custkey")).alias("address")
    )
    return as_text(ops.has_seen_ip(probes, ops.seen_ips(synth_packets(spark, sf_dir))), "address")


PROBE_SQL = """probes AS (SELECT 167772160 + c_custkey AS ip_lo, 3232235781 AS ip_hi,
    50000 + c_custkey AS port_lo, 502 AS port_hi, 'TCP' AS protocol FROM customer)"""


def _probe_keys(spark, sf_dir):
    """Keys of flows every customer would have with one server; many do not exist."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        ipv4_from_long(F.lit(167772160) + F.col("c_custkey")).alias("ip_lo"),
        ipv4_from_long(F.lit(3232235781)).alias("ip_hi"),
        (F.lit(50000) + F.col("c_custkey")).cast("int").alias("port_lo"),
        F.lit(502).alias("port_hi"),
        F.lit("TCP").alias("protocol"),
    )


@query(
    "contains_flow",
    f"WITH {FLOWS_CTE}, {PROBE_SQL} SELECT {FLOW_TEXT} FROM probes SEMI JOIN flows USING ({FLOW_COLUMNS})",
)
def contains_flow(spark, sf_dir):
    found = ops.contains_flow(_probe_keys(spark, sf_dir), ops.flow_stats(synth_packets(spark, sf_dir)))
    return as_text(found, "ip_lo", "ip_hi")


@query(
    "flow_lookup",
    f"WITH {FLOWS_CTE}, {PROBE_SQL} SELECT {FLOW_TEXT}, fwd_packet_count, bwd_packet_count, duration_us, avg_bps FROM flows SEMI JOIN probes USING ({FLOW_COLUMNS})",
)
def flow_lookup(spark, sf_dir):
    found = ops.lookup_flows(_probe_keys(spark, sf_dir), ops.flow_stats(synth_packets(spark, sf_dir)))
    chosen = found.select(*FLOW_KEY, "fwd_packet_count", "bwd_packet_count", "duration_us", "avg_bps")
    return as_text(chosen, "ip_lo", "ip_hi")


@query(
    "timestamp_algebra",
    """SELECT event_id, epoch_us(ts) // 1000000 AS timestamp_s, epoch_us(ts) % 1000000 AS timestamp_us,
    epoch_us(ts) AS as_micros, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00.5') AS since_us FROM events""",
)
def timestamp_algebra(spark, sf_dir):
    parts = events(spark, sf_dir).select("event_id", seconds_part(F.col("ts")).alias("timestamp_s"), micros_part(F.col("ts")).alias("timestamp_us"))
    rebuilt = from_parts(F.col("timestamp_s"), F.col("timestamp_us"))
    start = F.timestamp_micros(F.lit(1704067200500000))
    return parts.select(
        "*", F.unix_micros(rebuilt).alias("as_micros"), duration_us(rebuilt, start).alias("since_us")
    )
