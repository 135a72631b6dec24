"""Graph and DNS queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.fixtures import dns_queries, synth_devices, synth_packets
from packetlake.operators import graph as ops
from packetlake.operators.dns import flag_retransmissions
from packetlake.operators.flows import flow_stats
from packetlake.queries.base import FLOW_COLUMNS, FLOW_TEXT, FLOWS_CTE, PACKETS_CTE, as_text, REGISTRY, query, sql_ip
from packetlake.queries.flows import SCOPE_SQL

EDGE_SQL = """label, src, dst, protocol, src_port, dst_port, fwd_packet_count, bwd_packet_count, fwd_byte_count,
  bwd_byte_count, first_seen, last_seen, duration_ms, min_packet_size, max_packet_size, avg_packet_size, avg_pps, avg_bps"""
EDGE_KEY_SQL = "label, src, dst, protocol, src_port, dst_port"

EDGES_CTE = f"""{FLOWS_CTE},
edges AS (SELECT 'IPv4' AS label, {sql_ip('ip_lo')} AS src, {sql_ip('ip_hi')} AS dst, protocol, port_lo AS src_port, port_hi AS dst_port,
  fwd_packet_count, bwd_packet_count, fwd_byte_count, bwd_byte_count, first_seen_us // 1000000 AS first_seen,
  last_seen_us // 1000000 AS last_seen, duration_us // 1000 AS duration_ms, min_packet_size, max_packet_size,
  avg_packet_size, avg_pps, avg_bps FROM flows)"""

# The graph as it was after the first half of the packets.
OLD_CTE = EDGES_CTE.replace("FROM events)", "FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events))")


def _both_ctes() -> str:
    """All edges as ``edges`` and those of the first half as ``old_edges``."""
    old = OLD_CTE
    for name in ("sides", "packets", "keyed", "grouped", "flows", "edges"):
        old = old.replace(f"{name} AS (", f"old_{name} AS (").replace(f"FROM {name}", f"FROM old_{name}")
    return f"{EDGES_CTE}, {old}"


TWO_GRAPHS = _both_ctes()


def _edges(packets):
    return ops.flow_edges(flow_stats(packets))


def _first_half(packets):
    """Packets below half of the largest number, as a join with that one-row bound."""
    bound = packets.agg(F.expr("max(packet_no) div 2").alias("bound")).scalar()
    return packets.filter(F.col("packet_no") < bound)


@query("ip_nodes", f"WITH {PACKETS_CTE} SELECT 'IPv4' AS label, {sql_ip('a')} AS address, {SCOPE_SQL} AS type FROM (SELECT src_ip a FROM packets UNION SELECT dst_ip FROM packets)")
def ip_nodes(spark, sf_dir):
    return as_text(ops.ip_nodes(synth_packets(spark, sf_dir)), "address")


@query(
    "node_merge",
    f"""WITH {PACKETS_CTE}, device_ips AS (SELECT DISTINCT 167772160 + s_suppkey % 150 AS a FROM supplier WHERE s_suppkey % 10 <> 0)
    SELECT 'IPv4' AS label, {sql_ip('a')} AS address, {SCOPE_SQL} AS type
    FROM (SELECT a FROM device_ips UNION SELECT src_ip FROM packets UNION SELECT dst_ip FROM packets)""",
)
def node_merge(spark, sf_dir):
    existing = ops.as_nodes(ops.device_controls(synth_devices(spark, sf_dir)).select("address"))
    return as_text(ops.merge_nodes(existing, ops.ip_nodes(synth_packets(spark, sf_dir))), "address")


@query("flow_edges", f"WITH {EDGES_CTE} SELECT * FROM edges")
def flow_edges(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    return as_text(ops.edges_between(_edges(packets), ops.ip_nodes(packets)), "src", "dst")


@query(
    "edges_internal",
    f"""WITH {EDGES_CTE}, nodes AS (SELECT {sql_ip('a')} AS address FROM (SELECT src_ip a FROM packets UNION SELECT dst_ip FROM packets)
      WHERE {SCOPE_SQL} = 'internal')
    SELECT {EDGE_KEY_SQL} FROM edges WHERE src IN (SELECT address FROM nodes) AND dst IN (SELECT address FROM nodes)""",
)
def edges_internal(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    internal = ops.ip_nodes(packets).filter("type = 'internal'")
    kept = ops.edges_between(_edges(packets), internal).select(*ops.EDGE_KEY)
    return as_text(kept, "src", "dst")


@query(
    "edge_update",
    f"""WITH {TWO_GRAPHS} SELECT e.* FROM edges e SEMI JOIN old_edges USING ({EDGE_KEY_SQL})""",
)
def edge_update(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    return as_text(ops.update_edges(_edges(_first_half(packets)), _edges(packets)), "src", "dst")


@query("edge_upsert", f"WITH {EDGES_CTE} SELECT * FROM edges")
def edge_upsert(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    return as_text(ops.push_edges(_edges(_first_half(packets)), _edges(packets), "upsert"), "src", "dst")


@query("edge_append", f"WITH {TWO_GRAPHS} SELECT * FROM edges UNION ALL SELECT * FROM old_edges")
def edge_append(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    return as_text(ops.push_edges(_edges(_first_half(packets)), _edges(packets), "append"), "src", "dst")


@query("edge_merge", f"WITH {TWO_GRAPHS} SELECT * FROM edges UNION SELECT * FROM old_edges")
def edge_merge(spark, sf_dir):
    packets = synth_packets(spark, sf_dir)
    return as_text(ops.merge_edges(_edges(_first_half(packets)), _edges(packets)), "src", "dst")


CONTROLS_CTE = """controls AS (SELECT DISTINCT s_name AS name, 167772160 + s_suppkey % 150 AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE s_suppkey % 10 <> 0)"""


@query("device_controls", f"WITH {CONTROLS_CTE} SELECT name, {sql_ip('a')} AS address, {SCOPE_SQL} AS type FROM controls")
def device_controls(spark, sf_dir):
    return as_text(ops.device_controls(synth_devices(spark, sf_dir)), "address")


@query(
    "device_nodes",
    "SELECT DISTINCT s_name AS name, n_name AS roles FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0",
)
def device_nodes(spark, sf_dir):
    return ops.device_nodes(synth_devices(spark, sf_dir)).withColumn("roles", F.array_join("roles", ","))


@query(
    "device_bad_addresses",
    "SELECT s_name AS name, '10.0.0.999' AS address_text FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 = 0",
)
def device_bad_addresses(spark, sf_dir):
    return ops.invalid_device_addresses(synth_devices(spark, sf_dir))


@query(
    "flows_by_device",
    f"""WITH {FLOWS_CTE}, {CONTROLS_CTE} SELECT {FLOW_TEXT}, l.name AS device_lo, h.name AS device_hi,
    fwd_packet_count + bwd_packet_count AS packets
    FROM flows LEFT JOIN controls l ON ip_lo = l.a LEFT JOIN controls h ON ip_hi = h.a""",
)
def flows_by_device(spark, sf_dir):
    flows = flow_stats(synth_packets(spark, sf_dir))
    named = ops.flows_by_device(flows, ops.device_controls(synth_devices(spark, sf_dir)))
    packets = (F.col("fwd_packet_count") + F.col("bwd_packet_count")).alias("packets")
    return as_text(named.select(*FLOW_COLUMNS.split(", "), "device_lo", "device_hi", packets), "ip_lo", "ip_hi")


@query("flows_by_device_sets", REGISTRY["flows_by_device"][1])
def flows_by_device_sets(spark, sf_dir):
    """The rows of ``flows_by_device``, from flows that carry numbers of device sets."""
    addresses, sets = ops.device_sets(ops.device_controls(synth_devices(spark, sf_dir)))
    flows = ops.with_device_sets(flow_stats(synth_packets(spark, sf_dir)), addresses)
    packets = (F.col("fwd_packet_count") + F.col("bwd_packet_count")).alias("packets")
    named = ops.expand_device_sets(flows, sets)
    return as_text(named.select(*FLOW_COLUMNS.split(", "), "device_lo", "device_hi", packets), "ip_lo", "ip_hi")


@query(
    "device_traffic",
    f"""WITH {FLOWS_CTE}, {CONTROLS_CTE}, ends AS (SELECT 'lo' AS "end", ip_lo AS ip, * FROM flows UNION ALL SELECT 'hi', ip_hi, * FROM flows)
    SELECT name, "end", count(*) AS flows, CAST(sum(fwd_packet_count + bwd_packet_count) AS BIGINT) AS packets,
      CAST(sum(fwd_byte_count + bwd_byte_count) AS BIGINT) AS bytes FROM ends JOIN controls ON ip = a GROUP BY 1, 2""",
)
def device_traffic(spark, sf_dir):
    addresses, sets = ops.device_sets(ops.device_controls(synth_devices(spark, sf_dir)))
    return ops.device_traffic(ops.with_device_sets(flow_stats(synth_packets(spark, sf_dir)), addresses), sets)


@query(
    "person_nodes",
    "SELECT c_custkey AS id, 'Person_' || c_custkey AS name, c_custkey + 20 AS age, c_custkey % 2 = 0 AS active FROM customer",
)
def person_nodes(spark, sf_dir):
    return ops.person_nodes(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")))


@query("next_edges", "SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def next_edges(spark, sf_dir):
    return ops.next_edges(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")))


@query(
    "optional_neighbours",
    """SELECT a.c_custkey AS id, 'Person_' || a.c_custkey AS name, b.c_custkey AS dst, 'Person_' || b.c_custkey AS neighbour
    FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1 ORDER BY a.c_custkey LIMIT 20""",
)
def optional_neighbours(spark, sf_dir):
    nodes = person_nodes(spark, sf_dir)
    return ops.neighbours(nodes, ops.next_edges(nodes), "id")


@query(
    "dns_retransmit",
    """WITH q AS (SELECT event_id AS packet_no, event_type || '.' || (user_id % 2) AS qry_name, epoch_us(ts) AS t FROM events),
    d AS (SELECT *, t - lag(t) OVER (PARTITION BY qry_name ORDER BY t, packet_no) AS since FROM q)
    SELECT packet_no, qry_name, coalesce(since > 0 AND since <= 60000000, false) AS dns_retransmit,
      CASE WHEN since > 0 AND since <= 60000000 THEN since END AS dns_retransmit_request_in FROM d""",
)
def dns_retransmit(spark, sf_dir):
    flagged = flag_retransmissions(dns_queries(spark, sf_dir))
    return flagged.select("packet_no", "qry_name", "dns_retransmit", "dns_retransmit_request_in")
