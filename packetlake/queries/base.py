"""Registry of queries and the SQL shared by their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.fixtures import SERVERS
from packetlake.functions.net import ip_text

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = (function, sql)
        return function

    return register


def as_text(rows: DataFrame, *columns: str) -> DataFrame:
    """Shows BINARY address columns as text."""
    return rows.withColumns({c: ip_text(F.col(c)) for c in columns})


def sql_ip(value: str) -> str:
    return f"(({value} >> 24) & 255) || '.' || (({value} >> 16) & 255) || '.' || (({value} >> 8) & 255) || '.' || ({value} & 255)"


def sql_hash(seed: int, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def _server_case(part: int) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {values[part]}" for name, values in SERVERS.items())
    return f"CASE event_type {whens} END"


PACKETS_CTE = f"""
sides AS (
  SELECT event_id AS packet_no, epoch_us(ts) AS ts_us, event_type, user_id, props,
         167772160 + user_id AS a_ip, {_server_case(0)} AS b_ip,
         CASE WHEN event_id % 97 = 0 THEN 60000 + event_id % 1000 ELSE 50000 + user_id END AS a_port,
         {_server_case(1)} AS b_port, event_id % 2 = 0 AS to_server,
         54 + length(props) + CAST(floor(value) AS BIGINT) AS size
  FROM events),
packets AS (
  SELECT packet_no, ts_us, event_type, user_id, props, size,
         CASE WHEN to_server THEN a_ip ELSE b_ip END AS src_ip,
         CASE WHEN to_server THEN b_ip ELSE a_ip END AS dst_ip,
         CASE WHEN to_server THEN a_port ELSE b_port END AS src_port,
         CASE WHEN to_server THEN b_port ELSE a_port END AS dst_port,
         CASE WHEN event_type = 'signup' THEN 'UDP' ELSE 'TCP' END AS protocol
  FROM sides),
keyed AS (
  SELECT *, CASE WHEN is_fwd THEN src_ip ELSE dst_ip END AS ip_lo,
            CASE WHEN is_fwd THEN dst_ip ELSE src_ip END AS ip_hi,
            CASE WHEN is_fwd THEN src_port ELSE dst_port END AS port_lo,
            CASE WHEN is_fwd THEN dst_port ELSE src_port END AS port_hi
  FROM (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port < dst_port) AS is_fwd FROM packets))
"""

FLOW_COLUMNS = "ip_lo, ip_hi, port_lo, port_hi, protocol"
FLOW_TEXT = f"{sql_ip('ip_lo')} AS ip_lo, {sql_ip('ip_hi')} AS ip_hi, port_lo, port_hi, protocol"

STATS_SQL = """
  count(*) FILTER (WHERE is_fwd) AS fwd_packet_count,
  count(*) FILTER (WHERE NOT is_fwd) AS bwd_packet_count,
  CAST(coalesce(sum(size) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fwd_byte_count,
  CAST(coalesce(sum(size) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bwd_byte_count,
  arg_min(ts_us, packet_no) AS first_seen_us, arg_max(ts_us, packet_no) AS last_seen_us,
  min(size) AS min_packet_size, max(size) AS max_packet_size,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS total, arg_min(size, packet_no) AS first_size
"""

DERIVED_SQL = """
  fwd_packet_count, bwd_packet_count, fwd_byte_count, bwd_byte_count, first_seen_us, last_seen_us,
  greatest(last_seen_us - first_seen_us, 0) AS duration_us, last_seen_us < first_seen_us AS clock_went_back,
  min_packet_size, max_packet_size, CAST(total AS DOUBLE) / n AS avg_packet_size,
  CASE WHEN last_seen_us - first_seen_us >= 1000000 THEN n * 1e6 / (last_seen_us - first_seen_us) ELSE 1.0 END AS avg_pps,
  CASE WHEN last_seen_us - first_seen_us >= 1000000 THEN total * 1e6 / (last_seen_us - first_seen_us)
       ELSE CAST(first_size AS DOUBLE) END AS avg_bps
"""

FLOWS_CTE = f"""{PACKETS_CTE},
grouped AS (SELECT {FLOW_COLUMNS}, {STATS_SQL} FROM keyed GROUP BY {FLOW_COLUMNS}),
flows AS (SELECT {FLOW_COLUMNS}, {DERIVED_SQL} FROM grouped)
"""
