"""Repeated DNS queries over decoded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.operators.ordered import DEFAULT_WIDTH, SEGMENT, balanced, previous_value

QUERY_KEY = ["qry_name", "qry_type", "qry_class"]
WINDOW_US = 60_000_000
STATE_AGE_US = 300_000_000
FLAGS = ["dns_retransmit", "dns_retransmit_request_in"]


def dns_queries(packets: DataFrame) -> DataFrame:
    """Readable questions of decoded packets."""
    return packets.filter("dns.rfc_compatible").select("packet_no", "ts", "src_ip", *[f"dns.{c}" for c in QUERY_KEY])


def _flags(since: Column, window_us: int) -> dict[str, Column]:
    repeated = F.coalesce((since > 0) & (since <= window_us), F.lit(False))
    return dict(zip(FLAGS, (repeated, F.when(repeated, since))))


def _with_last(queries: DataFrame, target: int) -> DataFrame:
    """Adds ``__last``, when the same query was asked before. A popular name is cut at equal
    counts along time, and each cut inherits one row, so its queries never meet in one task."""
    cut = balanced(queries, QUERY_KEY, "ts_us", target)
    return previous_value(cut, QUERY_KEY, ["ts_us", "packet_no"], F.col(SEGMENT), "ts_us", "__last", F.max("ts_us"))


def flag_retransmissions(queries: DataFrame, window_us: int = WINDOW_US, target: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``dns_retransmit`` and the microseconds since the same query was last asked.

    A repeat counts within the window but not at the very same time. ``target``
    is the number of rows of one query above which it is cut.
    """
    linked = _with_last(queries.withColumn("ts_us", F.unix_micros("ts")), target)
    return linked.withColumns(_flags(F.col("ts_us") - F.col("__last"), window_us)).select(*queries.columns, *FLAGS)


def with_retransmissions(packets: DataFrame, window_us: int = WINDOW_US, target: int = DEFAULT_WIDTH) -> DataFrame:
    """Decoded packets with both columns of ``flag_retransmissions``; NULL where no question was read.

    Each question is matched to the last one before it as an as-of join does.
    Only packets with a readable question are shuffled; all others pass as they
    are. Of one instant, the lower packet number comes first.
    """
    asks = F.coalesce("dns.rfc_compatible", F.lit(False))
    names = {c: F.col(f"dns.{c}") for c in QUERY_KEY}
    linked = _with_last(packets.filter(asks).withColumns({**names, "ts_us": F.unix_micros("ts")}), target)
    flagged = linked.withColumns(_flags(F.col("ts_us") - F.col("__last"), window_us)).select(*packets.columns, *FLAGS)
    none = dict(zip(FLAGS, (F.lit(None).cast("boolean"), F.lit(None).cast("long"))))
    return flagged.unionByName(packets.filter(~asks).withColumns(none))
